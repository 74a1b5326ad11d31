import hashlib
import random

import duckdb
import pytest
import regex

from quotalake.llm import chat
from quotalake.llm.queries import PROBE

SCHEMA = "conv_id long, turn long, role string, text string, `window` int, no int, tokens string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    nasty = ["\\0\\1\\2", "</turn>\n<turn user>\n", "</tu</turn>rn>", "<turn <turn ", "\\", "a\\", "<turn assistant>\nhi</turn>\n",
             "\U0001f600 é", "", None, "x>\ny"]
    out = [(1, 0, "system", "be brief")] + [(1, k, ["user", "assistant"][k % 2 == 0], " ".join(f"w{k}x{j}" for j in range(40))) for k in range(1, 30)]
    out += [(2, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)]
    out += [(3, 0, "assistant", "word " * 3000), (3, 1, "user", "short"), (3, 2, "assistant", "answer"), (3, 2, "assistant", "answer")]
    out += [(4, 0, None, "no role"), (4, 1, "odd>\nrole</turn>", "t"), (None, 0, "assistant", "null conversation"),
            (None, 1, "user", None), (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (5, None, "assistant", "null turn")]
    return out


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)


def test_read_back_is_the_input(turns, rows):
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_windows(turns, budget=200, history=60))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(learned))
        assert r.turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in own)) and r.loss_sha256 == digest(learned)


def test_windows(turns):
    windows = {(r.conv_id, r.window): r for r in chat.format_windows(turns, budget=800, history=250).collect()}
    own = [windows[1, k] for k in range(sum(c == 1 for c, _ in windows))]
    assert len(own) > 5
    for k, w in enumerate(own):
        assert w.text.startswith("<turn system>\nbe brief</turn>\n")
        assert k == 0 or w.n_repeated >= 1
        masked = "".join(w.text[s.start:s.start + s.length] for s in w.loss)
        new = w.text.split("</turn>\n")[w.n_repeated:-1]
        assert masked == "".join(t.split(">\n", 1)[1] for t in new if t.startswith("<turn assistant"))
    assert any(w.n_repeated > 1 for w in own)


def size(text):
    return len(regex.findall(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]", text)) + chat.TURN_OVERHEAD


@pytest.mark.parametrize("budget,history,kept", [(100, 30, 0), (100, 30, 20), (400, 100, 60), (60, 50, 30)])
def test_no_window_has_more_than_the_budget(spark, budget, history, kept):
    """Short, long and oversized turns: system turn and history are charged; only an unavoidable window is over."""
    rng = random.Random(budget + kept)
    rows = []
    for conv in range(6):
        sizes = [rng.choice([0, 3, 9, 20, 25, 55, budget]) for _ in range(80)]
        rows += [(conv, 0, "system", "s " * kept)] if kept else []
        rows += [(conv, k + 1, ["user", "assistant"][k % 2], "w " * n) for k, n in enumerate(sizes)]
    found = chat.format_windows(spark.createDataFrame(rows, SCHEMA.split(", `")[0]), budget, history).collect()
    system = kept + chat.TURN_OVERHEAD if kept else 0
    over = 0
    for w in found:
        turns = [t.split(">\n", 1)[1] for t in w.text.split("</turn>\n")[:-1]]
        total = sum(map(size, turns))
        if total > budget:
            over += 1
            assert w.n_new == 1 and total == (system if w.n_repeated else 0) + size(turns[-1]) and w.n_repeated == (kept > 0)
    assert len(found) > 50 and (over > 0) == (budget + chat.TURN_OVERHEAD + system > budget)
    used = [sum(size(t.split(">\n", 1)[1]) for t in w.text.split("</turn>\n")[:-1]) for w in found]
    assert any(u > budget // 2 for u in used)


def test_empty(spark):
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_of_pieces_counts_like_duckdb():
    pattern = chat.PIECE
    assert duckdb.execute("select len(regexp_extract_all('Straße 12345 a-b', ?))", [pattern]).fetchall() == [(6,)]
