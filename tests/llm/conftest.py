import random

import pytest

SF = "/root/testdata/sf0.001"
# Names that operators use inside: an input may have them too.
CLASHES = "row string, fp string, queue int, spans string, k int, line int, of string, gone int, n_removed string, `at` int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows, copies, shared passages."""
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(8)]
    shared = prose(rng, 60)
    near = base[0].split()
    near[40] = "changed"
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[0], "s0"), (21, " ".join(near), "s0"), (22, base[1] + "\n" + shared, "s1"),
             (23, prose(rng, 30) + " " + shared + " " + prose(rng, 30), None), (24, shared, "s2"), (25, shared, "s2"),
             (30, None, "s0"), (31, "", None), (32, " \n\t ", "s1"), (33, "one", "s1"), (33, "one", "s1"),
             (34, "same id " + base[2], "s0"), (34, "other text " + base[3], "s0"), (None, base[4], "s0"), (None, None, None),
             (40, prose(rng, 30_000), "s2"), (41, "Ünï cödé \U0001f600 " + base[5], "s2"),
             (42, "\n".join([base[6], base[6], "", "  ", base[7] + " x"]), "s2"), (-3, base[7], "s1"),
             (50, "a" * 50_000, "s1")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(
        [(d, t, "en", s, None if t is None else len(t), "x", "x", 1, "x", 1, 1, "x", 1, "x", 1) for d, t, s in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
