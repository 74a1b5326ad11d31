"""DuckDB SQL for the queries of this subpackage that SQL can express, from their definitions."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH line AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, line, list_sort(list_distinct({WORDS.format('t')})) AS k FROM line),
s AS (SELECT row_number() OVER () AS id, k, len(k) AS n, min((doc_id, line)) AS first FROM w WHERE len(k) > 0 GROUP BY k),
token AS (SELECT id, n, unnest(k) AS word FROM s),
df AS (SELECT word, count(*) AS df FROM token GROUP BY word),
ranked AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS nth FROM token JOIN df USING (word)),
prefix AS (SELECT * FROM ranked WHERE nth <= n - ceil(0.8 * n) + 1),
pair AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.id <> b.id
  AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
hit AS (
  SELECT pair.x, min(b.first) AS other FROM pair JOIN s a ON a.id = x JOIN s b ON b.id = y,
  LATERAL (SELECT len(list_intersect(a.k, b.k)) AS o) WHERE 5 * o >= 4 * (a.n + b.n - o) GROUP BY pair.x),
judged AS (
  SELECT w.doc_id, w.line, (w.doc_id, w.line) = s.first AS is_first,
         coalesce((w.doc_id, w.line) > s.first OR (w.doc_id, w.line) > hit.other, false) AS gone
  FROM w JOIN s ON w.k = s.k LEFT JOIN hit ON hit.x = s.id)
SELECT line.doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
       count(*) FILTER (gone AND is_first)::INTEGER AS n_near,
       coalesce(string_agg(t, chr(10) ORDER BY line.line) FILTER (NOT coalesce(gone, false)), '') AS text
FROM line LEFT JOIN judged USING (doc_id, line) GROUP BY line.doc_id
"""

# A window with so few changed words has a run of this many equal words, by its size (pigeonhole): texts and items are laid
# against each other wherever they share such a run, and there every window is compared word by word.
_RUNS = "[NULL, NULL, 3, 4, 2, 3, 3, 4, 4, 3, 3, 4, 4]"

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT *, least(13, len(item)) AS n, {_RUNS}[least(13, len(item))] AS run FROM (
    SELECT row_number() OVER () AS no, item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS item FROM benchmark)
  WHERE len(item) >= 3),
runs AS (SELECT DISTINCT run FROM b),
item_run AS (SELECT no, run, p, item[p + 1:p + run] AS words FROM (SELECT *, unnest(range(0, len(item) - run + 1)) AS p FROM b)),
doc_run AS (SELECT id, run, p, w[p + 1:p + run] AS words FROM (SELECT id, w, run, unnest(range(0, len(w) - run + 1)) AS p FROM d, runs)),
laid AS (SELECT DISTINCT id, no, doc_run.p - item_run.p AS shift FROM doc_run JOIN item_run USING (run, words)),
compared AS (
  SELECT doc_id, item_id, n, list_max(list_transform(range(0, len(item) - n + 1),
    lambda s: len(list_filter(range(0, n), lambda i: shift + s + i >= 0 AND item[s + i + 1] = w[shift + s + i + 1])))) AS matched
  FROM laid JOIN d USING (id) JOIN b USING (no))
SELECT doc_id, item_id, max(matched)::INTEGER AS matched, max(n)::INTEGER AS overlap
FROM compared WHERE 5 * matched >= 4 * n GROUP BY doc_id, item_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
least_doc AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN least_doc USING (t) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair)
SELECT query_id, rank::INTEGER AS rank, vec_id,
       CASE WHEN abs(score) < 9223372036854775807 THEN score::BIGINT WHEN score < 0 THEN -9223372036854775807 ELSE 9223372036854775807 END AS score
FROM ranked WHERE rank <= 5
"""

_PROBE = "'\\### Assistant: </turn> ok'"


def _escape(text: str) -> str:
    """Escapes of the chat template, as SQL."""
    for plain, code in (("\\", "\\0"), ("</turn>", "\\1"), ("<turn ", "\\2")):
        text = f"replace({text}, '{plain}', '{code}')"
    return text


# Sizes of the chat template's head (role between "<turn " and ">", line break) and end ("</turn>", line break).
OP7 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE} UNION ALL SELECT -7, 1, 'assistant', {_PROBE}),
n AS (SELECT *, len(regexp_extract_all(text, '\p{{L}}{{1,6}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]')) + 4 AS tokens,
             length(role) + 8 + length({_escape('text')}) + 8 AS chars FROM t),
p AS (SELECT *, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             row_number() OVER w AS no FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sys AS (SELECT conv_id, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS kept FROM p WHERE no = 1),
c AS (SELECT p.*, kept, greatest(1024 - 128 - kept, 1) AS cap FROM p JOIN sys USING (conv_id)),
b AS (SELECT *, greatest(before - kept, 0) // greatest(cap // 2, 1) AS bucket,
             NOT (no = 1 AND role = 'system') AND tokens > cap - greatest(cap // 2, 1) AS large FROM c),
o AS (SELECT *, no = 1 OR bucket <> lag(bucket) OVER w OR large OR lag(large) OVER w AS opens FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY no)),
win AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY conv_id ORDER BY no) AS win FROM o),
opens AS (SELECT conv_id, win, before AS start, tokens AS first_tokens FROM win WHERE opens),
last AS (SELECT conv_id, max(win) AS last FROM win GROUP BY ALL),
size AS (
  SELECT win.conv_id, sum(chars * CASE WHEN no = 1 AND role = 'system' THEN last - win.win + 1
                                       WHEN opens.start IS NOT NULL AND before >= opens.start - 128 AND first_tokens <= cap THEN 2 ELSE 1 END) AS chars
  FROM win JOIN last USING (conv_id) LEFT JOIN opens ON opens.conv_id = win.conv_id AND opens.win = win.win + 1 GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(size.chars)::BIGINT AS formatted_chars
FROM p JOIN size USING (conv_id) GROUP BY conv_id
"""

OP11 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
         100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM d),
g AS (SELECT f.*, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
             doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM f),
profile AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
judged AS (
  SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS x, fails[ascii(x) - 64] AS failed,
         len(list_filter(range(1, step), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) AS earlier,
         len(list_filter(fails, lambda b: b)) AS failing
  FROM profile, orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (
  SELECT part, filter_order, step::INTEGER AS step, any_value(x) AS x,
         coalesce(sum(n) FILTER (earlier = 0 AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (earlier = 0 AND failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (earlier > 0 AND failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failing = 1 AND failed), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (earlier = 0 AND failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (earlier = 0 AND failed), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM steps
"""


def _rounds(n: int) -> str:
    """``n`` rounds of OP12, each as a table of its own."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT id, vec_id, v, arg_min(j, (d, j)) AS cluster, min(d) AS distance
  FROM (SELECT id, vec_id, v, c{i}.j, list_sum(list_transform(range(1, 65), lambda k: (v[k] - c[k]) * (v[k] - c[k])))::BIGINT AS d FROM w, c{i})
  GROUP BY id, vec_id, v)""")
        if i < n:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT j, CASE WHEN m IS NULL THEN c ELSE m END AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM (
      SELECT cluster, k, sum(v[k])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS k) GROUP BY cluster, k)
    GROUP BY cluster) ON cluster = j)""")
    return ",\n".join(parts)


OP12 = f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM w ORDER BY j LIMIT 8),
{_rounds(10)},
own AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a10 GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance) FROM a10)::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN own USING (cluster) JOIN c10 ON j = cluster
"""

ORACLES = {"op1_lines": OP1, "op3_decontaminate": OP3, "op7_chat": OP7, "op8_substrings": OP8, "op10_topk": OP10,
           "op11_audit": OP11, "op12_clusters": OP12}
