"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .secrets import BASE, RULES


def secret_scan_sql() -> str:
    """The scan by plain search: each rule's matches, placed by the texts between them."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, r in enumerate(RULES):
        found, gaps = f"regexp_extract_all(body, {q(r.pattern)})", f"regexp_split_to_array(body, {q(r.pattern)})"
        kept = f"regexp_extract_all(body, {q(r.pattern)}, {r.group})"
        parts.append(
            f"SELECT row_no, {n} AS rule, {q(r.kind)} AS kind, start, start + long AS stop FROM ("
            f"SELECT row_no, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start, length(found[i]) AS long, length(kept[i]) AS kept_long "
            f"FROM (SELECT row_no, found, gaps, kept, unnest(range(1, len(found) + 1)) AS i FROM (SELECT row_no, {found} AS found, {gaps} AS gaps, {kept} AS kept FROM d))) WHERE kept_long >= {r.least}"
        )
    spans = " UNION ALL ".join(parts)
    text = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rule)"
    counts = ", ".join(f"count(s.rule) FILTER (s.rule = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))
    return (
        f"WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents), s AS ({spans}) "
        f"SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256(coalesce({text} FILTER (s.rule < {len(BASE)}), '')) AS base_sha256, coalesce({text} FILTER (s.rule IS NOT NULL), '') AS spans "
        f"FROM d LEFT JOIN s USING (row_no) GROUP BY row_no"
    )


#: CRC-32 by its table of 256 steps, one byte of every different feature a round.
_IMPORTANCE = r"""
WITH RECURSIVE bits(byte, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, @words@ AS w FROM documents),
aimed AS (SELECT @words@ AS w FROM benchmark),
runs AS (
  SELECT r, @runs@ AS f FROM texts),
aimed_runs AS (
  SELECT @runs@ AS f FROM aimed),
features AS (SELECT f, row_number() OVER () AS id, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM aimed_runs)),
steps(id, h, c) AS (
  SELECT id, h, 4294967295::BIGINT FROM features
  UNION ALL SELECT id, h[3:], xor(c >> 8, steps[(xor(c, 16 * instr('0123456789ABCDEF', h[1]) + instr('0123456789ABCDEF', h[2]) - 17) & 255) + 1]) FROM steps, crc WHERE h <> ''),
hashed AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM features JOIN steps USING (id) WHERE steps.h = ''),
held AS (SELECT r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM held GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM aimed_runs JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gain USING (bucket) GROUP BY ALL),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r)),
placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * eligible // 100 THEN place END AS rank FROM placed
"""


def importance_sql() -> str:
    """The draw, with each feature's hash worked out byte by byte."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "unnest(flatten(list_transform(range(1, 4), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' ')))))"
    return _IMPORTANCE.replace("@words@", words).replace("@runs@", runs)


_WHOLE = """
SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


def hard_negatives_sql() -> str:
    """All pairs of anchors and rows, ranked."""
    return f"""
WITH v AS (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM ({_WHOLE.format(factor=256)}) WHERE label IS NOT NULL),
met AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
positives AS (SELECT r, anchor_id, other, vec_id, score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.vec_id, n.other) AS rank
  FROM positives p JOIN met n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def top_k_sql() -> str:
    """All pairs of queries and rows, ranked."""
    return f"""
WITH v AS ({_WHOLE.format(factor=64)}),
met AS (SELECT a.r, a.vec_id AS query_id, b.r AS other, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM met)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM placed WHERE rank <= 20
"""
