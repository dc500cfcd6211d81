"""DuckDB SQL of the queries that SQL can express. The others (robust distances, prefix-free parsing, the random field,
merges of a vocabulary, an approximate search) are tested against brute force instead."""

from __future__ import annotations

from . import lm_scores, mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def lm_sql(digits: int = 4, mean_digits: int = 6) -> str:
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, r, unnest(w) AS w3, unnest(range(len(w))) AS i FROM d),
g AS (SELECT *, lag(w3) OVER p AS w2, lag(w3, 2) OVER p AS w1 FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *,
  count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY r, w3) AS c3,
  count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY r, w2, w3) AS c23,
  count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY r, w1, w2, w3) AS c123,
  count(*) OVER () - count(*) OVER (PARTITION BY r) AS rest FROM g),
x AS (SELECT *, lag(c3) OVER p AS c2, lag(c23) OVER p AS c12 FROM c WINDOW p AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, CASE WHEN i >= 2 AND c123 > 0 THEN ln(c123::DOUBLE / c12)
  WHEN i >= 1 AND c23 > 0 THEN ln(c23::DOUBLE / c2) + CASE WHEN i >= 2 THEN ln({lm_scores.BACKOFF}) ELSE 0 END
  ELSE CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / rest) ELSE -ln(2.0 * rest + 2) END + least(i, 2) * ln({lm_scores.BACKOFF}) END AS s FROM x)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0.0), {digits}) AS score, round(score / len(w), {mean_digits}) AS mean_score
FROM d LEFT JOIN (SELECT r, sum(s) AS score FROM s GROUP BY r) USING (r)"""


def url_sql(rules: dict[str, str], listed: tuple[str, ...]) -> str:
    parts = "CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    fits = [f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{p}') THEN '{n}/{p}'" for n, _, p in (r.partition("/") for r in sorted(rules, key=len, reverse=True))]
    says = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules.items())
    hosts = ", ".join(f"'{h}'" for h in listed)
    low = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT page_id, host, path, rule, CASE {says} WHEN host IN ({hosts}) THEN 'block' ELSE 'allow' END AS verdict FROM (
SELECT *, CASE {' '.join(fits)} END AS rule FROM (SELECT page_id, {low} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {parts} AS rest FROM pages)))"""


def mixing_sql(cap: int = mixing.MOST_EPOCHS) -> str:
    return f"""WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight,
  -ln((('0x' || substr(md5('mix' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight AS energy FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce({cap} * sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, {cap} * source_size::DOUBLE / w AS ratio, row_number() OVER (ORDER BY {cap} * source_size::DOUBLE / w, source IS NULL, source) AS n
  FROM s WINDOW b AS (ORDER BY {cap} * source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(n) AS n, arg_min(level, n) AS level FROM l WHERE level <= ratio),
p AS (SELECT l.source, l.source_size, CASE WHEN l.n >= f.n THEN f.level * l.w ELSE {cap}::DOUBLE * l.source_size END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
o AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.energy, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND epochs < {cap} AND (upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM o"""


def jaccard_sql(percent: int = 70) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
reach AS (SELECT a AS doc_id, a AS root FROM near UNION SELECT near.b, root FROM reach JOIN near ON near.a = reach.doc_id WHERE root < near.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_similar, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM near GROUP BY a) USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""


def sharding_sql(limit: int) -> str:
    return f"""WITH k AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, array_to_string(list_transform(range(1, 17), lambda i: bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), i, 1))::INT + 16)[2:]), '') AS bits FROM documents),
p AS (SELECT k.*, depth, left(bits, depth) AS shard, sum(n_bytes) OVER (PARTITION BY depth, left(bits, depth)) AS shard_bytes FROM k, (SELECT unnest(range(65)) AS depth)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bits, n_bytes ORDER BY depth) AS r FROM p WHERE shard_bytes <= {limit} OR depth = 64)
SELECT doc_id, n_bytes, shard, depth, shard_bytes::BIGINT AS shard_bytes, shard_bytes <= {limit} AS fits FROM b WHERE r = 1"""
