"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Word rule of benchmark texts once A-Z are lower-cased, and of sizes.
_PLAIN = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS text_key,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
-- In order of stop / weight the stopped sources come first; k of them are stopped.
o AS (
  SELECT *, row_number() OVER (ORDER BY size::DOUBLE / w, source NULLS LAST) AS k FROM s),
c AS (
  SELECT *, (sum(size) OVER ()
             - coalesce(sum(3 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            )::BIGINT AS rest,
         (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share
  FROM o),
f AS (
  SELECT k, rest, share FROM c WHERE 3 * size::HUGEINT * share >= w::HUGEINT * rest
  ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, o.size AS source_size,
         CASE WHEN o.k < f.k THEN (3 * o.size)::DOUBLE
              ELSE f.rest::DOUBLE * o.w::DOUBLE / f.share::DOUBLE END AS target
  FROM o, f),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         (sum(d.size) OVER (
            PARTITION BY d.source
            ORDER BY md5(concat_ws('/', 'mix-1', d.doc_id::VARCHAR, d.text_key)), d.doc_id, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size
        + least(greatest(floor(target)::BIGINT - epochs * source_size - start, 0), size))::BIGINT AS taken
FROM r
"""

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_PLAIN}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_PLAIN}') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (
  SELECT r, i, l, list_slice(w, i, i + l - 1) AS win
  FROM d, (SELECT DISTINCT l FROM bw), unnest(range(1, len(w) - l + 2)) t(i) WHERE len(w) >= l),
occ AS (SELECT r, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
hit AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM occ)) GROUP BY r),
it AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
       coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r
"""

# Line rules: end marks, shouting, bars of links, symbols, boilerplate, navigation.
_BOILERPLATE = (
    "all rights reserved|licensed under|released under the|under the terms of"
    "|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript"
    "|general public license|sign up for our newsletter|powered by"
)
_NAVIGATION = (
    "^(home|menu|login|log in|sign in|register|next|previous|back to top|skip to content"
    "|share|search)\\b"
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FAILS = f"""(
  (position(right(rtrim(l, {_BLANKS}), 1) IN '.!?:;…。！？"'')]}}”’»') = 0
   AND position('. ' IN l) + position('? ' IN l) + position('! ' IN l) = 0)
  OR (length(l) - length(replace(l, '!!', ''))) / 2 * 4 >= length(l) - length(replace(l, ' ', '')) + 1
  OR (length(l) - length(replace(l, ' | ', ''))) / 3 * 4 >= length(l) - length(replace(l, ' ', '')) + 1
  OR (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) * 10 >= length(l)
  OR (len(regexp_extract_all(lower(l), '{_BOILERPLATE}'))
      + regexp_matches(lower(l), '{_NAVIGATION}')::INT) * 200 >= length(l))"""

RULES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents),
ln AS (
  SELECT r, i, l, {_FAILS} AS fails
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i
        FROM d)
  WHERE regexp_matches(l, '{_WORD}')),
ls AS (
  SELECT r, count(*) - count(DISTINCT l) AS dups, count(*) FILTER (fails) AS removed,
         coalesce(sum(len(regexp_extract_all(l, '{_WORD}'))) FILTER (NOT fails), 0) AS words_left
  FROM ln GROUP BY r),
runs AS (
  SELECT r, i, list_slice(w, i, i + 4) AS run FROM d, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
again AS (SELECT r, run FROM runs GROUP BY r, run HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT runs.r, unnest(range(i, i + 5)) AS p FROM runs JOIN again
        ON runs.r = again.r AND runs.run = again.run) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed, 0)::BIGINT AS lines_removed, coalesce(words_left, 0)::BIGINT AS words_left
  FROM d LEFT JOIN ls ON d.r = ls.r LEFT JOIN rep ON d.r = rep.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT 100 * (n_words - words_left) > 60 * n_words AS kept
FROM f
"""

_CHUNK = "('0x' || sha1(h)[5 * k + 1:5 * k + 5])::BIGINT"
_SIGNS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
         array_to_string([array_to_string([{_SIGNS}[(({_CHUNK} >> s) & 31) + 1] FOR s IN [15, 10, 5, 0]], '')
                          FOR k IN range(8)], '') AS payload_digest
  FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""


def _smoothing() -> str:
    """One step per order: counts of the symbol after its context lean on the order below."""
    steps = []
    for k in range(4):
        columns = []
        for c in "ab":
            own = f"sum({c}) OVER (PARTITION BY substr(gram, {4 - k}, {k + 1}))"
            all_of = f"sum({c}) OVER (PARTITION BY substr(gram, {4 - k}, {k}))"
            columns.append(f"({own} + 2.0::DOUBLE * p{c}) / ({all_of} + 2.0::DOUBLE) AS p{c}")
        steps.append(f"g{k + 1} AS (SELECT gram, a, b, {', '.join(columns)} FROM g{k})")
    return ",\n".join(steps)


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


URLS = f"""
WITH u AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
n AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rl AS (
  SELECT *, CASE
    WHEN {_fits("www.example.com", "/en/")} THEN 'www.example.com/en/'
    WHEN {_fits("example.com", "/en/")} THEN 'example.com/en/'
    WHEN {_fits("net", "/es/")} THEN 'net/es/'
    WHEN {_fits("net", "/fr/")} THEN 'net/fr/'
    WHEN {_fits("com", "/")} THEN 'com/' END AS rule,
    translate(host || path, {_LOWER}) AS s FROM n),
sy AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                 WHEN rule IS NOT NULL THEN 'block' END AS says, substr(md5(s), 1, 1) < '3' AS held FROM rl),
ad AS (
  SELECT s, count(*) FILTER (says = 'allow' AND NOT held) AS na,
         count(*) FILTER (says = 'block' AND NOT held) AS nb,
         count(*) FILTER (says = 'allow' AND held) AS ha,
         count(*) FILTER (says = 'block' AND held) AS hb
  FROM sy GROUP BY s),
gr AS (
  SELECT s, na, nb, substr(repeat(chr(2), 3) || s || chr(3), i, 4) AS gram
  FROM ad, unnest(range(1, length(s) + 2)) t(i)),
ab AS (SELECT 1.0::DOUBLE / count(DISTINCT substr(gram, 4, 1))::DOUBLE AS p FROM gr),
g0 AS (
  SELECT gram, sum(na) AS a, sum(nb) AS b, any_value(p) AS pa, any_value(p) AS pb
  FROM gr, ab GROUP BY gram),
{_smoothing()},
ra AS (SELECT gram, round((ln(pa) - ln(pb)) * 1e9::DOUBLE)::BIGINT AS ratio FROM g4),
sc AS (
  SELECT s, sum(ratio)::BIGINT::DOUBLE / count(*)::DOUBLE / 1e9::DOUBLE AS score
  FROM gr JOIN ra ON gr.gram = ra.gram GROUP BY s),
st AS (
  SELECT greatest(least(floor(score / 0.01::DOUBLE), 1000), -1000)::BIGINT AS step,
         sum(ha)::BIGINT AS a, sum(hb)::BIGINT AS b
  FROM sc JOIN ad ON sc.s = ad.s WHERE ha + hb > 0 GROUP BY 1),
tot AS (SELECT coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b FROM st),
pl AS (SELECT step AS place FROM st UNION SELECT 0 UNION SELECT 1001),
er AS (
  SELECT place, coalesce((SELECT sum(a) FROM st WHERE step < place), 0) * tot.b
              + coalesce((SELECT sum(b) FROM st WHERE step >= place), 0) * tot.a AS error
  FROM pl, tot),
cu AS (
  SELECT CASE WHEN tot.a = 0 OR tot.b = 0 THEN 0.0::DOUBLE
              ELSE (SELECT place FROM er ORDER BY error, abs(place), place LIMIT 1) * 0.01::DOUBLE END AS cut
  FROM tot)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM sy JOIN sc ON sy.s = sc.s, cu
"""

# The unsigned crc32 of the decimal id, by the reflected polynomial 0xEDB88320.
PREFIX_TRIE = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                          lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
src AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY p) AS m FROM src GROUP BY c),
h AS (
  SELECT c, m,
         xor(list_reduce(list_concat([4294967295]::BIGINT[],
                                     list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h
  FROM l, tab),
r AS (
  SELECT a.c, list_concat(coalesce(b.m[1:a.h], []), a.m[a.h + 1:]) AS m
  FROM h a LEFT JOIN l b ON b.c = a.c - a.c % 5),
n AS (
  SELECT m[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(m) = d), '') AS ends
  FROM r, unnest(range(0, len(m) + 1)) t(d) GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(ch.n, 0) AS n_children, p.conv_id AS parent_conv_id,
         CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.k[n.d].x) END AS own
  FROM n
  LEFT JOIN (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL) ch
    ON ch.k = n.k AND ch.d = n.d
  LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
s AS (
  SELECT k[1:e] AS k, e AS d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved
  FROM w, unnest(range(0, d + 1)) t(e) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
       s.saved AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.k = w.k AND s.d = w.d
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT DISTINCT vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, a.v AS av, a.label = e.label AS same, e.id, 
         coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM e a, e WHERE a.id % 100 = 0 AND e.id <> a.id),
p AS (
  SELECT a, av, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a, av ORDER BY score DESC, id) <= 5)
SELECT p.a AS anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.a, p.av, p.id ORDER BY s.score DESC, s.id))::INT AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.av = p.av AND NOT s.same
 AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
