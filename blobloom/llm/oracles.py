"""DuckDB SQL for the contract queries that SQL can express.

Fingerprints (XXH64), trained models and BPE tokenizers have no SQL form here;
their queries are tested against brute force or held-out rows.
"""

from __future__ import annotations

from . import decontam, line_dedup, mixing, sharding, substring_dedup
from .common import UPPER

WORD = r"[^\x20\x09-\x0D]+"
LOWER = f"'{UPPER}', '{UPPER.lower()}'"


def mixing_sql() -> str:
    w = ", ".join(f"{x}.0" for x in mixing.WEIGHTS)
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [{w}][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w,
         (source_size * {mixing.MAX_EPOCHS})::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * {mixing.BUDGET}::DOUBLE AS total,
         sum(cap) OVER run - cap AS cap_before, sum(w) OVER () - sum(w) OVER run + w AS w_left
  FROM w WINDOW run AS (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (
  SELECT (total - cap_before) / w_left AS share FROM l WHERE (total - cap_before) * w <= cap * w_left
  ORDER BY cap / w LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT share FROM f) * w), cap) AS target FROM l),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS b
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((whole + CASE WHEN need > 0 AND b + size / 2 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c"""


def contamination_sql() -> str:
    word = decontam.NOT_WORD.replace("[", "[^", 1)
    k = decontam.WINDOW
    return rf"""
WITH i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, {LOWER}), '{word}') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), {k}) AS n, unnest(range(1, len(w) - least(len(w), {k}) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, {LOWER}), '{word}'), []) AS w FROM documents),
dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {decontam.MIN_ITEMS} AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)"""


def substring_sql() -> str:
    return rf"""
WITH p AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(\n|[.!?][ \t])', '\1' || chr(30), 'g'),
           '([ \t])(\p{{Lu}})', '\1' || chr(30) || '\2', 'g'), chr(30)) AS pieces
  FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM p),
c AS (
  SELECT doc_id, k, length(piece) AS len, regexp_extract_all(translate(piece, {LOWER}), '{WORD}') AS w,
         (sum(length(piece)) OVER e)::BIGINT AS stop, (sum(len(regexp_extract_all(piece, '{WORD}'))) OVER e)::BIGINT AS last,
         coalesce(sum((suffix(piece, chr(10)))::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM o WINDOW e AS (PARTITION BY doc_id ORDER BY k)),
l AS (
  SELECT doc_id, line, min(stop - len) AS start, max(stop) AS stop, min(last - len(w)) AS first, max(last) AS last,
         count(*) FILTER (len(w) > 0) AS pieces, string_agg(array_to_string(w, ' '), ' ' ORDER BY k) FILTER (len(w) > 0) AS norm
  FROM c GROUP BY doc_id, line),
u AS (
  SELECT doc_id, start, stop, first, last, last - first >= {substring_dedup.LINE_WORDS} AS line, norm FROM l WHERE pieces > 0
  UNION ALL
  SELECT c.doc_id, c.stop - len, c.stop, c.last - len(w), c.last, false, array_to_string(w, ' ')
  FROM c JOIN l ON c.doc_id = l.doc_id AND c.line = l.line WHERE l.pieces > 1 AND len(w) > 0),
a AS (
  SELECT *, first_value(doc_id) OVER e AS kept, row_number() OVER e AS nth
  FROM u WINDOW e AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, first, last)),
n AS (
  SELECT *, coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < first, true) AS new
  FROM a WHERE nth > 1),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (
  SELECT doc_id, run, min(start) AS start, max(stop) AS stop, max(last) - min(first) AS n_words,
         arg_min(kept, {{'n': first - last, 'f': first, 'l': last}}) AS kept
  FROM r GROUP BY doc_id, run)
SELECT doc_id, start::INT AS start, stop::INT AS stop, n_words::BIGINT AS n_words, kept AS kept_doc_id FROM g WHERE n_words >= {substring_dedup.MIN_WORDS}
UNION ALL
SELECT r.doc_id, r.start::INT, r.stop::INT, (last - first)::BIGINT, r.kept
FROM r JOIN g ON r.doc_id = g.doc_id AND r.run = g.run WHERE line AND n_words < {substring_dedup.MIN_WORDS}"""


def line_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, to in line_dedup.STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')" if to != "\n" else f"regexp_replace({text}, '{pattern}', chr(10), 'g')"
    for entity, char in line_dedup.ENTITIES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
         list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
h AS (SELECT host, count(*) AS n FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p) GROUP BY ALL),
b AS (
  SELECT c.host, list(line) AS bad FROM c JOIN h USING (host)
  WHERE c.n >= {line_dedup.MIN_PAGES} AND c.n / h.n > {line_dedup.MAX_RATIO} GROUP BY c.host),
k AS (
  SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k"""


def top_k_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def sharding_sql() -> str:
    bits, shards, cells = sharding.BITS, sharding.SHARDS, list(sharding.curve(3, sharding.BITS))
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (
  SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
         xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, crc),
s AS (SELECT source, floor((sum(count(*)) OVER (ORDER BY source NULLS LAST) - count(*)) * {1 << bits}.0 / sum(count(*)) OVER ()) AS q FROM d GROUP BY source),
l AS (SELECT lang, floor((sum(count(*)) OVER (ORDER BY lang NULLS LAST) - count(*)) * {1 << bits}.0 / sum(count(*)) OVER ()) AS q FROM d GROUP BY lang),
c AS (
  SELECT d.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text_crc32::VARCHAR, '') || ':' || size::VARCHAR), 1, {sharding.BUCKET_DIGITS}))::INT AS bucket,
         {cells}[((s.q * {1 << bits} + l.q) * {1 << bits} + least(length(bin(size)) - 1, {(1 << bits) - 1}))::INT + 1] AS cell
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN l ON d.lang IS NOT DISTINCT FROM l.lang),
r AS (
  SELECT *, row_number() OVER (ORDER BY cell, bucket, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS pos, count(*) OVER () AS n FROM c)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * {shards} // n)::INT AS shard,
       (pos - ((pos * {shards} // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing_sql(),
        "op2_decontamination": contamination_sql(),
        "op4_substring_dedup": substring_sql(),
        "op5_line_dedup": line_sql(),
        "op8_top_k": top_k_sql(),
        "op10_sharding": sharding_sql(),
    }
