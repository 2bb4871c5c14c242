"""DuckDB SQL for the opN_ queries that SQL can express, over whole tables."""

from __future__ import annotations

import zlib

from lotloom.llm.feistel import LOW, M1, M2, M3, round_keys
from lotloom.llm.warc import ALPHABET

WHITE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _crc_table() -> str:
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    assert zlib.crc32(b"a") == (table[(0xFFFFFFFF ^ 97) & 255] ^ 0xFFFFFF) ^ 0xFFFFFFFF
    return "[" + ", ".join(f"{c}::BIGINT" for c in table) + "]"


def _round(key: int) -> str:
    """The round function of r with the keys of llm.feistel."""
    a = f"(((xor(r, {key}) * {M1}) + {key}) & {LOW})"
    b = f"((xor({a}, {a} >> 15) * {M2}) & {LOW})"
    c = f"((xor({b}, {b} >> 13) * {M3}) & {LOW})"
    return f"(xor({c}, {c} >> 16) & low)"


def _permuted(source: str, seed: int) -> str:
    """(rn, x permuted once) for the rows (rn, x, h, low) of source."""
    inner = f"SELECT rn, h, low, x >> h AS l, x & low AS r FROM ({source})"
    for k in round_keys(seed):
        inner = f"SELECT rn, h, low, r AS l, xor(l, {_round(k)}) AS r FROM ({inner})"
    return f"SELECT rn, (l << h) | r AS x FROM ({inner})"


def sharding(shards: int, seed: int) -> str:
    return f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT n, h, (1::BIGINT << h) - 1 AS low FROM (
    SELECT n, (SELECT min(k) FROM range(1, 32) t(k) WHERE power(4, k) >= n)::INT AS h FROM (SELECT count(*) AS n FROM documents))),
base AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, list_extract({_crc_table()}, (xor(c, b) & 255) + 1))), 4294967295) AS text_crc32
  FROM documents),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn FROM base),
walk(rn, x) AS (
  {_permuted("SELECT rn, rn AS x, h, low FROM numbered, p", seed)}
  UNION ALL
  {_permuted("SELECT rn, x, h, low FROM walk, p WHERE x >= n", seed)})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, (x // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN walk USING (rn), p WHERE x < n
"""


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

TOPK_SEARCH = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _base32(digest: str) -> str:
    out = []
    for i in range(4):
        group = f"('0x' || substr({digest}, {10 * i + 1}, 10))::BIGINT"
        out += [f"substr('{ALPHABET}', ((({group}) >> {s}) & 31)::INT + 1, 1)" for s in range(35, -1, -5)]
    return " || ".join(out)


WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS d, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32("d")} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM g
"""


def _apportioned(name: str, parties: str, within: str, keys: str, tie: str, claim: str) -> str:
    """CTEs that end in `name`: keys and won, for the parties with claim, seats and most."""
    return f"""
{name}_b0 AS (SELECT *, {claim} AS c, count(*) OVER (PARTITION BY {within}) AS np, {claim} / sum({claim}) OVER (PARTITION BY {within}) AS share FROM {parties} WHERE {claim} > 0),
{name}_b AS MATERIALIZED (SELECT *, least(most, greatest(0, floor(share * (seats - np / 2) - 1)::BIGINT)) AS low,
  least(most, ceil(share * (seats + np / 2) + 1)::BIGINT) AS high FROM {name}_b0),
{name}_l AS MATERIALIZED (SELECT *, seats - sum(low) OVER (PARTITION BY {within}) AS remaining FROM {name}_b),
{name}_q AS (SELECT *, unnest(range(low, high)) AS i FROM {name}_l),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY c / (2 * i + 1) DESC, {tie}, i) AS place FROM {name}_q),
{name}_m AS (SELECT {keys}, count(*) AS more FROM {name}_r WHERE place <= remaining GROUP BY {keys}),
{name} AS MATERIALIZED (SELECT {keys}, (low + coalesce(more, 0))::BIGINT AS won FROM {name}_l LEFT JOIN {name}_m USING ({keys}))"""


def mixing(seed: int = 0, block: int = 8) -> str:
    number = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    return f"""
WITH n AS (SELECT greatest(1, ceil(sqrt(count(*)) / 4))::BIGINT AS shards FROM documents),
d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, 't') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS draw, {number(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))")} % shards AS shard FROM documents, n),
cells AS MATERIALIZED (SELECT s, shard, sum(size)::BIGINT AS size, ceil(sum(size) / {block})::BIGINT AS blocks FROM d GROUP BY s, shard),
per AS (SELECT s, sum(size)::BIGINT AS source_size, (sum(blocks) * 2)::BIGINT AS most FROM cells GROUP BY s),
w AS (SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS top FROM per),
lv AS (SELECT *, top / w AS level FROM w),
o AS (SELECT *, coalesce(sum(top) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
  sum(w) OVER (ORDER BY level, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM lv),
t0 AS (SELECT *, max((total - before) / open) OVER () AS rise FROM o),
t1 AS (SELECT s, source_size, most, 0 AS a, least(top, rise * w) AS target FROM t0),
t AS MATERIALIZED (SELECT *, round(sum(target) OVER () / {block})::BIGINT AS seats FROM t1),
{_apportioned("u", "t", "a", "s", "s", "target")},
x AS MATERIALIZED (SELECT cells.*, source_size, target, coalesce(u.won, 0) AS seats, blocks * 2 AS most FROM cells JOIN t USING (s) LEFT JOIN u USING (s)),
{_apportioned("v", "x", "s", "s, shard", "shard", "blocks::DOUBLE")},
q AS (SELECT x.*, coalesce(v.won, 0) AS quota, greatest(blocks, 1) AS there FROM x LEFT JOIN v USING (s, shard)),
run AS (SELECT s, shard, source_size, target, there, quota // there AS rounds,
  {number(f"'{seed}:' || s || ':' || shard")} % there * {block} AS b0, quota % there * {block} AS len FROM q),
p AS (SELECT *, sum(size) OVER (PARTITION BY s, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS b FROM d)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(b, b0 + len) - greatest(b - size, b0))
  + greatest(0, least(b, b0 + len - there * {block}) - (b - size)))::BIGINT AS taken
FROM p JOIN run USING (s, shard)
"""


EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), {WHITE}, '') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""

ORACLES = {
    "op1_sharding": sharding(8, 20240229),
    "op2_line_dedup": LINE_DEDUP,
    "op3_topk_search": TOPK_SEARCH,
    "op5_warc": WARC,
    "op6_mixing": mixing(),
    "op10_exact_dedup": EXACT_DEDUP,
}
