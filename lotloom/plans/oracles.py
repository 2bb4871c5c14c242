"""DuckDB SQL for the queries of plans.queries, over whole tables."""

from __future__ import annotations

from lotloom.functions.text import EXCLUDED, KEYWORDS

ALPHANUMERIC_ONLY = "[^a-z0-9]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '{ALPHANUMERIC_ONLY}', ' ', 'g'))"


def compact(x: str) -> str:
    return f"replace({norm(x)}, ' ', '')"


def _found(n: str) -> str:
    return " + ".join(f"regexp_matches({n}, '{p}')::INT" for p in KEYWORDS.values())


def _missing(n: str) -> str:
    parts = ", ".join(f"CASE WHEN NOT regexp_matches({n}, '{p}') THEN '{k}' END" for k, p in KEYWORDS.items())
    return f"array_to_string(list_filter([{parts}], lambda k: k IS NOT NULL), '|')"


PAGES = "p AS (SELECT conv_id AS lot_id, turn + 1 AS page_number, role, text AS ocr_raw FROM conversations)"
EVENT_PAGES = "e AS (SELECT user_id AS lot_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_number, event_type FROM events)"
LOTS = """l AS (SELECT l_orderkey AS lot_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_suppkey, l_quantity FROM lineitem),
pg AS (SELECT lot_id, n AS page_number, l_partkey % 4 > 0 AS is_start, CASE WHEN l_suppkey % 10 > 0 THEN 'x' END AS compact FROM l),
rw AS (SELECT lot_id, n AS row_number, 'N ' || (l_suppkey % 3) AS commande, (l_suppkey % 2)::VARCHAR AS client_number, 'Été ' || (l_suppkey % 2) AS distributeur, 'c' AS client,
  NULL::VARCHAR AS cote, '1' AS caisse, count(*) OVER (PARTITION BY lot_id, l_suppkey % 3, l_suppkey % 2) > 1 AS is_duplicate FROM l WHERE l_quantity > 10),
tot AS (SELECT lot_id, count(*) AS total FROM pg GROUP BY lot_id)"""


def _pairs(documents: str) -> str:
    return f"""(SELECT * EXCLUDE (k), k % 4 = 0 AS oe, k % 3 = 0 AS ce, least((k % 5) / 4.0::DOUBLE, 1) AS c, least((k % 7) / 5.0::DOUBLE, 1) AS d
  FROM (SELECT *, doc_index * 31 + row_number * 17 + lot_id AS k FROM {documents} JOIN rw USING (lot_id)))"""


STRICT = f"""{LOTS},
sd AS MATERIALIZED (SELECT lot_id, (row_number() OVER w)::INT AS doc_index, page_number AS start_page, compact FROM pg WHERE is_start WINDOW w AS (PARTITION BY lot_id ORDER BY page_number)),
sp AS {_pairs("(SELECT * FROM sd WHERE compact IS NOT NULL)")},
sc AS MATERIALIZED (SELECT *, oe::INT * 0.35::DOUBLE + ce::INT * 0.25::DOUBLE + d * 0.2::DOUBLE + c * 0.2::DOUBLE AS score, oe AND ce AND d > 0.9 AND c > 0.9 AS qualifies,
  oe::INT + ce::INT + (d > 0.9)::INT + (c > 0.9)::INT AS n_matched FROM sp WHERE oe OR ce OR d > 0.9 OR c > 0.9),
ac AS (SELECT lot_id, doc_index, count(*) AS n_accepted, min(row_number) AS claimed FROM sc WHERE qualifies GROUP BY ALL),
c0 AS (SELECT sd.*, coalesce(n_accepted, 0) AS n_accepted, CASE WHEN n_accepted = 1 THEN claimed END AS claimed_row FROM sd LEFT JOIN ac USING (lot_id, doc_index)),
cl AS MATERIALIZED (SELECT *, CASE WHEN claimed_row IS NOT NULL THEN count(*) OVER (PARTITION BY lot_id, claimed_row) END AS n_claims FROM c0),
iss AS MATERIALIZED (
  SELECT lot_id, 'document_count_mismatch' AS code, 'Detected ' || coalesce(x.n, 0) || ' documents for ' || coalesce(y.n, 0) || ' CSV rows' AS message, 'error' AS severity,
    NULL::BIGINT AS doc_index, NULL::BIGINT AS page_number, NULL::BIGINT AS row_number
  FROM (SELECT lot_id, count(*) AS n FROM sd GROUP BY lot_id) x FULL JOIN (SELECT lot_id, count(*) AS n FROM rw GROUP BY lot_id) y USING (lot_id) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)
  UNION ALL SELECT lot_id, 'no_start_pages', 'No document start pages were detected', 'error', NULL, NULL, NULL FROM tot WHERE lot_id NOT IN (SELECT lot_id FROM sd)
  UNION ALL SELECT lot_id, 'leading_pages_before_first_start', 'First detected document starts at page ' || min(start_page) || ', not page 1', 'error', NULL, min(start_page), NULL FROM sd GROUP BY lot_id HAVING min(start_page) <> 1
  UNION ALL SELECT lot_id, 'missing_first_page_ocr', 'Document ' || doc_index || ' has no first-page OCR payload', 'error', doc_index, start_page, NULL FROM cl WHERE compact IS NULL
  UNION ALL SELECT lot_id, 'no_match', 'Document ' || doc_index || ' has no valid CSV match', 'error', doc_index, start_page, NULL FROM cl WHERE compact IS NOT NULL AND n_accepted = 0
  UNION ALL SELECT lot_id, 'ambiguous_match', 'Document ' || doc_index || ' has ' || n_accepted || ' valid CSV candidates', 'error', doc_index, start_page, NULL FROM cl WHERE compact IS NOT NULL AND n_accepted > 1
  UNION ALL SELECT lot_id, 'duplicate_row_assignment', 'CSV row ' || claimed_row || ' is assigned to multiple documents', 'error', doc_index, NULL, claimed_row FROM cl WHERE n_claims > 1)"""
ROUNDS = 7  # a lot has at most so many documents


def _rounds() -> str:
    """CTEs of the rounds of proposals: g1, g2, ... are who is given what, t1, t2, ... what is left."""
    out = []
    for i in range(ROUNDS):
        out.append(f"""o{i} AS (SELECT *, row_number() OVER w AS r, lead(g) OVER w AS g2 FROM t{i} WINDOW w AS (PARTITION BY lot_id, doc_index ORDER BY k)),
g{i + 1} AS MATERIALIZED (SELECT lot_id, doc_index, row_number FROM o{i} WHERE r = 1 AND (g2 IS NULL OR g2 <> g) QUALIFY row_number() OVER (PARTITION BY lot_id, row_number ORDER BY k) = 1),
t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE (lot_id, doc_index) NOT IN (SELECT (lot_id, doc_index) FROM g{i + 1}) AND (lot_id, row_number) NOT IN (SELECT (lot_id, row_number) FROM g{i + 1}))""")
    return ",\n".join(out)


RECON = f"""{LOTS},
rp AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY lot_id ORDER BY page_number) AS doc FROM pg),
rd AS MATERIALIZED (SELECT lot_id, doc::INT AS doc_index, min(page_number) AS start_page, max(page_number) AS end_page, count(*) AS page_count, doc::INT || '.pdf' AS file_name FROM rp GROUP BY lot_id, doc),
c1 AS (SELECT *, oe::INT * 35.0::DOUBLE + ce::INT * 35.0::DOUBLE + c * 15.0::DOUBLE + d * 15.0::DOUBLE AS raw FROM {_pairs("rd")}),
c2 AS (SELECT *, round_even(raw::DECIMAL(38, 15), 3)::DOUBLE AS g, greatest(0, least(100, round_even(raw, 0)::INT)) AS percent, (oe AND ce)::INT AS twice, round_even(c * 100, 0)::INT AS cp,
  round_even(d * 100, 0)::INT AS dp, (oe AND ce AND (c >= 0.9 OR d >= 0.9)) OR ((oe OR ce) AND c >= 0.7 AND d >= 0.8) AS exact,
  list_filter([CASE WHEN NOT oe THEN 'Commande' END, CASE WHEN NOT ce THEN 'N° Client' END, CASE WHEN c < 0.9 THEN 'Client (' || round_even(c * 100, 0)::INT || ')' END,
    CASE WHEN d < 0.7 THEN 'Distributeur (' || round_even(d * 100, 0)::INT || ')' END], lambda v: v IS NOT NULL) AS verify FROM c1),
cd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY twice DESC, oe DESC, ce DESC, dp DESC, cp DESC, g DESC, row_number, start_page) AS k FROM c2),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lot_id, doc_index ORDER BY k) AS rank_for_doc, row_number() OVER (PARTITION BY lot_id, row_number ORDER BY k) AS rank_for_row FROM cd)"""
ASSIGNED = f"""{RECON},
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lot_id, doc_index ORDER BY k) AS i, concat_ws('|', twice, oe, ce, dp, cp) AS sig FROM cd WHERE exact),
amb AS MATERIALIZED (SELECT lot_id, doc_index, CASE WHEN bool_or(is_duplicate) THEN 'Doublon possible' ELSE 'Plusieurs exact matches' END AS why
  FROM x GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT CASE WHEN i <= 2 THEN sig END) = 1),
ambr AS MATERIALIZED (SELECT lot_id, row_number, arg_min(why, start_page) AS why FROM x JOIN amb USING (lot_id, doc_index) GROUP BY ALL),
sure AS MATERIALIZED (SELECT * FROM x WHERE i = 1 AND (lot_id, doc_index) NOT IN (SELECT (lot_id, doc_index) FROM amb)),
g0 AS MATERIALIZED (SELECT lot_id, doc_index, row_number FROM sure WHERE (lot_id, row_number) NOT IN (SELECT (lot_id, row_number) FROM ambr)
  QUALIFY row_number() OVER (PARTITION BY lot_id, row_number ORDER BY k) = 1),
t0 AS MATERIALIZED (SELECT * FROM cd WHERE (lot_id, doc_index) NOT IN (SELECT (lot_id, doc_index) FROM x) AND (lot_id, row_number) NOT IN (SELECT (lot_id, row_number) FROM ambr)
  AND (lot_id, row_number) NOT IN (SELECT (lot_id, row_number) FROM g0)),
{_rounds()},
given AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(ROUNDS + 1))}),
tied AS MATERIALIZED (SELECT *, count(*) OVER p AS n, bool_or(is_duplicate) OVER p AS dup FROM (SELECT * FROM t{ROUNDS} QUALIFY g = first_value(g) OVER (PARTITION BY lot_id, doc_index ORDER BY k)) WINDOW p AS (PARTITION BY lot_id, doc_index)),
tw AS MATERIALIZED (SELECT *, CASE WHEN dup THEN 'Doublon possible' ELSE 'Ex æquo sur le meilleur score' END AS why FROM tied WHERE n > 1),
v AS MATERIALIZED (SELECT lot_id, 'doc' AS side, doc_index::BIGINT AS id, row_number::BIGINT AS partner, NULL::VARCHAR AS reason FROM given
  UNION ALL SELECT lot_id, 'row', row_number, doc_index, NULL FROM given
  UNION ALL SELECT lot_id, 'doc', doc_index, NULL, why FROM amb
  UNION ALL SELECT lot_id, 'doc', doc_index, NULL, 'Affectation non tranchable' FROM sure WHERE (lot_id, doc_index) NOT IN (SELECT (lot_id, doc_index) FROM g0)
  UNION ALL SELECT DISTINCT lot_id, 'doc', doc_index, NULL, why FROM tw
  UNION ALL SELECT lot_id, 'row', row_number, NULL, why FROM ambr
  UNION ALL SELECT lot_id, 'row', row_number, NULL, arg_min(why, start_page) FROM tw GROUP BY lot_id, row_number)"""
_OUI = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN {c} THEN 'oui' ELSE 'non' END"
_KEYS = ("commande", "client_number", "distributeur", "client", "cote", "caisse")
OUTPUTS = f"""{ASSIGNED},
ro AS MATERIALIZED (SELECT rw.lot_id, rw.row_number, {", ".join(f"rw.{c}" for c in _KEYS)}, partner IS NOT NULL AS done, reason, q.* EXCLUDE (lot_id, row_number, {", ".join(_KEYS)})
  FROM rw LEFT JOIN (SELECT * FROM v WHERE side = 'row') vr ON vr.lot_id = rw.lot_id AND vr.id = rw.row_number
  JOIN ranked q ON q.lot_id = rw.lot_id AND q.row_number = rw.row_number AND (q.doc_index = partner OR (partner IS NULL AND rank_for_row = 1))),
rl AS MATERIALIZED (SELECT *, CASE WHEN done AND len(verify) = 0 THEN 'OK' WHEN done THEN 'À vérifier' WHEN reason IS NOT NULL THEN 'Ambigu' ELSE 'Sans PDF' END AS status,
  coalesce(reason, 'Aucun PDF n''a pu être affecté automatiquement') AS why FROM ro),
dl AS MATERIALIZED (SELECT rd.lot_id, rd.file_name, rd.start_page, rd.end_page, rd.page_count, partner IS NOT NULL AS done, reason, q.* EXCLUDE (lot_id, file_name, start_page, end_page, page_count, doc_index)
  FROM rd LEFT JOIN (SELECT * FROM v WHERE side = 'doc') vd ON vd.lot_id = rd.lot_id AND vd.id = rd.doc_index
  LEFT JOIN ranked q ON q.lot_id = rd.lot_id AND q.doc_index = rd.doc_index AND (q.row_number = partner OR (partner IS NULL AND rank_for_doc = 1)))"""
FEATURES = """f AS (SELECT l_orderkey AS lot_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page_number, CASE WHEN l_linenumber % 5 > 0 THEN l_partkey % 3 > 0 END AS success,
  (l_suppkey % 100) / 100.0::DOUBLE AS inlier, l_partkey % 60 AS used, l_quantity / 50.0::DOUBLE AS v, (l_suppkey * 7 % 100) / 100.0::DOUBLE AS c FROM lineitem),
s AS (SELECT *, CASE WHEN success THEN inlier ELSE 0 END AS score, coalesce(success AND inlier >= 0.4::DOUBLE, false) AS matched FROM f)"""
SCORED = """s AS (SELECT l_orderkey AS doc, l_linenumber AS line, (l_orderkey * 7 + l_linenumber * 13) % 3 = 0 AS oe, (l_orderkey * 7 + l_linenumber * 13) % 5 < 2 AS ce,
  ((l_quantity::BIGINT * 2) % 101)::DOUBLE / 100 AS c, (l_suppkey % 101)::DOUBLE / 100 AS d FROM lineitem),
g AS (SELECT *, oe::INT * 35.0::DOUBLE + ce::INT * 35.0::DOUBLE + c * 15.0::DOUBLE + d * 15.0::DOUBLE AS raw FROM s)"""
WORDS = """w AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, 'w' || l_partkey AS text, l_quantity::BIGINT / 50.0::DOUBLE AS confidence, l_partkey % 200 AS x,
  l_suppkey * 7 % 120 AS y, l_quantity::BIGINT % 30 + 5 AS width, l_partkey % 11 + 4 AS height, l_linenumber % 2 AS par_num, l_linenumber AS line_num FROM lineitem),
z AS (SELECT o_orderkey AS doc_id, lower(r_name) AS zone_name, r_regionkey % 2 = 0 AS is_text, r_regionkey < 2 AS required, r_regionkey * 40 - 4 AS zx, r_regionkey * 20 - 4 AS zy, 68 AS zw, 48 AS zh
  FROM orders, region),
i AS (SELECT *, greatest(least(x + width, zx + zw) - greatest(x, zx), 0) * greatest(least(y + height, zy + zh) - greatest(y, zy), 0) AS common FROM w JOIN z USING (doc_id)),
j AS (SELECT *, common / (width * height)::DOUBLE AS overlap, x + width / 2.0 BETWEEN zx AND zx + zw AND y + height / 2.0 BETWEEN zy AND zy + zh AS centred FROM i WHERE common > 0),
h AS (SELECT *, overlap + CASE WHEN centred THEN 0.25 ELSE 0 END AS hit FROM j WHERE overlap >= 0.2 OR centred),
f0 AS (SELECT doc_id, zone_name, string_agg(text, ' ' ORDER BY par_num, line_num, x, id, text) AS raw, sum(confidence * greatest(hit, 0.05)) / sum(greatest(hit, 0.05)) AS conf, count(*) AS n FROM h GROUP BY ALL),
f1 AS (SELECT z.*, conf, coalesce(n, 0) AS n, raw, coalesce(CASE WHEN is_text THEN raw ELSE regexp_replace(raw, '[^0-9.,-]', '', 'g') END, '') AS value FROM z LEFT JOIN f0 USING (doc_id, zone_name))"""
CHOSEN = """r AS (SELECT o_orderkey AS source_row, CASE WHEN o_orderkey % 10 > 0 THEN ' C' || (o_custkey * 2) || CASE WHEN o_orderkey % 9 = 0 THEN '.txt' ELSE '.PDF' END ELSE ' ' END AS pdf_name,
  o_orderstatus = 'F' AS validated, o_orderkey % 25 = 0 AS manual, o_custkey % 2 = 0 AS has_distributor FROM orders),
rk AS (SELECT *, lower(trim(pdf_name)) AS key FROM r),
a AS (SELECT 'c' || c_custkey || '.pdf' AS pdf_name FROM customer),
u AS (SELECT key, count(*) AS n FROM rk WHERE key <> '' GROUP BY key)"""
_BITS = lambda a, b: f"list_reduce(list_prepend(0::BIGINT, list_transform(embedding[{a}:{b}], lambda x: (x > 0)::BIGINT)), lambda a, b: a * 2 + b)"
DESCRIPTORS = f"""v AS MATERIALIZED (SELECT vec_id, label, {_BITS(1, 32)} AS high, {_BITS(33, 64)} AS low FROM embeddings),
m AS (SELECT q.label, q.vec_id AS query_id, t.vec_id AS train_id, (bit_count(xor(q.high, t.high)) + bit_count(xor(q.low, t.low)))::INT AS distance FROM v q JOIN v t ON q.label = t.label WHERE q.vec_id <> t.vec_id),
n2 AS (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY distance, train_id) AS rank FROM m QUALIFY rank <= 2)"""

ORACLES = {
    "text_normalize": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "text_compact_digits": f"""WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages)
SELECT side, id, length({compact("text")})::BIGINT AS n_compact, regexp_replace(text, '[^\\p{{Nd}}]+', '', 'g') AS digits FROM t""",
    "order_variants": """SELECT o_orderkey, CASE WHEN lpad(o_orderkey::VARCHAR, 6, '0') LIKE '0%' THEN lpad(o_orderkey::VARCHAR, 6, '0') || '|f' || substr(lpad(o_orderkey::VARCHAR, 6, '0'), 2)
  ELSE lpad(o_orderkey::VARCHAR, 6, '0') END AS variants FROM orders""",
    "keyword_match": f"""WITH n AS MATERIALIZED (SELECT doc_id, {norm("text")} AS n FROM documents)
SELECT doc_id, ({_found("n")})::INT AS n_found, {_missing("n")} AS missing, ({_found("n")}) >= 1 AND NOT regexp_matches(n, '{EXCLUDED}') AS is_start FROM n""",
    "start_page_filter": f"""WITH {PAGES}, n AS MATERIALIZED (SELECT lot_id, page_number, {norm("coalesce(ocr_raw, '')")} AS n FROM p)
SELECT lot_id, page_number FROM n WHERE ({_found("n")}) >= 1 AND NOT regexp_matches(n, '{EXCLUDED}')""",
    "segment_ranges": f"""WITH {PAGES}, t AS (SELECT lot_id, count(*) AS total FROM p GROUP BY lot_id),
s AS (SELECT *, row_number() OVER w AS i, lead(page_number) OVER w AS nxt FROM p WHERE role = 'user' WINDOW w AS (PARTITION BY lot_id ORDER BY page_number))
SELECT lot_id, i::INT AS doc_index, page_number AS start_page, coalesce(nxt - 1, total) AS end_page, coalesce(nxt - 1, total) - page_number + 1 AS page_count FROM s JOIN t USING (lot_id)""",
    "segment_with_leading": f"""WITH {PAGES}, g AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY lot_id ORDER BY page_number) AS doc FROM p)
SELECT lot_id, doc::INT AS doc_index, min(page_number) AS start_page, max(page_number) AS end_page, count(*) AS page_count FROM g GROUP BY lot_id, doc""",
    "ranges_from_starts": f"""WITH {PAGES}, t AS (SELECT lot_id, count(*) AS total FROM p GROUP BY lot_id),
s AS (SELECT DISTINCT lot_id, page_number FROM (SELECT lot_id, page_number FROM p WHERE role = 'assistant' UNION ALL SELECT lot_id, page_number + 1 FROM p WHERE role = 'user') JOIN t USING (lot_id) WHERE page_number BETWEEN 1 AND total),
m AS (SELECT lot_id, page_number, row_number() OVER (PARTITION BY lot_id ORDER BY page_number) AS i FROM s),
a AS (SELECT * FROM m UNION ALL SELECT lot_id, 1, 0 FROM t WHERE lot_id NOT IN (SELECT lot_id FROM m WHERE i = 1 AND page_number = 1)),
n AS (SELECT *, lead(page_number) OVER (PARTITION BY lot_id ORDER BY page_number) AS nxt FROM a)
SELECT lot_id, i::INT AS doc_index, page_number AS start_page, coalesce(nxt - 1, total) AS end_page, coalesce(nxt - 1, total) - page_number + 1 AS page_count FROM n JOIN t USING (lot_id)""",
    "first_page_lookup": f"""WITH {PAGES}, t AS (SELECT lot_id, count(*) AS total FROM p GROUP BY lot_id),
s AS (SELECT *, row_number() OVER w AS i, lead(page_number) OVER w AS nxt FROM p WHERE role = 'user' WINDOW w AS (PARTITION BY lot_id ORDER BY page_number))
SELECT lot_id, page_number AS start_page, i::INT AS doc_index, coalesce(nxt - 1, total) AS end_page, coalesce(nxt - 1, total) - page_number + 1 AS page_count, length(ocr_raw) AS n_chars FROM s JOIN t USING (lot_id)""",
    "long_gaps": f"""WITH {EVENT_PAGES}, m AS (SELECT lot_id, page_number AS mark FROM e WHERE event_type = 'signup' UNION ALL SELECT lot_id, count(*) + 1 FROM e GROUP BY lot_id),
g AS (SELECT lot_id, coalesce(lag(mark) OVER (PARTITION BY lot_id ORDER BY mark), 0) + 1 AS gap_start, mark - 1 AS gap_end FROM m)
SELECT *, gap_end - gap_start + 1 AS gap_length FROM g WHERE gap_end - gap_start + 1 >= 15""",
    "leading_pages_check": f"""WITH {EVENT_PAGES}, f AS (SELECT lot_id, min(page_number) FILTER (WHERE event_type = 'signup') AS first FROM e GROUP BY lot_id)
SELECT lot_id, CASE WHEN first IS NULL THEN 'no_start_pages' ELSE 'leading_pages_before_first_start' END AS code, first AS page_number FROM f WHERE first IS NULL OR first <> 1""",
    "exact_link": f"""WITH k AS MATERIALIZED (SELECT item_id, {compact("text")} AS key FROM benchmark), d AS MATERIALIZED (SELECT doc_id, {compact("text")} AS page FROM documents)
SELECT doc_id, item_id FROM d JOIN k ON contains(page, key) WHERE key <> ''""",
    "number_link": f"""WITH d AS MATERIALIZED (SELECT doc_id, {compact("text")} AS page FROM documents), o AS (SELECT DISTINCT lpad((o_orderkey % 5000)::VARCHAR, 4, '0') AS "order" FROM orders),
k AS MATERIALIZED (SELECT "order", "order" AS key FROM o UNION SELECT "order", 'f' || substr("order", 2) FROM o WHERE "order" LIKE '0%')
SELECT DISTINCT doc_id, "order" FROM d JOIN k ON contains(page, key)""",
    "strict_rank": f"""WITH {STRICT} SELECT lot_id, doc_index, row_number, round(score, 6) AS score, qualifies, n_matched,
  row_number() OVER (PARTITION BY lot_id, doc_index ORDER BY qualifies DESC, oe DESC, ce DESC, n_matched DESC, score DESC, row_number) AS rank,
  count(*) FILTER (WHERE qualifies) OVER (PARTITION BY lot_id, doc_index) AS n_accepted FROM sc""",
    "duplicate_claims": f"""WITH {STRICT} SELECT lot_id, doc_index, n_accepted, claimed_row, n_claims, CASE WHEN n_claims = 1 THEN claimed_row END AS assigned_row,
  CASE WHEN compact IS NULL THEN 'Missing first-page OCR' WHEN n_accepted = 0 THEN 'No CSV row satisfied the exact numeric and fuzzy text rule'
    WHEN n_accepted > 1 THEN 'Multiple CSV rows satisfy the matching rule' WHEN n_claims > 1 THEN 'CSV row ' || claimed_row || ' is claimed by multiple documents' END AS blocked_reason FROM cl""",
    "strict_issues": f"WITH {STRICT} SELECT * FROM iss",
    "lot_summary": f"""WITH {STRICT} SELECT lot_id, total AS total_pages, (SELECT count(*) FROM rw WHERE rw.lot_id = tot.lot_id) AS csv_row_count,
  (SELECT count(*) FROM sd WHERE sd.lot_id = tot.lot_id) AS detected_document_count, (SELECT count(*) FROM cl WHERE cl.lot_id = tot.lot_id AND n_claims = 1) AS matched_document_count,
  lot_id IN (SELECT lot_id FROM iss WHERE severity <> 'warning') AS validation_blocked FROM tot""",
    "duplicate_rows": f"WITH {LOTS} SELECT lot_id, row_number, is_duplicate FROM rw",
    "recon_rank": f"""WITH {RECON} SELECT lot_id, doc_index, row_number, g AS global_score, percent AS global_percent, exact AS is_exact, cp AS client_percent, dp AS distributor_percent,
  array_to_string(verify, '; ') AS verify, rank_for_doc, rank_for_row, coalesce(g = lead(g) OVER (PARTITION BY lot_id, doc_index ORDER BY k), false) AS tie FROM ranked""",
    "greedy_assign": f"WITH {ASSIGNED} SELECT * FROM v",
    "unassigned_rows": f"WITH {ASSIGNED} SELECT lot_id, row_number FROM rw WHERE (lot_id, row_number) NOT IN (SELECT (lot_id, row_number) FROM given)",
    "unassigned_docs": f"WITH {ASSIGNED} SELECT lot_id, doc_index::BIGINT AS doc_index FROM rd WHERE (lot_id, doc_index) NOT IN (SELECT (lot_id, doc_index) FROM given)",
    "row_output": f"""WITH {OUTPUTS} SELECT lot_id, row_number AS source_row, 'non' AS manual, status, '' AS validation_error, CASE WHEN done THEN file_name ELSE '' END AS pdf_name,
  CASE WHEN done THEN '' ELSE file_name END AS suggested_pdf_name, file_name AS detected_pdf_name, start_page, end_page, page_count, {", ".join(_KEYS)},
  CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS match_type, percent AS global_score, {_OUI("oe")} AS commande_exact, {_OUI("ce")} AS client_number_exact, cp AS client_percent, dp AS distributeur_percent,
  CASE WHEN done THEN array_to_string(verify, '; ') WHEN status = 'Ambigu' THEN why ELSE '' END AS verify_fields, '' AS review_note, CASE WHEN done THEN '' ELSE why END AS diagnostic_reason FROM rl""",
    "document_output": f"""WITH {OUTPUTS} SELECT lot_id, file_name AS pdf_name, CASE WHEN done AND len(verify) = 0 THEN 'Affecté' WHEN done THEN 'À vérifier' WHEN reason IS NOT NULL THEN 'Ambigu' ELSE 'Non affecté' END AS status,
  start_page, end_page, page_count, row_number AS best_source_row, percent AS global_score, {_OUI("oe")} AS commande_exact, {_OUI("ce")} AS client_number_exact, cp AS client_percent, dp AS distributeur_percent,
  {", ".join(f"coalesce({c}, '') AS best_{c}" for c in _KEYS)},
  CASE WHEN done AND len(verify) = 0 THEN 'Affecté automatiquement' WHEN done THEN 'Affecté automatiquement avec contrôle requis'
    ELSE coalesce(reason, CASE WHEN row_number IS NULL THEN 'Aucune ligne candidate n''a été trouvée pour ce PDF' ELSE 'Aucune ligne CSV n''a été affectée à ce PDF' END) END AS reason FROM dl""",
    "recon_summary": f"""WITH {OUTPUTS}, r AS (SELECT lot_id, count(*) AS n, count(*) FILTER (WHERE status IN ('OK', 'À vérifier')) AS a, count(*) FILTER (WHERE status = 'À vérifier') AS c,
  count(*) FILTER (WHERE status = 'Ambigu') AS u, count(*) FILTER (WHERE status = 'Sans PDF') AS m FROM rl GROUP BY lot_id)
SELECT lot_id, coalesce(n, 0) AS csv_row_count, coalesce(a, 0) AS auto_assigned_count, coalesce(c, 0) AS needs_verification_count, coalesce(u, 0) AS ambiguous_count, coalesce(m, 0) AS missing_pdf_count,
  (SELECT count(*) FROM rd WHERE rd.lot_id = tot.lot_id) AS generated_pdf_count FROM tot LEFT JOIN r USING (lot_id)""",
    "separate_orb": f"""WITH {FEATURES}, t AS (SELECT lot_id, count(*) AS total FROM s GROUP BY lot_id),
m AS (SELECT *, row_number() OVER w AS i, lead(page_number) OVER w AS nxt FROM s WHERE matched WINDOW w AS (PARTITION BY lot_id ORDER BY page_number))
SELECT lot_id, i::INT AS doc_index, page_number AS start_page, coalesce(nxt - 1, total) AS end_page, coalesce(nxt - 1, total) - page_number + 1 AS page_count FROM m JOIN t USING (lot_id)""",
    "separate_orb_pages": f"WITH {FEATURES} SELECT lot_id, page_number, round(score, 6) AS score, matched FROM s",
    "separate_hybrid": f"""WITH {FEATURES}, g AS (SELECT *, greatest(0.30::DOUBLE, 0.55::DOUBLE - 0.15::DOUBLE) AS gv, greatest(0.33::DOUBLE, 0.55::DOUBLE - 0.10::DOUBLE) AS gc, greatest(0.18::DOUBLE, 0.55::DOUBLE - 0.25::DOUBLE) AS go FROM f),
h AS (SELECT *, CASE WHEN v >= gv AND coalesce(success, false) THEN greatest(0, least(1, inlier * 0.75::DOUBLE + least(used / 40.0::DOUBLE, 1) * 0.25::DOUBLE)) ELSE 0 END AS o FROM g),
i AS (SELECT *, v * 0.45::DOUBLE + o * 0.55::DOUBLE AS t FROM h)
SELECT lot_id, page_number, round(o, 9) AS orb, round(t, 9) AS score, t >= 0.55::DOUBLE AND v >= gv AND c >= gc AND o >= go AS matched, 2 * (v < gv)::INT + (c < gc)::INT + (o < go)::INT AS n_warnings, v < gv AS skipped FROM i""",
    "recon_score": f"""WITH {SCORED} SELECT doc, line, round_even(raw::DECIMAL(38, 15), 3)::DOUBLE AS global_score, greatest(0, least(100, round_even(round(raw, 6), 0)::INT)) AS percent,
  (oe AND ce AND (c >= 0.9 OR d >= 0.9)) OR ((oe OR ce) AND c >= 0.7 AND d >= 0.8) AS is_exact,
  array_to_string(list_filter([CASE WHEN NOT oe THEN 'Commande' END, CASE WHEN NOT ce THEN 'N° Client' END, CASE WHEN c < 0.9 THEN 'Client (' || round_even(c * 100, 0)::INT || ')' END,
    CASE WHEN d < 0.7 THEN 'Distributeur (' || round_even(d * 100, 0)::INT || ')' END], lambda v: v IS NOT NULL), '; ') AS verify FROM g""",
    "strict_score": f"""WITH {SCORED} SELECT doc, line, round(oe::INT * 0.35::DOUBLE + ce::INT * 0.25::DOUBLE + d * 0.2::DOUBLE + c * 0.2::DOUBLE, 6) AS score, oe AND ce AND d > 0.9 AND c > 0.9 AS qualifies
FROM g WHERE oe OR ce OR d > 0.9 OR c > 0.9""",
    "mutual_best": """WITH p AS (SELECT l_suppkey, l_partkey, count(*) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_suppkey, l_partkey) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey, l_partkey) AS b FROM p)
SELECT l_suppkey, l_partkey, score FROM r WHERE a = 1 AND b = 1""",
    "zone_words": f"WITH {WORDS} SELECT doc_id, zone_name, id, round(overlap, 6) AS overlap, centred, round(hit, 6) AS hit FROM h",
    "zone_text": f"""WITH {WORDS} SELECT doc_id, zone_name, value, round(coalesce(conf, 0), 6) AS confidence, CASE WHEN raw IS NULL THEN 'No OCR words intersect zone'
  WHEN value = '' THEN 'OCR words matched but value is empty' WHEN conf < 0.5 THEN 'Low OCR confidence' ELSE '' END AS warning, n::INT AS n_words FROM f1""",
    "zone_missing": f"WITH {WORDS} SELECT doc_id, zone_name FROM f1 WHERE required AND value = ''",
    "zone_normalize": """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN regexp_replace(t, '[^0-9.,-]', '', 'g') WHEN 2 THEN regexp_replace(t, '[^0-9/.-]', '', 'g')
  ELSE regexp_replace(t, '[^A-Za-z0-9_-]', '', 'g') END) AS value_md5 FROM c""",
    "box_normalize": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS x1, l_suppkey * 3 % 300 AS x2, l_quantity AS y1, l_quantity + l_linenumber AS y2,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, least(x1, x2)::INT AS x, round_even(least(y1, y2), 0)::INT AS y, abs(x2 - x1)::INT AS width, round_even(abs(y2 - y1), 0)::INT AS height,
  round(greatest(0, least(1, CASE WHEN c > 1 THEN c / 100 ELSE c END)), 6) AS confidence FROM b WHERE x1 <> x2 AND round_even(abs(y2 - y1), 0) > 0""",
    "median_height": "SELECT p_brand, round(greatest(8.0::DOUBLE, median(p_size) * 0.6::DOUBLE), 6) AS threshold FROM part GROUP BY p_brand",
    "hamming_knn": f"WITH {DESCRIPTORS} SELECT label, query_id, train_id, distance, rank::INT AS rank FROM n2",
    "good_matches": f"""WITH {DESCRIPTORS}, b AS (SELECT label, query_id, min(distance) FILTER (WHERE rank = 1) AS d1, min(distance) FILTER (WHERE rank = 2) AS d2, min(train_id) FILTER (WHERE rank = 1) AS train_id FROM n2 GROUP BY ALL)
SELECT * FROM b WHERE d1 < d2 * 0.9""",
    "weighted_scores": """WITH s AS (SELECT p_brand, p_size / 50.0::DOUBLE AS s, p_partkey % 5 + 1 AS w, p_partkey % 3 = 0 AS c FROM part),
g AS (SELECT p_brand, sum(s * w) / sum(w) AS v, sum(s * w) FILTER (WHERE c) / sum(w) FILTER (WHERE c) AS cr FROM s GROUP BY p_brand)
SELECT p_brand, round(v, 6) AS visual, round(coalesce(cr, v), 6) AS critical FROM g""",
    "region_score": """WITH s AS (SELECT p_partkey, least(1, p_size / 50.0::DOUBLE) AS p, CASE WHEN p_size % 3 > 0 THEN least(1, p_size / 40.0::DOUBLE) END AS d, p_size / 60.0::DOUBLE AS h,
  greatest(0, 1 - least(abs(p_size / 100.0::DOUBLE - 0.2::DOUBLE) / 0.15::DOUBLE, 1)) AS e FROM part)
SELECT p_partkey, round((p * 0.45 + coalesce(d * 0.25, 0) + 0.5 * 0.3) / (0.75 + CASE WHEN d IS NULL THEN 0 ELSE 0.25 END) * 0.6 + h * 0.25 + e * 0.15, 6) AS score FROM s""",
    "hybrid_gate": """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS v, (l_suppkey % 100)::DOUBLE / 100 AS c,
  CASE WHEN l_linenumber > 1 THEN greatest(0, least(1, l_discount * 10 * 0.75::DOUBLE + least((l_partkey % 60) / 40.0::DOUBLE, 1) * 0.25::DOUBLE)) ELSE 0 END AS o FROM lineitem),
g AS (SELECT *, v * 0.45::DOUBLE + o * 0.55::DOUBLE AS f, greatest(0.30::DOUBLE, 0.55::DOUBLE - 0.15::DOUBLE) AS gv, greatest(0.33::DOUBLE, 0.55::DOUBLE - 0.10::DOUBLE) AS gc, greatest(0.18::DOUBLE, 0.55::DOUBLE - 0.25::DOUBLE) AS go FROM s)
SELECT l_orderkey, l_linenumber, round(f, 9) AS score, f >= 0.55::DOUBLE AND v >= gv AND c >= gc AND o >= go AS matched, (v < gv)::INT + (c < gc)::INT + (o < go)::INT AS n_warnings FROM g""",
    "topk_stable": """SELECT * FROM (SELECT p_brand, p_partkey AS kp_idx, p_size AS stability, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 10""",
    "ignored_regions": """WITH k AS (SELECT p_brand, p_partkey AS kp_idx, p_partkey % 100 AS x, p_size AS y FROM part)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k r WHERE r.p_brand = k.p_brand AND r.kp_idx % 37 = 0 AND k.x BETWEEN r.x AND r.x + 10 AND k.y BETWEEN r.y AND r.y + 10)""",
    "view_stability": """WITH p AS (SELECT p_brand, p_partkey AS kp_idx, p_partkey * 7 % 500 AS x, p_partkey * 13 % 300 AS y FROM part),
d AS (SELECT p_brand, p_partkey * 11 % 500 AS x, p_size * 6 AS y FROM part WHERE p_size > 25)
SELECT p_brand, kp_idx, (y < 290 AND EXISTS (SELECT 1 FROM d WHERE d.p_brand = p.p_brand AND (d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y) <= 25))::BIGINT AS stability FROM p""",
    "histogram": """WITH b AS (SELECT l_returnflag, floor(l_quantity)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM b""",
    "availability_check": f"""WITH {CHOSEN} SELECT source_row, array_to_string(list_filter([
  CASE WHEN rk.key = '' AND validated THEN 'Impossible de valider sans Nom PDF' END,
  CASE WHEN rk.key <> '' AND rk.key NOT LIKE '%.pdf' THEN 'Le nom du PDF doit se terminer par .pdf' END,
  CASE WHEN rk.key <> '' AND rk.key NOT IN (SELECT pdf_name FROM a) THEN 'Le fichier PDF est introuvable dans sep/' END,
  CASE WHEN n > 1 THEN 'Le même PDF est utilisé plusieurs fois' END,
  CASE WHEN manual AND NOT has_distributor THEN 'Distributeur obligatoire pour une ligne manuelle' END,
  CASE WHEN manual THEN 'Cote obligatoire pour une ligne manuelle' END], lambda m: m IS NOT NULL), '; ') AS validation_error FROM rk LEFT JOIN u USING (key)""",
    "orphan_report": f"""WITH {CHOSEN} SELECT CASE WHEN length(pdf_name) % 2 = 0 THEN upper(pdf_name) ELSE pdf_name END AS pdf_name,
  CASE WHEN length(pdf_name) % 2 = 0 THEN 'seen' ELSE 'PDF présent dans sep/ mais non référencé' END AS reason, CASE WHEN pdf_name LIKE '%1.pdf' THEN 'note' ELSE '' END AS review_note
FROM a WHERE pdf_name NOT IN (SELECT key FROM u)""",
    "effective_status": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Validé' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'sep/' || o_orderkey || '.pdf' ELSE '' END AS link FROM orders""",
    "template_upsert": """WITH n AS (SELECT p_partkey + 100 AS p_partkey, 'new' AS p_name, p_size FROM part WHERE p_size > 25)
SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT * FROM n""",
    "template_delete": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "progress_thinning": f"""WITH {EVENT_PAGES}, t AS (SELECT *, count(*) OVER (PARTITION BY lot_id) AS total FROM e)
SELECT lot_id, page_number FROM t WHERE page_number = total OR total <= 20 OR page_number <= 5 OR page_number % 10 = 0""",
    "json_config": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS threshold FROM events",
}
ORACLES["orphan_lines"] = f"SELECT * FROM ({ORACLES['orphan_report']}) ORDER BY pdf_name LIMIT 19"
