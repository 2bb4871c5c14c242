"""Queries of the reconciliation engine over the test tables, and the DuckDB SQL each is held against.

Roles: conversations are lots of pages (turn + 1 is the page, a user turn starts a document), documents and benchmark
items are page texts and manifest texts, orders and customers keyed rows, lineitem boxes and scores, events pages of
a long scan, embeddings descriptors. In the `lot` queries each order is a lot whose lines are its pages and manifest
rows, with signs of a match made from their numbers, so that SQL can follow linkage, assignment and outputs whole.
Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotloom.functions import boxes, scores, text
from lotloom.operators import assignment, descriptors, linkage, reconciliation, report, segments, zones
from lotloom.plans.oracles import ORACLES
from lotloom.sources import files
from lotloom.streaming.pages import classified



def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("lot_id"), (F.col("turn") + 1).alias("page_number"), "role", F.col("text").alias("ocr_raw")
    )


def text_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm"))


def text_compact_digits(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.lit("d").alias("side"), F.col("doc_id").alias("id"), "text")
    pages = _t(spark, sf_dir, "pages").select(F.lit("p").alias("side"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("side", "id", F.char_length(text.compact(F.col("text"))).cast("long").alias("n_compact"), text.digits(F.col("text")).alias("digits"))


def order_variants(spark, sf_dir):
    key = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.order_variants(key), "|").alias("variants"))


def keyword_match(spark, sf_dir):
    norm = F.col("norm")
    found = text.found_keywords(norm)
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm")).select(
        "doc_id", F.size(found).alias("n_found"), F.array_join(text.missing_keywords(found), "|").alias("missing"), text.is_first_page(norm, 1).alias("is_start")
    )


def start_page_filter(spark, sf_dir):
    return classified(_pages(spark, sf_dir), 1).where("is_new_document").select("lot_id", "page_number")


def segment_ranges(spark, sf_dir):
    return segments.ranges(_pages(spark, sf_dir), F.col("role") == "user")


def segment_with_leading(spark, sf_dir):
    return segments.ranges_with_leading(_pages(spark, sf_dir), F.col("role") == "assistant")


def ranges_from_starts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    starts = pages.where("role = 'assistant'").select("lot_id", "page_number").unionByName(pages.where("role = 'user'").select("lot_id", (F.col("page_number") + 1).alias("page_number")))
    return segments.ranges_from_starts(starts, segments.totals(pages, "lot_id"))


def first_page_lookup(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    docs = segments.ranges(pages, F.col("role") == "user")
    return segments.with_first_page(docs, pages.select("lot_id", "page_number", F.char_length("ocr_raw").cast("long").alias("n_chars")))


def _event_pages(spark, sf_dir) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("lot_id"), F.row_number().over(by_user).cast("long").alias("page_number"), "event_type")


def long_gaps(spark, sf_dir):
    pages = _event_pages(spark, sf_dir)
    return segments.long_gaps(pages.where("event_type = 'signup'"), segments.totals(pages, "lot_id"))


def leading_pages_check(spark, sf_dir):
    return segments.start_issues(_event_pages(spark, sf_dir), F.col("event_type") == "signup")


def exact_link(spark, sf_dir):
    """Documents that hold a whole benchmark item."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("page"))
    keys = _t(spark, sf_dir, "benchmark").select("item_id", text.compact(F.col("text")).alias("key"))
    return linkage.contained_links(docs, keys, "doc_id", "page", "item_id", "key")


def number_link(spark, sf_dir):
    """Documents that hold a variant of an order's number (keys of four characters)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("page"))
    key = F.lpad((F.col("o_orderkey") % 5000).cast("string"), 4, "0")
    keys = _t(spark, sf_dir, "orders").select(key.alias("order")).distinct().select("order", F.explode(text.order_variants(F.col("order"))).alias("key"))
    return linkage.contained_links(docs, keys, "doc_id", "page", "order", "key").distinct()


#: Lines that one task takes, so that its memory does not grow with the table.
LINES_AT_ONCE = 125_000


def _by_lot(lines: DataFrame) -> DataFrame:
    """lines dealt over tasks by lot: all that follows stays there, as it meets, is ranked and counted in its lot."""
    n = max(lines.sparkSession.sparkContext.defaultParallelism, lines.count() // LINES_AT_ONCE + 1)
    return lines.repartition(n, "l_orderkey")


def _lot_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages and manifest rows: each order is a lot, its lines are pages, and those of a larger quantity rows."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    lines = _by_lot(_t(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("lot_id"), place.alias("n"), "l_partkey", "l_suppkey", "l_quantity")
    pages = lines.select("lot_id", F.col("n").alias("page_number"), (F.col("l_partkey") % 4 > 0).alias("is_new_document"), F.when(F.col("l_suppkey") % 10 > 0, F.lit("x")).alias("compact"))
    key = lambda k: (F.col("l_suppkey") % k).cast("string")
    rows = lines.where("l_quantity > 10").select(
        "lot_id", F.col("n").alias("row_number"), F.concat(F.lit("N "), key(3)).alias("commande"), key(2).alias("client_number"), F.concat(F.lit("Été "), key(2)).alias("distributeur"),
        F.lit("c").alias("client"), F.lit(None).cast("string").alias("cote"), F.lit("1").alias("caisse"),
    )
    return pages, rows


def _lot_pairs(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """documents with the rows of their lot and the four signs, from numbers instead of texts."""
    k = F.col("doc_index") * 31 + F.col("row_number") * 17 + F.col("lot_id")
    return documents.join(rows, "lot_id").withColumns(
        {"order_exact": k % 4 == 0, "client_exact": k % 3 == 0, "client_score": k % 5 / 4, "distributor_score": k % 7 / 5}
    ).withColumns({"client_score": F.least("client_score", F.lit(1.0)), "distributor_score": F.least("distributor_score", F.lit(1.0))})


def _strict(spark, sf_dir) -> dict[str, DataFrame]:
    pages, rows = _lot_tables(spark, sf_dir)
    documents = segments.ranges(pages, F.col("is_new_document"), first=F.col("compact")).withColumnRenamed("first_page", "first_page_compact")
    candidates = linkage.strict_candidates(_lot_pairs(documents.where("first_page_compact IS NOT NULL"), rows))
    claims = linkage.strict_assignments(documents, candidates)
    issues = reconciliation.validation_issues(pages, F.col("is_new_document"), documents, rows, claims)
    return {"pages": pages, "rows": rows, "documents": documents, "candidates": candidates, "claims": claims, "issues": issues}


def strict_rank(spark, sf_dir):
    return _strict(spark, sf_dir)["candidates"].select("lot_id", "doc_index", "row_number", F.round("score", 6).alias("score"), "qualifies", "n_matched", F.col("rank").cast("long").alias("rank"), "n_accepted")


def duplicate_claims(spark, sf_dir):
    return _strict(spark, sf_dir)["claims"].select("lot_id", "doc_index", "n_accepted", "claimed_row", "n_claims", "assigned_row", "blocked_reason")


def strict_issues(spark, sf_dir):
    return _strict(spark, sf_dir)["issues"]


def lot_summary(spark, sf_dir):
    s = _strict(spark, sf_dir)
    return reconciliation.lot_summary(s["pages"], s["rows"], s["documents"], s["claims"], s["issues"])


def duplicate_rows(spark, sf_dir):
    return linkage.duplicate_rows(_lot_tables(spark, sf_dir)[1]).select("lot_id", "row_number", "is_duplicate")


def fuzzy_link(spark, sf_dir):
    """Region names in nation names, by best-window similarity: all nations with all regions."""
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", text.compact(F.col("n_name")).alias("page"))
    from lotloom.functions.similarity import window_similarity

    regions = _t(spark, sf_dir, "region").select(F.col("r_regionkey"), text.compact(F.col("r_name")).alias("key")).hint("broadcast")  # five rows
    met = nations.crossJoin(regions)
    return met.select("n_nationkey", "r_regionkey", window_similarity(F.col("key"), F.col("page")).alias("w")).select("n_nationkey", "r_regionkey", "w.score", "w.occurrence")


def _scored(spark, sf_dir) -> DataFrame:
    """Pairs of an order (document) and a line (row) with signs and scores from whole-number arithmetic."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("row_number"),
        (k % 3 == 0).alias("order_exact"), (k % 5 < 2).alias("client_exact"),
        ((F.col("l_quantity").cast("long") * 2) % 101 / 100).alias("client_score"), (F.col("l_suppkey") % 101 / 100).alias("distributor_score"),
    )


def recon_score(spark, sf_dir):
    four = [F.col(c) for c in ("order_exact", "client_exact", "client_score", "distributor_score")]
    raw = scores.global_score(*four)
    return _scored(spark, sf_dir).select(
        "doc", "line", linkage.rounded(raw, 3).alias("global_score"), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(raw, 6)).cast("int"))).alias("percent"),
        scores.exact_match(*four).alias("is_exact"), F.array_join(text.to_verify(*four), "; ").alias("verify"),
    )


def strict_score(spark, sf_dir):
    four = [F.col(c) for c in ("order_exact", "client_exact", "distributor_score", "client_score")]
    return _scored(spark, sf_dir).where(scores.strict_emitted(*four)).select(
        "doc", "line", F.round(scores.strict_score(*four), 6).alias("score"), scores.strict_qualifies(*four).alias("qualifies")
    )


def mutual_best(spark, sf_dir):
    """Suppliers and parts that are each other's best by number of lines."""
    pairs = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("score"))
    return assignment.best_mutual(pairs, "l_suppkey", "l_partkey", [F.col("score").desc(), F.col("l_suppkey"), F.col("l_partkey")])


def _reconciled(spark, sf_dir) -> dict[str, DataFrame]:
    """Nothing is kept: pairs are made from numbers where their lot lies, and each output reads them once."""
    pages, rows = _lot_tables(spark, sf_dir)
    documents = segments.ranges_with_leading(pages, F.col("is_new_document")).withColumn("file_name", F.concat(F.col("doc_index").cast("string"), F.lit(".pdf")))
    return {"documents": documents, "rows": rows, "candidates": linkage.recon_candidates(_lot_pairs(documents, linkage.duplicate_rows(rows)))}


def recon_rank(spark, sf_dir):
    """All candidates with scores and both ranks, and whether the second of a document has the first one's score."""
    c = _reconciled(spark, sf_dir)["candidates"]
    following = F.lead("global_score").over(Window.partitionBy("lot_id", "doc_index").orderBy(*linkage.best_first()))
    return c.select(
        "lot_id", "doc_index", "row_number", "global_score", "global_percent", "is_exact", "client_percent", "distributor_percent", F.array_join("verify_fields", "; ").alias("verify"),
        F.col("rank_for_doc").cast("long").alias("rank_for_doc"), F.col("rank_for_row").cast("long").alias("rank_for_row"), F.coalesce(F.col("global_score") == following, F.lit(False)).alias("tie"),
    )


def greedy_assign(spark, sf_dir):
    return assignment.assign(_reconciled(spark, sf_dir)["candidates"])


def unassigned_rows(spark, sf_dir):
    r = _reconciled(spark, sf_dir)
    return reconciliation.unassigned(r["rows"], r["documents"], assignment.settled(r["candidates"]), "row", "row_number")


def unassigned_docs(spark, sf_dir):
    r = _reconciled(spark, sf_dir)
    left = reconciliation.unassigned(r["documents"], r["rows"], assignment.settled(r["candidates"]), "doc", "doc_index")
    return left.select("lot_id", F.col("doc_index").cast("long").alias("doc_index"))


def row_output(spark, sf_dir):
    r = _reconciled(spark, sf_dir)
    return reconciliation.row_output(r["rows"], r["documents"], reconciliation.settled(r["candidates"]))


def document_output(spark, sf_dir):
    r = _reconciled(spark, sf_dir)
    return reconciliation.document_output(r["documents"], r["rows"], reconciliation.settled(r["candidates"]))


def recon_summary(spark, sf_dir):
    r = _reconciled(spark, sf_dir)
    return reconciliation.summary(reconciliation.row_output(r["rows"], r["documents"], reconciliation.settled(r["candidates"])), r["documents"])


def _lots(spark, sf_dir) -> dict[str, DataFrame]:
    """Reconciliation of conversations. Manifest names are cut from user texts, so that some are found whole and some nearly."""
    from lotloom.plans.lots import reconcile_lots

    pages = _pages(spark, sf_dir).withColumn("ocr_compact", text.compact(F.coalesce("ocr_raw", F.lit(""))))
    rows = pages.where("role = 'user'").select(
        "lot_id", (F.row_number().over(Window.partitionBy("lot_id").orderBy("page_number")) + 1).cast("long").alias("row_number"),
        F.format_string("%06d", F.col("lot_id")).alias("commande"), F.col("page_number").cast("string").alias("client_number"),
        F.substring("ocr_raw", 1, 12).alias("distributeur"), F.substring("ocr_raw", 5, 10).alias("client"), F.lit("1").alias("cote"), F.lit("2").alias("caisse"),
    )
    return reconcile_lots(pages, rows, F.col("role") == "user")


def reconciliation_summary(spark, sf_dir):
    return _lots(spark, sf_dir)["summary"]


def strict_analysis(spark, sf_dir):
    """Issues of strict validation of conversations as lots, whose manifests are their first user texts."""
    from lotloom.plans.lots import Config, analyze_lots

    pages = _pages(spark, sf_dir)
    rows = pages.where("role = 'user'").select(
        "lot_id", (F.col("page_number") + 1).alias("row_number"), F.col("lot_id").cast("string").alias("commande"), F.col("page_number").cast("string").alias("client_number"),
        F.substring("ocr_raw", 1, 10).alias("distributeur"), F.substring("ocr_raw", 5, 10).alias("client"), F.lit("").alias("cote"), F.lit("").alias("caisse"),
    )
    return analyze_lots(pages.drop("role"), rows, Config(min_keywords=1))["issues"]


def _words(spark, sf_dir) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    return line.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.concat(F.lit("w"), p.cast("string")).alias("text"),
        (q / 50.0).alias("confidence"), (p % 200).alias("x"), (F.col("l_suppkey") * 7 % 120).alias("y"), (q % 30 + 5).alias("width"), (p % 11 + 4).alias("height"),
        F.lit(0).alias("block_num"), (F.col("l_linenumber") % 2).alias("par_num"), F.col("l_linenumber").alias("line_num"),
    )


def _zones(spark, sf_dir) -> DataFrame:
    region = _t(spark, sf_dir, "region").select(
        F.lower("r_name").alias("zone_name"), F.when(F.col("r_regionkey") % 2 == 0, F.lit("text")).otherwise(F.lit("number")).alias("zone_type"),
        (F.col("r_regionkey") * 40).alias("x"), (F.col("r_regionkey") * 20).alias("y"), F.lit(60).alias("width"), F.lit(40).alias("height"), (F.col("r_regionkey") < 2).alias("required"),
    )
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).crossJoin(F.broadcast(region))  # one template of five zones


def zone_words(spark, sf_dir):
    return zones.zone_hits(_words(spark, sf_dir), _zones(spark, sf_dir)).select("doc_id", "zone_name", "id", F.round("overlap", 6).alias("overlap"), "centred", F.round("hit", 6).alias("hit"))


def zone_text(spark, sf_dir):
    return zones.extract_fields(_words(spark, sf_dir), _zones(spark, sf_dir)).select(
        "doc_id", "zone_name", "value", F.round("confidence", 6).alias("confidence"), F.coalesce("warning", F.lit("")).alias("warning"), F.size("word_ids").alias("n_words")
    )


def zone_missing(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return zones.missing_required(zones.extract_fields(_words(spark, sf_dir), z), z).select("doc_id", "zone_name")


def page_lines(spark, sf_dir):
    return zones.with_lines(_words(spark, sf_dir), "doc_id").select("doc_id", "id", "line_num")


def zone_normalize(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("text", "number", "date", "alphanumeric"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.zone_value(F.col("text"), kind).cast("binary")).alias("value_md5"))


def box_normalize(spark, sf_dir):
    x1, x2 = F.col("l_partkey") % 300, F.col("l_suppkey") * 3 % 300
    box = boxes.from_corners(x1, F.col("l_quantity"), x2, F.col("l_quantity") + F.col("l_linenumber"))
    conf = boxes.confidence(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_discount")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"), F.round(conf, 6).alias("confidence")).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.*", "confidence")


def median_height(spark, sf_dir):
    return zones.line_threshold(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("height"))).select(F.col("doc_id").alias("p_brand"), F.round("threshold", 6).alias("threshold"))


def _descriptors(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", descriptors.sign_bits(F.col("embedding"), 64).alias("descriptor"))


def hamming_knn(spark, sf_dir):
    """Two nearest of every vector among the others of its label, over all components."""
    d = _descriptors(spark, sf_dir)
    return descriptors.nearest_two(d.withColumnRenamed("vec_id", "query_id"), d.withColumnRenamed("vec_id", "train_id"), "label")


def good_matches(spark, sf_dir):
    return descriptors.good_matches(hamming_knn(spark, sf_dir), "label", ratio=0.9)


def weighted_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(
        "p_brand", (F.col("p_size") / 50.0).alias("score"), (F.col("p_partkey") % 5 + 1).alias("weight"), (F.col("p_partkey") % 3 == 0).alias("critical")
    )
    return scores.weighted_scores(rows, ["p_brand"]).select("p_brand", F.round("visual", 6).alias("visual"), F.round("critical", 6).alias("critical"))


def region_score(spark, sf_dir):
    p = F.col("p_size")
    hashes = scores.hash_score({"phash": p / 50.0, "dhash": F.when(p % 3 > 0, p / 40.0), "whash": F.lit(0.5)})
    edges = scores.edge_score(p / 100.0, F.lit(0.2))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(scores.region_score(hashes, p / 60.0, edges), 6).alias("score"))


def hybrid_gate(spark, sf_dir):
    visual, critical = F.col("l_quantity") / 50.0, F.col("l_suppkey") % 100 / 100.0
    orb = scores.confirmation(F.col("l_linenumber") > 1, F.col("l_discount") * 10, F.col("l_partkey") % 60)
    t = F.lit(0.55)
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scores.hybrid_score(visual, orb), 9).alias("score"), scores.hybrid_matched(visual, critical, orb, t).alias("matched"),
        F.size(scores.hybrid_warnings(visual, critical, orb, t)).alias("n_warnings"),
    )


def topk_stable(spark, sf_dir):
    kp = _t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("kp_idx"), F.col("p_size").alias("stability"))
    return descriptors.most_stable(kp, "p_brand", 10).select("p_brand", "kp_idx", "stability", F.col("place").cast("long").alias("place"))


def ignored_regions(spark, sf_dir):
    """Parts as keypoints that lie in no region of their brand."""
    kp = _t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("kp_idx"), (F.col("p_partkey") % 100).alias("x"), F.col("p_size").alias("y"))
    regions = kp.where("kp_idx % 37 = 0").select("p_brand", "x", "y", F.lit(10).alias("width"), F.lit(10).alias("height"))
    return descriptors.outside_regions(kp, regions, "p_brand")


def view_stability(spark, sf_dir):
    """Parts as keypoints, lines as detections in one view of each brand."""
    part = _t(spark, sf_dir, "part")
    projected = part.select("p_brand", F.lit(0).alias("view"), F.col("p_partkey").alias("kp_idx"), (F.col("p_partkey") * 7 % 500).alias("x"), (F.col("p_partkey") * 13 % 300).alias("y"), F.lit(500).alias("width"), F.lit(290).alias("height"))
    detected = part.where("p_size > 25").select("p_brand", F.lit(0).alias("view"), (F.col("p_partkey") * 11 % 500).alias("x"), (F.col("p_size") * 6).alias("y"))
    return descriptors.stability(projected, detected, "p_brand", 5)


def histogram(spark, sf_dir):
    return descriptors.histogram(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", "bin", "n", F.round("share", 6).alias("share"))


def _chosen(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows that name a customer's file, and the files there are."""
    rows = _t(spark, sf_dir, "orders").select(
        F.lit(1).alias("lot_id"), F.col("o_orderkey").alias("source_row"),
        F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit(" C"), (F.col("o_custkey") * 2).cast("string"), F.when(F.col("o_orderkey") % 9 == 0, ".txt").otherwise(".PDF"))).otherwise(F.lit(" ")).alias("pdf_name"),
        F.when(F.col("o_orderstatus") == "F", "Validé").otherwise("").alias("validation_operator"), F.when(F.col("o_orderkey") % 25 == 0, "Oui").otherwise("non").alias("manual"),
        F.col("o_orderstatus").alias("commande"), F.lit("1").alias("client_number"), F.when(F.col("o_custkey") % 2 == 0, "d").otherwise(" ").alias("distributeur"),
        F.lit("c").alias("client"), F.lit("").alias("cote"), F.lit("9").alias("caisse"),
    )
    available = _t(spark, sf_dir, "customer").select(F.lit(1).alias("lot_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("pdf_name"))
    return rows, available


def availability_check(spark, sf_dir):
    rows, available = _chosen(spark, sf_dir)
    return report.row_errors(rows, available).select("source_row", "validation_error")


def orphan_report(spark, sf_dir):
    rows, available = _chosen(spark, sf_dir)
    details = available.where("length(pdf_name) % 2 = 0").select("lot_id", F.upper("pdf_name").alias("pdf_name"), F.lit("seen").alias("reason"))
    notes = available.where("pdf_name LIKE '%1.pdf'").select("lot_id", "pdf_name", F.lit("note").alias("review_note"))
    return report.orphans(available, rows, details, notes).drop("lot_id")


def orphan_lines(spark, sf_dir):
    return report.report_lines(orphan_report(spark, sf_dir), ["pdf_name"], report.ORPHAN_LINES)


def effective_status(spark, sf_dir):
    system = F.col("o_orderstatus")
    operator = F.when(F.col("o_orderkey") % 3 == 0, report.VALIDATED)
    pdf = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", report.effective_status(operator, pdf, system).alias("status"), report.link(pdf).alias("link"))


def template_upsert(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_size > 25").select((F.col("p_partkey") + 100).alias("p_partkey"), F.lit("new").alias("p_name"), "p_size")
    return files.upserted(part, new, "p_partkey")


def template_delete(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return files.deleted(part, _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")


def progress_thinning(spark, sf_dir):
    pages = _event_pages(spark, sf_dir).join(segments.totals(_event_pages(spark, sf_dir), "lot_id"), "lot_id")
    return pages.where(segments.thinned(F.col("page_number"), F.col("total_pages"))).select("lot_id", "page_number")


def json_config(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", files.workspace_config(F.replace("props", F.lit('"k"'), F.lit('"paperThreshold"')))["paper_threshold"].alias("threshold"))


def separate_orb(spark, sf_dir):
    """Lines as pages with alignment results: scores, matches and document ranges of the geometric method."""
    from lotloom.plans.lots import Config, separate

    return separate(_features(spark, sf_dir), Config(method="orb", threshold=0.4))["documents"]


def _features(spark, sf_dir) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lot_id"), place.alias("page_number"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_partkey") % 3 > 0).alias("success"), (F.col("l_suppkey") % 100 / 100.0).alias("inlier_ratio"),
        (F.col("l_partkey") % 60).alias("matches_used"), (F.col("l_quantity") / 50.0).alias("visual"), (F.col("l_suppkey") * 7 % 100 / 100.0).alias("critical"),
    )


def separate_orb_pages(spark, sf_dir):
    from lotloom.plans.lots import Config, separate

    return separate(_features(spark, sf_dir), Config(method="orb", threshold=0.4))["pages"].select("lot_id", "page_number", F.round("score", 6).alias("score"), "matched")


def separate_hybrid(spark, sf_dir):
    from lotloom.plans.lots import Config, separate

    out = separate(_features(spark, sf_dir), Config(method="visual-structural"))["pages"]
    return out.select("lot_id", "page_number", F.round("orb", 9).alias("orb"), F.round("score", 9).alias("score"), "matched", F.size("warnings").alias("n_warnings"), F.coalesce(F.get("warnings", F.lit(0)), F.lit("")).startswith("Skipped").alias("skipped"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation, linkage, assignment and counts, end to end."""
    return reconciliation_summary(spark, sf_dir)


_OWN = (
    text_normalize, text_compact_digits, order_variants, keyword_match, start_page_filter, segment_ranges, segment_with_leading, ranges_from_starts,
    first_page_lookup, long_gaps, leading_pages_check, exact_link, number_link, strict_rank, duplicate_claims, strict_issues, lot_summary, duplicate_rows,
    fuzzy_link, recon_score, strict_score, recon_rank, mutual_best, greedy_assign, unassigned_rows, unassigned_docs, row_output, document_output,
    recon_summary, reconciliation_summary, strict_analysis, separate_orb, separate_orb_pages, separate_hybrid, zone_words, zone_text, zone_missing,
    page_lines, zone_normalize, box_normalize, median_height, hamming_knn, good_matches, weighted_scores, region_score, hybrid_gate, topk_stable,
    ignored_regions, view_stability, histogram, availability_check, orphan_report, orphan_lines, effective_status, template_upsert, template_delete,
    progress_thinning, json_config,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
