"""Linkage against difflib, whole jobs, sources and streams."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lotloom.functions.similarity import window_similarity
from lotloom.operators import descriptors, linkage
from lotloom.plans.lots import SKIPPED, Config, analyze_lots, reconcile_lots, separate
from lotloom.sources import files
from lotloom.streaming.pages import document_events

PAGE = "bon de commande du vendeur distributeur "
MANIFEST = "row_number long, commande string, client_number string, distributeur string, client string, cote string, caisse string"


def _best(key, page):
    """Highest ratio over all windows, and the first window that has it."""
    if not key or not page:
        return 0.0, ""
    if len(page) <= len(key):
        return (1.0, key) if key in page else (round(SequenceMatcher(None, key, page).ratio(), 6), page)
    if key in page:
        return 1.0, key
    rated = [(SequenceMatcher(None, key, page[i : i + len(key)]).ratio(), -i) for i in range(len(page) - len(key) + 1)]
    top, at = max(rated)
    return round(top, 6), page[-at : -at + len(key)]


def test_window_similarity_is_that_of_all_windows(spark):
    rng = random.Random(1)
    page = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    pairs = [("", "abc"), ("abc", ""), ("abcd", "ab"), (None, "x"), ("x", None)]
    for _ in range(120):
        p = page(rng.randint(1, 60))
        at = rng.randrange(len(p))
        k = list(p[at : at + rng.randint(1, 12)])
        for _ in range(rng.randint(0, 2)):  # near misses
            k[rng.randrange(len(k))] = rng.choice("abcdez")
        pairs.append(("".join(k), p))
    df = spark.createDataFrame(pairs, "k string, p string")
    for r in df.select("k", "p", window_similarity(F.col("k"), F.col("p")).alias("w")).collect():
        score, where = _best(r.k or "", r.p or "")
        assert r.w.score == score and (score == 0 or r.w.occurrence == where), r


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_contained_links_of_any_length(spark, chunk):
    docs = spark.createDataFrame([(1, "xxabcdefyy"), (2, "bcd"), (3, None), (4, ""), (5, "bcdbcd")], "doc long, page string")
    keys = spark.createDataFrame([("a", "bcd"), ("b", "abcdef"), ("c", "q"), ("d", None), ("e", ""), ("f", "bcd"), ("g", "y")], "id string, key string")
    got = linkage.contained_links(docs, keys, "doc", "page", "id", "key", chunk).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b"), (1, "f"), (1, "g"), (2, "a"), (2, "f"), (5, "a"), (5, "f")]
    assert linkage.contained_links(docs, keys.limit(0), "doc", "page", "id", "key").count() == 0


def test_rounded_as_python(spark):
    values = [0.0005, 2.6755, 1.0005, 0.5, 12.3455, 99.9995, 1 / 3, 33.25, 0.0, 1e-9, 2.0015]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select("v", linkage.rounded(F.col("v"), 3).alias("r")).collect()] == [round(v, 3) for v in values]


def test_duplicate_rows(spark):
    rows = spark.createDataFrame([("a", 1, "N 01", "7", "Été", "c", None, None), ("a", 2, "01", "7", "ete", "C", "", ""), ("b", 3, "01", "7", "ete", "C", "", "")], f"lot_id string, {MANIFEST}")
    assert [r.is_duplicate for r in linkage.duplicate_rows(rows).orderBy("row_number").collect()] == [True, True, False]


def test_reconcile_lots(spark):
    """A near-miss name, two rows alike, a document without a row, and another lot that must not mix in."""
    pages = spark.createDataFrame([
        ("a", 1, True, PAGE + "n 0451 client 77 dupont freres paris garage central"),
        ("a", 2, False, "suite"),
        ("a", 3, True, PAGE + "n 0999 client 12 martin lyon station nord"),
        ("a", 4, True, PAGE + "rien"),
        ("b", 1, True, PAGE + "n 0451 client 77 dupont freres paris garage central"),
    ], "lot_id string, page_number long, is_start boolean, ocr_raw string").withColumn("ocr_compact", F.replace("ocr_raw", F.lit(" "), F.lit("")))
    rows = spark.createDataFrame([
        ("a", 2, "0451", "77", "Garage Central", "Dupond Frères Paris", "", ""),
        ("a", 3, "0999", "12", "Station Nord", "Martin Lyon", "", ""),
        ("a", 4, "0999", "12", "station nord", "MARTIN LYON", "", ""),
    ], f"lot_id string, {MANIFEST}")
    out = reconcile_lots(pages, rows, F.col("is_start"))
    lines = {r.source_row: r for r in out["rows"].collect()}
    assert (lines[2].status, lines[2].pdf_name, lines[2].commande_exact, lines[2].match_type, lines[2].page_count) == ("OK", "1.pdf", "oui", "exact", 2)
    assert lines[2].client_percent == 94 and lines[3].status == lines[4].status == "Ambigu" and lines[3].diagnostic_reason == "Doublon possible"
    docs = {(r.lot_id, r.pdf_name): r.status for r in out["document_lines"].collect()}
    assert docs == {("a", "1.pdf"): "Affecté", ("a", "2.pdf"): "Ambigu", ("a", "3.pdf"): "Non affecté", ("b", "1.pdf"): "Non affecté"}
    assert {(r.lot_id, r.csv_row_count, r.auto_assigned_count, r.ambiguous_count, r.generated_pdf_count) for r in out["summary"].collect()} == {("a", 3, 1, 2, 3), ("b", 0, 0, 0, 1)}


def test_analyze_lots_field_results(spark):
    pages = spark.createDataFrame([("a", 1, PAGE + "n 0451 client 77 dupont garage central"), ("a", 2, "suite")], "lot_id string, page_number long, ocr_raw string")
    rows = spark.createDataFrame([("a", 2, "0451", "77", "Garage Central", "Dupont", "", ""), ("a", 3, "0888", "77", "Autre", "Durand", "", "")], f"lot_id string, {MANIFEST}")
    out = analyze_lots(pages, rows, Config(min_keywords=3))
    best, second = out["candidates"].orderBy("rank").collect()
    assert best.qualifies and [(f.field, f.matched, f.normalized, f.occurrence) for f in best.fields] == [
        ("commande", True, "0451 | f451", "0451"), ("client_number", True, "77", "77"),
        ("distributeur", True, "garagecentral", "garagecentral"), ("client", True, "dupont", "dupont"),
    ]
    assert [f.matched for f in second.fields] == [False, True, False, False] and second.fields[0].occurrence is None
    assert [(r.doc_index, r.assigned_row, r.blocked_reason) for r in out["documents"].collect()] == [(1, 2, None)]


def test_separate(spark):
    features = spark.createDataFrame([("a", 1, True, 0.9, 40, 0.8, 0.9), ("a", 2, False, 0.9, 40, 0.2, 0.9), ("a", 3, None, None, None, 0.5, 0.1)], "lot_id string, page_number long, success boolean, inlier_ratio double, matches_used int, visual double, critical double")
    orb = separate(features, Config())["pages"].orderBy("page_number").collect()
    assert [(r.score, r.matched) for r in orb] == [(0.9, True), (0.0, False), (0.0, False)]
    hybrid = separate(features, Config(method="hybrid"))["pages"].orderBy("page_number").collect()
    assert [r.matched for r in hybrid] == [True, False, False] and hybrid[1].warnings[0] == SKIPPED and SKIPPED not in hybrid[2].warnings


def test_manifests(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes("N° Commande;N° Client\n".encode())
    head = ";".join(files.MANIFEST)
    for name, body, said in (("1.csv", b"", "empty"), ("1.csv", head.encode(), "no rows"), ("1.csv", b"a;b\n1;2", "lacks")):
        (tmp_path / name).write_bytes(body)
        with pytest.raises(Exception, match=said):
            files.read_manifests(spark, f"file://{tmp_path}").collect()
    (tmp_path / "1.csv").write_bytes(("﻿" + head + "\n\n" + ";".join(f' "é{i}" ' if i else " 001 " for i in range(len(files.MANIFEST))) + "\n").encode("utf-8"))
    row = files.read_manifests(spark, f"file://{tmp_path}").collect()[0]
    assert row.lot_id == "1" and row.row_number == 2 and row[2] == "001"


def test_pages_of(spark):
    df = spark.createDataFrame([("a", bytearray(b"5"), None), ("b", bytearray(b"x"), None), ("c", bytearray(b"0"), None), ("d", None, "empty")], "path string, content binary, problem string")

    def render(content, page, dpi):
        if page == 4:
            raise ValueError("torn")
        return f"{page}@{dpi}".encode()

    got = {(r.path, r.page_number): (r.image and bytes(r.image), r.problem) for r in files.pages_of(df, lambda b: int(b), render, 90, at_once=2).collect()}
    assert set(got) == {("a", i) for i in range(1, 6)} | {("b", 0)} and got["a", 5] == (b"5@90", None) and got["a", 4] == (None, "torn") and "invalid literal" in got["b", 0][1]


def test_document_events_forget_complete_lots(spark, tmp_path):
    schema = "lot_id string, page_number long, is_new_document boolean, is_last boolean"
    (tmp_path / "in").mkdir()
    events = document_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in"), F.col("is_last"))
    batches = [[("a", 1, False, False), ("a", 2, True, False)], [("a", 3, False, False), ("a", 4, True, True)], [("a", 1, True, True)]]
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(f'{{"lot_id":"{a}","page_number":{p},"is_new_document":{str(n).lower()},"is_last":{str(x).lower()}}}' for a, p, n, x in rows))
        query = events.writeStream.format("json").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.schema("lot_id string, type string, doc_index long, start_page long, end_page long, page_number long").json(f"file://{tmp_path}/out")
    documents = sorted((r.doc_index, r.start_page, r.end_page) for r in got.where("type = 'document'").collect())
    assert documents == [(0, 1, 1), (1, 1, 1), (1, 2, 3), (2, 4, 4)]
    assert got.where("type = 'complete'").count() == 2 and got.where("type = 'provisional_document'").count() == 3


def test_nearest_two_in_blocks(spark, monkeypatch):
    """Blocks of a few descriptors against all pairs: ties, own ids, a null descriptor, groups of one and two."""
    rng = random.Random(4)
    rows = [(i, 0 if i < 60 else 1 if i < 62 else i, None if i == 7 else [rng.getrandbits(3), rng.choice((-1, 5, 1 << 62))]) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, label int, descriptor array<long>")
    monkeypatch.setattr(descriptors, "BLOCK", 9)
    out = descriptors.nearest_two(df.withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "train_id"), "label")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    far = lambda a, b: None if a is None or b is None else sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    expected = set()
    for i, label, bits in rows:
        near = sorted(((d := far(bits, other)) is None, d or 0, j, d) for j, own, other in rows if own == label and j != i)[:2]
        expected |= {(label, i, j, d, rank) for rank, (_, _, j, d) in enumerate(near, 1)}
    assert {tuple(r) for r in out.collect()} == expected


def test_outside_regions_meet_in_cells(spark):
    """Regions of all sizes, borders, negative places and nulls, against every pair; only cells meet."""
    rng = random.Random(6)
    points = [(rng.choice("ab"), i, rng.randint(-40, 200), rng.randint(-40, 200)) for i in range(400)] + [("a", 400, None, 3), ("c", 401, 1, 1)]
    areas = [(rng.choice("ab"), rng.randint(-40, 200), rng.randint(-40, 200), rng.choice((0, 1, 3, 8, 17, 64)), rng.choice((0, 2, 5, 16, 40))) for _ in range(30)]
    kp = spark.createDataFrame(points, "template string, kp_idx int, x int, y int")
    regions = spark.createDataFrame(areas, "template string, x int, y int, width int, height int")
    out = descriptors.outside_regions(kp, regions, "template")
    got = sorted(r.kp_idx for r in out.collect())
    assert got == sorted(i for t, i, x, y in points if not any(t == u and x is not None and a <= x <= a + w and b <= y <= b + h for u, a, b, w, h in areas)) and out.columns == kp.columns
    assert "_cx" in out._jdf.queryExecution().optimizedPlan().toString()
