import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotloom.operators import assignment, linkage
from lotloom.operators.assignment import AMBIGUOUS, DUPLICATE, TIE, assign_lot
from lotloom.plans import queries
from lotloom.plans.lots import reconcile_lots


def cand(row, doc, score, exact=False, duplicate=False):
    sig = (0, 0, 0, 0, 0)
    return {"doc": doc, "row": row, "start": doc, "exact": exact, "duplicate": duplicate, "signature": sig, "score": score, "key": (*sig, score, -row, -doc)}


def test_rounds_are_not_one_greedy_pass():
    given, docs, rows = assign_lot([cand(2, 3, 9), cand(2, 2, 8), cand(1, 2, 7), cand(1, 1, 6), cand(1, 3, 2), cand(2, 1, 1)])
    assert given == {3: 2, 1: 1} and not docs and not rows


def test_ties():
    given, docs, rows = assign_lot([cand(1, 1, 5), cand(2, 1, 5)])
    assert not given and docs == {1: TIE} and rows == {1: TIE, 2: TIE}
    assert assign_lot([cand(1, 1, 5, duplicate=True), cand(2, 1, 5, duplicate=True)])[1] == {1: DUPLICATE}
    assert AMBIGUOUS == "Ambigu"


def test_partial_matching_for_any_input():
    rng = random.Random(1)
    for _ in range(200):
        cands = [cand(r, d, rng.randint(0, 6), rng.random() < 0.2) for r in range(4) for d in range(4)]
        given, docs, _ = assign_lot(cands)
        assert len(set(given.values())) == len(given) and not set(given) & set(docs)


def test_lots_settled_side_by_side_are_as_one_by_one(spark, monkeypatch):
    """Random lots with ties, exact candidates, twins and lots cut across batches, against the plain form."""
    rng = random.Random(2)
    lots, rows = {}, []
    for lot in range(300):
        for d in range(rng.randint(1, 5)):
            for r in range(rng.randint(1, 5)):
                lots.setdefault(lot, []).append((d, r + 10, rng.choice((True, False)), rng.choice((True, False)), rng.choice((0, 70, 100)), rng.randint(0, 3) * 1.0, rng.random() < 0.3, rng.random() < 0.3))
        for d, r, o, n, p, g, exact, dup in lots[lot]:
            rows.append((lot, d, r, (d * 7) % 5, o, n, p, 50, g, exact, dup))
    schema = "lot_id int, doc_index int, row_number long, start_page long, order_exact boolean, client_exact boolean, distributor_percent int, client_percent int, global_score double, is_exact boolean, is_duplicate boolean"
    by = lambda c: Window.partitionBy("lot_id", c).orderBy(*linkage.best_first())
    df = spark.createDataFrame(rows, schema).withColumns({"rank_for_doc": F.row_number().over(by("doc_index")), "rank_for_row": F.row_number().over(by("row_number"))})
    monkeypatch.setattr(assignment, "CHUNK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(v.lot_id, v.side, v.id, v.partner, v.reason) for v in assignment.assign(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for lot, cands in lots.items():
        made = []
        for d, r, o, n, p, g, exact, dup in cands:
            sig = (int(o and n), int(o), int(n), p, 50)
            made.append({"doc": d, "row": r, "start": (d * 7) % 5, "exact": exact, "duplicate": dup, "signature": sig, "score": g, "key": (*sig, g, -r, -((d * 7) % 5))})
        given, docs, of_rows = assign_lot(made)
        expected |= {(lot, "doc", d, r, None) for d, r in given.items()} | {(lot, "row", r, d, None) for d, r in given.items()}
        expected |= {(lot, "doc", d, None, why) for d, why in docs.items()} | {(lot, "row", r, None, why) for r, why in of_rows.items() if r not in set(given.values())}
    assert got == expected


@pytest.mark.parametrize("name", ["recon_rank", "greedy_assign", "unassigned_rows", "unassigned_docs", "row_output", "document_output"])
def test_pairs_are_neither_kept_nor_shuffled(spark, name):
    """Only lines move; the pairs made from them stay where their lot lies."""
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "ExistingRDD" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan")


def test_lots_with_one_side_only(spark):
    pages = spark.createDataFrame([("a", 1, True, "x 0451"), ("b", 1, True, "x")], "lot_id string, page_number long, start boolean, ocr_compact string")
    rows = spark.createDataFrame([("a", 2, "451", "1", "d", "c", "", ""), ("c", 2, "451", "1", "d", "c", "", "")], "lot_id string, row_number long, commande string, client_number string, distributeur string, client string, cote string, caisse string")
    out = reconcile_lots(pages, rows, F.col("start"))
    assert {r.lot_id: (r.diagnostic_reason, r.match_type) for r in out["rows"].collect()}["c"] == ("Aucun PDF candidat disponible", "none")
    assert {r.lot_id: (r.reason, r.best_commande) for r in out["document_lines"].collect()}["b"] == ("Aucune ligne candidate n'a été trouvée pour ce PDF", "")


@pytest.mark.parametrize("name", ["strict_rank", "duplicate_claims", "duplicate_rows"])
def test_strict_validation_stays_in_its_lot(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan")


def test_issues_read_the_pairs_once(spark):
    """Only claims have the signs of pairs; every kind of issue that comes from them is told in one reading."""
    plan = queries.queries()["strict_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(queries, "LINES_AT_ONCE", 500)
    assert queries.duplicate_rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 12
