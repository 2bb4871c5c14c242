import random
from statistics import median

from lotloom.operators import zones


def test_fields(spark):
    words = spark.createDataFrame(
        [(1, 0, "A", 0.9, 100, 100, 20, 10, 0, 0, 0), (1, 1, "B", 0.3, 150, 100, 20, 10, 0, 0, 0), (1, 2, "C", 0.9, 151, 100, 20, 10, 0, 0, 0)],
        "doc_id int, id int, text string, confidence double, x int, y int, width int, height int, block_num int, par_num int, line_num int",
    )
    zone = spark.createDataFrame([(1, "z", "text", 100, 100, 50, 20, True), (1, "far", "text", 900, 900, 50, 20, True)], "doc_id int, zone_name string, zone_type string, x int, y int, width int, height int, required boolean")
    got = {r.zone_name: r for r in zones.extract_fields(words, zone).collect()}
    assert got["z"].value == "A B" and got["z"].word_ids == [0, 1] and round(got["z"].confidence, 6) == 0.817241 and got["z"].warning is None
    assert got["far"].value == "" and got["far"].warning == zones.NO_WORDS


def test_lines_of_many_pages_without_a_call_for_each(spark):
    """Pages follow one another through batches; each is read as alone."""
    rng = random.Random(3)
    words = [(page, i, f"w{i}", 0.5, rng.randrange(90), rng.randrange(60), 9, rng.randint(4, 30), 3, 1, 7) for page in range(60) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(words, "doc_id long, id int, text string, confidence double, x long, y long, width long, height long, block_num int, par_num int, line_num int")
    out = zones.with_lines(df, "doc_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.doc_id, r.id): (r.block_num, r.par_num, r.line_num, r.text) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for page in range(60):
        own = sorted((w for w in words if w[0] == page), key=lambda w: (w[5], w[4], w[1]))
        reach, centres = max(8.0, median(w[7] for w in own) * 0.6), []
        for w in own:
            c = w[5] + w[7] / 2
            near = [(abs(c - m), i) for i, m in enumerate(centres) if abs(c - m) <= reach]
            if near:
                i = min(near)[1]
                centres[i] = (centres[i] + c) / 2
            else:
                i = len(centres)
                centres.append(c)
            expected[page, w[1]] = (0, 0, i, w[2])
    assert got == expected


def test_confidence_does_not_depend_on_the_order_of_words(spark):
    """Sums of these differ in the last bit with their order."""
    rng = random.Random(5)
    words = [(page, i, "A", rng.randrange(50) / 50.0, 100 + rng.randrange(50), 100 + rng.randrange(20), rng.randint(5, 35), rng.randint(4, 14), 0, 0, i) for page in range(200) for i in range(6)]
    schema = "doc_id int, id int, text string, confidence double, x int, y int, width int, height int, block_num int, par_num int, line_num int"
    zone = spark.createDataFrame([(page, "z", "text", 100, 100, 50, 20, True) for page in range(200)], "doc_id int, zone_name string, zone_type string, x int, y int, width int, height int, required boolean")
    got = [{r.doc_id: r.confidence for r in zones.extract_fields(spark.createDataFrame(w, schema).coalesce(1), zone).collect()} for w in (words, words[::-1])]
    assert len(got[0]) == 200 and got[0] == got[1]
