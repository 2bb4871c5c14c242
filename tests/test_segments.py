from pyspark.sql import functions as F

from lotloom.operators import segments


def pages(spark, total, starts):
    return spark.createDataFrame([(1, p, p in starts) for p in range(1, total + 1)], "lot_id int, page_number long, s boolean")


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


COLS = ("doc_index", "start_page", "end_page", "page_count")


def test_ranges(spark):
    assert listed(segments.ranges(pages(spark, 6, {3, 5}), F.col("s")), *COLS) == [(1, 3, 4, 2), (2, 5, 6, 2)]


def test_ranges_with_leading(spark):
    assert listed(segments.ranges_with_leading(pages(spark, 6, {3, 5}), F.col("s")), *COLS[:3]) == [(0, 1, 2), (1, 3, 4), (2, 5, 6)]
    assert listed(segments.ranges_with_leading(pages(spark, 6, set()), F.col("s")), *COLS[:3]) == [(0, 1, 6)]


def test_ranges_from_starts(spark):
    lots = spark.createDataFrame([(1, 6), (2, 0)], "lot_id int, total_pages long")
    starts = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (1, 9), (2, 1)], "lot_id int, page_number long")
    assert listed(segments.ranges_from_starts(starts, lots), "lot_id", *COLS[:3]) == [(1, 0, 1, 4), (1, 1, 5, 6)]


def test_long_gaps(spark):
    lots = spark.createDataFrame([(1, 40), (2, 20), (3, 15)], "lot_id int, total_pages long")
    starts = spark.createDataFrame([(1, 1), (1, 20), (2, 16)], "lot_id int, page_number long")
    got = listed(segments.long_gaps(starts, lots), "lot_id", "gap_start", "gap_end")
    assert got == [(1, 2, 19), (1, 21, 40), (2, 1, 15), (3, 1, 15)]
