"""From page flags to document ranges.

Every function takes a key that names the lot, so that many lots run in one job, each as one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_GAP = 15


def _numbered(starts: DataFrame, lot: str, page: str) -> DataFrame:
    """Distinct starts with index from 1 and the next start."""
    order = Window.partitionBy(lot).orderBy(page)
    return starts.select(lot, page).distinct().withColumn("doc_index", F.row_number().over(order)).withColumn("next", F.lead(page).over(order))


def totals(pages: DataFrame, lot: str) -> DataFrame:
    return pages.groupBy(lot).agg(F.count(F.lit(1)).alias("total_pages"))


def ranges(pages: DataFrame, is_start: Column, lot: str = "lot_id", page: str = "page_number", first: Column | None = None) -> DataFrame:
    """Documents from each start to before the next (W1); pages before the first start belong to none.

    first: a column of the first page that comes along, where a page has one row, without meeting the pages again.
    """
    starts = pages.where(is_start)
    if first is None:
        marked, along = _numbered(starts, lot, page), []
    else:
        order = Window.partitionBy(lot).orderBy(page)
        once = starts.groupBy(lot, page).agg(F.min(first).alias("_first"))
        marked, along = once.withColumn("doc_index", F.row_number().over(order)).withColumn("next", F.lead(page).over(order)), [F.col("_first").alias("first_page")]
    marked = marked.join(totals(pages, lot), lot)
    end = F.coalesce(F.col("next") - 1, F.col("total_pages"))
    return marked.select(
        lot, "doc_index", F.col(page).alias("start_page"), end.cast("long").alias("end_page"), (end - F.col(page) + 1).cast("long").alias("page_count"), *along
    )


def ranges_with_leading(pages: DataFrame, is_start: Column, lot: str = "lot_id", page: str = "page_number") -> DataFrame:
    """Pages before the first start are document 0; a lot without starts is document 0 as a whole.

    One window: the running number of starts is the document.
    """
    so_far = Window.partitionBy(lot).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    doc = F.sum(F.coalesce(is_start, F.lit(False)).cast("int")).over(so_far).cast("int").alias("doc_index")
    return (
        pages.select(lot, page, doc)
        .groupBy(lot, "doc_index")
        .agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.count(F.lit(1)).alias("page_count"))
    )


def ranges_from_starts(starts: DataFrame, lots: DataFrame, lot: str = "lot_id", page: str = "page_number") -> DataFrame:
    """W2 for bare start lists and (lot, total_pages): repeats and starts outside 1..total are ignored."""
    valid = starts.join(lots, lot).where(F.col(page).between(1, F.col("total_pages"))).select(lot, page)
    marked = _numbered(valid, lot, page).drop("next")
    led = lots.where("total_pages > 0").join(marked.where("doc_index = 1").select(lot, F.col(page).alias("first")), lot, "left")
    leading = led.where("first IS NULL OR first > 1").select(lot, F.lit(1).cast("long").alias(page), F.lit(0).alias("doc_index"))
    all_ = marked.unionByName(leading)
    order = Window.partitionBy(lot).orderBy(page)
    ends = all_.withColumn("next", F.lead(page).over(order)).join(lots, lot)
    end = F.coalesce(F.col("next") - 1, F.col("total_pages"))
    return ends.select(lot, "doc_index", F.col(page).alias("start_page"), end.alias("end_page"), (end - F.col(page) + 1).alias("page_count"))


def long_gaps(starts: DataFrame, lots: DataFrame, lot: str = "lot_id", page: str = "page_number", least: int = LONG_GAP) -> DataFrame:
    """Runs of `least` pages or more without a start, also before the first and after the last."""
    marks = starts.select(lot, F.col(page).cast("long").alias("mark")).distinct().unionByName(
        lots.where("total_pages > 0").select(lot, (F.col("total_pages") + 1).cast("long").alias("mark"))
    )
    begin = F.coalesce(F.lag("mark").over(Window.partitionBy(lot).orderBy("mark")), F.lit(0)) + 1
    gaps = marks.select(lot, begin.alias("gap_start"), (F.col("mark") - 1).alias("gap_end"))
    return gaps.withColumn("gap_length", F.col("gap_end") - F.col("gap_start") + 1).where(F.col("gap_length") >= least)


def start_issues(pages: DataFrame, is_start: Column, lot: str = "lot_id", page: str = "page_number") -> DataFrame:
    """Lots without a start, and lots whose first start is not page 1."""
    first = pages.groupBy(lot).agg(F.min(F.when(is_start, F.col(page))).alias("first"))
    none = first.where("first IS NULL").select(lot, F.lit("no_start_pages").alias("code"), F.lit(None).cast("long").alias("page_number"))
    late = first.where("first <> 1").select(lot, F.lit("leading_pages_before_first_start").alias("code"), F.col("first").cast("long").alias("page_number"))
    return none.unionByName(late)


def with_first_page(documents: DataFrame, pages: DataFrame, lot: str = "lot_id", page: str = "page_number") -> DataFrame:
    """Documents with the columns of their first page, null where it is missing."""
    first = pages.withColumnRenamed(page, "start_page")
    return documents.join(first, [lot, "start_page"], "left")


def thinned(n: Column, total: Column) -> Column:
    """Which steps of a long run are reported (T4): all of 20 or fewer, the first 5, every tenth, the last."""
    return (total > 0) & ((n == total) | (total <= 20) | (n <= 5) | (n % 10 == 0))
