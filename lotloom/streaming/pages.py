"""Pages as a stream (T1-T8, K7): each arriving page is classified, and the open document of its lot is carried on.

Pages of a lot are taken in page order inside a micro-batch; across batches they are to arrive in order, as a scanner
delivers them. State is one row a lot: its open document and page count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lotloom.functions import text

PAGE_SCHEMA = "lot_id string, page_number long, ocr_raw string"
EVENT_SCHEMA = "lot_id string, type string, doc_index long, start_page long, end_page long, page_number long"
STATE_SCHEMA = "doc_index long, start_page long, last_page long"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """JSON lines below path as a stream; a line still being written is not read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def classified(pages: DataFrame, min_keywords: int = 3, source: str = "ocr_raw") -> DataFrame:
    """pages with normalised and compact text, keywords and start flag; the same for streams and tables."""
    norm = text.normalized(F.coalesce(F.col(source), F.lit("")))
    out = pages.withColumn("ocr_norm", norm).withColumn("ocr_compact", F.replace("ocr_norm", F.lit(" "), F.lit("")))
    found = text.found_keywords(F.col("ocr_norm"))
    return out.withColumns(
        {
            "found_keywords": found,
            "missing_keywords": text.missing_keywords(found),
            "is_new_document": text.is_first_page(F.col("ocr_norm"), min_keywords),
        }
    )


def _events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    doc, start, last = state.get if state.exists else (0, 0, 0)
    out: list[tuple] = []
    pages = pd.concat(list(batches)).sort_values("page_number")
    for page, is_start, is_last in zip(pages.page_number, pages.is_new_document, pages.is_last, strict=True):
        out.append((key[0], "page", None, None, None, page))
        if is_start or not start:
            if start:
                out.append((key[0], "document", doc, start, page - 1, None))
            # pages before the first start are document 0
            doc, start = doc + 1 if is_start else 0, page
            if is_start:
                out.append((key[0], "provisional_document", doc, start, None, page))
        last = page
        if is_last:
            out.append((key[0], "document", doc, start, page, None))
            out.append((key[0], "complete", None, None, page, None))
            doc, start, last = 0, 0, 0
    if start:
        state.update((int(doc), int(start), int(last)))
    elif state.exists:
        state.remove()  # the lot is complete
    frame = pd.DataFrame(out, columns=["lot_id", "type", "doc_index", "start_page", "end_page", "page_number"])
    yield frame.astype({c: "Int64" for c in ("doc_index", "start_page", "end_page", "page_number")})


def document_events(pages: DataFrame, is_last: Column) -> DataFrame:
    """Events of a stream of classified pages: page, provisional_document where one starts, document once its end is
    known, complete (T1, T2, T6). State goes with a lot's last page; a lot that comes again starts anew.

    is_last marks a lot's last page, which closes its open document.
    """
    narrow = pages.select("lot_id", "page_number", "is_new_document", is_last.alias("is_last"))
    return narrow.groupBy("lot_id").applyInPandasWithState(_events, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def write_events(events: DataFrame, path: str, checkpoint: str, name: str):
    """NDJSON sink, each batch exactly once; one active query of a name is the single-flight lock."""
    return events.writeStream.queryName(name).format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_lot_batch(pages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """Runs a batch function on each micro-batch (T3): reconciliation of the lots that have become complete."""
    return pages.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_ndjson(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
