"""Fields of template zones from word boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotloom.functions import boxes, text

PADDING, LEAST_OVERLAP = 4, 0.2
NO_WORDS, NO_VALUE, LOW = "No OCR words intersect zone", "OCR words matched but value is empty", "Low OCR confidence"


def zone_hits(words: DataFrame, zones: DataFrame, on: str = "doc_id") -> DataFrame:
    """Words that lie in a zone of their document, with overlap and score.

    zones have the key too; for one template over all documents, join it to the documents' keys first. The two meet
    by key, and a document has few zones.
    """
    z = zones.select(on, "zone_name", "zone_type", *[F.col(c).alias(f"z_{c}") for c in ("x", "y", "width", "height")])
    box = [F.col(c) for c in ("x", "y", "width", "height")]
    zone = [F.col("z_x") - PADDING, F.col("z_y") - PADDING, F.col("z_width") + 2 * PADDING, F.col("z_height") + 2 * PADDING]
    met = words.where("width > 0 AND height > 0").join(z, on)
    met = met.withColumn("common", boxes.intersection(*zone, *box)).where("common > 0")
    met = met.withColumns({"overlap": F.col("common") / (F.col("width") * F.col("height")), "centred": boxes.centre_inside(*box, *zone)})
    return met.where((F.col("overlap") >= LEAST_OVERLAP) | F.col("centred")).withColumn(
        "hit", F.col("overlap") + F.when(F.col("centred"), 0.25).otherwise(0.0)
    )


def extract_fields(words: DataFrame, zones: DataFrame, on: str = "doc_id") -> DataFrame:
    """A row for each zone: text in reading order, weighted confidence, warning, ids of its words.

    Confidence is summed in reading order too, so that the order in which words arrive does not decide a tie of rounding.
    """
    read = F.struct("block_num", "par_num", "line_num", "x", F.col("id"), F.col("text"), F.col("confidence"), F.greatest("hit", F.lit(0.05)).alias("weight"))
    found = zone_hits(words, zones, on).groupBy(on, "zone_name").agg(F.array_sort(F.collect_list(read)).alias("words"))
    total = lambda of: F.aggregate("words", F.lit(0.0), lambda s, w: s + F.coalesce(of(w), F.lit(0.0)))
    rated = F.exists("words", lambda w: w["confidence"].isNotNull())
    found = found.withColumn("confidence", F.when(rated, total(lambda w: w["confidence"] * w["weight"]) / total(lambda w: w["weight"])))
    met = zones.select(on, "zone_name", "zone_type").join(found, [on, "zone_name"], "left")
    value = F.coalesce(text.zone_value(F.array_join("words.text", " "), F.col("zone_type")), F.lit(""))
    warning = F.when(F.col("words").isNull(), F.lit(NO_WORDS)).when(F.col("value") == "", F.lit(NO_VALUE)).when(F.col("confidence") < 0.5, F.lit(LOW))
    return met.withColumn("value", value).select(
        on, "zone_name", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), warning.alias("warning"),
        F.coalesce("words.id", F.array().cast("array<int>")).alias("word_ids"),
    )


def missing_required(fields: DataFrame, zones: DataFrame, on: str = "doc_id") -> DataFrame:
    """Required zones that came out empty."""
    return fields.join(zones.where("required").select(on, "zone_name"), [on, "zone_name"], "left_semi").where("value = ''")


def words_of_fields(fields: DataFrame, words: DataFrame, on: str = "doc_id") -> DataFrame:
    """Text of each field from its word ids."""
    ids = fields.select(on, "zone_name", F.posexplode("word_ids").alias("pos", "id"))
    return ids.join(words.select(on, "id", "text"), [on, "id"]).groupBy(on, "zone_name").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(pos, text))), w -> w.text)"), " ").alias("words")
    )


def matched_words(fields: DataFrame, words: DataFrame, on: str = "doc_id") -> DataFrame:
    """All words, with whether any field has them."""
    used = fields.select(on, F.explode("word_ids").alias("id")).distinct().withColumn("matched", F.lit(True))
    return words.join(used, [on, "id"], "left").na.fill(False, ["matched"])


def page_text(words: DataFrame, on: str = "doc_id") -> DataFrame:
    """All words of a page in reading order."""
    read = F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "x", "id", "text")))
    return words.groupBy(on).agg(F.array_join(read["text"], " ").alias("page_text"))


def line_threshold(words: DataFrame, on: str = "doc_id") -> DataFrame:
    """How far a word may lie from its line."""
    return words.groupBy(on).agg(F.greatest(F.lit(8.0), F.median("height") * 0.6).alias("threshold"))


def with_lines(words: DataFrame, on: str = "doc_id") -> DataFrame:
    """words with line_num from their boxes (J19): each joins the nearest line within reach, and moves its centre.

    The running centres depend on the order of words, so a page is read by one task; pages follow one another there,
    and only numbers are looked at one by one. block_num and par_num become 0.
    """
    page = Window.partitionBy(on).orderBy(*[F.col(c).asc_nulls_last() for c in ("y", "x", "id", "height", "text")])
    whole = Window.partitionBy(on)
    reach = F.greatest(F.lit(8.0), F.median("height").over(whole) * 0.6)
    read = words.withColumns({"_at": F.row_number().over(page), "_centre": F.col("y") + F.col("height") / 2}).withColumn("_reach", reach)
    names = words.columns

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[float] = []
        for batch in batches:
            number = []
            for at, c, most in zip(*(batch.column(n).to_pylist() for n in ("_at", "_centre", "_reach")), strict=True):
                if at == 1:
                    centres = []
                best, i, c = most, -1, math.nan if c is None else c
                for j, m in enumerate(centres):
                    far = abs(c - m)
                    if far < best or (far == best and i < 0):
                        best, i = far, j
                if i < 0:
                    i = len(centres)
                    centres.append(c)
                else:
                    centres[i] = (centres[i] + c) / 2
                number.append(i)
            zero = pa.array([0] * len(number))
            new = {"line_num": pa.array(number), "block_num": zero, "par_num": zero}
            yield pa.RecordBatch.from_arrays([new[n].cast(batch.schema.field(n).type) if n in new else batch.column(n) for n in names], names=names)

    return read.mapInArrow(lines, words.schema)
