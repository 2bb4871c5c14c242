"""Word tables of recognition engines, and keypoint tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotloom.functions import boxes

PAYLOAD = "rec_texts array<string>, rec_scores array<string>, rec_boxes array<array<double>>"
KEYPOINTS = "path string, kp_idx int, x double, y double, size double, angle double, response double, octave int, class_id int, descriptor array<bigint>"


def payload(json: Column) -> Column:
    """The struct of parallel arrays in a result's text, be it bare or under `res`."""
    both = F.from_json(json, f"res struct<{PAYLOAD.replace(' array', ': array')}>, {PAYLOAD}")
    bare = F.struct(*[both[n].alias(n) for n in ("rec_texts", "rec_scores", "rec_boxes")])
    return F.when(F.get_json_object(json, "$.res").startswith("{"), both["res"]).otherwise(bare)


def words_of_arrays(results: DataFrame, page: str, found: Column, scale_x: Column | None = None, scale_y: Column | None = None) -> DataFrame:
    """A row for each word of results: the page's column, id from 0, text, confidence, x, y, width, height.

    found: struct(rec_texts, rec_scores, rec_boxes of corners x1, y1, x2, y2). The arrays are cut to the shortest;
    null counts as empty. Words without text, without a number as score or without area are left out before ids are
    given. Boxes are rounded, scaled and rounded again.
    """
    parts = [F.coalesce(found[n], F.array()) for n in ("rec_texts", "rec_scores", "rec_boxes")]
    n = F.least(*[F.size(p) for p in parts])
    zipped = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), lambda i: F.struct(*[F.get(p, i).alias(k) for p, k in zip(parts, "tsb", strict=True)]))
    rows = results.select(page, F.posexplode(zipped).alias("place", "w"))
    box = boxes.from_corners(*[F.get(F.col("w.b"), F.lit(i)) for i in range(4)])
    text, score = F.regexp_replace(F.col("w.t"), r"(?U)^\s+|\s+$", ""), F.col("w.s").try_cast("double")
    sx, sy = (F.lit(1.0) if s is None else s for s in (scale_x, scale_y))
    scaled = {k: F.bround(box[k] * s).cast("int") for k, s in (("x", sx), ("y", sy), ("width", sx), ("height", sy))}
    kept = rows.withColumns({"text": text, "score": score, "confidence": boxes.confidence(score), **scaled}).where((F.col("text") != "") & F.col("score").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0))
    columns = ["text", "confidence", "x", "y", "width", "height"]
    of_page = kept.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("words"))  # a page's words
    return of_page.select(page, F.posexplode("words").alias("id", "w")).select(page, "id", *[F.col(f"w.{c}").alias(c) for c in columns])


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """Stored keypoints (.npz with `keypoints` of 7 columns and `descriptors` of bytes) as rows.

    Sizes are at least 1, octaves and classes whole; a descriptor's bytes become longs of 32 bits. `save` such a table
    with write.parquet (K11).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    points, bits = np.asarray(held["keypoints"], np.float64).reshape(-1, 7), np.ascontiguousarray(held["descriptors"], np.uint8)
                longs = bits.view(">u4").astype(np.int64).reshape(len(points), -1)
                yield pa.RecordBatch.from_pydict({
                    "path": [name] * len(points), "kp_idx": pa.array(range(len(points)), pa.int32()), "x": points[:, 0], "y": points[:, 1], "size": np.maximum(points[:, 2], 1.0),
                    "angle": points[:, 3], "response": points[:, 4], "octave": np.rint(points[:, 5]).astype(np.int32), "class_id": np.rint(points[:, 6]).astype(np.int32),
                    "descriptor": pa.array(longs.tolist(), pa.list_(pa.int64())),
                })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, KEYPOINTS)
