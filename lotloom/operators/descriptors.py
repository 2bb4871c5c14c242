"""Matching of binary descriptors and stable keypoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotloom.functions import boxes

RATIO, LEAST_MATCHES = 0.75, 20
#: Descriptors of a block, and queries of it that are compared with a block at once.
BLOCK, TILE = 4096, 256


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def sign_bits(vector: Column, n: int, bits: int = 32) -> Column:
    """The signs of a vector's first n components as an array of longs of `bits` bits each."""
    words = [F.slice(vector, at + 1, bits) for at in range(0, n, bits)]
    return F.array(*[F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)) for w in words])


def nearest_two(queries: DataFrame, train: DataFrame, within: str, query: str = "query_id", to: str = "train_id") -> DataFrame:
    """The two nearest of each query in its group, by Hamming distance, ties to the smaller id.

    Both have `descriptor`, an array of longs. A descriptor does not meet the one of its own id; one that is null or has
    a null is at no distance, after all others. All pairs of a group are compared, in blocks of about BLOCK
    descriptors of each side that are dealt over tasks: a block pair leaves two rows for each of its queries.
    """
    whole = lambda df, n: df.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    sizes = whole(queries, "_nq").join(whole(train, "_nt"), within)

    def blocks(df: DataFrame, key: str, own: str, other: str, name: str) -> DataFrame:
        # ids in order: the first of equal distances is the smaller id
        at = F.pmod(F.xxhash64(key), F.col(f"_n{own}")).alias(f"_{own}")
        packed = df.where(F.col(key).isNotNull()).join(sizes, within).select(within, f"_n{other}", at, F.struct(F.col(key).alias("id"), "descriptor").alias("d"))
        packed = packed.groupBy(within, f"_n{other}", f"_{own}").agg(F.sort_array(F.collect_list("d")).alias("d"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        return packed.select(within, f"_{own}", every, F.col("d.id").alias(f"{name}_id"), F.col("d.descriptor").alias(f"{name}_bits"))

    met = blocks(queries, query, "q", "t", "query").join(blocks(train, to, "t", "q", "train"), [within, "_q", "_t"])
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((queries, within), (queries, query), (train, to))}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                group, q_id, q_bits, t_id, t_bits = (c.slice(i, 1) for c in batch.columns)
                yield from _two_of_blocks(group, q_id.flatten(), q_bits.flatten(), t_id.flatten(), t_bits.flatten(), (within, query, to))

    far = met.select(within, "query_id", "query_bits", "train_id", "train_bits").mapInArrow(
        compare, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", distance int"
    )
    order = Window.partitionBy(within, query).orderBy(F.col("distance").asc_nulls_last(), to)
    return far.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def _words_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors as a table of 64-bit words, and how many words each has (-1: null, or with a null)."""
    lengths = bits.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
    flat = bits.flatten()
    words = np.zeros((len(lengths), max(1, lengths.max(initial=0))), np.uint64)
    rows = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    places = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), np.maximum(lengths, 0))
    words[rows, places] = flat.fill_null(0).to_numpy().view(np.uint64)
    lengths[rows[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return words, lengths


def _two_of_blocks(group: pa.Array, q_id: pa.Array, q_bits: pa.Array, t_id: pa.Array, t_bits: pa.Array, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The two nearest of a block of queries in a block of train descriptors, which are in the order of their ids."""
    (q, q_n), (t, t_n) = _words_of(q_bits), _words_of(t_bits)
    wide = max(q.shape[1], t.shape[1])
    q, t = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, t))
    both = pa.concat_arrays([q_id, t_id.cast(q_id.type)]).dictionary_encode().indices.to_numpy()
    q_code, t_code = both[: len(q)], both[len(q) :]
    order = np.argsort(t_code, kind="stable")
    low, high = (np.searchsorted(t_code[order], q_code, side) for side in ("left", "right"))
    none, never = 64 * wide + 1, 64 * wide + 2
    even = len({*np.unique(q_n), *np.unique(t_n)}) == 1 and q_n[0] >= 0
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        far = np.zeros((len(q[part]), len(t)), np.uint8 if never < 256 else np.int32)
        for w in range(wide):
            far += np.bitwise_count(q[part, w, None] ^ t[None, :, w])
        if not even:
            far[(q_n[part, None] != t_n[None, :]) | (q_n[part, None] < 0)] = none
        lo, hi = low[part].copy(), high[part]
        while (own := np.flatnonzero(lo < hi)).size:  # the descriptor of the same id
            far[own, order[lo[own]]] = never
            lo[own] += 1
        rows = np.arange(len(far))
        for _ in range(min(2, len(t))):
            best = far.argmin(axis=1)
            distance = far[rows, best].astype(np.int32)
            far[rows, best] = never
            real = np.flatnonzero(distance != never)
            d = pa.array(distance[real], pa.int32(), mask=distance[real] == none)
            yield pa.RecordBatch.from_arrays([group.take(pa.array(np.zeros(len(real), np.int64))), q_id.take(pa.array(real + at)), t_id.take(pa.array(best[real])), d], names=[*names, "distance"])


def good_matches(two: DataFrame, within: str, query: str = "query_id", to: str = "train_id", ratio: float = RATIO) -> DataFrame:
    """Nearest neighbours clearly nearer than the second (P17); queries with fewer than two are dropped."""
    best = two.groupBy(within, query).agg(
        F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"),
        F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"),
        F.min(F.when(F.col("rank") == 1, F.col(to))).alias(to),
    )
    return best.where(F.col("d1") < F.col("d2") * ratio)


def support(matches: DataFrame, within: str, least: int = LEAST_MATCHES) -> DataFrame:
    """Match counts, and whether they suffice for an alignment."""
    n = matches.groupBy(within).agg(F.count(F.lit(1)).alias("matches_used"))
    return n.withColumn("enough", F.col("matches_used") >= least)


def inlier_ratio(inliers: DataFrame, within: str) -> DataFrame:
    """Share of matches that fit the alignment."""
    return inliers.groupBy(within).agg(F.avg(F.col("inlier").cast("int")).alias("inlier_ratio"))


def outside_regions(keypoints: DataFrame, regions: DataFrame, within: str) -> DataFrame:
    """Keypoints in no ignored region of their template.

    Regions lie on a grid whose cells are as wide as they are (a power of two for each of them), so that each is in
    four cells at most; a place of keypoints meets the different regions of its own cell only, once.
    """
    names = ("x", "y", "width", "height")
    r = regions.select(within, *[F.col(c).alias(f"r_{c}") for c in names]).where("r_width >= 0 AND r_height >= 0").distinct()
    side = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("r_width", "r_height", F.lit(1)).cast("double"))))
    cell = lambda v, size: F.floor(v.cast("double") / size)
    sized = r.withColumn("_side", side)
    span = lambda at, by: F.sequence(cell(F.col(at), F.col("_side")), cell(F.col(at) + F.col(by), F.col("_side")))
    laid = sized.withColumn("_cx", F.explode(span("r_x", "r_width"))).withColumn("_cy", F.explode(span("r_y", "r_height")))
    places = keypoints.select(within, "x", "y").distinct().join(sized.select(within, "_side").distinct(), within)
    met = places.withColumns({"_cx": cell(F.col("x"), F.col("_side")), "_cy": cell(F.col("y"), F.col("_side"))}).join(laid, [within, "_side", "_cx", "_cy"])
    hit = met.where(boxes.inside(F.col("x"), F.col("y"), *[F.col(f"r_{c}") for c in names])).select(within, "x", "y").distinct()
    return keypoints.join(hit, [within, "x", "y"], "left_anti").select(*keypoints.columns)


def stability(projected: DataFrame, detected: DataFrame, within: str, epsilon: int = 5) -> DataFrame:
    """In how many views each keypoint has a detected one within epsilon.

    projected: (within, view, kp_idx, x, y, width, height); detected: (within, view, x, y). Detections are put on a
    grid of cells of epsilon; a point meets only those of its own and the eight cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / epsilon)
    seen = F.sequence(F.lit(-1), F.lit(1))
    points = projected.where(boxes.in_image(F.rint("x"), F.rint("y"), F.col("width"), F.col("height")))
    grid = detected.select(within, "view", F.col("x").alias("dx"), F.col("y").alias("dy"), cell("x").alias("cx"), cell("y").alias("cy"))
    spread = points.withColumn("i", F.explode(seen)).withColumn("j", F.explode(seen)).withColumns({"cx": cell("x") + F.col("i"), "cy": cell("y") + F.col("j")})
    near = spread.join(grid, [within, "view", "cx", "cy"]).where((F.pow(F.col("x") - F.col("dx"), 2) + F.pow(F.col("y") - F.col("dy"), 2)) <= epsilon**2)
    counts = near.select(within, "view", "kp_idx").distinct().groupBy(within, "kp_idx").agg(F.count(F.lit(1)).alias("stability"))
    return projected.select(within, "kp_idx").distinct().join(counts, [within, "kp_idx"], "left").na.fill(0, ["stability"])


def most_stable(keypoints: DataFrame, within: str, k: int = 300) -> DataFrame:
    """The k most stable keypoints of each template, ties in order."""
    order = Window.partitionBy(within).orderBy(F.col("stability").desc(), "kp_idx")
    return keypoints.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def histogram(values: DataFrame, key: str, value: str) -> DataFrame:
    """Shares of whole-number bins."""
    bins = values.groupBy(key, F.floor(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def histogram_correlation(a: DataFrame, b: DataFrame, bins: int = 256) -> DataFrame:
    """Correlation of two tables of (bin, share) over all bins, missing ones counting as 0."""
    spark = a.sparkSession
    all_ = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    met = all_.join(a.select("bin", F.col("share").alias("p")), "bin", "left").join(b.select("bin", F.col("share").alias("q")), "bin", "left")
    return met.na.fill(0.0).agg(F.greatest(F.lit(0.0), F.corr("p", "q")).alias("score"))
