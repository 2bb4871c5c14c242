"""Scores of linkage and of visual matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regions of a page that tell a template: name, corners as shares of the page, weight, critical.
ANCHORS = [
    ("header_left", 0.00, 0.00, 0.35, 0.20, 0.24, True),
    ("header_center", 0.20, 0.04, 0.80, 0.22, 0.28, True),
    ("header_right", 0.65, 0.00, 1.00, 0.22, 0.18, True),
    ("body_left", 0.06, 0.25, 0.42, 0.58, 0.10, False),
    ("footer_band", 0.00, 0.72, 1.00, 0.95, 0.20, True),
]
HASH_WEIGHTS = {"phash": (256, 0.45), "dhash": (64, 0.25), "whash": (64, 0.30)}


def unit(c: Column) -> Column:
    """Clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "name string, x0 double, y0 double, x1 double, y1 double, weight double, critical boolean")


def strict_score(order: Column, client_no: Column, distributor: Column, client: Column) -> Column:
    """Share of a strict match."""
    return order.cast("int") * 0.35 + client_no.cast("int") * 0.25 + distributor * 0.20 + client * 0.20


def strict_qualifies(order: Column, client_no: Column, distributor: Column, client: Column) -> Column:
    """Both numbers found and both names above 0.90 (P10)."""
    return order & client_no & (distributor > 0.90) & (client > 0.90)


def strict_emitted(order: Column, client_no: Column, distributor: Column, client: Column) -> Column:
    """Any sign of a match."""
    return order | client_no | (distributor > 0.90) | (client > 0.90)


def global_score(order: Column, client_no: Column, client: Column, distributor: Column) -> Column:
    """0..100 (F21), before rounding."""
    return order.cast("int") * 35.0 + client_no.cast("int") * 35.0 + client * 15.0 + distributor * 15.0


def exact_match(order: Column, client_no: Column, client: Column, distributor: Column) -> Column:
    """Either rule of a reliable match."""
    both = order & client_no & ((client >= 0.90) | (distributor >= 0.90))
    return both | ((order | client_no) & (client >= 0.70) & (distributor >= 0.80))


def confirmation(success: Column, inlier_ratio: Column, matches: Column) -> Column:
    """Geometric confirmation of a visual match."""
    return F.when(success, unit(inlier_ratio * 0.75 + F.least(matches / 40.0, F.lit(1.0)) * 0.25)).otherwise(F.lit(0.0))


def hybrid_score(visual: Column, orb: Column) -> Column:
    return visual * 0.45 + orb * 0.55


def gates(threshold: Column) -> dict[str, Column]:
    """Least visual, critical and geometric scores for a threshold."""
    return {
        "visual": F.greatest(F.lit(0.30), threshold - 0.15),
        "critical": F.greatest(F.lit(0.33), threshold - 0.10),
        "orb": F.greatest(F.lit(0.18), threshold - 0.25),
    }


def hybrid_matched(visual: Column, critical: Column, orb: Column, threshold: Column) -> Column:
    """All gates and the threshold."""
    g = gates(threshold)
    return (hybrid_score(visual, orb) >= threshold) & (visual >= g["visual"]) & (critical >= g["critical"]) & (orb >= g["orb"])


def hybrid_warnings(visual: Column, critical: Column, orb: Column, threshold: Column, with_orb: bool = True) -> Column:
    """What fell below its gate."""
    g = gates(threshold)
    told = lambda name, v, gate: F.when(v < gate, F.format_string(f"{name} %.3f below gate %.3f", v, gate))
    lines = [told("Anchor score", visual, g["visual"]), told("Critical anchor score", critical, g["critical"])]
    if with_orb:
        lines.append(told("ORB confirmation", orb, g["orb"]))
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def paper_matched(success: Column, inlier_ratio: Column, threshold: float) -> Column:
    """P5 and P6."""
    return F.coalesce(success & (inlier_ratio >= threshold), F.lit(False))


def hamming_similarity(a: Column, b: Column, bits: int) -> Column:
    """1 - differing bits / bits, for longs."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def hash_score(similarities: dict[str, Column]) -> Column:
    """Weighted mean of hash similarities, each clamped; those that are null drop out."""
    pairs = [(c, F.lit(HASH_WEIGHTS[k][1])) for k, c in similarities.items()]
    top = sum((F.when(c.isNotNull(), unit(c) * w).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(F.lit(0.0))


def edge_score(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(F.abs(a - b) / 0.15, F.lit(1.0)))


def region_score(hashes: Column, histogram: Column, edges: Column) -> Column:
    """Likeness of two regions."""
    return hashes * 0.60 + histogram * 0.25 + edges * 0.15


def weighted_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means over (score, weight, critical) rows: visual, and critical, which falls back to visual."""
    w, s, c = F.col("weight"), F.col("score"), F.col("critical")
    sums = scores.groupBy(*keys).agg(
        F.sum(s * w).alias("sw"), F.sum(w).alias("w"), F.sum(F.when(c, s * w)).alias("csw"), F.sum(F.when(c, w)).alias("cw")
    )
    visual = F.when(F.col("w") > 0, F.col("sw") / F.col("w")).otherwise(F.lit(0.0))
    critical = F.when(F.col("cw") > 0, F.col("csw") / F.col("cw")).otherwise(visual)
    return sums.select(*keys, visual.alias("visual"), critical.alias("critical"))
