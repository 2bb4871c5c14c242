"""Whole jobs over many lots: analyse (strict), reconcile, separate, extract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.functions import scores
from lotloom.operators import assignment, linkage, reconciliation, segments, zones
from lotloom.streaming.pages import classified

METHODS = ("orb", "hybrid", "paper")
SKIPPED = "Skipped ORB confirmation because anchor score was below gate"


@dataclass(frozen=True)
class Config:
    """Parameters, checked when made."""

    min_keywords: int = 3
    method: str = "orb"
    threshold: float | None = None

    def __post_init__(self):
        method = "hybrid" if self.method.strip().lower() == "visual-structural" else self.method.strip().lower()
        if method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        if not 1 <= self.min_keywords <= 4:
            raise ValueError("min_keywords must be 1 to 4")
        threshold = (0.55 if method == "hybrid" else 0.35) if self.threshold is None else self.threshold
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be 0 to 1")
        object.__setattr__(self, "method", method)
        object.__setattr__(self, "threshold", threshold)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint in the folder that spark.checkpoint.dir names, else persisted on disk with its lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def analyze_lots(pages: DataFrame, rows: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Strict validation: documents with candidates, assignments, issues and summary of every lot."""
    read = classified(pages, config.min_keywords)
    start = F.col("is_new_document")
    documents = segments.with_first_page(
        segments.ranges(read, start), read.select("lot_id", "page_number", F.col("ocr_compact").alias("first_page_compact"))
    )
    found = linkage.field_results(linkage.pairs(documents.where("first_page_compact IS NOT NULL"), rows))
    candidates = kept(linkage.strict_candidates(found.drop("first_page_compact", "client_window", "distributor_window")))
    claims = linkage.strict_assignments(documents, candidates)
    issues = reconciliation.validation_issues(read, start, documents, rows, claims)
    return {
        "pages": read, "documents": claims, "candidates": candidates, "issues": issues,
        "summary": reconciliation.lot_summary(read, rows, documents, claims, issues),
    }


def reconcile_lots(pages: DataFrame, rows: DataFrame, is_start: Column, compact: str = "ocr_compact") -> dict[str, DataFrame]:
    """Reconciliation: every document with every row of its lot, one-to-one assignment, report lines and counts."""
    ranges = segments.ranges_with_leading(pages, is_start).withColumn("file_name", F.concat(F.col("doc_index").cast("string"), F.lit(".pdf")))
    documents = segments.with_first_page(ranges, pages.select("lot_id", "page_number", F.col(compact).alias("first_page_compact")))
    flagged = linkage.duplicate_rows(rows)
    # used more than once, and similarity is costly: kept, without the texts that nothing needs any more
    candidates = kept(linkage.recon_candidates(linkage.pairs(documents, flagged).drop("first_page_compact", "client_window", "distributor_window")))
    settled = reconciliation.settled(candidates)
    row_lines = reconciliation.row_output(rows, documents, settled)
    document_lines = reconciliation.document_output(documents, rows, settled)
    return {
        "documents": documents, "candidates": candidates, "verdicts": assignment.verdicts(settled), "rows": row_lines,
        "document_lines": document_lines, "summary": reconciliation.summary(row_lines, documents),
    }


def separate(features: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Page matches and ranges from alignment and visual scores: (lot_id, page_number, success, inlier_ratio,
    matches_used, visual, critical) (P5-P8).

    In hybrid mode geometric confirmation counts only where the visual score passes its gate (P8): the features may
    be left null elsewhere, so that the costly kernel runs on those pages only (see `needs_alignment`).
    """
    t = F.lit(float(config.threshold))
    if config.method == "hybrid":
        gate = F.col("visual") >= scores.gates(t)["visual"]
        orb = F.when(gate, scores.confirmation(F.coalesce("success", F.lit(False)), F.col("inlier_ratio"), F.col("matches_used"))).otherwise(F.lit(0.0))
        out = features.withColumn("orb", F.coalesce(orb, F.lit(0.0))).withColumns(
            {
                "score": scores.hybrid_score(F.col("visual"), F.col("orb")),
                "matched": scores.hybrid_matched(F.col("visual"), F.col("critical"), F.col("orb"), t),
                "warnings": F.array_distinct(F.concat(
                    F.when(gate, F.array().cast("array<string>")).otherwise(F.array(F.lit(SKIPPED))),
                    scores.hybrid_warnings(F.col("visual"), F.col("critical"), F.col("orb"), t),
                )),
            }
        )
    else:
        # a page whose alignment failed scores 0, whatever ratio was left over
        score = F.when(F.coalesce("success", F.lit(False)), F.coalesce("inlier_ratio", F.lit(0.0))).otherwise(F.lit(0.0))
        out = features.withColumns({"score": score, "matched": scores.paper_matched(F.col("success"), F.col("inlier_ratio"), config.threshold)})
    return {"pages": out, "documents": segments.ranges(out, F.col("matched"))}


def needs_alignment(visual: DataFrame, config: Config) -> DataFrame:
    """Pages worth the geometric kernel."""
    return visual.where(F.col("visual") >= scores.gates(F.lit(float(config.threshold)))["visual"])


def extract(words: DataFrame, zone_table: DataFrame) -> dict[str, DataFrame]:
    """Fields, required ones that are empty, and words with whether they were used."""
    fields = zones.extract_fields(words, zone_table)
    return {"fields": fields, "missing": zones.missing_required(fields, zone_table), "words": zones.matched_words(fields, words)}
