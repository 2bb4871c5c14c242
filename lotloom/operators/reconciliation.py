"""Reconciliation outputs: a line for each manifest row and each document, counts, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.functions import text
from lotloom.operators import assignment, linkage, segments

OK, REVIEW, ASSIGNED, MANUAL = "OK", "À vérifier", "Affecté", "Manuel"


#: What outputs need of a candidate besides its verdict.
_KEPT = ["file_name", "end_page", "page_count", "order_exact", "client_exact", "client_score", "distributor_score", "client_percent", "distributor_percent"]


def settled(candidates: DataFrame) -> DataFrame:
    """Candidates with their verdicts, as the outputs need them."""
    return assignment.settled(candidates, *_KEPT, *linkage.ROW_KEY)


def _shared(found: Column) -> dict[str, Column]:
    yes = lambda n: F.when(found, text.oui_non(F.col(n))).otherwise(F.lit(""))
    return {
        "global_score": F.col("global_percent"),
        "commande_exact": yes("order_exact"),
        "client_number_exact": yes("client_exact"),
        "client_percent": F.col("client_percent"),
        "distributeur_percent": F.col("distributor_percent"),
    }


def _chosen(own: DataFrame, others: DataFrame, candidates: DataFrame, side: str, partner: str) -> DataFrame:
    """For each of own its assigned candidate, else the best one, whether it is assigned, and the reason if ambiguous.

    All of a lot meet, so only what is in a lot without others has no candidate: nothing is joined but lots.
    """
    got = F.col(f"{side}_partner")
    best = candidates.where((got == F.col(partner)) | ((F.col(f"rank_for_{side}") == 1) & got.isNull()))
    told = linkage.told(best).withColumns({"assigned": got.isNotNull(), "reason": F.col(f"{side}_reason"), "found": F.lit(True)})
    alone = own.join(others.select("lot_id"), "lot_id", "left_anti").withColumns({"assigned": F.lit(False), "found": F.lit(False)})
    return told.unionByName(alone, allowMissingColumns=True)


def row_output(rows: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """A line for each manifest row (J13). candidates: as of settled."""
    met = _chosen(rows.select("lot_id", "row_number", *linkage.ROW_KEY), documents, candidates, "row", "doc_index")
    done, verify, found = F.col("assigned"), F.col("verify_fields"), F.col("found")
    missing = F.when(found, F.lit("Aucun PDF n'a pu être affecté automatiquement")).otherwise(F.lit("Aucun PDF candidat disponible"))
    why = F.coalesce("reason", missing)
    blank = F.lit("")
    status = (
        F.when(done & (F.size(verify) == 0), F.lit(OK)).when(done, F.lit(REVIEW))
        .when(F.col("reason").isNotNull(), F.lit(assignment.AMBIGUOUS)).otherwise(F.lit(assignment.MISSING))
    )
    name = F.coalesce("file_name", blank)
    match_type = F.when(~found, F.lit("none")).when(F.col("is_exact"), F.lit("exact")).otherwise(F.lit("fuzzy"))
    return met.select(
        "lot_id",
        F.col("row_number").alias("source_row"),
        F.lit("non").alias("manual"),
        status.alias("status"),
        blank.alias("validation_error"),
        F.when(done, name).otherwise(blank).alias("pdf_name"),
        F.when(done, blank).otherwise(name).alias("suggested_pdf_name"),
        name.alias("detected_pdf_name"),
        "start_page", "end_page", "page_count",
        *linkage.ROW_KEY,
        match_type.alias("match_type"),
        *[v.alias(k) for k, v in _shared(found).items()],
        F.when(done, F.array_join(verify, "; ")).when(status == assignment.AMBIGUOUS, why).otherwise(blank).alias("verify_fields"),
        blank.alias("review_note"),
        F.when(done, blank).otherwise(why).alias("diagnostic_reason"),
    )


def document_output(documents: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """A line for each document (J14). candidates: as of settled."""
    met = _chosen(documents.select("lot_id", "doc_index", "file_name", "start_page", "end_page", "page_count"), rows, candidates, "doc", "row_number")
    done, clean, found = F.col("assigned"), F.size("verify_fields") == 0, F.col("found")
    none = F.when(found, F.lit("Aucune ligne CSV n'a été affectée à ce PDF")).otherwise(F.lit("Aucune ligne candidate n'a été trouvée pour ce PDF"))
    status = F.when(done & clean, F.lit(ASSIGNED)).when(done, F.lit(REVIEW)).when(F.col("reason").isNotNull(), F.lit(assignment.AMBIGUOUS)).otherwise(F.lit(assignment.UNMATCHED))
    said = F.when(done & clean, F.lit("Affecté automatiquement")).when(done, F.lit("Affecté automatiquement avec contrôle requis")).otherwise(F.coalesce("reason", none))
    return met.select(
        "lot_id", F.col("file_name").alias("pdf_name"), status.alias("status"), "start_page", "end_page", "page_count",
        F.col("row_number").alias("best_source_row"),
        *[v.alias(k) for k, v in _shared(found).items()],
        *[F.coalesce(F.col(k), F.lit("")).alias(f"best_{k}") for k in linkage.ROW_KEY],
        said.alias("reason"),
    )


def unassigned(own: DataFrame, others: DataFrame, candidates: DataFrame, side: str, key: str) -> DataFrame:
    """lot_id and key of own that were not assigned. candidates: as of assignment.settled."""
    left = candidates.where((F.col(f"rank_for_{side}") == 1) & F.col(f"{side}_partner").isNull()).select("lot_id", key)
    return left.unionByName(own.join(others.select("lot_id"), "lot_id", "left_anti").select("lot_id", key))


def summary(row_lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts for each lot (A4)."""
    status = F.col("status")
    rows = row_lines.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("csv_row_count"),
        F.count_if(status.isin(OK, REVIEW)).alias("auto_assigned_count"),
        F.count_if(status == REVIEW).alias("needs_verification_count"),
        F.count_if(status == assignment.AMBIGUOUS).alias("ambiguous_count"),
        F.count_if(status == assignment.MISSING).alias("missing_pdf_count"),
    )
    docs = documents.groupBy("lot_id").agg(F.count(F.lit(1)).alias("generated_pdf_count"))
    names = [c for c in rows.columns if c != "lot_id"] + ["generated_pdf_count"]
    return rows.join(docs, "lot_id", "full").select("lot_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


_ISSUE = "lot_id", "code", "message", "severity", "doc_index", "page_number", "row_number"


def _issues(df: DataFrame, code: Column, message: Column, severity: str = "error") -> DataFrame:
    none = F.lit(None).cast("long")
    has = set(df.columns)
    return df.select(
        "lot_id", code.alias("code"), message.alias("message"), F.lit(severity).alias("severity"),
        *[(F.col(c).cast("long") if c in has else none).alias(c) for c in _ISSUE[4:]],
    )


def validation_issues(pages: DataFrame, is_start: Column, documents: DataFrame, rows: DataFrame, claims: DataFrame) -> DataFrame:
    """All findings of strict validation (U2): counts, starts, gaps, and what each document lacks.

    claims: as of linkage.strict_assignments.
    """
    text_ = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    n_docs = documents.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_docs"))
    n_rows = rows.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = n_docs.join(n_rows, "lot_id", "full").na.fill(0, ["n_docs", "n_rows"]).where("n_docs <> n_rows")
    starts = segments.start_issues(pages, is_start)
    none = F.col("code") == "no_start_pages"
    said = F.when(none, F.lit("No document start pages were detected")).otherwise(text_("First detected document starts at page ", F.col("page_number"), ", not page 1"))
    gaps = segments.long_gaps(pages.where(is_start), segments.totals(pages, "lot_id"))
    gaps = gaps.withColumn("page_number", F.col("gap_start"))
    # what documents lack, in one reading of the claims: they come from all pairs
    unread, doc = F.col("first_page_compact").isNull(), F.col("doc_index")
    issue = lambda code, message, row=None: F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.col("start_page" if row is None else row).cast("long").alias("at"), F.lit(row is None).alias("of_page")
    )
    lacks = F.array(
        F.when(unread, issue("missing_first_page_ocr", text_("Document ", doc, " has no first-page OCR payload"))),
        F.when(~unread & (F.col("n_accepted") == 0), issue("no_match", text_("Document ", doc, " has no valid CSV match"))),
        F.when(~unread & (F.col("n_accepted") > 1), issue("ambiguous_match", text_("Document ", doc, " has ", F.col("n_accepted"), " valid CSV candidates"))),
        F.when(F.col("n_claims") > 1, issue("duplicate_row_assignment", text_("CSV row ", F.col("claimed_row"), " is assigned to multiple documents"), "claimed_row")),
    )
    lacking = claims.select("lot_id", "doc_index", F.explode(F.filter(lacks, lambda i: i.isNotNull())).alias("i")).select(
        "lot_id", "doc_index", F.col("i.code").alias("code"), F.col("i.message").alias("message"),
        F.when(F.col("i.of_page"), F.col("i.at")).alias("page_number"), F.when(~F.col("i.of_page"), F.col("i.at")).alias("row_number"),
    )
    parts = [
        _issues(counts, F.lit("document_count_mismatch"), text_("Detected ", F.col("n_docs"), " documents for ", F.col("n_rows"), " CSV rows")),
        _issues(starts, F.col("code"), said),
        _issues(gaps, F.lit("long_gap_without_start"), text_(F.col("gap_length"), " pages without a new document between pages ", F.col("gap_start"), " and ", F.col("gap_end")), "warning"),
        _issues(lacking, F.col("code"), F.col("message")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lot_summary(pages: DataFrame, rows: DataFrame, documents: DataFrame, claims: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts of strict validation and whether anything but warnings was found."""
    count = lambda df, name: df.groupBy("lot_id").agg(F.count(F.lit(1)).alias(name))
    blocked = issues.groupBy("lot_id").agg(F.bool_or(F.col("severity") != "warning").alias("validation_blocked"))
    matched = claims.groupBy("lot_id").agg(F.count("assigned_row").alias("matched_document_count"))
    out = count(pages, "total_pages")
    for df in (count(rows, "csv_row_count"), count(documents, "detected_document_count"), matched, blocked):
        out = out.join(df, "lot_id", "full")
    return out.na.fill(0).na.fill(False)
