"""Report tables and operator revalidation.

A workbook is a set of DataFrames here, one for each sheet, which any sink can write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.functions import text
from lotloom.operators import assignment
from lotloom.operators.reconciliation import MANUAL, OK, REVIEW

VALIDATED = "Validé"
ISSUE_LINES, ORPHAN_LINES = 22, 19

#: Sheet headers and where they come from, in sheet order (K3).
RECON_COLUMNS = {
    "Statut": "effective_status", "Nom PDF": "pdf_name", "Ouvrir PDF": "link", "Champs à vérifier": "verify_fields",
    "Validation opérateur": "validation_operator", "Note opérateur": "review_note", "N° Commande": "commande", "N° Client": "client_number",
    "Distributeur": "distributeur", "Client": "client", "Cote": "cote", "Caisse": "caisse", "Détails": "details", "Statut système": "status",
    "Ligne source": "source_row", "Manuel": "manual", "Erreur de validation": "validation_error", "PDF suggéré": "suggested_pdf_name",
    "PDF détecté": "detected_pdf_name", "Page début": "start_page", "Page fin": "end_page", "Nb pages": "page_count",
    "Type d'association": "match_type", "Score global": "global_score", "Commande exacte": "commande_exact",
    "N° Client exact": "client_number_exact", "Score client": "client_percent", "Score distributeur": "distributeur_percent",
    "Motif diagnostic": "diagnostic_reason",
}

#: K4.
ORPHAN_COLUMNS = {
    "Nom PDF": "pdf_name", "Ouvrir PDF": "link", "Page début": "start_page", "Page fin": "end_page", "Nb pages": "page_count",
    "Meilleure ligne candidate": "best_source_row", "N° Commande candidat": "best_commande", "N° Client candidat": "best_client_number",
    "Distributeur candidat": "best_distributeur", "Client candidat": "best_client", "Cote candidat": "best_cote",
    "Caisse candidat": "best_caisse", "Motif": "reason", "Note opérateur": "review_note",
}


def effective_status(operator: Column, pdf: Column, system: Column) -> Column:
    """The operator's word counts once a file is named."""
    return F.when((F.coalesce(operator, F.lit("")) == VALIDATED) & (F.coalesce(pdf, F.lit("")) != ""), F.lit(VALIDATED)).otherwise(system)


def link(pdf: Column) -> Column:
    """Path of a split file, empty without a name."""
    return F.when(F.coalesce(pdf, F.lit("")) != "", F.concat(F.lit("sep/"), pdf)).otherwise(F.lit(""))


def prevalidated(status: Column) -> Column:
    """F52."""
    return F.when(status == OK, F.lit(VALIDATED)).otherwise(F.lit(""))


def _sheet(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("lot_id", *[F.col(c).alias(h) for h, c in columns.items()])


def recon_sheet(row_lines: DataFrame) -> DataFrame:
    """K3."""
    full = row_lines.withColumn("validation_operator", prevalidated(F.col("status")))
    full = full.withColumns(
        {
            "effective_status": effective_status(F.col("validation_operator"), F.col("pdf_name"), F.col("status")),
            "link": link(F.col("pdf_name")),
            "details": F.lit(""),
        }
    )
    return _sheet(full, RECON_COLUMNS)


def orphan_sheet(document_lines: DataFrame) -> DataFrame:
    """Documents that no row took (K4)."""
    lost = document_lines.where(F.col("status").isin(assignment.AMBIGUOUS, assignment.UNMATCHED))
    return _sheet(lost.withColumns({"link": link(F.col("pdf_name")), "review_note": F.lit("")}), ORPHAN_COLUMNS)


def list_sheet(document_lines: DataFrame) -> DataFrame:
    """File names as text sorts them."""
    return document_lines.orderBy("lot_id", "pdf_name")


def diagnostics(row_lines: DataFrame, document_lines: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """A table for each section of the diagnostics sheet (K5, P20, A5)."""
    s = F.col("status")
    counts = row_lines.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("Lignes CSV"), F.count_if(s == OK).alias("OK"), F.count_if(s == REVIEW).alias("À vérifier"),
        F.count_if(s == assignment.AMBIGUOUS).alias("Ambigus"), F.count_if(s == assignment.MISSING).alias("Sans PDF"), F.count_if(s == MANUAL).alias("Manuels"),
    )
    docs = document_lines.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("PDF générés"), F.count_if(s.isin(assignment.AMBIGUOUS, assignment.UNMATCHED)).alias("PDF non affectés")
    )
    warned = pages.where(F.size("warnings") > 0).select(
        "lot_id", F.col("page_number").cast("string").alias("page"), text.oui_non(F.col("is_new_document")).alias("nouveau_document"),
        text.percent(F.col("score")).alias("score_papier"), F.array_join("warnings", "; ").alias("avertissements"),
    )
    quiet = pages.select("lot_id").distinct().join(warned.select("lot_id").distinct(), "lot_id", "left_anti").select(
        "lot_id", F.lit("-").alias("page"), F.lit("-").alias("nouveau_document"), F.lit(None).cast("int").alias("score_papier"),
        F.lit("Aucun avertissement de séparation détecté").alias("avertissements"),
    )
    return {
        "metadata": counts.join(docs, "lot_id", "full"),
        "to_verify": row_lines.where(s == REVIEW).select("lot_id", "source_row", "pdf_name", "verify_fields"),
        "ambiguous": row_lines.where(s == assignment.AMBIGUOUS).select("lot_id", "source_row", "commande", "client_number", "client", "suggested_pdf_name", "diagnostic_reason"),
        "duplicates": row_lines.where(F.col("diagnostic_reason") == assignment.DUPLICATE).select("lot_id", "source_row", "commande", "client_number", "client", "diagnostic_reason"),
        "separation": warned.unionByName(quiet),
    }


# --- revalidation of an edited workbook ---


def _key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def used_counts(rows: DataFrame, name: str = "pdf_name") -> DataFrame:
    """How often each file is chosen, whatever its case."""
    return rows.where(_key(F.col(name)) != "").groupBy("lot_id", _key(F.col(name)).alias("key")).agg(F.count(F.lit(1)).alias("n_used"))


def row_errors(rows: DataFrame, available: DataFrame) -> DataFrame:
    """rows with validation_error (F16, J15): the file's name, presence and single use, and a manual row's fields."""
    there = available.select("lot_id", _key(F.col("pdf_name")).alias("key"), F.lit(True).alias("_there")).where("key <> ''").distinct()
    met = rows.withColumn("key", _key(F.col("pdf_name"))).join(there, ["lot_id", "key"], "left").join(used_counts(rows), ["lot_id", "key"], "left")
    named = F.col("key") != ""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    manual = F.lower(F.trim(F.coalesce("manual", F.lit("")))) == "oui"
    needed = {"commande": "N° Commande", "client_number": "N° Client", "distributeur": "Distributeur", "client": "Client", "cote": "Cote", "caisse": "Caisse"}
    messages = [
        F.when(~named & (F.trim("validation_operator") == VALIDATED), F.lit("Impossible de valider sans Nom PDF")),
        F.when(named & ~F.col("key").endswith(".pdf"), F.lit("Le nom du PDF doit se terminer par .pdf")),
        F.when(named & F.col("_there").isNull(), F.lit("Le fichier PDF est introuvable dans sep/")),
        F.when(named & (F.col("n_used") > 1), F.lit("Le même PDF est utilisé plusieurs fois")),
        *[F.when(manual & blank(c), F.lit(f"{label} obligatoire pour une ligne manuelle")) for c, label in needed.items()],
    ]
    return met.withColumn("validation_error", text.joined(messages)).drop("key", "_there", "n_used")


def orphans(available: DataFrame, rows: DataFrame, details: DataFrame, notes: DataFrame) -> DataFrame:
    """Files nobody chose, with what is known of them and the operator's notes."""
    left = available.withColumn("key", _key(F.col("pdf_name"))).where("key <> ''").join(used_counts(rows), ["lot_id", "key"], "left_anti")
    known = details.withColumn("key", _key(F.col("pdf_name"))).select("lot_id", "key", F.col("pdf_name").alias("detail_name"), "reason")
    noted = notes.withColumn("key", _key(F.col("pdf_name"))).select("lot_id", "key", "review_note")
    met = left.select("lot_id", "key", "pdf_name").join(known, ["lot_id", "key"], "left").join(noted, ["lot_id", "key"], "left")
    return met.select(
        "lot_id", F.coalesce("detail_name", "pdf_name").alias("pdf_name"),
        F.coalesce("reason", F.lit("PDF présent dans sep/ mais non référencé")).alias("reason"), F.coalesce("review_note", F.lit("")).alias("review_note"),
    )


def report_lines(df: DataFrame, order: list[str], most: int = ISSUE_LINES) -> DataFrame:
    """The first lines of a report section."""
    return df.orderBy(*order).limit(most)
