"""One-to-one assignment of documents to manifest rows.

The rounds of a lot depend on one another, so each lot is settled in one piece from its candidate table. Lots are dealt
over tasks by key and stream through them in chunks of whole lots, whose rounds run side by side (`assign_lot` is the
plain form for one); the largest lot bounds a task, and a lot is a box of scanned paper. `best_mutual` is the relational form of a single round, for tables too large for a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotloom.operators import linkage

AMBIGUOUS, MISSING, UNMATCHED = "Ambigu", "Sans PDF", "Non affecté"
DUPLICATE, MANY_EXACT, TIE, UNDECIDABLE = (
    "Doublon possible",
    "Plusieurs exact matches",
    "Ex æquo sur le meilleur score",
    "Affectation non tranchable",
)

WHY = [None, DUPLICATE, MANY_EXACT, TIE, UNDECIDABLE]
#: Candidates that a task settles at once.
CHUNK = 200_000


def assign_lot(cands: list[dict]) -> tuple[dict[int, int], dict[int, str], dict[int, str]]:
    """Assignment doc -> row, reasons of ambiguous docs, and of ambiguous rows, for one lot.

    A candidate has doc, row, key (a tuple, larger is better), score, exact, signature, start, duplicate.
    Documents are visited by start page. Steps: unambiguous exact candidates, best first; then rounds in which each
    document left proposes to its best row left unless two share the best score, best proposals first; then ties.
    """
    by_doc: dict[int, list[dict]] = {}
    for c in sorted(cands, key=lambda c: c["key"], reverse=True):
        by_doc.setdefault(c["doc"], []).append(c)
    docs = sorted(by_doc, key=lambda d: (by_doc[d][0]["start"], d))
    open_docs, open_rows = set(docs), {c["row"] for c in cands}
    given: dict[int, int] = {}
    doc_reason: dict[int, str] = {}
    row_reason: dict[int, str] = {}

    def grant(offers: list[dict]) -> list[dict]:
        """Takes offers best first; returns those that came too late."""
        late = []
        for c in sorted(offers, key=lambda c: c["key"], reverse=True):
            if c["row"] in open_rows and c["doc"] in open_docs:
                given[c["doc"]] = c["row"]
                open_rows.discard(c["row"])
                open_docs.discard(c["doc"])
            else:
                late.append(c)
        return late

    sure = []
    for d in docs:
        exact = [c for c in by_doc[d] if c["exact"]]
        if len(exact) > 1 and exact[0]["signature"] == exact[1]["signature"]:
            why = DUPLICATE if any(c["duplicate"] for c in exact) else MANY_EXACT
            doc_reason[d] = why
            open_docs.discard(d)
            for c in exact:
                row_reason.setdefault(c["row"], why)
                open_rows.discard(c["row"])
        elif exact:
            sure.append(exact[0])
    for c in grant(sure):
        doc_reason.setdefault(c["doc"], UNDECIDABLE)
        open_docs.discard(c["doc"])

    while True:
        offers = []
        for d in open_docs:
            left = [c for c in by_doc[d] if c["row"] in open_rows][:2]
            if left and (len(left) < 2 or left[0]["score"] != left[1]["score"]):
                offers.append(left[0])
        if not offers:
            break
        grant(offers)

    for d in (d for d in docs if d in open_docs):
        left = [c for c in by_doc[d] if c["row"] in open_rows]
        tied = [c for c in left if c["score"] == left[0]["score"]]
        if len(tied) > 1:
            doc_reason[d] = DUPLICATE if any(c["duplicate"] for c in tied) else TIE
            for c in tied:
                row_reason.setdefault(c["row"], doc_reason[d])
    return given, doc_reason, row_reason


def settled(candidates: DataFrame, *more: str) -> DataFrame:
    """Every candidate with more columns of it, both ranks, and what became of its two sides.

    doc_partner is the row its document got and row_partner the document its row got; doc_reason and row_reason say
    why a side is ambiguous. So outputs are chosen from one table without meeting it again.
    candidates: as of linkage.recon_candidates, with is_duplicate of the row. They are sorted in their lot, without a
    shuffle where they lie by lot; a task holds CHUNK candidates, or those of a larger lot.
    """
    of_lot = Window.partitionBy("lot_id").orderBy("doc_index", *linkage.best_first())
    signature = (F.col("order_exact").cast("int") * 2 + F.col("client_exact").cast("int")) * 10201 + F.col("distributor_percent") * 101 + F.col("client_percent")
    used = ["lot_id", "doc_index", "row_number", "start_page", "is_exact", "is_duplicate", "global_score", "rank_for_doc", "rank_for_row"]
    narrow = candidates.select(F.row_number().over(of_lot).alias("_at"), signature.alias("_signature"), *dict.fromkeys([*used, *more]))

    chunk = CHUNK

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(0).to_numpy() == 1)
            if size >= chunk and len(starts):
                yield from settle_lots(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                batch, held, size = batch.slice(starts[-1]), [], 0
            held.append(batch)
            size += len(batch)
        if size:
            yield from settle_lots(pa.Table.from_batches(held))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[2:]]
    return narrow.mapInArrow(verdicts, ", ".join([*kinds, "doc_partner long, doc_reason string, row_partner long, row_reason string"]))


def settle_lots(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """assign_lot for many whole lots at once: candidates in the order of lot, document and rank, with _at from 1 in each lot."""
    col = lambda n, t: np.asarray(table.column(n).cast(t).fill_null(0).combine_chunks(), dtype=t)
    flag = lambda n: np.asarray(pc.fill_null(table.column(n), False).combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    n = table.num_rows
    if not n:
        return
    lot = np.cumsum(col("_at", "int64") == 1)
    doc_index, row_number, start = (col(c, "int64") for c in ("doc_index", "row_number", "start_page"))
    score, signature, for_row = col("global_score", "float64"), col("_signature", "int64"), col("rank_for_row", "int64")
    exact, duplicate = flag("is_exact"), flag("is_duplicate")
    first = np.r_[True, (lot[1:] != lot[:-1]) | (doc_index[1:] != doc_index[:-1])]
    doc = np.cumsum(first) - 1
    row = np.unique(lot * n + np.unique(row_number, return_inverse=True)[1], return_inverse=True)[1]
    head = np.flatnonzero(first)
    visit = np.empty(len(head), np.int64)  # documents by start page
    visit[np.lexsort((doc_index[head], start[head], lot[head]))] = np.arange(len(head))
    n_rows = int(row.max()) + 1
    open_doc, open_row = np.ones(len(head), bool), np.ones(n_rows, bool)
    doc_partner, row_partner = np.full(len(head), -1), np.full(n_rows, -1)  # places of candidates
    doc_why, row_why = np.zeros(len(head), np.int8), np.zeros(n_rows, np.int8)

    def grant(offers: np.ndarray) -> None:
        """Each open row takes its best offer."""
        offers = offers[open_row[row[offers]] & open_doc[doc[offers]]]
        offers = offers[np.lexsort((for_row[offers], row[offers]))]
        won = offers[np.r_[True, row[offers][1:] != row[offers][:-1]][: len(offers)]]
        doc_partner[doc[won]], row_partner[row[won]] = won, won
        open_doc[doc[won]] = open_row[row[won]] = False

    def ambiguous(places: np.ndarray, other: int) -> None:
        """Documents of places, and their rows, are told why; a row hears it from the first such document."""
        twice = np.zeros(len(head), bool)
        twice[doc[places[duplicate[places]]]] = True
        doc_why[doc[places]] = np.where(twice[doc[places]], WHY.index(DUPLICATE), other)
        places = places[row_why[row[places]] == 0]
        places = places[np.lexsort((visit[doc[places]], row[places]))]
        told = places[np.r_[True, row[places][1:] != row[places][:-1]][: len(places)]]
        row_why[row[told]] = doc_why[doc[told]]

    def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places are the first of their document, and which are followed by another of it."""
        same = doc[places][1:] == doc[places][:-1]
        return np.r_[True, ~same][: len(places)], np.r_[same, False][: len(places)]

    sure = np.flatnonzero(exact)
    lead, more = runs(sure)
    following = np.r_[sure[1:], 0][: len(sure)]
    alike = lead & more & (signature[sure] == signature[following])
    unsure = np.zeros(len(head), bool)
    unsure[doc[sure[alike]]] = True
    ambiguous(sure[unsure[doc[sure]]], WHY.index(MANY_EXACT))
    open_doc[unsure] = False
    open_row[row[sure[unsure[doc[sure]]]]] = False
    sure = sure[lead & ~unsure[doc[sure]]]
    grant(sure)
    late = doc[sure][open_doc[doc[sure]]]
    doc_why[late], open_doc[late] = WHY.index(UNDECIDABLE), False

    left, over = np.arange(n), []
    while len(left):
        left = left[open_doc[doc[left]] & open_row[row[left]]]
        lead, more = runs(left)
        following = np.r_[left[1:], 0][: len(left)]
        offers = left[lead & ~(more & (score[left] == score[following]))]
        busy = np.isin(lot[left], lot[offers])  # a lot without an offer is done
        over.append(left[~busy])
        grant(offers)
        left = left[busy]
    left = np.sort(np.concatenate(over)) if over else left
    lead, _ = runs(left)
    best = np.zeros(len(head))
    best[doc[left[lead]]] = score[left[lead]]
    tied = left[score[left] == best[doc[left]]]
    count = np.bincount(doc[tied], minlength=len(head))
    ambiguous(tied[count[doc[tied]] > 1], WHY.index(TIE))

    names = pa.array(WHY, pa.string())
    d, r = doc_partner[doc], row_partner[row]
    added = [
        pa.array(row_number[d], pa.int64(), mask=d < 0), names.take(pa.array(doc_why[doc])),
        pa.array(doc_index[r], pa.int64(), mask=r < 0), names.take(pa.array(row_why[row])),
    ]
    for name, column in zip(("doc_partner", "doc_reason", "row_partner", "row_reason"), added, strict=True):
        table = table.append_column(name, column)
    yield from table.drop_columns(["_at", "_signature"]).combine_chunks().to_batches(max_chunksize=10_000)


def verdicts(candidates: DataFrame) -> DataFrame:
    """(lot_id, side, id, partner, reason): for each document ('doc') and row ('row') that was assigned or is ambiguous.

    candidates: as of settled.
    """
    side = lambda name, key, rank: F.when(
        (F.col(rank) == 1) & (F.col(f"{name}_partner").isNotNull() | F.col(f"{name}_reason").isNotNull()),
        F.struct(F.lit(name).alias("side"), F.col(key).cast("long").alias("id"), F.col(f"{name}_partner").alias("partner"), F.col(f"{name}_reason").alias("reason")),
    )
    both = F.filter(F.array(side("doc", "doc_index", "rank_for_doc"), side("row", "row_number", "rank_for_row")), lambda v: v.isNotNull())
    return candidates.select("lot_id", F.explode(both).alias("v")).select("lot_id", "v.*")


def assign(candidates: DataFrame) -> DataFrame:
    """verdicts of candidates as of linkage.recon_candidates."""
    return verdicts(settled(candidates))


def best_mutual(pairs: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """Pairs that are each other's best: one round of proposals, in two windows."""
    ranked = pairs.withColumns(
        {
            "_l": F.row_number().over(Window.partitionBy(left).orderBy(*order)),
            "_r": F.row_number().over(Window.partitionBy(right).orderBy(*order)),
        }
    )
    return ranked.where("_l = 1 AND _r = 1").drop("_l", "_r")
