"""Linkage of documents and manifest rows.

Both sides are normalised before they meet. They always meet on the lot, so that a pair never crosses lots and no
plan is a nested loop over everything; inside a lot every pair counts, because even the best of no match is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lotloom.functions import scores, text
from lotloom.functions.similarity import window_similarity

#: Characters of the keys that tasks hold at once.
KEY_BYTES = 16 << 20
ROW_KEY = ["commande", "client_number", "distributeur", "client", "cote", "caisse"]


def prepared_rows(rows: DataFrame) -> DataFrame:
    """Manifest rows with what is sought of them."""
    return rows.withColumns(
        {
            "variants": text.order_variants(F.col("commande")),
            "client_digits": text.digits(F.col("client_number")),
            "distributor_key": text.compact(F.col("distributeur")),
            "client_key": text.compact(F.col("client")),
        }
    )


def pairs(documents: DataFrame, rows: DataFrame, page: str = "first_page_compact") -> DataFrame:
    """Every document with every row of its lot, and the four signs of a match.

    documents: lot_id, doc_index, start_page, ...; rows: lot_id, row_number and manifest columns.
    """
    met = documents.join(prepared_rows(rows), "lot_id")
    p = F.coalesce(F.col(page), F.lit(""))
    found = met.withColumns(
        {
            "order_exact": text.contained(F.col("variants"), p),
            "client_exact": (F.col("client_digits") != "") & F.contains(p, F.col("client_digits")),
            "client_window": window_similarity(F.col("client_key"), p),
            "distributor_window": window_similarity(F.col("distributor_key"), p),
        }
    )
    return found.withColumns({"client_score": F.col("client_window.score"), "distributor_score": F.col("distributor_window.score")})


def contained_links(docs: DataFrame, keys: DataFrame, doc: str, page: str, key_id: str, key: str, chunk_bytes: int = KEY_BYTES) -> DataFrame:
    """Links (doc, key_id) of pages that contain a whole key, of whatever length.

    An automaton over the keys reads each page once, so pages are not shuffled and nothing is compared pair by pair.
    Keys go to the tasks in chunks of chunk_bytes at most, each with a pass over the pages. Null and empty keys find
    nothing; a key is found once a page, and repeated keys and docs link as often as they are there.
    """
    import ahocorasick

    kind = docs.schema[doc].dataType.simpleString(), keys.schema[key_id].dataType.simpleString()
    schema = f"`{doc}` {kind[0]}, `{key_id}` {kind[1]}"

    def passed(chunk: dict[str, list]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(chunk)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for k, ids in sent.value.items():
                automaton.add_word(k, (k, ids))
            automaton.make_automaton()
            for batch in batches:
                of, found = [], []
                for i, text_ in enumerate(batch.column(1).to_pylist()):
                    for _, ids in dict(v for _, v in automaton.iter(text_)).items() if text_ else ():
                        of += [i] * len(ids)
                        found += ids
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(found, batch_kind)], names=[doc, key_id])

        return docs.select(doc, page).mapInArrow(find, schema)

    batch_kind = to_arrow_type(keys.schema[key_id].dataType)
    out, chunk, size = docs.sparkSession.createDataFrame([], schema), {}, 0
    for r in keys.select(key_id, key).where(F.length(key) > 0).toLocalIterator():
        if size + len(r[1]) > chunk_bytes and chunk:
            out, chunk, size = out.unionByName(passed(chunk)), {}, 0
        chunk.setdefault(r[1], []).append(r[0])
        size += len(r[1])
    return out.unionByName(passed(chunk)) if chunk else out


def strict_candidates(found: DataFrame) -> DataFrame:
    """Candidates of strict validation with score, rank (W4) and accepted count (A2)."""
    four = [F.col(c) for c in ("order_exact", "client_exact", "distributor_score", "client_score")]
    signs = [four[0], four[1], four[2] > 0.90, four[3] > 0.90]
    kept = found.where(scores.strict_emitted(*four)).withColumns(
        {
            "qualifies": scores.strict_qualifies(*four),
            "score": scores.strict_score(*four),
            "n_matched": sum((s.cast("int") for s in signs), F.lit(0)),
        }
    )
    of_doc = Window.partitionBy("lot_id", "doc_index")
    order = [F.col(c).desc() for c in ("qualifies", "order_exact", "client_exact", "n_matched", "score")]
    return kept.withColumns(
        {
            "rank": F.row_number().over(of_doc.orderBy(*order, "row_number")),
            "n_accepted": F.count_if("qualifies").over(of_doc),
        }
    )


def field_results(found: DataFrame) -> DataFrame:
    """found with fields: what was sought of each manifest field, whether and as what it was found, and its score."""
    digit_fields = {"commande": ("order_exact", "variants"), "client_number": ("client_exact", "client_digits")}
    page = F.coalesce(F.col("first_page_compact"), F.lit(""))
    fields = []
    for name, (sign, _) in digit_fields.items():
        sought = F.array_join("variants", " | ") if name == "commande" else F.col("client_digits")
        hit = text.first_contained(F.col("variants"), page) if name == "commande" else F.col("client_digits")
        fields.append((name, F.col(sign), sought, F.when(F.col(sign), hit), F.col(sign).cast("int").cast("double")))
    for name, key, window, score in (
        ("distributeur", "distributor_key", "distributor_window", "distributor_score"),
        ("client", "client_key", "client_window", "client_score"),
    ):
        fields.append((name, F.col(score) > 0.90, F.col(key), F.when(F.col(score) > 0, F.col(f"{window}.occurrence")), F.col(score)))
    return found.withColumn("fields", F.array(*[
        F.struct(F.lit(n).alias("field"), m.alias("matched"), F.coalesce(F.col(n), F.lit("")).alias("expected"), sought.alias("normalized"), score.alias("score"), hit.alias("occurrence"))
        for n, m, sought, hit, score in fields
    ]))


def strict_assignments(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with accepted count, assigned row and blocked reason; rows claimed twice are nobody's."""
    accepted = candidates.where("qualifies").groupBy("lot_id", "doc_index").agg(
        F.count(F.lit(1)).alias("n_accepted"), F.min("row_number").alias("claimed_row")
    )
    # met by lot, where both lie: looking through a lot's accepted documents is less than the pairs they came from
    of_lot = accepted.groupBy("lot_id").agg(F.collect_list(F.struct("doc_index", "n_accepted", "claimed_row")).alias("_accepted"))
    own = F.get(F.filter("_accepted", lambda a: a["doc_index"] == F.col("doc_index")), F.lit(0))
    claims = documents.join(of_lot, "lot_id", "left").withColumn("_own", own).withColumns(
        {"n_accepted": F.coalesce("_own.n_accepted", F.lit(0)), "claimed_row": F.col("_own.claimed_row")}
    ).drop("_accepted", "_own")
    claims = claims.withColumn("claimed_row", F.when(F.col("n_accepted") == 1, F.col("claimed_row")))
    n_claims = F.when(F.col("claimed_row").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("lot_id", "claimed_row")))
    reason = (
        F.when(F.col("first_page_compact").isNull(), F.lit("Missing first-page OCR"))
        .when(F.col("n_accepted") == 0, F.lit("No CSV row satisfied the exact numeric and fuzzy text rule"))
        .when(F.col("n_accepted") > 1, F.lit("Multiple CSV rows satisfy the matching rule"))
        .when(F.col("n_claims") > 1, F.concat(F.lit("CSV row "), F.col("claimed_row").cast("string"), F.lit(" is claimed by multiple documents")))
    )
    return claims.withColumn("n_claims", n_claims).withColumns(
        {"assigned_row": F.when(F.col("n_claims") == 1, F.col("claimed_row")), "blocked_reason": reason}
    )


def recon_candidates(found: DataFrame) -> DataFrame:
    """Every pair with the scores of reconciliation (F21, F22, P11, F11) and its ranks by document and row.

    Pairs are many more than pages: they are ranked inside their lot, where they lie already, and what is only told of
    them is added after that.
    """
    order, number = F.col("order_exact"), F.col("client_exact")
    client, distributor = F.col("client_score"), F.col("distributor_score")
    rated = found.withColumns(
        {
            "global_score": rounded(scores.global_score(order, number, client, distributor), 3),
            "is_exact": scores.exact_match(order, number, client, distributor),
            "client_percent": text.percent(client),
            "distributor_percent": text.percent(distributor),
        }
    )
    by = lambda *c: Window.partitionBy("lot_id", *c).orderBy(*best_first())
    ranked = rated.withColumn("rank_for_row", F.row_number().over(by("row_number"))).withColumn("rank_for_doc", F.row_number().over(by("doc_index")))
    return told(ranked).withColumn("sort_key", sort_key())


def told(candidates: DataFrame) -> DataFrame:
    """candidates with what is only told of them: the whole percentage and the fields to look at."""
    order, number, client, distributor = (F.col(c) for c in ("order_exact", "client_exact", "client_score", "distributor_score"))
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(scores.global_score(order, number, client, distributor)).cast("int")))
    return candidates.withColumns({"global_percent": percent, "verify_fields": text.to_verify(order, number, client, distributor)})


def rounded(c: Column, places: int) -> Column:
    """Rounding of the double's exact binary value, as Python does it; Spark rounds its shortest decimal form.

    Only near ties does the binary value matter. There twice the scaled value is compared with an odd number without
    error: of the two parts of the value each has few enough bits for its product to be exact.
    """
    v, scale = c.cast("double"), float(10**places)
    x = v * scale
    below = F.floor(x).cast("double")
    head = v * 134217729.0 - (v * 134217729.0 - v)
    over = (head * (2 * scale) - (below * 2 + 1)) + (v - head) * (2 * scale)
    tie = F.when(over > 0, below + 1).when(over < 0, below).when(below % 2 == 0, below).otherwise(below + 1)
    near = F.abs(x - below - 0.5) < 1e-6
    return F.when(near, tie).otherwise(F.rint(x)) / scale


def signature() -> Column:
    """What ranks a candidate first."""
    flag = lambda c: F.col(c).cast("int")
    return F.struct(
        (F.col("order_exact") & F.col("client_exact")).cast("int").alias("both"), flag("order_exact").alias("o"), flag("client_exact").alias("n"),
        F.col("distributor_percent").alias("d"), F.col("client_percent").alias("c"),
    )


def sort_key() -> Column:
    """The candidate order of reconciliation, larger first."""
    s = signature()
    return F.struct(*[s[k].alias(k) for k in ("both", "o", "n", "d", "c")], F.col("global_score").alias("g"), (-F.col("row_number")).alias("r"), (-F.col("start_page")).alias("p"))


def best_first() -> list[Column]:
    """The order of sort_key, as columns to sort by."""
    s = signature()
    return [*[s[k].desc() for k in ("both", "o", "n", "d", "c")], F.col("global_score").desc(), F.col("row_number"), F.col("start_page")]


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """rows with is_duplicate: another row of the lot has the same six keys.

    They are counted in their lot, where lots are dealt over tasks already; rows of one key are read one after another.
    """
    keys = [text.digits(F.col(c)) if c in ("commande", "client_number") else text.compact(F.col(c)) for c in ROW_KEY]
    named = F.struct(*[F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)])
    keyed = rows.withColumn("_key", named)
    return keyed.withColumn("is_duplicate", F.count(F.lit(1)).over(Window.partitionBy("lot_id", "_key")) > 1).select(*rows.columns, "is_duplicate")
