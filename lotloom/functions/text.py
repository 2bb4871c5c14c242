"""Text functions of lot reconciliation, as column expressions.

All of them stay inside the JVM but `normalized_exact`, which covers the few letters that the expression can't
decompose and is meant for tests and for corpora that hold such letters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīıłńňőřśšţťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegiilnnorssttuuuzzz"

#: Words that mark a document's first page, in reporting order, with the expression that finds each.
KEYWORDS = {
    "bon de commande": r"\bbon\s+de\s+commande\b",
    "du": r"\bdu\b",
    "vendeur": r"\bvendeur\b",
    "distributeur": r"\bdistributeur\b",
}
EXCLUDED = r"\bfiche\s+complement\b"

#: Characters that stay for each type of zone.
ZONE_KEEPS = {"number": "[^0-9.,-]", "date": "[^0-9/.-]", "alphanumeric": "[^A-Za-z0-9_-]"}


def strip(c: Column) -> Column:
    """Python's strip(): Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(c: Column) -> Column:
    """Lower case, accents off, anything but a-z, 0-9 to single spaces (F1)."""
    flat = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)
    # plain ASCII, as most pages are, has nothing to replace
    flat = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.regexp_replace(flat, r"\p{Mn}+", ""))
    return F.trim(F.regexp_replace(flat, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalized_exact(texts: pd.Series) -> pd.Series:
    """F1 with full Unicode decomposition: ligatures, full-width and circled letters too."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        flat = (c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in flat).split())

    return texts.map(one)


def compact(c: Column) -> Column:
    """Normalised text without spaces (F2)."""
    return F.replace(normalized(c), F.lit(" "), F.lit(""))


def digits(c: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(c, r"(?U)\D+", "")


def order_variants(c: Column) -> Column:
    """Spellings under which an order number may stand on a page (F4): its digits, and f + the rest after one zero."""
    d = digits(c)
    with_f = F.when(c.startswith("0") & (d != ""), F.concat(F.lit("f"), compact(F.substr(c, F.lit(2), F.lit(1 << 20)))))
    return F.array_distinct(F.filter(F.array(d, with_f), lambda v: v.isNotNull() & (v != "")))


def contained(variants: Column, page: Column) -> Column:
    """Whether any variant stands in the space-less page."""
    return F.exists(variants, lambda v: F.contains(page, v))


def first_contained(variants: Column, page: Column) -> Column:
    """The first variant that stands in the page, else null."""
    return F.get(F.filter(variants, lambda v: F.contains(page, v)), F.lit(0))


def found_keywords(norm: Column) -> Column:
    """Keywords in a normalised text, in order."""
    return F.filter(F.array(*[F.when(norm.rlike(p), F.lit(k)) for k, p in KEYWORDS.items()]), lambda k: k.isNotNull())


def missing_keywords(found: Column) -> Column:
    """All keywords but those found (U4)."""
    return F.array_except(F.array(*map(F.lit, KEYWORDS)), found)


def is_first_page(norm: Column, min_keywords: int = 3) -> Column:
    """Whether a page starts a document (P3): enough keywords, and not the excluded phrase."""
    return (F.size(found_keywords(norm)) >= min_keywords) & ~norm.rlike(EXCLUDED)


def zone_value(c: Column, kind: Column) -> Column:
    """A zone's text by type (F8): white space collapsed, then only the type's characters."""
    clean = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    out = clean
    for k, drop in ZONE_KEEPS.items():
        out = F.when(kind == k, F.regexp_replace(clean, drop, "")).otherwise(out)
    return out


def percent(v: Column) -> Column:
    """0..100, a half going to the even number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(v * 100).cast("int")))


def oui_non(c: Column) -> Column:
    """oui or non."""
    return F.when(c, F.lit("oui")).otherwise(F.lit("non"))


def _present(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def to_verify(order_exact: Column, client_exact: Column, client: Column, distributor: Column) -> Column:
    """Fields an operator must look at."""
    low = lambda name, v: F.concat(F.lit(f"{name} ("), percent(v).cast("string"), F.lit(")"))
    return _present(
        F.when(~order_exact, F.lit("Commande")),
        F.when(~client_exact, F.lit("N° Client")),
        F.when(client < 0.90, low("Client", client)),
        F.when(distributor < 0.70, low("Distributeur", distributor)),
    )


def joined(messages: list[Column], by: str = "; ") -> Column:
    """Messages that are not null, joined."""
    return F.array_join(_present(*messages), by)


def lot_number(name: Column) -> Column:
    """Number of a lot folder, null for other names."""
    return F.when(name.rlike(r"^VN LOT \d+$"), F.regexp_extract(name, r"^VN LOT (\d+)$", 1).cast("long"))


def short_id(prefix: str = "tpl_") -> Column:
    """A fresh id: the prefix and 12 hexadecimal digits."""
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def utc_iso(c: Column) -> Column:
    """ISO 8601 text of a timestamp in the session's zone, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
