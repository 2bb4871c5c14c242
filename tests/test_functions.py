from pyspark.sql import functions as F

from lotloom.functions import similarity, text
from lotloom.operators import linkage


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalised(spark):
    assert one(spark, text.normalized(F.lit("Bon de Commande N° 0042 — ÉTÉ"))) == "bon de commande n 0042 ete"
    assert one(spark, text.normalized_exact(F.lit("Straße Œuvre ﬁn"))) == "strasse uvre fin"


def test_order_variants(spark):
    for value, want in (("000123", ["000123", "f00123"]), ("AB", []), ("0A", ["0", "fa"])):
        assert one(spark, text.order_variants(F.lit(value))) == want


def test_keyword_rule(spark):
    for value, want in (
        ("bon de commande du vendeur", True),
        ("bon de commande du vendeur fiche complement", False),
        ("bon de commande du distributeurs", False),
    ):
        assert one(spark, text.is_first_page(F.lit(value))) is want


def test_zone_values(spark):
    for value, kind, want in ((" 1 234,50 € ", "number", "1234,50"), ("le 03/04/2026", "date", "03/04/2026"), ("AB-12 é", "alphanumeric", "AB-12")):
        assert one(spark, text.zone_value(F.lit(value), F.lit(kind))) == want


def test_best_window():
    assert similarity.best_window("dupont", "xxdup0ntyy")[0] == 0.833333
    assert similarity.best_window("dupont", "dup")[0] == 0.666667
    assert similarity.best_window("dupont", "") == (0.0, "")


def test_rounded(spark):
    assert one(spark, linkage.rounded(F.lit(2.675), 2)) == 2.67
    assert one(spark, F.bround(F.lit(60.5)).cast("int")) == 60
