import re

import pytest

from shelfspark.functions import quantity as q
from shelfspark.operators import features


@pytest.mark.parametrize("title, size", [
    ("Pepsi 2.25 Liters", (2.25, "l")), ("Tea 75gm", (75.0, "g")), ("Rice 1.8 KG", (1.8, "kg")),
    ("Juice 1,000 ml", (1.0, "ml")), ("Spice 75gms", None), ("Eggs 12 pcs", (12.0, "pc")),
    ("Soap 6 pack", (6.0, "pc")), ("Oil 1 l pack of 5 x 200 ml", (200.0, "ml")),
    ("Milk 500 millilitres", (500.0, "ml")), ("Water", None), ("Flour 10 kgs 500 g", (500.0, "g")),
    ("Milk 1 L", (1.0, "l")), (None, None)])
def test_size(cell, title, size):
    got = cell(q.size("x"), x=title)
    assert (None if got is None else (got["size_value"], got["size_unit"])) == size


@pytest.mark.parametrize("title, packs", [
    ("Cola (Pack of 12)", 12), ("Cola pack 250 ml", 0), ("Cola 345ML x12", 0), ("Eggs 6 pcs", 6),
    ("Cola Pk of 4", 4), ("Soap pack (3)", 3), ("Cola pack of 6 330 ml", 6), ("Pack of 0", 0),
    ("pack of 500 g, 4 pc", 4), ("Pk 8", 8), ("5000 pcs", 0), ("Tea", 0)])
def test_pack_count(cell, title, packs):
    assert cell(q.pack_count("x"), x=title) == packs


@pytest.mark.parametrize("title, search, catalogue", [
    ("Coca Cola 1.5 lt", "Coca", "Coca"), ("coca-cola can", "Coca-Cola", "Coca-Cola"),
    ("7up 1l", "7Up", "7Up"), ("drink 7up", "7Up", "Drink"), ("Super NESTLE", "Nestle", "Nestle"),
    ("supreme tea", "Supreme", "Supreme"), ("(Olper's) milk", "Olpers", "Olpers"),
    ("peek freans sooper", "Peek Freans", "Peek Freans"), ("*** x", "Unknown", "Unknown"),
    ("", "Unknown", "Unknown"), (None, "Unknown", "Unknown")])
def test_brand(cell, title, search, catalogue):
    assert cell(q.brand("x", q.BRANDS), x=title) == search
    assert cell(q.brand("x", q.CATALOGUE_BRANDS), x=title) == catalogue


@pytest.mark.parametrize("known", [
    ["cola", "coca-cola", "diet coca"], ["coca-cola", "cola"], ["a+b", "b c", "b", "a.c", "c d e", "d"],
    ["tea", "tea time", "time out"], q.BRANDS])
def test_brands_that_overlap(spark, known):
    titles = ["Diet Coca-Cola", "coca-cola", "x a+bc", "a+b c d e", "abc", "tea time out", "TIME out", "cola cola",
              *[f"big {b.upper()} pack" for b in known]]
    rows = spark.createDataFrame([(t,) for t in titles], "x string").select("x", q.brand("x", known).alias("b"))
    for title, got in rows.collect():
        hit = [b for b in known if re.search(rf"\b{re.escape(b)}\b", title.lower())]
        if hit or title.isalnum():
            assert got == (hit[0] if hit else title.split()[0]).title(), title


def test_looser_rules(cell):
    assert cell(q.deal_quantity("x"), x="17 large") == 17000.0
    assert cell(q.deal_quantity("x"), x="Tea 250g") == 250.0
    assert cell(q.deal_quantity("x"), x="Tea") == 1.0
    assert cell(q.value_keyword_score("x"), x="Premium Fresh value pack") == 1
    assert cell(q.value_keyword_score("x"), x=None) == 0
    for raw, unit in (("Ltr", "l"), ("ML", "ml"), ("gm", "g"), ("KGS", "kg"), ("packnum", "pc")):
        assert cell(q.canonical_unit("x"), x=raw) == unit


def _listings(spark, rows):
    return spark.createDataFrame(rows, "site string, title string, price string")


def test_notes_and_prices(spark):
    rows = features.feature_table(_listings(spark, [
        ("A", "Cola 500 ml (Pack of 6)", "300"), ("A", "Cola", "80"), ("A", "Rice 2kg", "n/a"),
        ("A", "Cups pack of 3", "90")])).orderBy("title").collect()
    got = {r["title"]: r for r in rows}
    assert got["Cola"]["notes"] == "no-size-no-pack" and got["Cola"]["per_unit_price"] == 80.0
    assert got["Rice 2kg"]["notes"] == "no-pack" and got["Rice 2kg"]["unit_price"] is None
    assert got["Cups pack of 3"]["notes"] == "no-size"
    pack = got["Cola 500 ml (Pack of 6)"]
    assert (pack["unit_price"], pack["unit_price_unit"]) == (0.6, "PKR/ml")
    assert (pack["per_unit_price"], pack["total_volume"]) == (50.0, 3000.0)
    assert pack["brand_category"] == "Cola"


@pytest.mark.parametrize("titles, kept", [
    (["a 1l", "b 2l", "c 3kg", "d 4 pcs"], {"a 1l", "b 2l"}),
    (["a 1l", "c 3kg", "d 4 pcs"], {"c 3kg"}),
    (["a 1l", "d 4 pcs"], {"a 1l", "d 4 pcs"})])
def test_majority_family(spark, titles, kept):
    rows = _listings(spark, [("A", t, "10") for t in [*titles, "no size"]])
    assert {r["title"] for r in features.quantity_table(rows).collect()} == kept


def test_quantity_column_first(spark):
    rows = spark.createDataFrame([("Rice 1 kg", "500ml"), ("Rice 1 kg", ""), ("Rice 1 kg", "6 pack")],
                                 "title string, quantity string")
    got = features.with_quantity(rows, quantity="quantity").collect()
    assert [(r["size_value"], r["size_unit"]) for r in got] == [
        (500.0, "ml"), (1.0, "kg"), (6.0, "pc")]
