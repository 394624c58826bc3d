import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as t


@pytest.mark.parametrize("shown, style, price", [
    ("Rs. 1,500.00", "plain", 1500.0), ("Rs. 1500", "plain", 1500.0), ("PKR 99", "plain", 99.0),
    ("", "plain", None), (None, "plain", None), ("sold out", "plain", None),
    ("Rs. 1,500.00", "grouped", 1500.0), ("Rs. 1500", "grouped", 150.0),
    ("12500", "grouped", 125.0), ("PKR 160", "grouped", 160.0), ("Rs1,800", "grouped", 1800.0),
    ("PKR 1,250.50", "digits", 1250.5), ("none", "digits", None),
])
def test_parse_price(cell, shown, style, price):
    assert cell(t.parse_price("x", style), x=shown) == price


@pytest.mark.parametrize("whole, part, price", [
    ("1,160", ".50", 1160.5), ("160", None, 160.0), ("160", "PKR", 160.0), ("", "", None)])
def test_parse_price_parts(cell, whole, part, price):
    assert cell(t.parse_price_parts("a", "b"), a=whole, b=part) == price


@pytest.mark.parametrize("html, price", [
    ('<b data-price-amount="1,250"></b>', 1250.0),
    ('<input type="hidden" name="price" value="75.5">', 75.5),
    ('<input value="80" type="hidden" name="price">', 80.0),
    ("<p>Pack of 6</p><p>Rs <b>120</b></p>", 120.0), ("<p>6 pcs</p>", None)])
def test_price_from_markup(cell, html, price):
    assert cell(t.price_from_markup("x"), x=html) == price


@pytest.mark.parametrize("rule, url, expected", [
    ("slug", "https://s.example/products/tea-250g?variant=1", "tea-250g"),
    ("slug", "https://s.example/tea", None),
    ("p_number", "/mafpak/en/x/p/295592?q=1", "295592"),
    ("trailing_number", "https://s.example/detail/x/77/", "77"),
    ("trailing_number", "https://s.example/detail/tea", "tea"),
    ("product_number", "https://s.example/product/12/tea", "12"),
    ("product_number", "https://s.example/tea-250g/", "tea-250g"),
    ("digit_segment", "https://s.example/1/22/tea?x=3", "22"),
    ("digit_segment", "https://s.example/tea2", None),
    ("long_number", "https://s.example/a-1234567/b-123/c-55555x", "55555"),
    ("dom_suffix", "product-item-363703", "363703"),
    ("dom_suffix", "product-item-info_9", "9"),
])
def test_product_id(cell, rule, url, expected):
    assert cell(t.product_id("x", rule), x=url) == expected


@pytest.mark.parametrize("href, expected", [
    ("http://o.example/a", "http://o.example/a"), ("//cdn.example/a", "https://cdn.example/a"),
    ("/a?b=1", "https://s.example/a?b=1"), ("a", "https://s.example/shop/a"), ("", None)])
def test_absolute_url(cell, href, expected):
    assert cell(t.absolute_url("https://s.example/shop/list?p=1", "x"), x=href) == expected


@pytest.mark.parametrize("base, expected", [
    ("https://s.example/c", "https://s.example/c?currentPage=3"),
    ("https://s.example/c?a=1", "https://s.example/c?a=1&currentPage=3"),
    ("https://s.example/c?currentPage=1&a=1", "https://s.example/c?currentPage=3&a=1")])
def test_page_url(cell, base, expected):
    assert cell(t.page_url("x", 3), x=base) == expected


def test_titles_and_labels(cell):
    assert cell(t.squash_title("x"), x="  Milk  \n1 Ltr ") == "Milk 1 Ltr"
    assert cell(t.category_label("x"), x="https://s.example/en/fresh-fruit/?p=1") == "Fresh Fruit"
    assert cell(t.category_label("x"), x="https://s.example/") == "https://s.example/"
    assert cell(t.title_case("x"), x="7up coca-cola head&SHOULDERS") == "7Up Coca-Cola Head&Shoulders"


@pytest.mark.parametrize("title, query, hit", [
    ("Diet-Pepsi, 1L", "diet pepsi", True), ("xpepsi", "pepsi", False), ("Pepsi", "", False),
    (None, "pepsi", False), ("Pepsi", "pepsi 1l", False), ("coca-cola", "coca-cola", False),
    ("Pepsi", "  ", True)])
def test_match_all_tokens(cell, title, query, hit):
    assert cell(t.match_all_tokens("x", query), x=title) is hit


def test_other_matches(cell):
    assert cell(t.match_substring("x", "PEP"), x="xpepsi") is True
    assert cell(t.match_substring("x", "PEP"), x=None) is False
    assert cell(t.match_pattern("x", "pep.i|coke"), x="PEPSI") is True
    assert cell(t.match_pattern("x", "a"), x=None) is False
    assert cell(t.is_no_results("x"), x="<b>No Results Found for</b>") is True
    assert cell(t.is_no_results(F.lit(None).cast("string"))) is False
