"""Product cards, links and page state read from stored HTML pages.

A page is read by a tokenizer into elements (``markup``); every field of a card is an ordered list of rules
of which the first non-empty hit wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import markup
from shelfspark.operators.markup import Rule, tag_attr, tag_text

@dataclass(frozen=True)
class SiteRules:
    """Where one store puts the fields of a product card."""

    base: str
    card: str
    title: list[Rule]
    link: list[Rule]
    image: list[Rule]
    price: list[Rule] = field(default_factory=list)
    price_parts: tuple[Rule, Rule] | None = None
    card_id: list[Rule | str] = field(default_factory=list)  # a text is a pattern on the source of the card
    quantity: list[Rule] = field(default_factory=list)
    id_rule: str | None = None
    around: bool = False  # the link and the image may stand around the card


_IMAGE = [tag_attr("img", "src"), tag_attr("img", "data-src"), tag_attr("img", "data-original")]

# Card markers, class names and attributes of each store's pages.
SITE_RULES = {
    "Naheed": SiteRules(
        base="https://www.naheed.pk",
        card=r'<(?:li|div)\b[^>]*class="[^"]*product-item(?:-info)?(?:\s[^"]*)?"',
        title=[tag_text("a", "product-item-link"), tag_attr("a", "title", "product-item-link"),
               tag_text("a", "product-item-photo"), tag_text("a"), tag_attr("a", "title")],
        link=[tag_attr("a", "href", "product-item-link"),
              tag_attr("a", "href", "product-item-photo"), tag_attr("a", "href")],
        image=[tag_attr("img", "src", "product-image-photo"), *_IMAGE],
        price=[tag_text("span", r'class="price"'), tag_text("span", "price-wrapper"),
               tag_text("div", "price-box"), tag_text(r"\w+", "price")],
        card_id=[tag_attr("input", "value", 'name="product"'),
                 tag_attr("div", "data-product-id", "price-box"),
                 r'id="product-item-info_(\d+)'],
        id_rule="digit_segment",
    ),
    "Alfatah": SiteRules(
        base="https://alfatah.pk",
        card=r'<div\b[^>]*class="[^"]*product-card(?:\s[^"]*)?"',
        title=[tag_text("a", "product-title-ellipsis"),
               tag_attr("a", "title", "product-title-ellipsis"), tag_text("a"),
               tag_attr("a", "title"), tag_text(r"\w+", "product-title")],
        link=[tag_attr("a", "href", "product-title-ellipsis"), tag_attr("a", "href")],
        image=_IMAGE,
        price=[tag_text(r"\w+", "product-price")],
        card_id=[r'variant_?id="[^"]*?(\d{5,})'],
        id_rule="long_number",
    ),
    "Metro": SiteRules(
        base="https://www.metro-online.pk",
        card=r'<div\b[^>]*class="[^"]*CategoryGrid_product_nameAndPricing_div__FwOEW',
        title=[tag_attr("p", "title", "CategoryGrid_product_name__3nYsN"),
               tag_text("p", "CategoryGrid_product_name__3nYsN")],
        link=[tag_attr("a", "href")],
        image=_IMAGE,
        price=[tag_text("p", "CategoryGrid_product_price__Svf8T")],
        id_rule="trailing_number",
        around=True,
    ),
    "Imtiaz": SiteRules(
        base="https://shop.imtiaz.com.pk",
        card=r'<div\b[^>]*id="product-item-',
        title=[tag_attr("h4", "title"), tag_text("h4"), tag_attr("p", "title"), tag_text("p")],
        link=[tag_attr("a", "href")],
        image=_IMAGE,
        price=[tag_text("div", "hazle-product-item_product_item_price_label__ET_we")],
        card_id=[r'id="product-item-\s*([^"]*?)\s*"'],
    ),
    "Rainbow": SiteRules(
        base="https://rainbowcc.com.pk",
        card=r'<div\b[^>]*id="product-item-',
        title=[tag_attr("h4", "title"), tag_text("h4"), tag_attr("a", "title"), tag_text("a")],
        link=[tag_attr("a", "href")],
        image=_IMAGE,
        price=[tag_text("div", "hazle-product-item_product_item_price_label__ET_we")],
        card_id=[r'id="product-item-\s*([^"]*?)\s*"'],
        quantity=[tag_attr("p", "title", "hazle-product-item_product_item_description__ejRDa"),
                  tag_text("p", "hazle-product-item_product_item_description__ejRDa")],
    ),
    "Carrefour": SiteRules(
        base="https://www.carrefour.pk",
        card=r'<div\b[^>]*class="[^"]*max-w-\[134px\] sm:w-\[215px\]',
        title=[tag_text("a", "product_name"), tag_text("div", "text-sm leading-4 font-medium"),
               tag_text("div", "text-sm"), tag_text("h3"), tag_text("h4"), tag_attr("a", "title"),
               tag_text("a")],
        link=[tag_attr("a", "href", "/p/"), tag_attr("a", "href")],
        image=_IMAGE,
        price_parts=(tag_text("div", "text-lg"), tag_text("div", "text-2xs")),
        id_rule="p_number",
    ),
}


def decode_entities(text: Column) -> Column:
    """Named and numeric entities that occur in titles and links."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


RAW = ("card_no int, site string, card string, title string, link string, image string, card_id string, "
       "quantity string, whole string, cents string, prices array<string>")


def _raw_cards(site_rules: dict[str, SiteRules]):
    """Task function: the raw fields of every card of the pages of known stores, one page at a time."""
    kinds = {"card_no": pa.int32(), "prices": pa.list_(pa.string())}
    names = [c.strip().split(" ")[0] for c in RAW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, texts = batch.column("site").to_pylist(), batch.column("html").to_pylist()
            for i, (site, html) in enumerate(zip(sites, texts)):
                rules = site_rules.get(site)
                found = markup.cards(html, rules) if rules and html else []
                if not found:
                    continue
                rows = [f | {"card_no": n, "site": site} for n, f in enumerate(found)]
                ids = batch.column("page_id").take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [ids] + [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names],
                    names=["page_id", *names])
    return run


def extract_cards(pages: DataFrame, site_rules: dict[str, SiteRules] = SITE_RULES,
                  price_style: str = "plain") -> DataFrame:
    """One row per product card of pages(page_id, site, html, ...).

    Pages are read by a tokenizer; titles and prices are the whole text of their element. Pages of other
    stores and pages without text give no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    raw = pages.select("page_id", "site", "html").where(F.col("site").isin(list(site_rules))).mapInArrow(
        _raw_cards(site_rules), f"page_id {kind}, {RAW}")

    def by_site(choose) -> Column:
        value = F.lit(None).cast("string")
        for site, rules in site_rules.items():
            chosen = choose(rules)
            if chosen is not None:
                value = F.when(F.col("site") == site, chosen).otherwise(value)
        return value

    base = F.element_at(F.create_map(*[F.lit(x) for s, r in site_rules.items() for x in (s, r.base)]), F.col("site"))
    parts = [s for s, r in site_rules.items() if r.price_parts]
    listed = F.try_element_at(F.filter(F.transform(
        "prices", lambda p: t.parse_price(p, price_style)), lambda p: p.isNotNull()), F.lit(1))
    shown = F.when(F.col("site").isin(parts), t.parse_price_parts(F.col("whole"), F.col("cents"))).otherwise(listed) \
        if parts else listed
    rows = raw.withColumn("product_url", t.absolute_url(base, F.col("link")))
    from_link = by_site(lambda r: t.product_id("product_url", r.id_rule) if r.id_rule else None)
    return rows.select(
        "page_id", "card_no", "site", F.coalesce("card_id", from_link).alias("product_id"),
        t.squash_title(F.col("title")).alias("title"),
        F.coalesce(shown, t.price_from_markup(F.col("card"), price_style)).alias("price"),
        t.squash_title(F.col("quantity")).alias("quantity"),
        t.absolute_url(base, F.col("image")).alias("image_url"), "product_url")


ANCHOR = r"(?s)<a\b([^>]*)>(.*?)</a>"


def anchors(pages: DataFrame) -> DataFrame:
    """All links of a page in order: link_no, attributes, href, text."""
    pair = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("attributes"),
        F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("body"))
    kept = [c for c in pages.columns if c != "html"]
    links = pages.select(*kept, F.posexplode(pair).alias("link_no", "a"))
    attributes = F.col("a.attributes")
    quote = "[\"']"
    return links.select(
        *kept, "link_no", attributes.alias("attributes"),
        decode_entities(t.first_group(attributes, rf"\bhref={quote}([^\"']*){quote}")).alias("href"),
        t.first_group(attributes, rf"\btitle={quote}([^\"']*){quote}").alias("title"),
        t.squash_title(decode_entities(F.regexp_replace("a.body", r"<[^>]*>", " "))).alias("text"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, first heading and number of links of each page."""
    return pages.select(
        "page_id", "url",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("h1"),
        F.size(F.regexp_extract_all("html", F.lit(ANCHOR), 1)).alias("n_links"))


def category_links(pages: DataFrame, within: str | None = None,
                   depth: int | None = None) -> DataFrame:
    """Distinct links of each page in order of first appearance.

    ``within`` keeps links whose path holds that text, ``depth`` those with so
    many path segments. A link without text is named after its last segment.
    """
    links = anchors(pages).where(F.col("href").isNotNull())
    links = links.withColumn("link", t.absolute_url(F.col("url"), F.col("href")))
    if within is not None:
        links = links.where(F.col("link").contains(within))
    if depth is not None:
        links = links.where(F.size(t.path_segments("link")) == depth)
    named = links.withColumn("name", F.coalesce(
        t.blank_to_null("title"), t.blank_to_null("text"), t.category_label("link")))
    first = F.min(F.struct("link_no", "name")).alias("f")
    return named.groupBy("page_id", "link").agg(first).select(
        "page_id", "link", F.col("f.link_no").alias("link_no"), F.col("f.name").alias("name"))


# Classes, relation and words that mark a link to the next page.
NEXT_MARKS = r"amscroll-next-page|rel=[\"']next[\"']|class=[\"'][^\"']*\b(?:next|btn-primary)\b"
NEXT_WORDS = "next"
NEXT_SIGNS = ["›", "»"]


def next_page_link(pages: DataFrame) -> DataFrame:
    """Link to the next page: marked links first, then any link that says so."""
    links = anchors(pages).where(F.col("href").isNotNull())
    signs = t.any_of([F.col("text").contains(s) for s in NEXT_SIGNS])
    says_next = F.lower("text").contains(NEXT_WORDS) | signs
    plain_next = F.col("text").contains("Next") | signs
    marked = F.col("attributes").rlike(NEXT_MARKS) & says_next
    found = links.where(marked | plain_next).withColumn("_later", (~marked).cast("int"))
    return found.groupBy("page_id").agg(
        F.min_by(t.absolute_url(F.col("url"), F.col("href")),
                 F.struct("_later", "link_no")).alias("next_link"))
