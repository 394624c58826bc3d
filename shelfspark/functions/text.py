"""Column rules over page and listing text: cleaning, prices, ids, links."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    value = col(value)
    return F.when(F.trim(value) != "", value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first hit, null when there is none or it is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda hit: F.when(hit != "", hit))


def first_of(text: Column, patterns: list[str]) -> Column:
    """First non-empty capture over an ordered list of fallback patterns."""
    return F.coalesce(*[first_group(text, p) for p in patterns])


def number(value: Column | str) -> Column:
    """Text to double, null when it is not a number."""
    return col(value).try_cast("double")


def plain_spaces(text: Column | str) -> Column:
    """Non-breaking spaces become plain ones."""
    return F.replace(col(text), F.lit("\u00a0"), F.lit(" "))


def squash_title(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(text), r"\s+", " "))


def title_case(text: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    runs = F.split(F.lower(col(text)), r"(?<=[^a-z])")
    return F.array_join(F.transform(runs, F.initcap), "")


# ---------------------------------------------------------------- prices

# Fixed value: a number with optional thousands groups, as shown on store pages.
GROUPED_NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
CURRENCY = r"(?:Rs\.?|PKR)"


def parse_price(text: Column | str, style: str = "plain") -> Column:
    """First number in a price text.

    ``plain`` drops commas first. ``grouped`` is the rule of the category
    crawls, which reads at most three digits before a comma group, so an
    ungrouped ``1500`` becomes 150. ``digits`` keeps every digit and dot.
    """
    text = plain_spaces(text)
    if style == "plain":
        return number(first_group(F.replace(text, F.lit(",")), r"(\d+(?:\.\d+)?)"))
    if style == "grouped":
        hit = first_group(text, rf"(?i)(?:{CURRENCY}\s*)?{GROUPED_NUMBER}")
        return number(F.replace(hit, F.lit(",")))
    if style == "digits":
        return number(F.regexp_replace(text, r"[^0-9.]", ""))
    raise ValueError(f"unknown price style {style!r}")


def parse_price_parts(whole: Column | str, fraction: Column | str) -> Column:
    """Price from an integer part and a fraction part shown apart."""
    digits = F.regexp_replace(F.coalesce(col(whole), F.lit("")), r"[^0-9]", "")
    cents = first_group(F.coalesce(col(fraction), F.lit("")), r"(\d+)")
    return number(F.when(cents.isNull(), digits).otherwise(
        F.concat(digits, F.lit("."), cents)))


def price_from_markup(html: Column | str, style: str = "plain") -> Column:
    """Price hidden in markup: data attribute, hidden input, marked text."""
    html = col(html)
    quoted = r"""["']?"""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.coalesce(
        parse_price(first_group(
            html, rf"data-price(?:-amount)?\s*=\s*{quoted}\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), style),
        parse_price(first_of(html, [
            r"""<input[^>]*name=["']price["'][^>]*value=["']([^"']*)["']""",
            r"""<input[^>]*value=["']([^"']*)["'][^>]*name=["']price["']""",
        ]), style),
        parse_price(first_group(text, rf"(?i){CURRENCY}\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), style),
    )


# ------------------------------------------------------------ urls and ids

def url_path(url: Column | str) -> Column:
    """Path part of an absolute or relative link."""
    bare = F.regexp_replace(col(url), r"[?#].*$", "")
    return F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*", "")


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def last_segment(url: Column | str) -> Column:
    return F.try_element_at(path_segments(url), F.lit(-1))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Resolve absolute, protocol-relative, root-relative and sibling links."""
    base = F.lit(base) if isinstance(base, str) else base
    href = col(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(
        F.regexp_replace(F.substring(base, F.length(host) + 1, F.length(base)),
                         r"[?#].*$", ""), r"[^/]*$", "")
    return (
        F.when(F.trim(href) == "", F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def category_label(url: Column | str) -> Column:
    """Last path segment as words; the url itself when the path is empty."""
    words = title_case(F.replace(last_segment(url), F.lit("-"), F.lit(" ")))
    return F.coalesce(words, col(url))


def page_url(base: Column | str, page: Column | int, param: str = "currentPage") -> Column:
    """Set the page number in a query string, adding the parameter if absent."""
    base = col(base)
    page = F.lit(page) if isinstance(page, int) else page
    page = page.cast("string")
    known = rf"([?&]{param}=)[^&#]*"
    added = F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")),
                     F.lit(f"{param}="), page)
    replaced = F.regexp_replace(base, F.lit(known), F.concat(F.lit("$1"), page))
    return F.when(base.rlike(known), replaced).otherwise(added)


def _long_number(segments: Column) -> Column:
    found = F.transform(F.reverse(segments), lambda s: F.regexp_extract(s, r"(\d{5,})", 1))
    return F.try_element_at(F.filter(found, lambda s: s != ""), F.lit(1))


def product_id(url: Column | str, rule: str) -> Column:
    """Store id of a product, read from its link by the named rule."""
    url = col(url)
    trimmed = F.regexp_replace(url, r"/+$", "")
    tail = blank_to_null(F.substring_index(trimmed, "/", -1))
    segments = path_segments(url)
    if rule == "slug":
        return first_group(url, r"/products/([^/?#]+)")
    if rule == "p_number":
        return first_group(url, r"/p/(\d+)")
    if rule == "trailing_number":
        return F.coalesce(first_group(trimmed, r"/[^/]+/(\d+)$"), tail)
    if rule == "product_number":
        return F.coalesce(first_group(url, r"/product/(\d+)"), tail)
    if rule == "digit_segment":
        return F.try_element_at(
            F.filter(segments, lambda s: s.rlike(r"^\d+$")), F.lit(-1))
    if rule == "long_number":
        return _long_number(segments)
    if rule == "dom_suffix":
        return first_group(url, r"^product-item-(?:info_)?\s*(.*?)\s*$")
    raise ValueError(f"unknown product id rule {rule!r}")


# ------------------------------------------------------------ query filters

def words(text: Column | str) -> Column:
    """Lower-case whole words; punctuation separates."""
    clean = F.regexp_replace(F.lower(plain_spaces(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def match_all_tokens(title: Column | str, query: Column | str) -> Column:
    """Every query token stands as a whole word in the title."""
    query = F.lit(query) if isinstance(query, str) else query
    title = plain_spaces(title)
    clean = F.concat(F.lit(" "), F.regexp_replace(
        F.lower(title), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    tokens = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    hit = F.forall(tokens, lambda t: F.contains(clean, F.concat(F.lit(" "), t, F.lit(" "))))
    usable = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(query, F.lit("")) != "")
    return F.coalesce(usable & hit, F.lit(False))


def match_substring(title: Column | str, query: Column | str) -> Column:
    query = F.lit(query) if isinstance(query, str) else query
    return F.coalesce(F.contains(F.lower(col(title)), F.lower(query)), F.lit(False))


def match_pattern(title: Column | str, term: str) -> Column:
    """Case-insensitive regular expression search; null titles do not match."""
    return F.coalesce(col(title).rlike("(?i)" + term), F.lit(False))


def is_no_results(html: Column | str) -> Column:
    html = col(html)
    return F.coalesce(F.lower(html).contains("no results found")
                      | html.contains("ProductNotFound"), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
