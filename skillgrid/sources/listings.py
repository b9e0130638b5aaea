"""Job-board listing pages (landed HTML) to postings.

A layout is data: patterns for the cards of a page and for the parts of a card. A card reaches from its opening tag to
the next card, so nested markup needs no balanced matching; list items end at their closing tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.text import absolute_link, strip, utc_stamp
from skillgrid.operators.unnest import unnest


def _tag(name: str, attribute: str | None = None, value: str | None = None) -> str:
    """Opening tag, optionally with a word of an attribute's value."""
    if attribute is None:
        return rf"<{name}\b[^>]*>"
    return rf"""<{name}\b[^>]*\b{attribute}\s*=\s*["'](?:[^"']*\s)?{value}(?:\s[^"']*)?["'][^>]*>"""


def _element(name: str, attribute: str | None = None, value: str | None = None) -> str:
    """Whole element with its content as group 1."""
    return rf"(?is){_tag(name, attribute, value)}(.*?)</{name}\s*>"


@dataclass(frozen=True)
class ListingLayout:
    """Patterns of one source; alternatives are tried in order, content is group 1."""

    base: str
    card: tuple[str, ...]
    title: tuple[str, ...]
    company: tuple[str, ...] = ()
    location: tuple[str, ...] = ()
    snippet: tuple[str, ...] = ()
    # The opening tag whose href is the link; empty: the first pattern of ``title`` that matched.
    link: tuple[str, ...] = ()
    # True: a card is the content of an element; False: the text from an opening tag to the next one.
    closed: bool = False


# Class and attribute names of the supported sources' pages.
LAYOUTS = {
    "indeed": ListingLayout(
        base="https://www.indeed.com",
        card=(_tag("div", "class", "job_seen_beacon"), _tag("a", "class", "tapItem")),
        title=(_element("h2", "class", "jobTitle"), rf"(?is){_tag('h2')}.*?{_tag('a')}(.*?)</a\s*>"),
        company=(_element("span", "class", "companyName"),),
        location=(_element("div", "class", "companyLocation"),),
        snippet=(_element("div", "class", "job-snippet"),),
        link=(_tag("a"),),
    ),
    "wellfound": ListingLayout(
        base="https://wellfound.com",
        card=(_tag(r"\w+", "data-test", "StartupResult"), _tag("div", "class", "styles_component__Qn4R2")),
        title=(_element("a", "data-test", "JobTitle"), rf"(?is){_tag('h2')}.*?{_tag('a')}(.*?)</a\s*>"),
        company=(_element("a", "data-test", "CompanyName"), _element("h3")),
        location=(_element("span", "data-test", "Location"),),
        snippet=(_element("p"),),
        link=(_tag("a", "data-test", "JobTitle"), rf"{_tag('h2')}.*?{_tag('a')}"),
    ),
    "linkedin": ListingLayout(
        base="",
        card=(r"(?is)<li\b[^>]*>(.*?)(?=</li\s*>|<li\b)",),
        closed=True,
        title=(_element("h3"),),
        company=(_element("h4"),),
        location=(_element("span", "class", "job-search-card__location"),),
        link=(_tag("a", "class", "base-card__full-link"),),
    ),
}

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "),
             ("&amp;", "&")]


def unescape(c: Column) -> Column:
    """The character references that job pages use; the ampersand comes last."""
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def inner_text(html: Column) -> Column:
    """Text pieces between tags, stripped and joined by one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "<i>")
    return strip(unescape(F.regexp_replace(bare, r"\s*(?:<[^>]*>\s*)+", " ")))


def _first_match(c: Column, patterns: tuple[str, ...], group: int) -> Column:
    """Capture of the first pattern that occurs at all, null if none does."""
    tries = [F.when(F.regexp_like(c, F.lit(p)), F.regexp_extract(c, p, group)) for p in patterns]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def _cards(html: Column, layout: ListingLayout) -> Column:
    if layout.closed:
        return F.regexp_extract_all(html, F.lit(layout.card[0]), F.lit(1))
    options = []
    for pattern in layout.card:
        pieces = F.split(html, rf"(?is)(?={pattern})")
        options.append(F.filter(pieces, lambda p: F.regexp_like(p, F.lit(rf"(?is)\A{pattern}"))))
    chosen = options[-1]
    for option in reversed(options[:-1]):
        chosen = F.when(F.size(option) > 0, option).otherwise(chosen)
    return chosen


def page_cards(pages: DataFrame, layout: ListingLayout, keep: list[str]) -> DataFrame:
    """One row per card of a page: position and the card's HTML."""
    return unnest(pages, keep, _cards(F.col("html"), layout), "card", "position")


def href(opening_tag: Column) -> Column:
    return unescape(F.regexp_extract(opening_tag, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))


def postings_from_pages(pages: DataFrame, source: str, scraped_at: Column | None = None,
                        layout: ListingLayout | None = None, keep: list[str] | None = None) -> DataFrame:
    """Listing pages (page_url, query, location, html) of one source to postings, one per card."""
    layout = layout or LAYOUTS[source]
    carried = keep or []
    cards = page_cards(pages, layout, ["page_url", "query", "location", *carried])
    card = F.col("card")

    def part(patterns: tuple[str, ...], missing: Column) -> Column:
        return F.coalesce(inner_text(_first_match(card, patterns, 1)), missing)

    flagged = tuple(p if p.startswith("(?") else f"(?is){p}" for p in layout.link)
    link = href(F.regexp_extract(_first_match(card, flagged, 0), r"(?is)(<a\b[^>]*>)\s*\z", 1))
    return cards.select(
        F.lit(source).alias("source"),
        part(layout.title, F.lit("Unknown")).alias("title"),
        part(layout.company, F.lit("Unknown")).alias("company"),
        part(layout.location, F.coalesce("location", F.lit(""))).alias("location"),
        F.col("query").alias("role"),
        part(layout.snippet, F.lit("")).alias("description"),
        absolute_link(F.coalesce(link, F.lit("")), F.lit(layout.base), F.col("page_url")).alias("url"),
        (utc_stamp(F.current_timestamp()) if scraped_at is None else scraped_at).alias("scraped_at"),
        *carried, "position",
    )


def with_detail_descriptions(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Fill descriptions from landed detail pages (url, html), matched by link."""
    body = _first_match(F.col("html"), (_element("div", "class", "show-more-less-html__markup"),), 1)
    found = details.select("url", F.regexp_replace(inner_text(body), r"(?U)\s+", " ").alias("_detail"))
    joined = postings.join(found, "url", "left")
    return joined.withColumn("description", F.coalesce("_detail", "description")).drop("_detail").select(
        *postings.columns)
