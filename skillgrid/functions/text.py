"""Text expressions. Everything stays on the JVM side.

Whitespace and word characters follow Python's ``str`` methods and ``re`` module, not Java's defaults, so that
tags and chunks equal those of the plain-Python definition on any script.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillgrid.functions.binding import bind

# Every character Python's str.strip / str.split treat as white space.
_SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
SPACES = "".join(chr(c) for low, high in _SPACE_RANGES for c in range(low, high + 1))
SPACE_CLASS = "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in _SPACE_RANGES) + "]"

# Python's \w on str: letters, every kind of number, underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
RUN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"

ELSEWHERE_PRINTABLE = r"[\p{C}\p{Z}&&[^ \n]]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_CLASS + "+", " ")


def or_default(c: Column, default: Column | str) -> Column:
    """Default for null and for the empty string, then strip; a blank value strips to empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return strip(F.coalesce(F.nullif(c, F.lit("")), fallback))


def shown_or_default(c: Column, default: str) -> Column:
    """Display form: strip first, so blank values take the default too."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def filter_key(c: Column) -> Column:
    """A request's filter value: null or empty means no filter, a blank one means the empty key."""
    return F.when(c != "", F.lower(strip(c)))


def segment_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def posting_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", title, description)


def contains_query(title: Column, description: Column, query: Column) -> Column:
    """Stripped, lower-cased query is a substring of title and description; a blank query keeps every row."""
    return F.contains(F.lower(posting_text(title, description)), F.lower(strip(query)))


def word_runs(c: Column) -> Column:
    """Alternating runs of word and other characters; joined together they give the text back."""
    return F.regexp_extract_all(c, F.lit(RUN_PATTERN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def word_chunks(all_words: Column, size: int = 700, overlap: int = 90) -> Column:
    """Overlapping windows of words as an array of texts; the last window is the one that reaches the end."""
    def windows(listed: Column) -> Column:
        last_start = F.greatest(F.lit(0), F.size(listed) - F.lit(overlap + 1))
        starts = F.sequence(F.lit(0), last_start, F.lit(size - overlap))
        return F.when(
            F.size(listed) > 0, F.transform(starts, lambda at: F.array_join(F.slice(listed, at + 1, size), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return bind(all_words, windows)


def chunk_count(all_words: Column, size: int = 700, overlap: int = 90) -> Column:
    n = F.size(all_words)
    more = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)))
    return F.when(n > 0, more + 1).otherwise(0).cast("int")


def clean_text(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    for pattern, replacement in (("\r\n?", "\n"), ("\t+", " "), ("\n{3,}", "\n\n"), (" {2,}", " "),
                                 (ELSEWHERE_PRINTABLE, "")):
        text = F.regexp_replace(text, pattern, replacement)
    return F.btrim(text, F.lit(" \n"))


def title_case(c: Column) -> Column:
    """Upper case after every non-letter ("node.js" -> "Node.Js"), unlike initcap, which only looks at spaces."""
    pieces = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def absolute_link(href: Column, base: Column, page_url: Column) -> Column:
    """Site-relative links get the base; a missing link falls back to the page's own address."""
    absolute = F.when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(href)
    return F.coalesce(F.nullif(absolute, F.lit("")), page_url)


def parse_skill_cell(c: Column) -> Column:
    """A stored skills cell that is text: a JSON or quoted list, else comma-separated."""
    text = strip(c)
    listed = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    items = F.coalesce(listed, F.split(text, ","))
    return F.coalesce(clean_items(items), F.array().cast("array<string>"))


def clean_items(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda s: s != "")


def utc_stamp(c: Column) -> Column:
    """ISO-8601 text in UTC with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def parse_stamp(c: Column) -> Column:
    """Lenient: text that is no timestamp becomes null."""
    return F.try_to_timestamp(c)
