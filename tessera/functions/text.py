"""Text columns, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Space characters that are turned into plain spaces. Fixed values.
SPACES = "     ​﻿"
TOKEN = r"[a-z0-9][a-z0-9.,%$-]*"
WORDS_TO_TOKENS = 1.33
QUOTE_WORDS = 25


def tokens(text: Column) -> Column:
    """Lower-case tokens that keep figures such as 391,035 whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Estimated model tokens: whole part of words times 1.33; null counts as none."""
    return F.floor(F.size(words(F.coalesce(text, F.lit("")))) * F.lit(WORDS_TO_TOKENS)).cast("int")


def normalise_space(text: Column) -> Column:
    plain = F.translate(text, SPACES, " " * len(SPACES))
    one = F.regexp_replace(plain, r"[ \t]+", " ")
    lines = F.regexp_replace(one, r" *\n *", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n\t\r\f\u000b"))


def html_by_regex(html: Column) -> Column:
    """Text of HTML by replacement alone, for pages that no parser takes."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    broken = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/tr|/h[1-6]|/li)\b[^>]*>", "\n")
    text = F.regexp_replace(broken, r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return normalise_space(text)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 16)


def context_prefix(ticker: Column, fiscal_year: Column, item: Column, title: Column) -> Column:
    def some(x: Column, lead: str = "") -> Column:
        value = F.nullif(x.cast("string"), F.lit(""))
        return F.concat(F.lit(lead), value)

    return F.concat_ws(" | ", some(ticker), some(fiscal_year, "FY"), some(item, "Item "), some(title))


def cap_words(text: Column, n: int = QUOTE_WORDS) -> Column:
    w = words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(text)


def value_variants(value: Column, per_share: Column | None = None) -> Column:
    """Ways a figure may be printed, sorted: in units, thousands, millions (with a decimal below 10,000) and billions.

    Per-share values have two decimals, with and without grouping. Forms of fewer than
    three characters (commas aside) are too common to tell anything.
    """
    size = F.abs(value)
    forms = []
    for scale in (1.0, 1e3, 1e6):
        scaled = size / scale
        forms += [F.when(scaled >= 1, F.format_number(scaled, 0)), F.when((scaled >= 1) & (scaled < 10_000), F.format_number(scaled, 1))]
    forms += [F.when(size >= 1e9, F.format_number(size / 1e9, d)) for d in (1, 2)]
    plain = F.filter(F.array_distinct(F.array_compact(F.array(*forms))), lambda v: F.length(F.replace(v, F.lit(","), F.lit(""))) >= 3)
    if per_share is not None:
        two = F.format_number(value, 2)
        plain = F.when(per_share, F.array_distinct(F.array(two, F.replace(two, F.lit(","), F.lit(""))))).otherwise(plain)
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(plain))


def json_body(reply: Column) -> Column:
    """The object inside a reply that may be fenced: from its first brace to its last."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
