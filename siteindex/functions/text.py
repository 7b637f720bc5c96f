"""Text expressions: tolerant numbers, cuts at natural boundaries, titles, fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators in the order they are tried. Fixed values.
SENTENCE_ENDS = (". ", "! ", "? ")
CLAUSE_ENDS = (", ", "; ", " – ", " — ", " - ")
TITLE_ENDS = (" | ", " - ", " – ", " — ", " : ")
EXTENSIONS = (".html", ".htm", ".php", ".aspx")
#: Share of the limit below which a cut is not worth making. Fixed value.
LEAST_SHARE = 0.4
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A decimal number as double, or null."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def safe_int(text: Column) -> Column:
    """Truncated towards zero; anything that is no number gives 0."""
    return F.coalesce(number(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(text: Column) -> Column:
    """Trailing percent signs go; anything that is no number gives 0."""
    return F.coalesce(number(F.regexp_replace(F.trim(text), "%+$", "")), F.lit(0.0))


def locale_number(text: Column) -> Column:
    """Grouping spaces and commas go, a percent sign divides by 100; else null."""
    t = F.regexp_replace(text, "[\\s  ,]", "")
    value = number(F.regexp_replace(t, "%$", ""))
    return F.when(t.endswith("%"), value / 100).otherwise(value)


def _last(text: Column, sep: str, limit: int) -> Column:
    """0-based place of the last ``sep`` that ends within ``limit`` characters, or -1."""
    head = F.left(text, F.lit(limit))
    at = F.locate(sep[::-1], F.reverse(head))
    return F.when(at > 0, F.length(head) - (at - 1) - len(sep)).otherwise(-1)


def truncate_text(text: Column, limit: int = 120, ellipsis: bool = True) -> Column:
    """Cut at a sentence end, else a clause, else a word."""
    floor = limit * LEAST_SHARE
    cuts = [F.when(_last(text, s, limit) > floor, F.trim(F.left(text, _last(text, s, limit) + 1))) for s in SENTENCE_ENDS]
    cuts += [F.when(_last(text, s, limit) > floor, F.trim(F.left(text, _last(text, s, limit)))) for s in CLAUSE_ENDS]
    space = _last(text, " ", limit)
    cuts.append(F.when(space > 0, F.concat(F.trim(F.left(text, space)), F.lit("..." if ellipsis else ""))))
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(*cuts, F.trim(F.left(text, F.lit(limit)))))


def truncate_title(title: Column, limit: int = 60) -> Column:
    """Drop what follows the first separator, then cut what is left."""
    cuts = [F.when(F.locate(s, title).between(2, limit + 1), F.trim(F.left(title, F.locate(s, title) - 1))) for s in TITLE_ENDS]
    whole = F.when(F.length(title) <= limit, F.trim(title)).otherwise(truncate_text(title, limit, ellipsis=False))
    return F.coalesce(*cuts, whole)


def title_case(text: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def unslug(segment: Column) -> Column:
    return title_case(F.translate(segment, "-_", "  "))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / 4))


def fingerprint(text: Column, least: int = 200) -> Column:
    """BLAKE2b of 128 bits, in hex, of the text with case folded and white space levelled; empty for short texts."""

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        from hashlib import blake2b

        def one(raw: str | None) -> str:
            level = " ".join((raw or "").split()).casefold()
            return blake2b(level.encode(), digest_size=16).hexdigest() if len(level) >= least else ""

        return texts.map(one)

    return digests(text)


def usd(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, digits)), F.lit("—"))


def urn(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("resource"))
