"""URL expressions, native for ASCII; a pandas UDF takes the URLs that need more."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EXTENSIONS, unslug

PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: Query keys that name a traffic source. Fixed values.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid",
    "fbclid", "msclkid", "dclid", "mc_cid", "mc_eid", "_ga", "ref", "referrer",
)
#: Characters that a canonical path leaves unescaped beside letters, digits and _.-. Fixed values.
PATH_SAFE = "/~:@!$&'()*+,;="


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    """The path, without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def domain(url: Column) -> Column:
    """Authority without any "www."; port and case stay."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def site_domain(url: Column) -> Column:
    """Authority in lower case without a leading "www."."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def title_from_url(url: Column) -> Column:
    last = F.element_at(segments(url), -1)
    bare = F.coalesce(*[F.when(last.endswith(e), F.left(last, F.length(last) - len(e))) for e in EXTENSIONS], last)
    return F.when(F.size(segments(url)) == 0, F.lit("Home")).otherwise(F.coalesce(F.nullif(unslug(bare), F.lit("")), F.lit("Home")))


def description_from_url(url: Column) -> Column:
    parts = segments(url)
    named = F.transform(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), unslug)
    return F.when(F.size(parts) == 0, F.lit("Homepage")).otherwise(F.array_join(named, " > "))


def section_of(url: Column) -> Column:
    return F.when(F.size(segments(url)) == 0, F.lit("Main")).otherwise(unslug(F.get(segments(url), F.lit(0))))


def extension(url: Column) -> Column:
    """Extension of the last segment in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1)), F.lit(""))


def sitemap_label(url: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path(url), "/"), -1), F.lit("")), url)


def site_url(url: Column) -> Column:
    """Scheme (https where absent) and authority; an error where there is none."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    return F.when(authority(full) == "", F.raise_error(F.lit("a site URL needs a host"))).otherwise(F.concat(scheme(full), F.lit("://"), authority(full)))


def segment_class(segment: Column) -> Column:
    """Placeholder of a variable segment, or null for one that is no known kind."""
    return (
        F.when(segment.rlike(r"^(19|20)\d{2}$"), "{year}")
        .when(segment.rlike(r"^\d+$"), "{id}")
        .when(segment.rlike(r"^(19|20)\d{2}-\d{2}(-\d{2})?$"), "{date}")
        .when(segment.rlike(r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "{uuid}")
        .when(segment.rlike(r"^(?i)[a-z0-9]+(-[a-z0-9]+){2,}$"), "{slug}")
    )


def host_of(url: Column, property_host: str = "") -> Column:
    """Canonical host: lower case, no default port, www folded away or to the property's host."""
    h = F.regexp_replace(F.regexp_replace(F.lower(authority(url)), ":443$", ""), ":80$", "")
    if not property_host:
        return F.regexp_replace(h, r"^www\.", "")
    own = property_host.lower()
    same = h.isin(own, f"www.{own}") | (F.concat(F.lit("www."), h) == own)
    return F.when(same, F.lit(own)).otherwise(h)


def canonical(url: Column, meaningful: tuple[str, ...] = (), property_host: str = "") -> Column:
    """One key for each page: scheme, host, path case, slash, tracking keys, order and fragment levelled."""
    needs_python = url.rlike(r"[^\x21-\x7E]|%") | query(url).rlike(r"[^A-Za-z0-9_.~&=-]") | path(url).rlike(r"[^A-Za-z0-9_.~:@!$&'()*+,;=/-]")
    s = F.when(scheme(url).isin("http", "https", ""), F.lit("https")).otherwise(scheme(url))
    p = F.lower(path(url))
    p = F.when(p == "", F.lit("/")).otherwise(F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/")))
    dropped = [k for k in TRACKING if k not in meaningful]
    pairs = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(dropped))
    pairs = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.locate("=", x) + 1)).otherwise("").alias("v")))
    kept = F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    q = F.array_join(kept, "&")
    native = F.concat(s, F.lit("://"), host_of(url, property_host), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(needs_python, _canonical_udf(meaningful, property_host)(url)).otherwise(native)


def _canonical_udf(meaningful: tuple[str, ...], property_host: str):
    tracking, safe = frozenset(TRACKING) - set(meaningful), PATH_SAFE
    own = property_host.lower()

    def one(url: str) -> str | None:
        from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

        if url is None:
            return None
        u = urlsplit(url)
        host = u.netloc.lower().removesuffix(":443").removesuffix(":80")
        if own:
            host = own if host in (own, f"www.{own}") or f"www.{host}" == own else host
        else:
            host = host.removeprefix("www.")
        head, slash, last = u.path.rpartition("/")
        where = quote(unquote(head + slash + last.partition(";")[0] or "/").lower(), safe=safe)
        where = where.rstrip("/") or "/"
        pairs = sorted({(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in tracking})
        kind = "https" if u.scheme in ("http", "https", "") else u.scheme
        return f"{kind}://{host}{where}" + (f"?{urlencode(pairs)}" if pairs else "")

    @F.pandas_udf("string")
    def canonical_urls(urls: pd.Series) -> pd.Series:
        return urls.map(one)

    return canonical_urls
