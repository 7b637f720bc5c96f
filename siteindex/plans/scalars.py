"""Queries of the scalar expressions (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, ranking, text, urls
from .inputs import INVENTORY_SQL, inventory, sql_authority, sql_path, sql_query, sql_segments, sql_title_case, sql_unslug
from .registry import query, table

_RAW = "case event_id % 9 when 0 then ' 12.9 ' when 1 then '-3.99' when 2 then 'abc' when 3 then '' when 4 then '42.10%' when 5 then '1e3' when 6 then '1d' when 7 then cast(event_id as varchar) else '.5' end"
_RAW_SPARK = _RAW.replace("varchar", "string")
_NUMBER = r"case when regexp_matches({0}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast({0} as double) end"


@query("p01_safe_int", f"with t as (select event_id, {_RAW} as raw from events) select event_id, coalesce(cast(trunc({_NUMBER.format('trim(raw)')}) as bigint), 0) as value from t")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_RAW_SPARK).alias("raw")).select("event_id", text.safe_int(F.col("raw")).alias("value"))


_BARE = "rtrim(trim(raw), '%')"


@query("p02_safe_float", f"with t as (select event_id, {_RAW} as raw from events) select event_id, coalesce({_NUMBER.format(_BARE)}, 0.0) as value from t")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_RAW_SPARK).alias("raw")).select("event_id", text.safe_float(F.col("raw")).alias("value"))


def _sql_last(c: str, sep: str, limit: int) -> str:
    head = f"substr({c}, 1, {limit})"
    at = f"strpos(reverse({head}), '{sep[::-1]}')"
    return f"(case when {at} > 0 then length({head}) - ({at} - 1) - {len(sep)} else -1 end)"


def _sql_truncate(c: str, limit: int = 120, ellipsis: str = "...") -> str:
    floor = limit * text.LEAST_SHARE
    cuts = [f"case when {_sql_last(c, s, limit)} > {floor} then trim(substr({c}, 1, {_sql_last(c, s, limit)} + 1)) end" for s in text.SENTENCE_ENDS]
    cuts += [f"case when {_sql_last(c, s, limit)} > {floor} then trim(substr({c}, 1, {_sql_last(c, s, limit)})) end" for s in text.CLAUSE_ENDS]
    space = _sql_last(c, " ", limit)
    cuts.append(f"case when {space} > 0 then trim(substr({c}, 1, {space})) || '{ellipsis}' end")
    return f"case when length({c}) <= {limit} then {c} else coalesce({', '.join(cuts)}, trim(substr({c}, 1, {limit}))) end"


@query("p03_truncate_text", f"select doc_id, {_sql_truncate('text')} as cut from documents")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text")).alias("cut"))


def _sql_title(c: str) -> str:
    cuts = [f"case when strpos({c}, '{s}') between 2 and 61 then trim(substr({c}, 1, strpos({c}, '{s}') - 1)) end" for s in text.TITLE_ENDS]
    return f"coalesce({', '.join(cuts)}, case when length({c}) <= 60 then trim({c}) else {_sql_truncate(c, 60, '')} end)"


@query("p04_truncate_title", f"with t as (select doc_id, replace(text, '. ', case doc_id % 4 when 0 then ' | ' when 1 then ' - ' when 2 then ' — ' else ' : ' end) as title from documents) select doc_id, {_sql_title('title')} as short_title from t")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep = F.expr("case doc_id % 4 when 0 then ' | ' when 1 then ' - ' when 2 then ' — ' else ' : ' end")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), sep).alias("title"))
    return docs.select("doc_id", text.truncate_title(F.col("title")).alias("short_title"))


_LAST = f"{sql_segments()}[-1]"
_BARE_SEG = "coalesce(" + ", ".join(f"case when suffix({_LAST}, '{e}') then substr({_LAST}, 1, length({_LAST}) - {len(e)}) end" for e in urls.EXTENSIONS) + f", {_LAST})"


@query("p05_title_from_url", f"select page_id, case when len({sql_segments()}) = 0 then 'Home' else coalesce(nullif({sql_unslug(_BARE_SEG)}, ''), 'Home') end as title from pages")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.title_from_url(F.col("url")).alias("title"))


_SLUG = sql_title_case("translate(x, '-_', '  ')").replace("lambda r", "lambda y").replace("substr(r", "substr(y")


@query("p06_description_from_url", f"select page_id, case when len({sql_segments()}) = 0 then 'Homepage' else array_to_string(list_transform({sql_segments()}[-2:], lambda x: {_SLUG}), ' > ') end as description from pages")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.description_from_url(F.col("url")).alias("description"))


@query("p07_domain_of", rf"select page_id, replace({sql_authority()}, 'www.', '') as domain, regexp_replace(lower({sql_authority()}), '^www\.', '') as site from pages")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(u).alias("domain"), urls.site_domain(u).alias("site"))


@query("p08_estimate_tokens", "select doc_id, greatest(1, length(text) // 4) as tokens from documents")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("p09_content_fingerprint")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query("p10_effective_depth", f"with {INVENTORY_SQL} select ord, cast(depth as bigint) as depth from entries")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("ord", ranking.effective_depth().alias("depth"))


@query(
    "p11_score_breakdown",
    f"""with {INVENTORY_SQL} select ord,
    round(depth_value * case when linked then 0.2e0 else 0.2e0 / 0.3e0 end, 6) as depth_term,
    round(content_value * case when linked then 0.1e0 else 0.1e0 / 0.3e0 end, 6) as content_term,
    round(case when linked then link_score * 0.4e0 end, 6) as link_term,
    round(case when linked then least(unique_inlinks * 10e0, 100e0) * 0.3e0 end, 6) as inlinks_term,
    round(score, 6) as score from entries""",
)
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ranking.score_terms()
    return inventory(spark, sf_dir).select(
        "ord",
        F.round(t["depth"], 6).alias("depth_term"),
        F.round(t["content"], 6).alias("content_term"),
        F.round(t["link_score"], 6).alias("link_term"),
        F.round(t["inlinks"], 6).alias("inlinks_term"),
        F.round(ranking.importance(), 6).alias("score"),
    )


@query("p12_is_optional", f"with {INVENTORY_SQL} select ord, optional from entries")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("ord", ranking.is_optional().alias("optional"))


def sql_any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


CONTACT_SQL = f"({sql_any('lower(url)', ranking.CONTACT_URL)} or {sql_any('lower(display_title)', ranking.CONTACT_TITLE)})"
_LOWERED = f"'/' || lower(array_to_string({sql_segments()}, '/'))"
IDENTITY_SQL = f"(n_segments = 0 or {sql_any(_LOWERED, ranking.IDENTITY_URL)} or {sql_any('lower(display_title)', ranking.IDENTITY_TITLE)})"


@query("p13_is_contact", f"with {INVENTORY_SQL} select ord, {CONTACT_SQL} as contact from entries")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("ord", ranking.is_contact().alias("contact"))


@query("p14_is_identity", f"with {INVENTORY_SQL} select ord, {IDENTITY_SQL} as identity from entries")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("ord", ranking.is_identity().alias("identity"))


SECTION_SQL = f"case when len({sql_segments()}) = 0 then 'Main' else {sql_unslug(sql_segments() + '[1]')} end"


@query("p15_url_to_section", f"select page_id, {SECTION_SQL} as section from pages")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.section_of(F.col("url")).alias("section"))


def sql_canonical(c: str = "url") -> str:
    keys = ", ".join(f"'{k}'" for k in urls.TRACKING)
    host = f"regexp_replace(regexp_replace(regexp_replace(lower({sql_authority(c)}), ':443$', ''), ':80$', ''), '^www\\.', '')"
    path = f"coalesce(nullif(regexp_replace(lower({sql_path(c)}), '/+$', ''), ''), '/')"
    pairs = f"list_sort(list_distinct(list_filter(string_split({sql_query(c)}, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({keys}))))"
    return f"'https://' || {host} || {path} || case when len({pairs}) > 0 then '?' || array_to_string({pairs}, '&') else '' end"


@query("p16_canonical_url", f"select page_id, {sql_canonical()} as canonical_url from pages")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


def sql_class(s: str) -> str:
    return (
        f"case when regexp_matches({s}, '^(19|20)\\d{{2}}$') then '{{year}}' when regexp_matches({s}, '^\\d+$') then '{{id}}' "
        f"when regexp_matches({s}, '^(19|20)\\d{{2}}-\\d{{2}}(-\\d{{2}})?$') then '{{date}}' "
        f"when regexp_matches(lower({s}), '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') then '{{uuid}}' "
        f"when regexp_matches(lower({s}), '^[a-z0-9]+(-[a-z0-9]+){{2,}}$') then '{{slug}}' end"
    )


@query("p17_classify_segment", f"with s as (select page_id, unnest({sql_segments()} || [cast(1800 + page_id as varchar), '2024-0' || (page_id % 9 + 1), 'a-b-' || page_id]) as segment from pages) select page_id, segment, {sql_class('segment')} as kind from s")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.expr("array(cast(1800 + page_id as string), concat('2024-0', page_id % 9 + 1), concat('a-b-', page_id))")
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(urls.segments(F.col("url")), more)).alias("segment"))
    return s.select("page_id", "segment", urls.segment_class(F.col("segment")).alias("kind"))


@query("p18_extension", rf"select page_id, nullif(lower(regexp_extract({sql_path()}, '\.([^./]*)$', 1)), '') as extension from pages")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.extension(F.col("url")).alias("extension"))


@query("p19_sitemap_label", f"select page_id, coalesce(nullif(string_split({sql_path()}, '/')[-1], ''), url) as label from pages")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.sitemap_label(F.col("url")).alias("label"))


@query("p20_fold_change", "select o_orderkey, case when greatest(a, b) = 0 then 1.0 when least(a, b) = 0 then cast('inf' as double) else cast(greatest(a, b) as double) / least(a, b) end as fold from (select o_orderkey, o_orderkey % 5 as a, o_custkey % 7 as b from orders)")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", patterns.fold_change(F.col("o_orderkey") % 5, F.col("o_custkey") % 7).alias("fold"))


GLOBS = ("*/en/7*", "/fr/**", "/de/[0-4]*", "*.html", "/es/???/")


@query(
    "p21_glob_match",
    f"""with t as (select page_id, url, {sql_path()} as p from pages), f as (select page_id, [url, p, regexp_replace(p, '/+$', ''), regexp_replace(p, '/+$', '') || '/'] as forms from t)
    select page_id, coalesce({", ".join(f"case when len(list_filter(forms, lambda x: x glob '{g.replace('**', '*')}' or lower(x) glob '{g.replace('**', '*').lower()}')) > 0 then '{g}' end" for g in GLOBS)}) as pattern from f""",
)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", patterns.first_match(F.col("url"), GLOBS).alias("pattern"))


@query("p23_usd", "select o_orderkey, coalesce('$' || format('{:,.2f}', v), '—') as usd from (select o_orderkey, case when o_orderkey % 11 = 0 then null else round(o_totalprice, 2) end as v from orders)")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.round("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.usd(v).alias("usd"))


_TIER = "case when n < 100 then 'small' when n < 1000 then 'medium' when n < 10000 then 'large' else 'huge' end"
_CAP = "case when n < 100 then 0 when n < 1000 then 400 when n < 10000 then 1000 else 1500 end"


@query("p24_size_tier", f"select doc_id, {_TIER} as tier, {_CAP} as suggested, cast(case when doc_id % 5 = 0 then 77 when {_CAP} = 0 then case when n > 0 then n else 500 end else least({_CAP}, 500) end as bigint) as cap from (select doc_id, n_chars as n from documents)")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    asked = F.when(F.col("doc_id") % 5 == 0, F.lit(77))
    return table(spark, sf_dir, "documents").select("doc_id", patterns.size_tier(n).alias("tier"), patterns.suggested_cap(n).alias("suggested"), patterns.page_cap(n, asked).cast("bigint").alias("cap"))


@query("p25_urn", "select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'resource') as urn from part")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.urn(F.col("p_name")).alias("urn"))


@query(
    "p26_parse_facts",
    """with t as (select n_nationkey, unnest(['capital = ' || n_name || ' = atlas', 'region=' || n_regionkey, 'no fact here', ' = empty']) as line from nation)
    select n_nationkey, trim(split_part(line, '=', 1)) as name, trim(split_part(line, '=', 2)) as value, trim(split_part(line, '=', 3)) as source from t where contains(line, '=') and trim(split_part(line, '=', 1)) <> '' and trim(split_part(line, '=', 2)) <> ''""",
)
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.expr("array(concat('capital = ', n_name, ' = atlas'), concat('region=', n_regionkey), 'no fact here', ' = empty')")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(lines).alias("line"))
    parts = F.split("line", "=", 3)
    part = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    facts = rows.where(F.col("line").contains("=")).select("n_nationkey", part(0).alias("name"), part(1).alias("value"), part(2).alias("source"))
    return facts.where("name <> '' and value <> ''")


@query("p27_site_url", f"select page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {sql_authority()} as site_url from pages")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.site_url(F.col("url")).alias("site_url"))


_P5 = f"case when len({sql_segments()}) = 0 then 'Home' else coalesce(nullif({sql_unslug(_BARE_SEG)}, ''), 'Home') end"


@query("p28_fallback_copy", f"with {INVENTORY_SQL} select ord, coalesce(nullif({_sql_title('display_title')}, ''), {_P5}) as title, coalesce(nullif({_sql_truncate('description')}, ''), array_to_string(list_transform({sql_segments()}[-2:], lambda x: {_SLUG}), ' > ')) as description from entries")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    title = F.coalesce(F.nullif(text.truncate_title(ranking.display_title()), F.lit("")), urls.title_from_url(u))
    described = F.coalesce(F.nullif(text.truncate_text(F.col("description")), F.lit("")), urls.description_from_url(u))
    return inventory(spark, sf_dir).select("ord", title.alias("title"), described.alias("description"))
