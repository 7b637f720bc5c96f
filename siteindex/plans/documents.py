"""Queries of document parsing and rules (2.9), with W9, W17-W19, A20, A24 and J11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, review
from ..operators import documents as d
from .registry import query, table

_NL = "chr(10)"
_LINKS = """l as (select page_id // 50 as doc, page_id % 3 as part, string_agg(case when page_id % 23 = 0 then '- [broken](' || url else '- [' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '](' || url || ')' || case page_id % 4 when 0 then '' when 1 then ': Learn the best of colour and color' else ': Plain words ' || page_id end end, chr(10) order by page_id) as links from pages group by all)"""
_DOCS = f"""{_LINKS}, b as (select doc, max(links) filter (part = 0) as l0, max(links) filter (part = 1) as l1, max(links) filter (part = 2) as l2 from l group by doc),
docs as (select doc, case when doc % 5 = 0 then '' else '# Site ' || doc || chr(10) end || chr(10) || case when doc % 4 = 1 then '' else '> About ' || doc || chr(10) end || case when doc % 6 = 0 then '### Stray' || chr(10) else '' end
  || chr(10) || case when doc % 3 = 0 then '## Optional' else '## Pages' end || chr(10) || chr(10) || l0 || chr(10) || chr(10) || '## More' || chr(10) || l1 || chr(10) || '```' || chr(10) || '# comment' || chr(10) || '```' || chr(10) || '## Last' || chr(10) || l2
  || chr(10) || chr(10) || '---' || chr(10) || '*Generated today*' || case when doc % 7 = 0 then chr(10) || 'loose words' else '' end as text from b)"""
_M = lambda c, p: f"coalesce(regexp_matches({c}, '{p}'), false)"
_LINES = rf"""{_DOCS}, r as (select doc, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as raw from docs),
f as (select *, {_M('ltrim(raw)', '^(```|~~~)')} as fence from r), g as (select *, fence or sum(cast(fence as int)) over (partition by doc order by line) % 2 = 1 as fenced from f),
h as (select *, case when not fenced and regexp_matches(raw, '{d.HEADING}') then length(regexp_extract(raw, '{d.HEADING}', 1)) end as level from g),
i as (select *, case when level is not null then trim(regexp_extract(raw, '{d.HEADING}', 2)) end as heading from h),
s as (select *, last_value(case when level = 2 then heading end ignore nulls) over (partition by doc order by line rows unbounded preceding) as section, sum(cast(level = 2 as int)) over (partition by doc order by line) as section_no from i),
k as (select *, section is not null and coalesce(level <> 2, true) and {_M('trim(raw)', '^[-*]')} and not {_M('raw', d.BREAK)} and not {_M('raw', d.EMPHASISED)} and contains(raw, '](') as is_link from s),
lines as (select doc, line, raw, level, heading, section, section_no, is_link, is_link and not {_M('raw', d.LINK)} as malformed, case when is_link and {_M('raw', d.LINK)} then trim(regexp_extract(raw, '{d.LINK}', 1)) end as title,
  case when is_link and {_M('raw', d.LINK)} then trim(regexp_extract(raw, '{d.LINK}', 2)) end as url, case when is_link and {_M('raw', d.LINK)} then trim(regexp_extract(raw, '{d.LINK}', 3)) end as description from k)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    tail = F.when(i % 4 == 0, "").when(i % 4 == 1, ": Learn the best of colour and color").otherwise(F.concat(F.lit(": Plain words "), i.cast("string")))
    link = F.when(i % 23 == 0, F.concat(F.lit("- [broken]("), "url")).otherwise(F.concat(F.lit("- ["), title, F.lit("]("), "url", F.lit(")"), tail))
    part = lambda k: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(i % 3 == k, F.struct(i.alias("i"), link.alias("t"))))), lambda x: x["t"]), "\n"), F.lit("")).alias(f"l{k}")
    b = p.groupBy(F.floor(i / 50).alias("doc")).agg(part(0), part(1), part(2))
    name = F.col("doc").cast("string")
    when = lambda n, k, yes, no: F.when(F.col("doc") % n == k, yes).otherwise(no)
    none = F.lit("")
    text = F.concat(
        when(5, 0, none, F.concat(F.lit("# Site "), name, F.lit("\n"))),
        F.lit("\n"),
        when(4, 1, none, F.concat(F.lit("> About "), name, F.lit("\n"))),
        when(6, 0, F.lit("### Stray\n"), none),
        F.lit("\n"),
        when(3, 0, F.lit("## Optional"), F.lit("## Pages")),
        F.lit("\n\n"),
        "l0",
        F.lit("\n\n## More\n"),
        "l1",
        F.lit("\n```\n# comment\n```\n## Last\n"),
        "l2",
        F.lit("\n\n---\n*Generated today*"),
        when(7, 0, F.lit("\nloose words"), none),
    )
    return b.select("doc", text.alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.lines(_docs(spark, sf_dir))


@query("w18_headings_outside_fences", f"with {_LINES} select doc, cast(line as integer) as line, level, heading from lines where level is not null")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("level is not null").select("doc", "line", "level", "heading")


@query("w17_current_section", f"with {_LINES} select doc, cast(line as integer) as line, section, title, url, description, malformed from lines where is_link")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("is_link").select("doc", "line", "section", "title", "url", "description", "malformed")


# The rules in SQL, written apart from the operator's expressions.
_RULES = rf"""{_LINES}, m as (select doc, count(*) filter (level = 1) as h1s, min(line) filter (level = 1) as h1_line, min(line) filter (trim(raw) <> '') as first_line, min(line) filter (level = 2) as first_h2, greatest(max(line) filter (is_link), max(line) filter (level = 2)) as tail,
  count(*) filter (is_link) as links, min(section_no) filter (level = 2 and lower(heading) = 'optional') as opt, arg_max(heading, line) filter (level = 2) as last_section from lines group by doc),
q as (select m.doc, min(line) as quote_line from m join lines using (doc) where line > coalesce(h1_line, -1) and line < first_h2 and starts_with(trim(raw), '>') group by m.doc),
p as (select m.*, quote_line, octet_length(encode(text)) as bytes from m join docs using (doc) left join q using (doc)),
x as (select lines.*, p.h1_line, p.first_h2, p.quote_line, p.tail, p.opt from lines join p using (doc)),
fl as (select *, regexp_extract(regexp_replace(url, '^https?://[^/?#]*', ''), '^[^?#]*') as path, regexp_matches(url, '[?][^#]') as asks from x where is_link and not malformed),
slash as (select doc, count(*) filter (suffix(path, '/')) as w, count(*) filter (not suffix(path, '/')) as wo from fl where path not in ('', '/') and not contains(regexp_extract(path, '[^/]*$'), '.') group by doc),
status as (select url, case when page_id % 9 = 0 then 404 when page_id % 8 = 0 then null else 200 end as status from pages),
bounds as (select doc, section, least, most from docs cross join (values ('Pages', 5, null), ('More', null, 6), ('Absent', 1, null)) b(section, least, most) where doc % 3 = 1),
sized as (select doc, section, count(*) filter (is_link) as n from lines where section is not null group by all),
spelt as (select doc, a, b from docs cross join (values ('optimize', 'optimise'), ('analyze', 'analyse'), ('organize', 'organise'), ('recognize', 'recognise'), ('prioritize', 'prioritise'), ('specialize', 'specialise'), ('customize', 'customise'), ('maximize', 'maximise'), ('color', 'colour'), ('center', 'centre'), ('catalog', 'catalogue'), ('license', 'licence'), ('behavior', 'behaviour'), ('favorite', 'favourite')) w(a, b) where regexp_matches(lower(text), '\b' || a) and regexp_matches(lower(text), '\b' || b)),
faults as (
  select doc, 'IDX-001' as rule_id, 1 as n from p where h1s = 0 or h1_line <> first_line and h1s = 1 union all select doc, 'IDX-001', h1s from p where h1s > 1
  union all select doc, 'IDX-002', 1 from p where quote_line is null or quote_line > h1_line + 3
  union all select doc, 'IDX-003', 1 from x where level is not null and line > coalesce(quote_line, h1_line, -1) and line < first_h2
  union all select doc, 'IDX-004', 1 from p where opt is not null and lower(last_section) <> 'optional'
  union all select doc, 'IDX-005', 1 from x where line > tail and trim(raw) <> '' and not (raw = '---' or raw = '*Generated today*')
  union all select doc, 'IDX-006', 1 from x where malformed
  union all select doc, 'IDX-007', 1 from fl where not starts_with(url, 'http')
  union all select doc, 'IDX-007', 1 from fl where starts_with(url, 'http://') and doc not in (select doc from fl where not starts_with(url, 'http'))
  union all select doc, 'IDX-007', least(w, wo) from slash where least(w, wo) > 0.05 * (w + wo) and doc not in (select doc from fl where not starts_with(url, 'https'))
  union all select doc, 'IDX-008', 1 from fl group by doc, url having count(*) > 1
  union all select doc, 'IDX-008', 1 from fl where title <> '' group by doc, lower(title) having count(*) > 1
  union all select doc, 'IDX-009', bytes from p where doc % 2 = 0 and bytes > 1500
  union all select doc, 'IDX-010', links from p where doc % 2 = 0 and (links > 11 or links < 3)
  union all select doc, 'IDX-011', 1 from bounds left join sized using (doc, section) where coalesce(n, 0) < least
  union all select doc, 'IDX-011', 1 from bounds left join sized using (doc, section) where n > most
  union all select doc, 'IDX-012', 1 from fl where coalesce(description, '') = ''
  union all select doc, 'IDX-013', len(regexp_extract_all(lower(description), '\b(?:award-winning|best|leading|top|world-class|dominate|ultimate|premier|cutting-edge|proven|expert)\b')) from fl
  union all select doc, 'IDX-014', 1 from fl where regexp_matches(lower(description), '^(?:learn|discover|explore|understand|find out|dive into|unlock)')
  union all select doc, 'IDX-015', 1 from spelt
  union all select doc, 'IDX-016', 1 from fl where asks or regexp_matches(lower(path), '/(?:login|signin|sign-in|account|admin|wp-admin|cart|checkout)')
  union all select doc, 'IDX-017', 1 from fl where section_no = opt and regexp_matches(lower(url), '/(?:about|about-us|contact|case-stud|our-work|portfolio|team|testimonial|clients)')
  union all select distinct doc, 'IDX-018', 1 from x where regexp_matches(raw, '!\[[^\]]*\]\([^)]*\)') union all select distinct doc, 'IDX-018', 1 from x where regexp_matches(lower(raw), '<(?:div|span|p|img|script|style|br|table|iframe)\b')
  union all select doc, 'IDX-020', 1 from fl join status using (url) where status is null or status >= 400),
rules as (select * from (values ('IDX-001', 'error'), ('IDX-002', 'error'), ('IDX-003', 'warning'), ('IDX-004', 'warning'), ('IDX-005', 'warning'), ('IDX-006', 'error'), ('IDX-007', 'error'), ('IDX-008', 'warning'), ('IDX-009', 'warning'), ('IDX-010', 'warning'), ('IDX-011', 'info'), ('IDX-012', 'warning'), ('IDX-013', 'warning'),
  ('IDX-014', 'warning'), ('IDX-015', 'info'), ('IDX-016', 'warning'), ('IDX-017', 'error'), ('IDX-018', 'warning'), ('IDX-019', 'warning'), ('IDX-020', 'warning')) r(rule_id, severity)),
summed as (select doc, rule_id, sum(n) as n from faults group by all having sum(n) > 0),
found as (select doc, rule_id, severity, case when (rule_id in ('IDX-009', 'IDX-010') and doc % 2 <> 0) or (rule_id = 'IDX-011' and doc % 3 <> 1) then 'skipped' when n is not null then 'fail' else 'pass' end as outcome, cast(coalesce(n, 0) as bigint) as count from docs cross join rules left join summed using (doc, rule_id))"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    i = F.col("page_id")
    status = table(spark, sf_dir, "pages").select("url", F.when(i % 9 == 0, 404).when(i % 8 != 0, 200).alias("status"))
    profile = docs.where("doc % 2 = 0").select("doc", F.lit(1500).alias("max_bytes"), F.lit(11).alias("max_links"), F.lit(3).alias("min_links"))
    sections = spark.createDataFrame([("Pages", 5, None, 0), ("More", None, 6, 1), ("Absent", 1, None, 2)], "section string, least int, most int, ord int")
    bounds = docs.where("doc % 3 = 1").select("doc", F.explode(F.array(*[F.lit(x) for x in ("Pages", "More", "Absent")])).alias("section")).join(F.broadcast(sections), "section")  # three rows
    return audit.index_findings(docs, profile, bounds, status)


@query("idx_rules", f"with {_RULES} select doc, rule_id, severity, outcome, count from found")
def idx_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("doc", "rule_id", "severity", "outcome", "count")


@query("idx_findings")
def idx_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failed rules say, with their first examples."""
    return _audited(spark, sf_dir).where("outcome = 'fail'").select("doc", "rule_id", "message", "count", "examples")


_SCORED = """w as (select *, case severity when 'error' then 5e0 when 'warning' then 2e0 else 1e0 end as weight from found),
    scored as (select doc, coalesce(sum(weight) filter (outcome <> 'skipped'), 0) as applicable, coalesce(sum(weight) filter (outcome = 'pass'), 0) as passed, bool_or(severity = 'error' and outcome = 'fail') as e, bool_or(severity = 'warning' and outcome = 'fail') as w from w group by doc)
    select doc, cast(least(case when applicable > 0 then round_even(100 * passed / applicable, 0) else 0 end, case when e then 49 when w then 79 else 100 end) as bigint) as score, case when e then 'error' when w then 'warning' end as capped_by from scored"""


@query("a20_rule_score", f"with {_RULES}, {_SCORED}")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.report(_audited(spark, sf_dir))


@query("idx_008_duplicates", f"with {_LINES}, u as (select doc, url, count(*) as n from lines where is_link and not malformed group by all), t as (select doc, lower(title) as t, count(*) as n from lines where is_link and not malformed and title <> '' group by all) select doc, (select count(*) from u where u.doc = docs.doc and n > 1) as urls, (select count(*) from t where t.doc = docs.doc and n > 1) as titles from docs")
def idx_008(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _lines(spark, sf_dir).where("is_link and not malformed")
    count = lambda key, name: links.where(key != "").groupBy("doc", key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    both = _docs(spark, sf_dir).select("doc").join(count(F.col("url"), "urls"), "doc", "left").join(count(F.lower("title"), "titles"), "doc", "left")
    return both.fillna(0)


@query("idx_011_section_bounds", f"with {_LINES} select doc, section, count(*) filter (is_link) as links, count(*) filter (is_link) < 3 or count(*) filter (is_link) > 5 as outside from lines where section is not null group by all")
def idx_011(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _lines(spark, sf_dir).where("section is not null").groupBy("doc", "section").agg(F.count_if("is_link").alias("links"))
    return g.withColumn("outside", (F.col("links") < 3) | (F.col("links") > 5))


_STATUS = "status as (select url, case when page_id % 9 = 0 then 404 when page_id % 8 = 0 then null else 200 end as status from pages)"


@query("idx_020_links_resolve", f"with {_LINES}, {_STATUS} select doc, count(*) as broken from lines left join status using (url) where is_link and not malformed and (status is null or status >= 400) group by doc")
def idx_020(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).where("rule_id = 'IDX-020' and outcome = 'fail'").select("doc", F.col("count").alias("broken"))


_FULL = rf"""fulls as (select doc_id as doc, '# Doc ' || doc_id || chr(10) || chr(10) || '## One' || chr(10) || 'Source: https://x/' || doc_id || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '## **Two** ' || chr(10) || case when doc_id % 3 = 0 then 'Source: https://y/' || doc_id else '' end || chr(10) || '# Body' || chr(10) || '## _Three_' || chr(10) || 'end  ' as text from documents),
r as (select doc, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as raw from fulls),
h as (select *, case when regexp_matches(raw, '^# ') then 1 when regexp_matches(raw, '^## ') then 2 end as level, regexp_matches(raw, '^Source:\s*\S+\s*$') as cites, not regexp_matches(raw, '\S') as blank from r),
b as (select *, level is not distinct from 2 and coalesce(bool_or(cites) over (partition by doc order by line rows between 1 following and 6 following), false) as boundary from h),
g as (select *, sum(cast(boundary as int)) over (partition by doc order by line) as page_no, line - sum(cast(blank as int)) over (partition by doc order by line) as island from b),
gaps as (select doc, count(*) as blank_runs from (select doc, island from g where blank group by all having count(*) >= 3) group by doc),
body as (select doc, page_no, sum(case when boundary then 0 else length(raw) + 1 end) - 1 as chars from g where page_no > 0 group by all),
t as (select g.doc, count_if(level = 1) as h1s, count_if(level = 2) as h2s, count_if(cites) as cites, count_if(boundary) as pages, count_if(level = 2 and not boundary) + count_if(level = 1 and page_no > 0) as inside, count_if(regexp_matches(raw, '[ \t]$')) as spaced,
  count_if(regexp_matches(raw, '^#+\s+[*_]')) as wrapped, sum(length(raw) + 1) - 1 as chars from g group by g.doc),
f as (select doc, 'FULL-001' as rule_id, 'error' as severity, h1s <> 1 as bad, greatest(1, h1s) as n from t union all select doc, 'FULL-002', 'error', h2s <> cites or cites <> pages, abs(h2s - cites) from t union all select doc, 'FULL-003', 'error', inside > 0, inside from t
  union all select doc, 'FULL-004', 'warning', pages = 0, 1 from t union all select doc, 'FULL-005', 'warning', false, 0 from t union all select doc, 'FULL-006', 'info', coalesce(blank_runs, 0) + spaced > 0, coalesce(blank_runs, 0) + spaced from t left join gaps using (doc) union all select doc, 'FULL-007', 'info', wrapped > 0, wrapped from t
  union all select t.doc, 'FULL-008', 'info', coalesce(n, 0) > 0, coalesce(n, 0) from t left join (select doc, count(*) as n from body where chars between 1 and 2999 group by doc) using (doc) union all select doc, 'FULL-009', 'warning', chars // 4 > 200000, chars // 4 from t),
found as (select doc, rule_id, severity, case when bad then 'fail' else 'pass' end as outcome, cast(case when bad then n else 0 end as bigint) as count from f)"""


def _fulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Source: https://y/"), i)).otherwise("")
    text = F.concat(F.lit("# Doc "), i, F.lit("\n\n## One\nSource: https://x/"), i, F.lit("\n"), "text", F.lit("\n\n\n\n## **Two** \n"), source, F.lit("\n# Body\n## _Three_\nend  "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))


@query("full_rules", f"with {_FULL} select doc, rule_id, severity, outcome, count from found")
def full_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.full_findings(_fulls(spark, sf_dir)).select("doc", "rule_id", "severity", "outcome", "count")


@query("a20_full_score", f"with {_FULL}, {_SCORED}")
def a20_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.report(audit.full_findings(_fulls(spark, sf_dir)))


@query("w19_blank_runs", f"with {_FULL} select doc, blank_runs from gaps")
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.blank_runs(d.lines(_fulls(spark, sf_dir)))


@query(
    "a24_repeated_blocks",
    r"""with p as (select source as doc, doc_id as page, unnest(string_split(text, chr(10))) as block from documents), n as (select distinct doc, page, trim(regexp_replace(block, '\s+', ' ', 'g')) as block from p),
    c as (select doc, block, count(*) as n from n where length(block) >= 20 group by all having count(*) > 3) select doc, count(*) as blocks, cast(floor(sum(length(block) * (n - 1)) / 4) as bigint) as wasted_tokens from c group by doc""",
)
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return d.repeated_blocks(pages, least_chars=20)


@query("j11_index_not_in_full", "with f as (select distinct rtrim(url, '/') as u from pages where page_id % 3 <> 0) select page_id, url from pages where rtrim(url, '/') not in (select u from f)")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("u", F.rtrim("url", F.lit("/")))
    return p.select("page_id", "url", "u").join(p.where("page_id % 3 <> 0").select("u").distinct(), "u", "left_anti").select("page_id", "url")


_XF = f"""{_DOCS}, fulls as (select doc, case doc % 3 when 0 then text when 1 then replace(text, '> About', '> All about') else replace(text, '> About', 'About') end as whole, case when doc % 7 <> 3 then whole end as text from docs),
i as (select doc, trim(regexp_extract(text, '(?m)^> ?(.*)$', 1)) as mine from docs), o as (select doc, trim(regexp_extract(text, '(?m)^> ?(.*)$', 1)) as other from fulls)"""


@query("xf_001_blockquote", f"with {_XF} select doc, case when mine is null or other is null then 'skipped' when other = '' or (mine <> '' and mine <> other) then 'fail' else 'pass' end as outcome from i full join o using (doc)")
def xf_001(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    other = F.expr("case doc % 3 when 0 then text when 1 then replace(text, '> About', '> All about') else replace(text, '> About', 'About') end")
    return review.summaries_agree(docs, docs.select("doc", F.when(F.col("doc") % 7 != 3, other).alias("text")))


_AGENT = """agents as (select conv_id * 100 + turn as doc, case when turn % 3 = 0 then null else turn % 3 = 1 end as shop, case when turn % 4 = 3 then null else 'shop.example' end as host, case when turn % 2 = 0 then ['api.shop-store.example'] end as verified_hosts,
  case when turn % 5 = 4 then null else turn % 5 end as broken, case turn % 6 when 0 then 'text/markdown; charset=utf-8' when 1 then 'text/html' when 2 then 'application/json' when 3 then '' when 4 then 'text/plain' end as content_type,
  case when turn % 4 = 0 then '' else '# T' || chr(10) end || '## Use' || chr(10) || text || case when turn % 5 = 0 then ' mail me@x.org to checkout' else '' end || case when turn % 2 = 0 then chr(10) || '## Not supported' || chr(10) || 'add to cart' else '' end || case when turn % 7 = 0 then chr(10) || 'Generated 2026-08-20' else '' end
  || chr(10) || case turn % 3 when 0 then '- `/cart` page' when 1 then '- see https://www.shop.example/a and https://api.shop-store.example/b' else 'This file conforms to the agents.md spec, see /llms.txt' end as text from conversations)"""
_HOSTS = "list_transform(regexp_extract_all(text, 'https?://[^\\s<>\")\\]`]+'), lambda u: lower(regexp_extract(u, '^https?://([^/?#]*)', 1)))"


@query(
    "agt_rules",
    f"""with {_AGENT}, stats as (select doc, shop, len(regexp_extract_all(text, '(?m)^#\\s')) as h1s, len(regexp_extract_all(text, '(?m)^##\\s')) as h2s, length(trim(text)) as chars,
    {" + ".join(f"cast(contains(split_part(lower(text), '## not supported', 1), '{w}') as int)" for w in d.TRANSACTIONS)} as transactions, len(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')) as emails, 0 as phones,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '`/([^/`][^`]*)?`') and not contains(x, '://') and starts_with(ltrim(x), '-'))) as relative, contains(text, '## Not supported') as limits, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])20\\d{{2}}-\\d{{2}}-\\d{{2}}([^\\p{{L}}\\p{{N}}_]|$)') as dated,
    case when host is not null then len(list_filter({_HOSTS}, lambda h: not (contains(h, host) or contains(h, 'ucp.dev') or len(list_filter(coalesce(verified_hosts, []), lambda x: contains(h, x))) > 0))) end as offsite,
    {" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in d.CLAIMS)} as claims, contains(text, 'llms.txt') as pointer, broken, content_type from agents),
    f as (select doc, 'AGT-001' as rule_id, cast(h1s <> 1 as int) as n from stats union all select doc, 'AGT-002', cast(h2s = 0 as int) from stats union all select doc, 'AGT-003', cast(chars < 80 as int) from stats
      union all select doc, 'AGT-005', case shop when true then 0 when false then transactions end from stats union all select doc, 'AGT-007', broken from stats union all select doc, 'AGT-008', relative from stats union all select doc, 'AGT-009', offsite from stats
      union all select doc, 'AGT-010', cast(not limits as int) from stats union all select doc, 'AGT-011', least(claims, 1) from stats union all select doc, 'AGT-012', cast(not dated as int) from stats union all select doc, 'AGT-013', cast(not pointer as int) from stats
      union all select doc, 'AGT-014', case content_type when '' then 0 when 'text/markdown; charset=utf-8' then 0 when 'text/plain' then 0 when 'text/html' then 1 when 'application/json' then 1 end from stats)
    select doc, rule_id, case when n is null then 'skipped' when n > 0 then 'fail' else 'pass' end as outcome, cast(n as bigint) as count from f""",
)
def agt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.findings(d.agent_measures(_agents(spark, sf_dir)), {k: v for k, v in d.AGENT_RULES.items() if k != "AGT-006"})
    return found.select("doc", "rule_id", "outcome", "count")


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    kinds = ("text/markdown; charset=utf-8", "text/html", "application/json", "", "text/plain")
    text = F.concat(
        F.when(turn % 4 == 0, "").otherwise("# T\n"),
        F.lit("## Use\n"),
        "text",
        F.when(turn % 5 == 0, " mail me@x.org to checkout").otherwise(""),
        F.when(turn % 2 == 0, "\n## Not supported\nadd to cart").otherwise(""),
        F.when(turn % 7 == 0, "\nGenerated 2026-08-20").otherwise(""),
        F.lit("\n"),
        F.when(turn % 3 == 0, "- `/cart` page").when(turn % 3 == 1, "- see https://www.shop.example/a and https://api.shop-store.example/b").otherwise("This file conforms to the agents.md spec, see /llms.txt"),
    )
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("doc"),
        F.when(turn % 3 != 0, turn % 3 == 1).alias("shop"),
        F.when(turn % 4 != 3, "shop.example").alias("host"),
        F.when(turn % 2 == 0, F.array(F.lit("api.shop-store.example"))).alias("verified_hosts"),
        F.when(turn % 5 != 4, turn % 5).alias("broken"),
        F.get(F.array(*[F.lit(k) for k in kinds]), (turn % 6).cast("int")).alias("content_type"),
        text.alias("text"),
    )


@query("agt_006_contacts")
def agt_006(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails and phone numbers; the phone pattern needs a look-behind, which the SQL engine lacks."""
    return d.agent_measures(_agents(spark, sf_dir)).select("doc", "emails", "phones")


@query(
    "agt_004_unverified_urls",
    "with u as (select distinct conv_id, 'https://x/' || (turn % 5) as url from conversations), v as (select conv_id, 'https://x/' || (turn * 2 % 5) as url from conversations where role = 'user') select conv_id, url from u where (conv_id, url) not in (select (conv_id, url) from v)",
)
def agt_004(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a site's document that none of its own verified surfaces has."""
    c = table(spark, sf_dir, "conversations")
    named = c.select("conv_id", F.concat(F.lit("https://x/"), (F.col("turn") % 5).cast("string")).alias("url")).distinct()
    verified = c.where("role = 'user'").select("conv_id", F.concat(F.lit("https://x/"), (F.col("turn") * 2 % 5).cast("string")).alias("url"))
    return named.join(verified, ["conv_id", "url"], "left_anti").select("conv_id", "url")


_OPENINGS = ("", "Learn ", "Get to know ", "The best ", "gain ", "A world-class ")
_PAGE_COPY = """c as (select page_id, url, page_id // 50 as scope, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, case page_id % 6 when 0 then '' when 1 then 'Learn ' when 2 then 'Get to know ' when 3 then 'The best ' when 4 then 'gain ' else 'A world-class ' end || regexp_extract(html, '<p>([^<]*)', 1) as description from pages)"""


def _page_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    opening = F.get(F.array(*[F.lit(x) for x in _OPENINGS]), (i % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.floor(i / 50).alias("scope"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.concat(opening, F.regexp_extract("html", "<p>([^<]*)", 1)).alias("description"))


_T, _D = "trim(title)", "trim(description)"


@query(
    "copy_rules",
    f"""with {_PAGE_COPY} select page_id, array_to_string(list_filter([case when {_T} = '' then 'no title' end, case when length({_T}) > 60 then 'long title' end, case when {_D} = '' then 'no description' end, case when {_D} <> '' and length({_D}) < 25 then 'short description' end,
    case when length({_D}) > 160 then 'long description' end, case when regexp_matches(lower({_D}), '^({'|'.join(review.COPY_OPENERS)})') then 'opener' end, case when regexp_matches(lower({_D}), '{review.EDGE}({'|'.join(review.COPY_SUPERLATIVES)}){review.EDGE}') then 'superlative' end], lambda x: x is not null), ',') as problems from c""",
)
def copy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_copy(spark, sf_dir).select("page_id", F.array_join(review.copy_problems(F.col("title"), F.col("description")), ",").alias("problems"))


@query("w09_duplicate_description", f"with {_PAGE_COPY}, k as (select *, lower({_D}) as k from c), f as (select scope, page_id as ord, url, first_value(url) over (partition by scope, k order by page_id) as first_url from k where k <> '') select scope, ord, url, first_url from f where first_url <> url")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.duplicate_descriptions(_page_copy(spark, sf_dir).withColumnRenamed("page_id", "ord"))


_BOTH = ", ".join(f"case when list_contains(w, '{a}') and list_contains(w, '{b}') then '{a} / {b}' end" for a, b in review.COPY_LOCALES)


@query("copy_locale", f"with {_DOCS}, t as (select doc, case when doc % 3 = 0 then text || ' Colors, programme and program.' else text end as text from docs), v as (select doc, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as w from t) select doc, array_to_string(list_filter([{_BOTH}], lambda x: x is not null), ', ') as conflicts from v")
def copy_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc") % 3 == 0, F.concat("text", F.lit(" Colors, programme and program."))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc", F.array_join(review.locale_conflicts(text), ", ").alias("conflicts"))


_VDOCS = f"""{_DOCS}, vdocs as (select doc, text || case when doc % 4 = 0 then chr(10) || '- [rel](/a): x [b](https://x/b)' || chr(10) || '- loose item <DIV>' else '' end || case when doc % 3 = 1 then chr(10) || 'Full: https://x/llms-full.txt' else '' end || case when doc % 9 = 0 then repeat(' padding', 7000) else '' end as text from docs),
vl as (select doc, text, string_split(text, chr(10)) as ls from vdocs), hints as (select page_id // 50 as doc, bool_or(regexp_matches(lower(url), '{'|'.join(review.CONTACT_HINTS)}') or contains(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'contact')) as hinted from pages group by 1),
vstats as (select doc, octet_length(encode(text)) as bytes, starts_with(text, '# ') as titled, len(list_filter(ls[1:5], lambda x: starts_with(x, '>'))) > 0 as quoted, contains(text, '## ') as sectioned,
  len(list_filter(flatten(list_transform(ls, lambda x: regexp_extract_all(x, '{review.MARKDOWN_LINK}', 1))), lambda x: not regexp_matches(x, '^https?://'))) as relative, len(list_filter(ls, lambda x: starts_with(x, '- ') and not regexp_matches(x, '{review.LINK_LINE}'))) as malformed,
  regexp_matches(lower(text), '<(?:div|span|a |p |img |script|style)') as html, contains(text, '## Contact') or coalesce(hinted, false) as contact, contains(text, 'llms-full.txt') as companion from vl left join hints using (doc)),
vfound as (select doc, rule_id, severity, case when n > 0 then 'fail' else 'pass' end as outcome, cast(n as bigint) as count from (
  select doc, 'size' as rule_id, 'warning' as severity, cast(bytes > 51200 as int) as n from vstats union all select doc, 'h1', 'error', cast(not titled as int) from vstats union all select doc, 'blockquote', 'error', cast(not quoted as int) from vstats
  union all select doc, 'sections', 'info', cast(not sectioned as int) from vstats union all select doc, 'relative-url', 'error', relative from vstats union all select doc, 'link-format', 'warning', malformed from vstats
  union all select doc, 'html', 'warning', cast(html as int) from vstats union all select doc, 'contact', 'info', cast(not contact as int) from vstats union all select doc, 'full-reference', 'info', cast(not companion as int) from vstats))"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc")
    text = F.concat(
        "text",
        F.when(k % 4 == 0, "\n- [rel](/a): x [b](https://x/b)\n- loose item <DIV>").otherwise(""),
        F.when(k % 3 == 1, "\nFull: https://x/llms-full.txt").otherwise(""),
        F.when(k % 9 == 0, F.repeat(F.lit(" padding"), 7000)).otherwise(""),
    )
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("doc"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return d.findings(review.validator_measures(_docs(spark, sf_dir).select("doc", text.alias("text")), pages), review.VALIDATOR)


@query("val_checks", f"with {_VDOCS} select doc, rule_id, severity, outcome, count from vfound")
def val_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("doc", "rule_id", "severity", "outcome", "count")


@query("a25_worst_level", f"with {_VDOCS} select doc, case when bool_or(outcome = 'fail' and severity = 'error') then 'error' when bool_or(outcome = 'fail' and severity = 'warning') then 'warning' when bool_or(outcome = 'fail') then 'info' else 'ok' end as level from vfound group by doc")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.worst_level(_validated(spark, sf_dir))


@query(
    "val_broken_links",
    f"""with {_LINES}, {_STATUS}, probed as (select distinct doc, url from lines where is_link and not malformed), bad as (select doc, url || ' (' || coalesce(cast(status as varchar), 'unreachable') || ')' as name, row_number() over (partition by doc order by url) as n from probed join status using (url) where status is null or status >= 400)
    select doc, 'warning' as level, 'broken-link' as code, count(*) as broken, string_agg(name, ', ' order by name) filter (n <= 5) as examples from bad group by doc""",
)
def val_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    status = table(spark, sf_dir, "pages").select("url", F.when(i % 9 == 0, 404).when(i % 8 != 0, 200).alias("status"))
    return review.link_issues(_lines(spark, sf_dir).where("is_link and not malformed").select("doc", "url"), status)


@query("idx_019_companions", f"with {_VDOCS}, n as (select distinct doc, unnest(regexp_extract_all(text, 'https?://\\S*llms-full\\.txt')) as url from vdocs) select v.doc, case when count(n.url) > 0 then 'fail' else 'pass' end as outcome, count(n.url) as count from vdocs v left join n on v.doc = n.doc group by v.doc")
def idx_019(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc", F.concat("text", F.when(F.col("doc") % 3 == 1, "\nFull: https://x/llms-full.txt").otherwise("")).alias("text"))
    # Only pages were probed, so that no companion is known to resolve.
    status = table(spark, sf_dir, "pages").select("url", F.lit(200).alias("status"))
    return audit.index_findings(docs, status=status).where("rule_id = 'IDX-019'").select("doc", "outcome", "count")
