"""Queries of metrics (A1-A8, J2, J3, J7) and recon and planning (A9-A15, J5, J6, W6-W8, R13, R14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import patterns, urls
from ..functions.order import numbered
from ..operators import metrics as m
from ..operators import recon
from .inputs import select_list, sql_segments
from .registry import query, table
from .scalars import sql_class

_T = m.Thresholds(large_group=40, facet_impressions=300, facet_ctr=0.02, least_clicks=20, least_exemplar_clicks=3)

_KEYED = """rows_ as (select o_orderkey as ord, 'https://x.example/' || (o_custkey % 400) as key, 'u' || o_orderkey as url, case when o_orderkey % 5 = 0 then null else cast(trunc(o_totalprice) as bigint) % 50 end as clicks,
  case when o_orderkey % 7 = 0 then null else cast(trunc(o_totalprice) as bigint) % 900 end as impressions, o_totalprice as ctr, cast(o_orderkey % 30 as double) as position, o_orderpriority as source from orders)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, price = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        i.alias("ord"),
        F.concat(F.lit("https://x.example/"), (F.col("o_custkey") % 400).cast("string")).alias("key"),
        F.concat(F.lit("u"), i.cast("string")).alias("url"),
        F.when(i % 5 != 0, price % 50).alias("clicks"),
        F.when(i % 7 != 0, price % 900).alias("impressions"),
        F.col("o_totalprice").alias("ctr"),
        (i % 30).cast("double").alias("position"),
        F.col("o_orderpriority").alias("source"),
    )


_MERGED = """merged as (select key, case when count(*) > 1 then cast(sum(coalesce(clicks, 0)) as bigint) else cast(min(clicks) as bigint) end as clicks,
  case when count(*) > 1 then cast(sum(coalesce(impressions, 0)) as bigint) else cast(min(impressions) as bigint) end as impressions, arg_min(url, ord) as url, arg_min(ctr, ord) as ctr, arg_min(position, ord) as position, arg_min(source, ord) as source from rows_ group by key)"""


@query("a01_merge_metrics", f"with {_KEYED}, {_MERGED} select key, clicks, impressions, url, ctr, position, source from merged")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge(_keyed(spark, sf_dir))


@query(
    "j03_metrics_antijoin",
    f"""with {_KEYED}, {_MERGED}, known as (select distinct 'https://x.example/' || (c_custkey % 400) as key from customer where c_custkey % 400 < 330),
    x as (select merged.*, merged.key not in (select key from known) as orphan from merged),
    c as (select count(*) as total_rows, count(*) filter (orphan) as orphan_rows, cast(coalesce(sum(coalesce(clicks, 0)) filter (orphan), 0) as bigint) as orphan_clicks, cast(sum(coalesce(clicks, 0)) as bigint) as total_clicks from x)
    select *, total_rows - orphan_rows as joined_rows, orphan_rows / total_rows as orphan_share, orphan_clicks / total_clicks as orphan_click_share, orphan_rows / total_rows > 0.1 or orphan_clicks / total_clicks > 0.1 as looks_broken,
    (select string_agg(url, ',' order by coalesce(clicks, 0) desc, key) from (select * from x where orphan order by coalesce(clicks, 0) desc, key limit 20)) as orphan_sample from c""",
)
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 400 < 330").select(F.concat(F.lit("https://x.example/"), (F.col("c_custkey") % 400).cast("string")).alias("key"))
    return m.join_report(known, m.merge(_keyed(spark, sf_dir))).withColumn("orphan_sample", F.nullif(F.array_join("orphan_sample", ","), F.lit("")))


@query("a29_join_shares", f"with {_KEYED}, {_MERGED} select source, count(*) as total_rows, count(*) filter (coalesce(clicks, 0) > 40) as hits, case when count(*) > 0 then count(*) filter (coalesce(clicks, 0) > 40) / count(*) else 0e0 end as share from merged group by source")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = m.merge(_keyed(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.coalesce("clicks", F.lit(0)) > 40).alias("hits"))
    return x.withColumn("share", F.when(F.col("total_rows") > 0, F.col("hits") / F.col("total_rows")).otherwise(0.0))


_MEMBERS = """counts as (select o_custkey, count(*) as n from orders group by 1),
joined as (select 'g' || c_nationkey as grp, c_custkey as ord, 'https://x.example/n' || c_nationkey || '/' || c_custkey as url,
  case when c_nationkey in (3, 4) and c_custkey % 5 <> 0 then null when c_nationkey = 7 then null when c_custkey % (1 + c_nationkey * 2) = 0 then coalesce(n, 1) * (1 + c_nationkey) else 0 end as clicks,
  case when c_nationkey in (3, 4, 7) and c_custkey % 5 <> 0 then null when c_nationkey = 7 then null else coalesce(n, 0) * 40 end as impressions
  from customer left join counts on o_custkey = c_custkey),
k as (select *, clicks is not null or impressions is not null as known, coalesce(clicks, 0) as c from joined)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    nation, cust = F.col("c_nationkey"), F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    dark = F.when(nation.isin(3, 4) & (cust % 5 != 0), True).when(nation == 7, True).otherwise(False)
    clicks = F.when(~dark, F.when(cust % (1 + nation * 2) == 0, F.coalesce("n", F.lit(1)) * (1 + nation)).otherwise(0))
    return c.select(
        F.concat(F.lit("g"), nation.cast("string")).alias("group"),
        cust.alias("ord"),
        F.concat(F.lit("https://x.example/n"), nation.cast("string"), F.lit("/"), cust.cast("string")).alias("url"),
        clicks.cast("bigint").alias("clicks"),
        F.when(~dark, F.coalesce("n", F.lit(0)) * 40).alias("impressions"),
    ).withColumn("known", F.col("clicks").isNotNull() | F.col("impressions").isNotNull())


_ROLLED = f"""{_MEMBERS},
s as (select grp, count(*) as url_count, count(*) filter (known) as known_count, cast(coalesce(sum(c) filter (known), 0) as bigint) as total_clicks, cast(coalesce(sum(impressions) filter (known), 0) as bigint) as total_impressions,
  count(*) filter (known and c > 0) as urls_with_clicks, cast(coalesce(max(c) filter (known), 0) as bigint) as best_clicks, list_sort(list(c) filter (known)) as a from k group by grp),
x as (select *, len(a) as n, len(list_filter(a, lambda v: v > 0)) as earners, greatest(1, len(list_filter(a, lambda v: v > 0)) // 10) as cut, least(len(a) - 1, greatest(1, 9 * (len(a) + 1) // 10)) as j from s),
e as (select grp, string_agg(url, ',' order by rn) as exemplars, count(*) as n_exemplars from (select grp, url, c, row_number() over (partition by grp order by c desc, ord) as rn from k where known) where rn <= 5 and c >= 3 group by grp),
rolled as (select grp, url_count, known_count, total_clicks, total_impressions, urls_with_clicks, best_clicks,
  case when known_count = 0 then 0e0 else (a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2e0 end as median_clicks,
  case when known_count = 0 then 0e0 when n >= 10 then (a[j] * (10 - (9 * (n + 1) - 10 * j)) + a[j + 1] * (9 * (n + 1) - 10 * j)) / 10e0 else cast(a[-1] as double) end as p90_clicks,
  case when total_clicks > 0 and earners >= greatest(1, n // 10) then list_sum(a[n - cut + 1:n]) / total_clicks end as head_share,
  coalesce(exemplars, '') as exemplars, coalesce(n_exemplars, 0) as n_exemplars, urls_with_clicks / url_count as coverage, case when total_impressions > 0 then total_clicks / total_impressions else 0e0 end as mean_ctr,
  case when known_count / url_count >= 0.8 then 'high' when known_count / url_count >= 0.4 then 'medium' else 'low' end as confidence from x left join e using (grp))"""


@query("j02_metrics_lookup", f"with {_MEMBERS} select grp as \"group\", url, clicks, impressions, known from k")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir)
    metrics = rows.where("known").select(F.col("url").alias("key"), "clicks", "impressions")
    return m.measured(rows.select("group", "url", F.col("url").alias("key"), "ord"), metrics).select("group", "url", "clicks", "impressions", "known")


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rollup(_members(spark, sf_dir), t=_T)


_SHOW = ["group", "url_count", "known_count", "total_clicks", "total_impressions", "urls_with_clicks", "median_clicks", "p90_clicks", "head_share", "coverage", "mean_ctr", "confidence"]
_SHOW_SQL = 'grp as "group", ' + ", ".join(_SHOW[1:])


@query("a02_group_rollup", f"with {_ROLLED} select {_SHOW_SQL} from rolled")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select(*_SHOW)


@query("a03_p90_exclusive", f"with {_ROLLED} select grp as \"group\", p90_clicks from rolled")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("group", "p90_clicks")


@query("a04_head_share", f"with {_ROLLED} select grp as \"group\", head_share from rolled")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("group", "head_share")


@query("a05_exemplars", f"with {_ROLLED} select grp as \"group\", exemplars from rolled")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("group", F.array_join("exemplars", ",").alias("exemplars"))


@query("a06_confidence", f"with {_ROLLED} select grp as \"group\", confidence from rolled")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("group", "confidence")


_BASE = f"""{_ROLLED}, b as (select *, total_clicks >= 20 and best_clicks >= 3 as material from rolled),
base as (select * exclude (confidence), case when known_count = 0 then 'review' when coverage >= 0.4 then 'include_group' when head_share >= 0.7 and material then 'promote_exemplars' when head_share is null and material then 'review'
  when coverage >= 0.05 then 'review' when url_count > 40 then 'exclude' else 'review' end as verdict,
  case when known_count = 0 or (coverage < 0.4 and head_share is null and material) then 'low' else confidence end as confidence from b)"""


@query("a07_base_verdict", f"with {_BASE} select grp as \"group\", verdict, confidence from base")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.verdicts(_rolled(spark, sf_dir), _T).select("group", "verdict", "confidence")


EMBARGO, IDENTITY, VALUABLE, NOISE = ("*/n9/*",), ("*/n1?/*4",), ("g2*", "*/n8/*"), ("g0", "g1")
_FLAGS = """flags as (select grp, case when bool_or(url glob '*/n9/*') then '*/n9/*' end as embargo, coalesce(bool_or(url glob '*/n1?/*4'), false) as identity,
  case when grp glob 'g2*' then 'g2*' when bool_or(url glob '*/n8/*') then '*/n8/*' end as valuable, case when grp in ('g0', 'g1') then grp end as noise from k group by grp)"""
_OVER = f"""{_BASE}, {_FLAGS}, f as (select *, case when known_count = 0 then verdict when embargo is not null then 'exclude' when identity then case when verdict = 'exclude' then 'include_group' else verdict end
    when n_exemplars = 0 and verdict <> 'exclude' and total_impressions >= 300 and mean_ctr < 0.02 and url_count > 40 then 'exclude' when verdict = 'exclude' and confidence = 'low' then 'review' else verdict end as first from base join flags using (grp)),
final as (select *, known_count > 0 and embargo is null and ((first = 'exclude' and valuable is not null) or (first = 'include_group' and noise is not null)) as briefed from f)"""


def _flags(rows: DataFrame) -> DataFrame:
    url = F.col("url")
    hit = lambda p: F.min(patterns.first_match(url, p))
    by_name = lambda p: F.coalesce(*[F.when(F.col("group").rlike(patterns.glob_regex(x)), F.lit(x)) for x in p])
    seen = rows.groupBy("group").agg(hit(EMBARGO).alias("e"), hit(VALUABLE).alias("v"), hit(NOISE).alias("n"), F.bool_or(patterns.first_match(url, IDENTITY).isNotNull()).alias("identity"))
    return seen.select("group", F.coalesce(by_name(EMBARGO), "e").alias("embargo"), "identity", F.coalesce(by_name(VALUABLE), "v").alias("valuable"), F.coalesce(by_name(NOISE), "n").alias("noise"))


@query("j07_pattern_join", f"with {_MEMBERS}, {_FLAGS} select grp as \"group\", embargo, identity, valuable, noise from flags")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_members(spark, sf_dir))


@query("a08_overrides", f"with {_OVER} select grp as \"group\", case when briefed then case when n_exemplars > 0 then 'promote_exemplars' else 'review' end else first end as verdict, briefed or first <> verdict or (known_count > 0 and embargo is not null) as overridden, case when known_count > 0 and embargo is not null then embargo when briefed and first = 'exclude' then valuable when briefed then noise end as declared from final")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir)
    judged = m.verdicts(m.rollup(rows, t=_T), _T).join(_flags(rows), "group")
    return m.overridden(judged, _T).select("group", "verdict", "overridden", "declared")


@query("a26_verdict_histogram", f"with {_BASE} select verdict, count(*) as n from base group by verdict")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.verdicts(_rolled(spark, sf_dir), _T).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("w03_best_source", "with t as (select o_orderkey as id, 'd' || (o_custkey % 9) as domain, 'u' || (o_custkey % 300) as url, case when o_orderkey % 6 = 0 then null else o_orderkey % 11 end as clicks, o_orderpriority as source from orders) select domain, url, id, clicks, source from t qualify row_number() over (partition by domain, url order by coalesce(clicks, 0) desc, id) = 1")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, sf_dir, "orders").select(i.alias("id"), F.concat(F.lit("d"), (c % 9).cast("string")).alias("domain"), F.concat(F.lit("u"), (c % 300).cast("string")).alias("url"), F.when(i % 6 != 0, i % 11).alias("clicks"), F.col("o_orderpriority").alias("source"))
    return m.best_source(t)


@query("a16_metrics_summary", f"with {_KEYED} select source, count(*) as rows, cast(sum(clicks) as bigint) as clicks, min(ord) as first, max(ord) as last from rows_ group by source")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("clicks").alias("clicks"), F.min("ord").alias("first"), F.max("ord").alias("last"))


# -- recon ------------------------------------------------------------------

_SITE_URLS = """site_urls as (select o_orderkey as ord, 's' || (o_custkey % 3) as site, case when o_orderkey % 19 = 0 then null else 'https://m.example/' || o_orderpriority[1] || '/map_' || (o_custkey % 3) || '.xml' end as sitemap,
  'https://s' || (o_custkey % 3) || '.example' || case o_orderkey % 5 when 0 then '/blog/' || (2000 + o_orderkey % 25) || '/post-no-' || (o_orderkey % 40) when 1 then '/docs/' || (o_orderkey % 3) when 2 then '/products/cat-' || (o_custkey % 6) || '/' || (o_orderkey % 90) when 3 then '/tag/t' || (o_orderkey % 9) else '/' || case when o_orderkey % 2 = 0 then '' else 'p' || (o_orderkey % 7) || '?page=' || (o_orderkey % 3) end end as url,
  o_orderkey % 3 as listings from orders)"""


def _site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _SITE_URLS.removeprefix("site_urls as (select ").rpartition(" from orders)")[0]
    items = select_list("select " + sql.replace("\n", " ").replace("o_orderpriority[1]", "left(o_orderpriority, 1)") + " from orders")
    return table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in items])


def _steps(part: str) -> str:
    return f"""segs as (select {part}, ord, url, sitemap, listings, {sql_segments()} as s from {{src}}),
steps as (select {part}, ord, s, unnest(range(0, len(s))) as i from segs),
sib as (select {part}, array_to_string(s[1:i], '/') as prefix, count(distinct s[i + 1]) as siblings from steps group by all),
pieces as (select p.{part}, p.ord, p.i, case when sib.siblings >= 5 then coalesce({sql_class('p.s[p.i + 1]')}, '{{{{slug}}}}') else p.s[p.i + 1] end as piece from steps p join sib on sib.{part} = p.{part} and sib.prefix = array_to_string(p.s[1:p.i], '/')),
built as (select {part}, ord, '/' || string_agg(piece, '/' order by i) as template from pieces group by all),
templated as (select segs.{part}, segs.ord, segs.url, segs.listings, coalesce(template, '/') as template, len(s) as depth from segs left join built using ({part}, ord))"""


_SITE = _SITE_URLS + ", " + _steps("site").replace("{src}", "site_urls").replace("{{", "{").replace("}}", "}")


@query("a09_sibling_counts", f"with {_SITE} select site, prefix, siblings from sib")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.sibling_counts(_site_urls(spark, sf_dir), ("site",))


_COUNTED = f"""{_SITE}, counted as (select site, template, count(*) as count, cast(max(depth) as bigint) as max_depth, min(ord) as template_ord from templated group by all),
firsts as (select site, template, string_agg(url, ' ' order by ord) as examples from (select *, row_number() over (partition by site, template order by ord) as rn from templated) where rn <= 3 group by all)"""


@query("a10_path_templates", f"with {_COUNTED} select site, template, count, max_depth, examples from counted join firsts using (site, template)")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.templates(_site_urls(spark, sf_dir)).drop("template_ord").withColumn("examples", F.array_join("examples", " "))


_JUNK_RE = "|".join(recon.JUNK)
_PLAN = f"""{_COUNTED}, plan as (select site, template, template_ord, count, case when regexp_matches(template, '(?i){_JUNK_RE}') then 'exclude' when count > 200 then 'sample' else 'include' end as action,
  case when regexp_matches(template, '(?i){_JUNK_RE}') then 5 when count > 200 then 3 else least(5, greatest(1, max_depth)) end as priority from counted)"""


@query("f06_junk_templates", f"with {_PLAN} select site, template, action = 'exclude' as junk from plan")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.heuristic_plan(recon.templates(_site_urls(spark, sf_dir))).select("site", "template", (F.col("action") == "exclude").alias("junk"))


@query("r13_heuristic_plan", f"with {_PLAN} select site, template, action, cast(priority as bigint) as priority from plan")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.heuristic_plan(recon.templates(_site_urls(spark, sf_dir))).select("site", "template", "action", "priority")


_MATCH = "u.site = p.site and len(u.s) = len(list_filter(string_split(p.template, '/'), lambda x: x <> '')) and len(list_filter(range(1, len(u.s) + 1), lambda i: not (starts_with(list_filter(string_split(p.template, '/'), lambda x: x <> '')[i], '{') or list_filter(string_split(p.template, '/'), lambda x: x <> '')[i] = u.s[i]))) = 0"


@query("j06_url_template_join", f"with {_PLAN}, u as (select site, ord, {sql_segments()} as s from site_urls) select u.site, u.ord, p.template from u join plan p on {_MATCH}")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _site_urls(spark, sf_dir).select("site", "ord", "url")
    plan = recon.templates(_site_urls(spark, sf_dir)).select("site", "template")
    return recon.matches(rows, plan).select("site", "ord", "template")


@query(
    "w08_budget_select",
    f"""with {_PLAN}, u as (select site, ord, url, {sql_segments()} as s from site_urls),
    member as (select u.site, u.ord, u.url, p.template, p.action, p.priority, p.template_ord, row_number() over (partition by p.site, p.template order by u.ord) - 1 as pos, count(*) over (partition by p.site, p.template) as n from u join plan p on {_MATCH} where p.action <> 'exclude'),
    marked as (select *, case when action = 'include' then true when n <= 25 then true else pos in (select cast(floor(i * (n / 25)) as bigint) from range(25) r(i)) end as picked from member),
    spent as (select site, count(*) filter (picked) as spent from marked group by site),
    rest as (select *, row_number() over (partition by site, template order by ord) - 1 as rat, count(*) over (partition by site, template) as rn from marked where not picked),
    sizes as (select distinct site, template, priority, template_ord, rn from rest),
    room as (select site, template, greatest(0, least(rn, 1500 - spent - coalesce(sum(rn) over (partition by site order by priority, template_ord rows between unbounded preceding and 1 preceding), 0))) as take from sizes join spent using (site)),
    more as (select rest.*, 1 as extra from rest join room using (site, template) where take > 0 and (rn <= take or rat in (select cast(floor(i * (rn / take)) as bigint) from range(2000) r(i) where i < take))),
    every as (select site, url, ord, priority, template_ord, 0 as extra from marked where picked union all select site, url, ord, priority, template_ord, extra from more),
    once as (select * from every qualify row_number() over (partition by site, url order by priority, extra, template_ord, ord) = 1),
    placed as (select site, url, row_number() over (partition by site order by priority, extra, template_ord, ord) as place from once),
    home as (select distinct site, 'https://' || site || '/' as url, 0 as place from site_urls),
    alll as (select site, url, place from placed union all select site, url, place from home where not exists (select 1 from placed p where p.site = home.site and p.url = home.url))
    select site, cast(row_number() over (partition by site order by place) as integer) as place, url from alll qualify row_number() over (partition by site order by place) <= 1500""",
)
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _site_urls(spark, sf_dir).select("site", "ord", "url")
    return recon.selection(rows, recon.heuristic_plan(recon.templates(rows)), 1500)


@query("w06_even_stride", f"with {_SITE_URLS}, r as (select site, ord, row_number() over (partition by site order by ord) - 1 as pos, count(*) over (partition by site) as n from site_urls) select site, ord from r where n <= 12 or pos in (select cast(floor(i * (n / 12)) as bigint) from range(12) q(i))")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.even_sample(_site_urls(spark, sf_dir).select("site", "ord"), ("site",), F.lit(12)).where("picked").select("site", "ord")


@query("w07_first_per_sitemap", f"with {_SITE_URLS}, f as (select site, sitemap, arg_min(url, ord) as url, min(ord) as first from site_urls where sitemap is not null group by all) select site, url, first from f qualify row_number() over (partition by site order by first) <= 4")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _site_urls(spark, sf_dir).where("sitemap is not null").groupBy("site", "sitemap").agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("first"))
    return f.withColumn("n", F.row_number().over(W.Window.partitionBy("site").orderBy("first"))).where("n <= 4").select("site", "url", "first")


_GROUPED = f"{_SITE_URLS}, named as (select coalesce(sitemap, '__unsourced__') as grp, ord, url, sitemap, listings from site_urls), " + _steps("grp").replace("{src}", "named").replace("{{", "{").replace("}}", "}")
_PLANNED = f"{_GROUPED}, g as (select grp, count(*) as url_count, count(*) filter (listings > 1) as multi_listed, count(distinct template) as template_diversity from templated group by grp)"


@query("a11_planning_rollup", f"with {_PLANNED}, r as (select grp, url, ord, row_number() over (partition by grp order by ord) - 1 as pos, count(*) over (partition by grp) as n from named), p as (select grp, string_agg(url, ' ' order by ord) as sample_urls from r where n <= 5 or pos in (select cast(floor(i * (n / 5)) as bigint) from range(5) q(i)) group by grp) select grp as \"group\", url_count, multi_listed, template_diversity, sample_urls from g join p using (grp)")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.planning_rollup(_site_urls(spark, sf_dir)).withColumn("sample_urls", F.array_join("sample_urls", " "))


@query("r14_heuristic_intent", f"with {_PLANNED} select grp as \"group\", case when contains(lower(grp), 'tag') or contains(lower(grp), 'author') or contains(lower(grp), 'search') or contains(lower(grp), 'page-sitemap-') then 'utility' when url_count >= 200 and url_count / greatest(1, template_diversity) >= 100 then 'faceted' when url_count <= 20 and template_diversity <= 3 then 'hub' when template_diversity > 3 then 'editorial' else 'unknown' end as intent from g")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.heuristic_intents(recon.planning_rollup(_site_urls(spark, sf_dir))).select("group", "intent")


@query("w11_group_order", f"with {_SITE_URLS}, g as (select coalesce(sitemap, '__unsourced__') as grp, count(*) as n from site_urls group by 1) select grp as \"group\", n, cast(row_number() over (order by n desc, grp) as integer) as place from g")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _site_urls(spark, sf_dir).groupBy(F.coalesce("sitemap", F.lit(recon.UNSOURCED)).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(g, [F.desc("n"), F.col("group")], "place").withColumn("place", (F.col("place") + 1).cast("int"))


@query("a12_sitemap_groups", f"with {_SITE_URLS} select string_split(sitemap, '/')[-1] as label, sitemap, count(*) as n from site_urls where sitemap is not null group by all")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_urls(spark, sf_dir).where("sitemap is not null").groupBy(urls.sitemap_label(F.col("sitemap")).alias("label"), "sitemap").agg(F.count(F.lit(1)).alias("n"))


@query("a13_membership_count", f"with {_SITE_URLS} select url, count(*) as listings from site_urls where sitemap is not null group by url")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_urls(spark, sf_dir).where("sitemap is not null").groupBy("url").agg(F.count(F.lit(1)).alias("listings"))


_STEM = r"regexp_replace(string_split(sitemap, '/')[-1], '\.[^.]*$', '')"


@query("a14_most_specific_sitemap", f"with {_SITE_URLS} select url, sitemap from (select distinct url, sitemap from site_urls where sitemap is not null) qualify row_number() over (partition by url order by case when regexp_matches({_STEM}, '^\\d+$') then 0 else 1 end desc, len({sql_segments('sitemap')}) + length({_STEM}) desc, sitemap desc) = 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.most_specific(_site_urls(spark, sf_dir).where("sitemap is not null"))


@query("j05_drift", "with t as (select o_orderpriority || (o_custkey % 40) as grp, case o_custkey % 40 when 7 then 0 when 9 then 1 else o_orderkey % 4 end as half from orders), w as (select grp, count(*) filter (half = 0) as was, count(*) filter (half > 0) as now from t group by grp), x as (select grp, nullif(was, 0) as was, nullif(now, 0) as now from w) select grp as \"group\", was, now, case when was is null then 'added' when now is null then 'removed' else 'resized' end as change from x where was is null or now is null or (greatest(was, now) >= 50 and greatest(was, now) / least(was, now) >= 2)")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey") % 40
    half = F.when(c == 7, 0).when(c == 9, 1).otherwise(F.col("o_orderkey") % 4)
    t = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", c.cast("string")).alias("group"), half.alias("half"))
    count = lambda x: x.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return recon.drift(count(t.where("half = 0")), count(t.where("half > 0")))


@query("j09_plan_defaults", f"with {_PLAN} select site, template, case when count % 2 = 0 then 'include' else action end as action from plan")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = recon.heuristic_plan(recon.templates(_site_urls(spark, sf_dir)))
    ruled = plan.where("count % 2 = 0").select("site", "template", F.lit("include").alias("action"))
    rest = plan.select("site", "template", "action").join(ruled.select("site", "template"), ["site", "template"], "left_anti")
    return ruled.unionByName(rest)


@query("a02_large_rollup", "with m as (select p_brand as grp, l_partkey as url, count(*) as clicks, sum(l_quantity) as impressions from lineitem join part on p_partkey = l_partkey group by all) select grp as \"group\", count(*) as url_count, cast(sum(clicks) as bigint) as total_clicks, cast(sum(impressions) as bigint) as total_impressions from m group by grp")
def a02_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("clicks"), F.sum("l_quantity").cast("bigint").alias("impressions"))
    joined = sold.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("group")), "p_partkey")
    rows = joined.select("group", F.col("p_partkey").cast("string").alias("url"), F.col("p_partkey").alias("ord"), "clicks", "impressions", F.lit(True).alias("known"))
    return m.rollup(rows).select("group", "url_count", "total_clicks", "total_impressions")
