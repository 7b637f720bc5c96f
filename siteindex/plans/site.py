"""Queries of probes and components (R, J12, J13, K9-K17), embargo (F7-F13), costs, logs, queues, edits and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import streaming
from ..functions import patterns, ranking
from ..functions.order import numbered_within
from ..lineage import shared_folder
from ..operators import agents, edits, embargo, fingerprints, handover, markup, review, site
from ..operators import operations as ops
from ..sources import store, versions
from .inputs import select_list, sql_path
from .registry import query, table


def _one(rows: DataFrame, sql: str) -> DataFrame:
    """Select list of ``sql`` (one plain select, written for both engines) over ``rows``."""
    return rows.selectExpr(*[x.strip() for x in select_list(" ".join(sql.split()))])


# -- embargo and guards -----------------------------------------------------

EMBARGO = ("*/fr/*", "*.html", "*/es/[1-4]*")
_HIT = f"coalesce({', '.join(f'case when url glob {chr(39)}{g}{chr(39)} or {sql_path()} glob {chr(39)}{g}{chr(39)} then {chr(39)}{g}{chr(39)} end' for g in EMBARGO)})"


@query("f07_embargo_split", f"select {_HIT} as pattern, count(*) as n from pages group by 1")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = patterns.first_match(F.col("url"), EMBARGO)
    return table(spark, sf_dir, "pages").groupBy(hit.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


_INDEX = "select page_id // 50 as doc, string_agg('- [p](' || url || ')' || case when page_id % 4 = 0 then ' see https://x.example/fr/1' else '' end, chr(10) order by page_id) as text from pages group by 1"


@query(
    "f08_embargo_purge",
    rf"""with d as ({_INDEX}), l as (select doc, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as raw from d),
    u as (select doc, line, raw, len(list_filter(regexp_extract_all(raw, 'https?://[^\s<>")\]]+'), lambda x: x glob '*/fr/*' or x glob '*.html' or x glob '*/es/[1-4]*')) > 0 as gone from l)
    select doc, coalesce(string_agg(raw, chr(10) order by line) filter (not gone), '') as text, count(*) filter (gone) as removed, case when bool_or(gone) then '' else 'kept' end as full_text from u group by doc""",
)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    line = F.concat(F.lit("- [p]("), "url", F.lit(")"), F.when(i % 4 == 0, " see https://x.example/fr/1").otherwise(""))
    d = table(spark, sf_dir, "pages").groupBy(F.floor(i / 50).alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), line.alias("l")))), lambda x: x["l"]).alias("lines"))
    rows = d.select("doc", F.posexplode("lines").alias("line", "raw"))
    urls_ = rows.select("doc", "line", F.explode(F.regexp_extract_all("raw", F.lit(r'(https?://[^\s<>")\]]+)'), F.lit(1))).alias("url"))
    gone = urls_.where(patterns.first_match(F.col("url"), EMBARGO).isNotNull()).select("doc", "line", F.lit(True).alias("gone")).distinct()
    marked = rows.join(gone, ["doc", "line"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("line", "raw"))))
    return marked.groupBy("doc").agg(
        F.array_join(F.transform(kept, lambda x: x["raw"]), "\n").alias("text"),
        F.count_if("gone").alias("removed"),
        F.when(F.bool_or("gone"), "").otherwise("kept").alias("full_text"),
    )


_HELD = f"""d as (select page_id // 50 as run, string_agg('- [p](' || url || ')' || case when page_id % 4 = 0 then ' see https://x.example/fr/1' else '' end, chr(10) order by page_id) as text, string_agg(url, ' and ' order by page_id) filter (page_id % 3 = 0) as body from pages group by 1),
revs as (select run, k as revision, text, case when k = 1 then '' else body end as body from d, (select unnest([1, 2]) as k)),
gone as (select url glob '*/fr/*' or url glob '*.html' or url glob '*/es/[1-4]*' as hit from pages)"""
_HITS = "len(list_filter(regexp_extract_all({0}, 'https?://[^\\s<>\")\\]]+'), lambda x: x glob '*/fr/*' or x glob '*.html' or x glob '*/es/[1-4]*')) > 0"
_LINES_GONE = f"len(list_filter(string_split(text, chr(10)), lambda l: {_HITS.format('l')}))"


@query(
    "f08_purge_of_all_tables",
    f"""with {_HELD}, r as (select 'runs' as "table", {_LINES_GONE} as n, {_HITS.format("coalesce(body, '')")} as f from d union all select 'revisions', {_LINES_GONE}, {_HITS.format("coalesce(body, '')")} from revs)
    select 'pages' as "table", count(*) filter (hit) as rows, 0 as index_lines, 0 as full_texts, count(*) filter (not hit) as left_ from gone union all select 'metrics', count(*) filter (hit), 0, 0, count(*) filter (not hit) from gone
    union all select "table", count(*) filter (n > 0 or f), sum(n), count(*) filter (f), count(*) from r group by 1""",
)
def f08_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, metrics, runs and revisions are committed, purged in one change, and read back."""
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    line = F.concat(F.lit("- [p]("), "url", F.lit(")"), F.when(i % 4 == 0, " see https://x.example/fr/1").otherwise(""))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c[1], F.struct("page_id", c[0].alias("x"))))), lambda e: e["x"])
    runs = p.groupBy(F.floor(i / 50).alias("run")).agg(F.array_join(ordered((line, F.lit(True))), "\n").alias("index_text"), F.array_join(ordered((F.col("url"), i % 3 == 0)), " and ").alias("full_text"))
    revisions = runs.select("run", F.explode(F.array(F.lit(1), F.lit(2))).alias("revision"), "index_text", "full_text").withColumn("full_text", F.when(F.col("revision") == 1, "").otherwise(F.col("full_text")))
    root = f"{shared_folder(spark)}/siteindex/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    versions.commit(spark, root, {"pages": p, "metrics": p.select("url", (i % 7).alias("clicks")), "runs": runs, "revisions": revisions}, 0)
    before = versions.tables(spark, root)
    versions.change(spark, root, lambda held: embargo.purged(held, EMBARGO))
    left = None
    for name, rows in versions.tables(spark, root).items():
        n = rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("left_"))
        left = n if left is None else left.unionByName(n)
    return embargo.purge_report(before, EMBARGO).join(left, "table")


@query("f09_matching_patterns", "select p as pattern from (select unnest(['*/fr/*', '*/zz/*', '*.html', '/en/*']) as p) where exists (select 1 from pages where url glob p)")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("*/fr/*", "*/zz/*", "*.html", "/en/*")
    hits = [F.when(F.max(F.col("url").rlike(patterns.glob_regex(n)).cast("int")) == 1, F.lit(n)).alias(f"h{i}") for i, n in enumerate(names)]
    one = table(spark, sf_dir, "pages").agg(*hits)
    return one.select(F.explode(F.array_compact(F.array(*[F.col(f"h{i}") for i in range(len(names))]))).alias("pattern"))


@query("f10_known_keys", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 3 = 0) and o_orderstatus in ('F', 'O')")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).join(known, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


_COMPONENTS = "components as (select * from (values " + ", ".join(f"({i}, '{k}', '{f}', '{p}', {la}, '{e}', '{a[0]}', '{a[1]}', '{a[2]}', '{art}', {str(t).lower()})" for i, (k, f, p, la, e, a, art, t) in enumerate(site.COMPONENTS)) + ") t(pos, key, family, priority, layer, effort, content, app_api, ecommerce, artifact, templated))"


@query("f11_applicable_components", f"with {_COMPONENTS} select n_nationkey as site, key, family from nation cross join components where [content, app_api, ecommerce][1 + n_nationkey % 3] <> 'N'")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that apply to each site's type; the fixed table is 26 rows."""
    types = F.array(*[F.lit(t) for t in site.SITE_TYPES])
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"), F.get(types, F.col("n_nationkey") % 3).alias("site_type"))
    applies = F.coalesce(*[F.when(F.col("site_type") == t, F.col(t)) for t in site.SITE_TYPES])
    return sites.join(F.broadcast(site.component_table(spark)), F.lit(True)).where(applies != "N").select("site", "key", "family")


@query("f12_freshness", "select o_orderkey, date_diff('day', cast(o_orderdate as date), date '1998-08-01') < 30 as fresh from orders")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.lit("1998-08-01").cast("date"), F.to_date("o_orderdate")) < 30).alias("fresh"))


@query("f13_recent_window", "select event_id from events where ts >= timestamp '2024-01-31 00:00:00' - interval 7 day")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = min(365, max(1, 7))
    since = F.lit("2024-01-31 00:00:00").cast(table(spark, sf_dir, "events").schema["ts"].dataType) - F.expr(f"interval {days} days")
    return table(spark, sf_dir, "events").where(F.col("ts") >= since).select("event_id")


# -- joins and sets ---------------------------------------------------------


@query("j04_pages_of_domain", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(runs, "l_orderkey")


_MODEL = "case event_id % 6 when 0 then 'gpt-4o-2024-11-20' when 1 then 'gpt-4o-mini' when 2 then 'o3' when 3 then 'mystery-1' when 4 then 'gpt-4.1-nano-x' else 'o4-mini' end"
_RATES = "rates as (select * from (values " + ", ".join(f"('{k}', {a}e0, {b}e0)" for k, (a, b) in ops.RATES.items()) + ") t(name, pin, pout))"
_RATED = f"{_RATES}, m as (select event_id, {_MODEL} as model from events), names as (select distinct model from m), best as (select model, pin, pout from names left join rates on starts_with(model, name) qualify row_number() over (partition by model order by length(name) desc nulls last) = 1)"


@query("p22_rate_for", f"with {_RATED} select event_id, pin as prompt_rate, pout as completion_rate from m join best using (model)")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("event_id", ops.rate_for(F.expr(_MODEL)).alias("r"))
    return m.select("event_id", F.col("r.prompt").alias("prompt_rate"), F.col("r.completion").alias("completion_rate"))


@query("j08_longest_prefix", f"with {_RATED} select model, count(*) as n, any_value(pin) as prompt_rate from m join best using (model) group by model")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.expr(_MODEL).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return m.select("model", "n", ops.rate_for(F.col("model"))["prompt"].alias("prompt_rate"))


@query("j10_update_join", "with n as (select p_partkey as k, case when p_partkey % 3 = 0 then '' else upper(p_name) end as title, p_partkey % 4 as sec from part where p_partkey % 2 = 0) select p_partkey, coalesce(nullif(title, ''), p_name) as title, coalesce(sec, 0) * 1000 + p_partkey % 7 as position from part left join n on k = p_partkey")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    new = p.where(k % 2 == 0).select("p_partkey", F.when(k % 3 == 0, "").otherwise(F.upper("p_name")).alias("title"), (k % 4).alias("sec"))
    return p.join(new, "p_partkey", "left").select("p_partkey", F.coalesce(F.nullif("title", F.lit("")), "p_name").alias("title"), (F.coalesce("sec", F.lit(0)) * 1000 + k % 7).alias("position"))


@query("u01_rules_union", "select n_name as rule, 'plan' as source from nation where n_regionkey = 1 union all select n_name, 'heuristic' from nation where n_regionkey <> 1")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    plan = n.where("n_regionkey = 1").select(F.col("n_name").alias("rule"), F.lit("plan").alias("source"))
    rest = n.select(F.col("n_name").alias("rule")).join(n.where("n_regionkey = 1").select(F.col("n_name").alias("rule")), "rule", "left_anti")
    return plan.unionByName(rest.withColumn("source", F.lit("heuristic")))


@query("u02_group_difference", "select k, case when count(*) filter (a) > 0 and count(*) filter (not a) > 0 then 'both' when count(*) filter (a) > 0 then 'only_a' else 'only_b' end as side from (select o_custkey as k, o_orderkey % 2 = 0 as a from orders) group by k")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2 == 0).alias("a"), F.col("o_custkey").alias("k"))
    a, b = o.where("a").select("k"), o.where("not a").select("k")
    named = lambda rows, side: rows.withColumn("side", F.lit(side))
    return named(a.subtract(b), "only_a").unionByName(named(b.subtract(a), "only_b")).unionByName(named(a.intersect(b), "both"))


@query("u03_ordered_distinct", "select o_custkey % 100 as k, arg_min(o_orderpriority, o_orderkey) as first from orders group by 1")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), "o_orderkey", "o_orderpriority")
    return o.groupBy("k").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first"))


@query("u04_unpriced_models", f"with {_RATED} select string_agg(distinct model, ',' order by model) as models from m join best using (model) where pin is null")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.expr(_MODEL).alias("model")).where(ops.rate_for(F.col("model")).isNull())
    return m.agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query("u05_new_error_codes", "with c as (select user_id, event_type, event_id % 2 as half from events) select distinct user_id, event_type from c where half = 1 and (user_id, event_type) not in (select (user_id, event_type) from c where half = 0)")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("was"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("now"))
    return c.select("user_id", F.explode(F.array_except("now", "was")).alias("event_type"))


@query("u06_concat_issues", "select doc_id as id, 'short' as issue from documents where n_chars < 200 union all select doc_id, 'foreign' from documents where lang <> 'en'")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return d.where("n_chars < 200").select("id", F.lit("short").alias("issue")).unionByName(d.where("lang <> 'en'").select("id", F.lit("foreign").alias("issue")))


# -- costs, logs, queues, edits ---------------------------------------------

_USAGE = f"usage as (select user_id % 40 as run, {_MODEL} as model, cast(sum(event_id % 900) as bigint) as prompt, cast(sum(event_id % 70) as bigint) as completion from events group by all)"
_COSTS = f"""{_RATED}, {_USAGE}, costs as (select run, cast(sum(prompt) as bigint) as prompt, cast(sum(completion) as bigint) as completion, coalesce(sum(prompt / 1e6 * pin + completion / 1e6 * pout), 0e0) as llm_usd,
  cast(coalesce(sum(prompt + completion) filter (pin is null), 0) as bigint) as unpriced_tokens, coalesce(string_agg(model, ',' order by model) filter (pin is null), '') as unpriced, (run % 9) * 0.0025e0 as serp_usd from usage join best using (model) group by run)"""


def _usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 40)
    usage = e.groupBy("run", F.expr(_MODEL).alias("model")).agg(F.sum(F.col("event_id") % 900).alias("prompt"), F.sum(F.col("event_id") % 70).alias("completion"))
    return usage, usage.select("run", (F.col("run") % 9).alias("serp_calls")).distinct()


@query("a17_run_cost", f"with {_COSTS} select run, prompt, completion, round(llm_usd, 9) as llm_usd, serp_usd, unpriced_tokens, unpriced from costs")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ops.run_costs(*_usage(spark, sf_dir))
    return c.select("run", "prompt", "completion", F.round("llm_usd", 9).alias("llm_usd"), "serp_usd", "unpriced_tokens", F.array_join("unpriced_models", ",").alias("unpriced"))


@query("a18_cost_totals", f"with {_COSTS} select count(*) as runs, count(*) filter (unpriced = '') as priced_runs, round(sum(llm_usd + serp_usd), 6) as total_usd, round(sum(llm_usd + serp_usd) / nullif(count(*) filter (unpriced = ''), 0), 6) as usd_per_run, (select string_agg(distinct model, ',' order by model) from usage join best using (model) where pin is null) as unpriced_models from costs")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ops.cost_totals(ops.run_costs(*_usage(spark, sf_dir)))
    return t.withColumn("total_usd", F.round("total_usd", 6)).withColumn("usd_per_run", F.round("usd_per_run", 6))


@query("a19_cost_by_day", f"with {_RATED}, e as (select cast(ts as date) as day, event_id, {_MODEL} as model from events) select day, count(*) as calls, round(sum((event_id % 900) / 1e6 * coalesce(pin, 0e0)), 9) as usd from e join best using (model) group by day")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", ops.rate_for(F.expr(_MODEL)).alias("r"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum((F.col("event_id") % 900) / 1e6 * F.coalesce("r.prompt", F.lit(0.0))), 9).alias("usd"))


@query("a19_cost_by_model", f"with {_RATED} select model, count(*) as calls, case when any_value(pin) is null then -1e0 else round(sum((event_id % 900) / 1e6 * pin), 9) end as usd from m join best using (model) group by model")
def a19_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr(_MODEL).alias("model"), "event_id")
    rate = ops.rate_for(F.col("model"))["prompt"]
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("event_id") % 900) / 1e6).alias("t")).select("model", "calls", F.coalesce(F.round(F.col("t") * rate, 9), F.lit(-1.0)).alias("usd"))


@query("a28_usage_meter", f"with m as (select event_type as stage, {_MODEL} as model, event_id from events) select stage, count(*) as calls, cast(sum(event_id % 900) as bigint) as prompt, count(distinct model) as models from m group by stage")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.expr(_MODEL).alias("model"), "event_id")
    return m.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("event_id") % 900).alias("prompt"), F.countDistinct("model").alias("models"))


@query("w04_latest_log", "select * from (select event_id, ts, event_type from events order by ts desc, event_id desc limit 25) order by ts, event_id")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.latest_of_log(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"))


@query("w05_latest_run", "select o_custkey, o_orderkey from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w10_batches", "select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 40 as batch from documents")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = numbered_within(table(spark, sf_dir, "documents").select("source", "doc_id"), ("source",), [F.col("doc_id")], "n")
    return ranked.select("source", "doc_id", F.floor(F.col("n") / 40).alias("batch"))


_JOBS = "select o_orderkey as id, case when o_custkey % 10 = 0 then null else 'l' || (o_custkey % 400) end as lock, cast(o_shippriority_ as integer) as priority, case o_orderkey % 7 when 0 then 'doing' when 1 then 'done' else 'todo' end as status from (select *, o_custkey % 3 as o_shippriority_ from orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(i % 7 == 0, "doing").when(i % 7 == 1, "done").otherwise("todo")
    return table(spark, sf_dir, "orders").select(i.alias("id"), F.when(c % 10 != 0, F.concat(F.lit("l"), (c % 400).cast("string"))).alias("lock"), (c % 3).cast("int").alias("priority"), status.alias("status"))


_ELIGIBLE = f"jobs as ({_JOBS}), eligible as (select * from jobs j where status = 'todo' and not exists (select 1 from jobs o where j.lock is not null and o.lock = j.lock and (o.status = 'doing' or (o.status = 'todo' and (o.priority > j.priority or (o.priority = j.priority and o.id < j.id))))))"


@query("j14_eligible_jobs", f"with {_ELIGIBLE} select id, lock, priority from eligible")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.eligible_jobs(_jobs(spark, sf_dir)).select("id", "lock", "priority")


@query("t02_next_job", f"with {_ELIGIBLE} select id, priority from eligible order by priority desc, id limit 1")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.next_job(_jobs(spark, sf_dir)).select("id", "priority")


@query("t03_stalled_workers", "select user_id, max(ts) as heartbeat from events group by user_id having max(ts) < timestamp '2024-01-30 12:00:00'")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"))
    return h.where(F.col("heartbeat") < F.lit("2024-01-30 12:00:00").cast(h.schema["heartbeat"].dataType))


@query("t01_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event-time windows, here in batch; streaming/ runs the same over files that arrive."""
    return streaming.windowed_counts(table(spark, sf_dir, "events"))


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as edit logs: a turn is an operation on pages and sections that earlier turns name."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "text")
    n = F.col("seq")
    url = F.concat(F.lit("https://x.example/"), (n % 4).cast("string"))
    section = lambda k: F.concat(F.lit("S"), (k % 3).cast("string"))
    first = c.groupBy("doc", url.alias("url")).agg(F.min("seq").alias("ord"), F.min_by("text", "seq").alias("title"))
    described = F.when(F.col("ord") % 3 == 0, "").otherwise("About this page.")
    pages = first.select("doc", "url", "ord", "title", described.alias("description"), section(F.col("ord")).alias("section"), F.lit(False).alias("optional"), F.lit(True).alias("included"))
    sites = c.select("doc").distinct().select("doc", F.lit("Site").alias("site_name"), F.lit("").alias("site_summary"), F.lit("").alias("notes"))
    kinds = F.array(*[F.lit(x) for x in (*edits.HANDLERS, "delete_everything")])
    log = c.select(
        "doc",
        "seq",
        F.get(kinds, F.pmod(F.xxhash64("doc", "seq"), F.lit(len(edits.HANDLERS) + 1)).cast("int")).alias("op"),
        F.when(n % 7 == 6, F.concat(url, F.lit("/"))).otherwise(url).alias("url"),
        F.when(n % 5 != 4, section(n + 1)).otherwise("").alias("section"),
        F.when(n % 6 == 5, F.concat(F.lit("# "), "text")).otherwise(F.concat(F.lit("S"), (n % 4).cast("string"))).alias("text"),
        F.when(n % 2 == 0, F.concat(F.lit("Title "), n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, "text").otherwise("").alias("description"),
        (n % 2 == 1).alias("flag"),
        F.array(section(n), section(n + 1)).alias("sections"),
    )
    return pages, sites, log


@query("t05_edit_fold")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page after its document's ten kinds of edits."""
    out = edits.edited(*_edits(spark, sf_dir)).where("kind = 'page'")
    return out.select("doc", "url", "title", "description", "section", "optional", "included")


@query("t05_edit_report")
def t05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation, and why it was refused."""
    return edits.edited(*_edits(spark, sf_dir)).where("kind = 'operation'").select("doc", "seq", "op", "url", "reason")


_CODES = "e as (select user_id as run, event_id % 2 = 1 as after, event_type || '-' || event_id % 3 as code from events)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), (F.col("event_id") % 2 == 1).alias("after"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("code"))


@query(
    "t06_edit_gate",
    f"with {_CODES}, n as (select run, code from e where after except select run, code from e where not after), b as (select run, string_agg(code, ', ' order by code) as broke from n group by run) select run, broke is not null as rolled_back, coalesce(broke, '') as broke from (select distinct run from e) left join b using (run)",
)
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _codes(spark, sf_dir)
    return review.edit_gate(e.where("not after"), e.where("after"))


@query(
    "t06_gated_rows",
    f"with {_CODES}, n as (select run, code from e where after except select run, code from e where not after) select run, code from e where after = (run not in (select run from n))",
)
def t06_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _codes(spark, sf_dir)
    before, after = e.where("not after").select("run", "code"), e.where("after").select("run", "code")
    return review.gated(before, after, review.edit_gate(before, after))


_STAGES = "st as (select l_orderkey as run, l_linenumber as seq, cast(l_linenumber * 10 as bigint) as started from lineitem), ca as (select o_orderkey as run, cast(o_orderkey % 60 as bigint) as asked from orders where o_orderstatus = 'F')"


@query(
    "t04_run_stages",
    f"with {_STAGES}, r as (select st.run, seq, coalesce(started >= asked, false) as stops from st left join ca using (run)), s as (select *, bool_or(stops) over (partition by run order by seq) as stopped from r) select run, count_if(not stopped) as done, case when bool_or(stopped) then 'cancelled' else 'done' end as status from s group by run",
)
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") * 10).cast("bigint").alias("started"))
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 60).alias("at"))
    return review.run_stages(stages, asked)


# -- probes and components --------------------------------------------------

_RESP = """select o_orderkey as id, 's' || (o_custkey % 30) as site, case o_orderkey % 8 when 0 then null when 1 then 404 when 2 then 500 else 200 end as status,
  case o_orderkey % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'application/json' when 2 then '' else 'text/plain' end as content_type from orders"""
_KIND = "lower(trim(split_part(content_type, ';', 1)))"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(table(spark, sf_dir, "orders"), _RESP.replace("'s' || (o_custkey % 30)", "concat('s', o_custkey % 30)"))


@query("r01_surface_state", f"with r as ({_RESP}) select id, case when status is null then 'unreachable' when status >= 400 then 'absent' when contains({_KIND}, 'html') then 'soft_404' when {_KIND} <> '' and {_KIND} not in ('text/plain', 'text/markdown') then 'wrong_type' else 'present' end as state from r")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(F.lit("text/plain"), F.lit("text/markdown"))
    return _responses(spark, sf_dir).select("id", site.surface_state(F.col("status"), F.col("content_type"), expected).alias("state"))


@query("r09_check_state", f"with r as ({_RESP}) select id, case when status is null then 'unreachable' when status >= 400 or contains({_KIND}, 'html') or ({_KIND} <> '' and not contains({_KIND}, 'json')) then 'fail' else 'pass' end as state from r")
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("id", site.check_state(F.col("status"), F.col("content_type"), F.array(F.lit("json"))).alias("state"))


@query("r11_declared_endpoints", f"with r as ({_RESP}) select site, count(*) filter (status < 400 and not contains({_KIND}, 'html') and ({_KIND} = '' or contains({_KIND}, 'json'))) as verified, count(*) as declared from r group by site")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site.check_state(F.col("status"), F.col("content_type"), F.array(F.lit("json")))
    return _responses(spark, sf_dir).groupBy("site").agg(F.count_if(s == "pass").alias("verified"), F.count(F.lit(1)).alias("declared"))


@query("r02_commerce_profile", "select s_suppkey, 'dev.svc' || x as name, '2026-0' || x as version, 'https://e/' || s_suppkey || '/' || x as endpoint from (select s_suppkey, unnest(range(1, 4)) as x from supplier) where x <> 3")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    bind = lambda x: F.array(F.struct(F.lit(f"2026-0{x}").alias("version"), (F.concat(F.lit("https://e/"), k, F.lit(f"/{x}")) if x != 3 else F.lit("")).alias("endpoint")))
    body = F.to_json(F.struct(F.struct(F.create_map(*[y for x in (1, 2, 3) for y in (F.lit(f"dev.svc{x}"), bind(x))]).alias("services")).alias("ucp")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(site.profile_services(body)).alias("s"))
    return rows.select("s_suppkey", "s.name", "s.version", "s.endpoint")


_PLATFORM = "case when s_suppkey % 11 = 0 then 'shopify' else case s_suppkey % 6 when 0 then 'shopify' when 1 then 'nextjs' when 2 then case when s_suppkey % 4 = 0 then 'woocommerce' else 'wordpress' end when 3 then 'drupal' else 'unknown' end end"


def _headers() -> tuple:
    k = F.col("s_suppkey")
    server = F.when(k % 6 == 0, "Shopify").otherwise("nginx")
    powered = F.when(k % 6 == 1, "Next.js").when(k % 6 == 2, "WordPress").otherwise("php")
    headers = F.create_map(F.lit("Server"), server, F.lit("X-Powered-By"), powered)
    generator = F.when(k % 6 == 3, "Drupal 10").when(k % 4 == 0, "WooCommerce 9").otherwise("")
    generator = F.when((k % 6).isin(2, 3) | (k % 4 != 0), generator).otherwise("")
    return headers, generator, F.when(k % 11 == 0, F.array(F.lit("https://a.myshopify.com/x"))).otherwise(F.array().cast("array<string>"))


@query("r06_platform_precedence", f"select s_suppkey, {_PLATFORM} as platform from supplier")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", site.platform(*_headers()).alias("platform"))


@query("r03_platform_evidence", "select s_suppkey, s_suppkey % 11 = 0 as by_endpoint from supplier")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, endpoints = _headers()
    none = F.create_map(F.lit("a"), F.lit("b"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", (site.platform(none, F.lit(""), endpoints) == "shopify").alias("by_endpoint"))


@query("r04_platform_headers", "select s_suppkey, case s_suppkey % 6 when 0 then 'shopify' when 1 then 'nextjs' when 2 then 'wordpress' else 'unknown' end as platform from supplier")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, _, _ = _headers()
    return table(spark, sf_dir, "supplier").select("s_suppkey", site.platform(headers, F.lit(""), F.array().cast("array<string>")).alias("platform"))


#: A small dataset in the shards' format.
_TECHNOLOGIES = {
    "Shopify": r'{"cats":[6],"headers":{"X-ShopId":""},"cookies":{"_shopify_s":""},"scriptSrc":"cdn\\.shop\\.example"}',
    "WordPress": r'{"cats":[1,11],"meta":{"generator":"^WordPress(?: ([\\d.]+))?\\;version:\\1"}}',
    "Nginx": r'{"cats":[22],"headers":{"Server":"nginx(?:/([\\d.]+))?\\;version:\\1"}}',
    "Blogs": r'{"cats":[1],"url":["/blog/","\\.html$"]}',
}


def _page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    headers = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("server").alias("k"), F.when(i % 3 == 0, "nginx/1.25").when(i % 3 == 1, "Apache").alias("v")),
                F.struct(F.lit("x-shopid").alias("k"), F.when(i % 4 == 0, "17").alias("v")),
                F.struct(F.lit("set-cookie").alias("k"), F.when(i % 5 == 0, "a=1; path=/, _Shopify_S=x; secure").otherwise("b=_shopify_s").alias("v")),
            ),
            lambda x: x["v"].isNotNull(),
        )
    )
    head = F.concat(F.when(i % 6 == 0, '<meta name="Generator" content="WordPress 6.5">').when(i % 6 == 1, "<meta name='generator' content='Not WordPress'>").otherwise(""), F.when(i % 7 == 0, '<script async src="https://CDN.shop.example/x.js"></script>').otherwise(""))
    return table(spark, sf_dir, "pages").select(i.alias("id"), "url", headers.alias("headers"), F.concat(head, "html").alias("html"))


_SIGNS = """g as (select page_id as id, 'Shopify' as name, case when page_id % 4 = 0 then 'header' when page_id % 5 = 0 then 'cookie' when page_id % 7 = 0 then 'script' end as surface from pages
  union all select page_id, 'WordPress', case when page_id % 6 = 0 then 'meta' end from pages union all select page_id, 'Nginx', case when page_id % 3 = 0 then 'header' end from pages
  union all select page_id, 'Blogs', case when regexp_matches(url, '(?i)/blog/|\\.html$') then 'url' end from pages)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(_TECHNOLOGIES.items()), "name string, spec string")
    return fingerprints.detect(_page_responses(spark, sf_dir), fingerprints.pattern_table(rows))


@query("r05_fingerprints", f"with {_SIGNS} select id, name, surface from g where surface is not null".replace("\\\\.", "\\."))
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("id", "name", "surface")


@query("r05_summary", f"with {_SIGNS} select id, coalesce(string_agg(name, ', ' order by name) filter (name = 'Shopify'), '') as ecommerce, coalesce(string_agg(name, ', ' order by name) filter (name in ('WordPress', 'Blogs')), '') as cms, coalesce(string_agg(name, ', ' order by name) filter (name = 'Nginx'), '') as other from g where surface is not null group by id".replace("\\\\.", "\\."))
def r05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.summary(_detected(spark, sf_dir))
    return found.select("id", *[F.array_join(c, ", ").alias(c) for c in ("ecommerce", "cms", "other")])


@query("s17_fingerprint_dataset", "with d as (select p_partkey, 'tech' || p_partkey as name, '{\"cats\":[' || p_size || ']}' as spec, p_partkey % 4 as k from part) select name, spec, 'fresh' as copy from d where k <> 1 union all select name, spec, 'stale' from d where k = 1")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards whose copies have outlived their time count only for technologies that no fresh shard has."""
    spec = F.concat(F.lit('{"cats":['), F.col("p_size").cast("string"), F.lit("]}"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("tech"), F.col("p_partkey").cast("string")).alias("name"), spec.alias("spec"), (F.col("p_partkey") % 4).alias("k"))
    aged = rows.withColumn("old", fingerprints.expired(F.when(F.col("k") == 1, F.lit("2026-01-01")).otherwise(F.lit("2026-01-30")).cast("timestamp"), F.lit("2026-02-01").cast("timestamp")))
    fresh, stale = aged.where("not old").select("name", "spec"), aged.select("name", "spec")
    copy = F.when(F.substr("name", F.lit(5)).cast("long") % 4 == 1, "stale").otherwise("fresh")
    return fingerprints.with_fallback(fresh, stale).select("name", "spec", copy.alias("copy"))


@query("r07_endpoint_labels", f"with r as ({_RESP}) select site, content_type as label, min(id) as first from r where status = 200 group by all")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).where("status = 200").groupBy("site", F.col("content_type").alias("label")).agg(F.min("id").alias("first"))


# Pages with forms, roles and ids beside their own markup, by their number.
_TAILS = (
    ("page_id % 4", ('<input type="text" id="a"><label for="a">x</label>', '<input type="hidden"><div tabindex="0">y</div>', '<input id="q"><p id="q"></p>', '<div role="button" onclick="z()"></div>')),
    ("page_id % 5", ('<ul role="directory"></ul>', '<span role="Widget dialogbox" tabindex="0"></span>', '<nav2 role="doc-toc">', '<input type=submit><i id="z" aria-controls="q z"></i><i id="z"></i>', '<INPUT aria-label="x" type=text>')),
)


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.expr("page_id % 3 = 0"), F.replace("html", F.lit("<nav>"), F.lit('<div role="navigation">'))).when(F.expr("page_id % 3 = 1"), F.replace("html", F.lit("<nav>"), F.lit("<div>"))).otherwise(F.col("html"))
    tails = [F.get(F.array(*[F.lit(x) for x in options]), F.expr(f"cast({k} as int)")) for k, options in _TAILS]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(html, *tails).alias("html"))


@query(
    "r08_html_checks",
    """with n as (select page_id, page_id % 3 as a, page_id % 4 as b, page_id % 5 as c, list_sum([cast(contains(lower(html), t) as int) for t in ['<main', '<article', '<section', '<header', '<footer', '<aside']]) + cast(a <> 1 and contains(html, '<nav>') as int) as marks from pages),
    s as (select page_id, unnest(['semantic-html', 'roles', 'labels', 'aria-roles', 'unique-ids']) as "check", unnest([case when marks >= 3 then 'pass' else 'fail' end, case when b = 1 then 'fail' else 'pass' end, case when b = 2 then 'fail' when b = 0 or c = 4 then 'pass' else 'n/a' end,
      case when c in (0, 1) then 'fail' when a = 0 or b = 3 or c = 2 then 'pass' else 'n/a' end, case when b = 2 or c = 3 then 'fail' when b = 0 then 'pass' else 'n/a' end]) as state from n) select * from s""",
)
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_checks(_html(spark, sf_dir), "page_id").select("page_id", "check", "state")


@query("r08_details")
def r08_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failed checks say."""
    return markup.markup_checks(_html(spark, sf_dir), "page_id").where("state = 'fail'").select("page_id", "check", "detail")


@query("j13_duplicate_ids_referenced", "select page_id, 'q' as id, 2 as n, page_id % 5 = 3 as referenced from pages where page_id % 4 = 2 union all select page_id, 'z', 2, true from pages where page_id % 5 = 3")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.repeated_ids(markup.elements(_html(spark, sf_dir), "page_id"), "page_id")


_CHECKS = "checks as (select 's' || (o_custkey % 30) as site, case o_orderkey % 4 when 0 then 'robots' when 1 then 'llms-txt' when 2 then 'labels' else 'mcp-card' end as key, case when o_custkey % 30 < 4 and o_orderkey % 4 = 2 then 'n/a' when o_orderkey % 11 = 0 and o_custkey % 5 = 0 then 'fail' when o_orderkey % 3 = 0 then 'n/a' else 'pass' end as state from orders)"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.when(i % 4 == 0, "robots").when(i % 4 == 1, "llms-txt").when(i % 4 == 2, "labels").otherwise("mcp-card")
    state = F.when((c % 30 < 4) & (i % 4 == 2), "n/a").when((i % 11 == 0) & (c % 5 == 0), "fail").when(i % 3 == 0, "n/a").otherwise("pass")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (c % 30).cast("string")).alias("site"), key.alias("key"), state.alias("state"))


_WORST = f"{_CHECKS}, worst as (select site, key, case when count(*) filter (state = 'fail') > 0 then 'fail' when bool_and(state = 'n/a') then 'n/a' else 'pass' end as state, count(*) filter (state = 'fail') as failed from checks group by all)"


@query("a22_worst_of_pages", f"with {_WORST} select * from worst")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.worst_of(_checks(spark, sf_dir))


_SCORES = "case priority when 'Must' then 5 when 'Should' then 2 else 1 end"


@query("a21_readiness_score", f"with {_COMPONENTS}, {_WORST} select site, cast(case when sum({_SCORES}) filter (state in ('pass', 'fail')) > 0 then round_even(100e0 * coalesce(sum({_SCORES}) filter (state = 'pass'), 0) / sum({_SCORES}) filter (state in ('pass', 'fail')), 0) else 0 end as bigint) as score from worst join components using (key) group by site")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.readiness_score(site.worst_of(_checks(spark, sf_dir)), site.component_table(spark))


@query("w14_severity_order", f"with {_COMPONENTS}, {_WORST} select site, key, cast(row_number() over (partition by site order by case priority when 'Must' then 0 when 'Should' then 1 else 2 end, pos) as integer) as place from worst join components using (key) where state = 'fail'")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site.worst_of(_checks(spark, sf_dir)).where("state = 'fail'").join(F.broadcast(site.component_table(spark)), "key")
    rank = F.when(F.col("priority") == "Must", 0).when(F.col("priority") == "Should", 1).otherwise(2)
    return rows.select("site", "key", F.row_number().over(W.Window.partitionBy("site").orderBy(rank, "pos")).alias("place"))


_STATES = f"""{_COMPONENTS}, {_WORST}, sites as (select distinct site, ['content', 'app_api', 'ecommerce'][1 + cast(substr(site, 2) as integer) % 3] as site_type, cast(substr(site, 2) as integer) as n from worst),
states as (select s.site, c.key, c.family, c.effort, case when case s.site_type when 'content' then c.content when 'app_api' then c.app_api else c.ecommerce end = 'N' then 'not_applicable' when w.state = 'pass' then 'live' when s.n % 4 = 0 and c.key in ('cls', 'labels') and c.layer = 1 and c.key not in ('semantic-html', 'roles', 'labels', 'aria-roles', 'unique-ids') then 'live'
  when c.artifact <> '' and ((s.n % 2 = 0 and c.artifact = 'llms.txt') or (s.n % 3 = 0 and c.artifact = 'agents.md')) then 'ready' when c.templated then 'template' else 'missing' end as state from sites s cross join components c left join worst w on w.site = s.site and w.key = c.key)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = site.worst_of(_checks(spark, sf_dir))
    n = F.substr("site", F.lit(2)).cast("int")
    sites = checks.select("site").distinct()
    marks = sites.where(n % 4 == 0).select("site", F.explode(F.array(F.lit("cls"), F.lit("labels"))).alias("key"))
    files = sites.where(n % 2 == 0).select("site", F.lit("llms.txt").alias("artifact")).unionByName(sites.where(n % 3 == 0).select("site", F.lit("agents.md").alias("artifact")))
    kinds = F.array(*[F.lit(t) for t in site.SITE_TYPES])
    return site.component_states(sites.withColumn("site_type", F.get(kinds, n % 3)), site.component_table(spark), checks, marks, files)


@query("j12_component_states", f"with {_STATES} select site, key, family, effort, state from states")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query("a23_family_counts", f"with {_STATES} select site, family, count(*) filter (state = 'live') as live, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'ready') as ready from states where state <> 'not_applicable' group by all")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir).where("state <> 'not_applicable'")
    return s.groupBy("site", "family").agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("live", "missing", "ready")])


@query("r10_checklist", f"with {_COMPONENTS}, {_WORST}, t as (select distinct site, ['content', 'app_api', 'ecommerce'][1 + cast(substr(site, 2) as integer) % 3] as site_type from worst) select site, key, case when state = 'fail' and case site_type when 'content' then content when 'app_api' then app_api else ecommerce end = 'C' then 'n/a' else state end as state from worst join components using (key) join t using (site)")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = site.worst_of(_checks(spark, sf_dir)).join(F.broadcast(site.component_table(spark)), "key")
    n = F.substr("site", F.lit(2)).cast("int") % 3
    applies = F.when(n == 0, F.col("content")).when(n == 1, F.col("app_api")).otherwise(F.col("ecommerce"))
    return w.select("site", "key", F.when((F.col("state") == "fail") & (applies == "C"), "n/a").otherwise(F.col("state")).alias("state"))


@query("r12_size_warnings", "with t as (select doc_id, n_chars as total, n_chars - doc_id % 3 as html, case when doc_id % 4 = 0 then null else (doc_id % 5) * n_chars end as indexed from documents) select doc_id, array_to_string(list_filter([case when total > 0 and html < total then 'assets' end, case when indexed is not null and html > 0 and indexed > html * 3 then 'orphans' end, case when indexed is not null and html > 0 and not indexed > html * 3 and html > greatest(indexed * 3, 50) then 'not kept' end, case when indexed is null then 'no count' end, case when html = 0 then 'no pages' end, case when greatest(html, coalesce(indexed, 0)) >= 10000 then 'huge' end], lambda x: x is not null), ',') as warnings from t")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("n_chars"), F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(site.size_warnings(n, n - i % 3, F.when(i % 4 != 0, (i % 5) * n)), ",").alias("warnings"))


_PROFILES = "case {} " + " ".join(f"when '{k}' then '{v}'" for k, v in site.PROFILES.items()) + " end"
_ACTION = "['contact_agency', 'shop_on_store', 'read_and_cite', 'undecided', 'use_the_api'][1 + n_nationkey % 5]"


@query("p29_profile_for", f"with t as (select n_nationkey, {_ACTION} as action from nation) select n_nationkey, coalesce({_PROFILES.format('action')}, case when n_nationkey % 3 = 0 then 'catalog' end, case when n_nationkey % 2 = 0 then 'ecommerce_retail' end, 'agency_services') as profile from t")
def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select("n_nationkey", "profile")


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    action = F.get(F.array(*[F.lit(x) for x in ("contact_agency", "shop_on_store", "read_and_cite", "undecided", "use_the_api")]), k % 5)
    profile = site.profile_for(action, F.when(k % 3 == 0, "catalog").otherwise(""), k % 2 == 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", action.alias("action"), profile.alias("profile"))


_SCENARIO_NAMES = ", ".join(f"'{k}'" for k in site.SCENARIOS)


@query(
    "p30_scenario_files",
    f"with {_COMPONENTS}, s as (select * from (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{c}{chr(39)})' for k, v in site.SCENARIOS.items() for c in v)}) t(scenario, key)), n as (select n_nationkey as site, [{_SCENARIO_NAMES}][1 + n_nationkey % {len(site.SCENARIOS)}] as scenario from nation) select distinct site, scenario, artifact from n join s using (scenario) join components using (key) where artifact <> ''",
)
def p30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each site's scenario asks for; both fixed tables are small."""
    names = F.array(*[F.lit(k) for k in site.SCENARIOS])
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"), F.get(names, (F.col("n_nationkey") % len(site.SCENARIOS)).cast("int")).alias("scenario"))
    rows = spark.createDataFrame([(k, c) for k, v in site.SCENARIOS.items() for c in v], "scenario string, key string")
    wanted = rows.join(F.broadcast(site.component_table(spark)), "key").where("artifact <> ''").select("scenario", "artifact").distinct()
    return sites.join(F.broadcast(wanted), "scenario").select("site", "scenario", "artifact")


_SECTIONS = "shapes as (select * from (values " + ", ".join(f"('{k}', {i}, '{s}')" for k, v in site.PROFILE_SECTIONS.items() for i, s in enumerate(v)) + ") t(profile, pos, section))"
_EVIDENCE = "(section in ('identity', 'not_supported') or (section in ('read_only', 'contact') and n_nationkey % 2 = 0) or (section = 'policies' and n_nationkey % 3 = 0))"
_P29 = f"p as (select n_nationkey, coalesce({_PROFILES.format(_ACTION)}, case when n_nationkey % 3 = 0 then 'catalog' end, case when n_nationkey % 2 = 0 then 'ecommerce_retail' end, 'agency_services') as profile from nation)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _profiled(spark, sf_dir).select(F.col("n_nationkey").alias("site"), "profile")
    even = sites.where("site % 2 = 0").select("site", F.explode(F.array(F.lit("read_only"), F.lit("contact"))).alias("section"))
    third = sites.where("site % 3 = 0").select("site", F.lit("policies").alias("section"))
    return site.agent_sections(sites, even.unionByName(third))


@query("k09_agent_sections", f"with {_SECTIONS}, {_P29} select n_nationkey as site, section, pos, {_EVIDENCE} as kept from p join shapes using (profile)")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with their suppliers' and customers' addresses as evidence."""
    k = F.col("site")
    url = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example"))
    link = lambda label, path: F.struct(F.lit(label).alias("label"), F.concat(url, F.lit(path)).alias("url"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"), "n_name")
    rows = _sections(spark, sf_dir)
    kept = rows.groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "section")))), lambda x: x["section"]).alias("sections"),
        F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("section")))).alias("omitted"),
    )
    return kept.join(_profiled(spark, sf_dir).select(F.col("n_nationkey").alias("site"), "profile"), "site").join(names, "site").select(
        "site", "profile", "sections", "omitted",
        url.alias("site_url"),
        F.when(k % 4 != 0, F.initcap("n_name")).alias("site_name"),
        F.when(k % 3 != 0, F.concat(F.lit("> About "), "n_name")).alias("summary"),
        F.when(k % 5 == 0, "  Ask first. ").alias("guidance"),
        F.array(F.struct(F.lit("Orders").alias("label"), F.concat(url, F.lit("/mcp")).alias("url"), F.lit("mcp").alias("transport"))).alias("capabilities"),
        F.array(link("Catalogue", "/c"), link("Search", "/s")).alias("read_only"),
        F.array(link("Privacy", "/p")).alias("policies"),
        F.concat(url, F.lit("/contact")).alias("contact_url"),
        F.lit("One a second. ").alias("rate_limit"),
        F.when(k % 2 == 1, F.concat(url, F.lit("/llms.txt"))).alias("llms_url"),
        F.lit("2026-04-08").alias("version"),
        F.array(F.lit("2026-01-23"), F.lit("2026-04-08")).alias("supported"),
    )


_E = "'https://' || lower(n_name) || '.example"


@query(
    "k10_agent_document",
    rf"""with {_SECTIONS}, {_P29}, e as (select n.*, profile, {_E}' as url from nation n join p using (n_nationkey)), kept as (select n_nationkey, pos, section, profile from p join shapes using (profile) where {_EVIDENCE}),
    lost as (select distinct n_nationkey from p join shapes using (profile) where section = 'contact' and not {_EVIDENCE}),
    b as (select n_nationkey, pos, case section when 'identity' then '## About this site' || chr(10) || chr(10) || case when n_nationkey % 5 = 0 then 'Ask first.' else 'Canonical site: ' || url end || case when n_nationkey % 2 = 1 and not exists (select 1 from kept k2 where k2.n_nationkey = e.n_nationkey and k2.section = 'api_access') then chr(10) || chr(10) || 'Content overview for language models: ' || url || '/llms.txt' else '' end
      when 'read_only' then '## Read-only browsing (no authentication)' || chr(10) || chr(10) || '- Catalogue: `' || url || '/c`' || chr(10) || '- Search: `' || url || '/s`'
      when 'contact' then '## Contact' || chr(10) || chr(10) || '- Enquiries: `' || url || '/contact`' || chr(10) || chr(10) || 'Submit an enquiry only when the person you are acting for has asked you to, and pass on only details they have given you for that purpose.'
      when 'policies' then '## Policies' || chr(10) || chr(10) || '- Privacy: `' || url || '/p`' || chr(10) || chr(10) || 'Read these before acting on this site; they govern what is permitted.'
      when 'not_supported' then '## Not supported' || chr(10) || chr(10) || case when e.profile in ('ecommerce_retail', 'ecommerce') then '- No agent commerce protocol is published for this site yet. Do not attempt to transact programmatically; direct the person you are acting for to the site itself.' else '- This site does not sell through an agent protocol. There is no cart, checkout or ordering endpoint; do not attempt to transact here.' end || chr(10)
        || case when n_nationkey in (select n_nationkey from lost) then '- No contact endpoint is published for agent use.' || chr(10) else '' end || '- Do not submit forms, create accounts, or take any action that changes state on this site without explicit instruction from the person you are acting for.' end as block from kept join e using (n_nationkey))
    select n_nationkey as site, '# ' || case when n_nationkey % 4 <> 0 then upper(n_name[1]) || lower(n_name[2:]) else any_value(url) end || chr(10) || chr(10) || case when n_nationkey % 3 <> 0 then '> About ' || n_name || chr(10) || chr(10) else '' end || string_agg(block, chr(10) || chr(10) order by pos) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
      || '*Generated 2026-08-20. Follows the agents.md convention as published by Shopify (May 2026). agents.md is a convention rather than a ratified specification; the machine-readable contract for commerce is UCP, at /.well-known/ucp.*' || chr(10) as body from b join e using (n_nationkey) group by n_nationkey, n_name""",
)
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.render_agents(_evidence(spark, sf_dir), "2026-08-20").select("site", "body")


@query("k11_capability_catalog", """with s as (select n_regionkey as site, case n_nationkey % 3 when 0 then 'sitemap' when 1 then 'mcp' else 'api' end as kind, 'https://e/' || n_nationkey as url, case when n_nationkey % 5 = 0 then 'absent' else 'present' end as state from nation), g as (select site, count(*) as n, '[' || string_agg('{"kind":"' || kind || '","url":"' || url || '"}', ',' order by '{"kind":"' || kind || '","url":"' || url || '"}') || ']' as entries from s where state = 'present' and kind <> 'sitemap' group by site) select site, entries from g where n >= 2""")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, "sitemap").when(k % 3 == 1, "mcp").otherwise("api")
    s = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("site"), kind.alias("kind"), F.concat(F.lit("https://e/"), k.cast("string")).alias("url"), F.when(k % 5 == 0, "absent").otherwise("present").alias("state"))
    return site.catalog_entries(s)


_MADE = "made as (select n_nationkey as site, unnest(list_filter([case when n_nationkey % 2 = 0 then 'llms.txt' end, case when n_nationkey % 3 = 0 then 'llms-full.txt' end, case when n_nationkey % 5 < 3 then 'agents.md' end, case when n_nationkey % 4 = 0 then 'ai-catalog.json' end], lambda x: x is not null)) as artifact from nation)"
_WANTED = f"""{_COMPONENTS}, n as (select n_nationkey as site, [{_SCENARIO_NAMES}][1 + n_nationkey % {len(site.SCENARIOS)}] as scenario from nation), {_MADE},
s as (select * from (values {", ".join(f"('{k}', '{c}')" for k, v in site.SCENARIOS.items() for c in v)}) t(scenario, key)), wanted as (select distinct site, artifact from n join s using (scenario) join components using (key) where artifact <> ''),
files as (select site, artifact, case when (site, artifact) not in (select (site, artifact) from wanted) then 'not needed' when artifact in ('robots.txt', '_headers') or (site, artifact) in (select (site, artifact) from made) then 'produced' else 'missing' end as state from n, (select distinct artifact from components where artifact <> '') a)"""


def _bundled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(x) for x in site.SCENARIOS])
    sites = table(spark, sf_dir, "nation").select(k.alias("site"), F.get(names, (k % len(site.SCENARIOS)).cast("int")).alias("scenario"))
    have = F.array_compact(F.array(F.when(k % 2 == 0, "llms.txt"), F.when(k % 3 == 0, "llms-full.txt"), F.when(k % 5 < 3, "agents.md"), F.when(k % 4 == 0, "ai-catalog.json")))
    return sites, table(spark, sf_dir, "nation").select(k.alias("site"), F.explode(have).alias("artifact"))


@query("k12_bundle_files", f"with {_WANTED} select site, artifact, state from files")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.bundle_files(*_bundled(spark, sf_dir)).select("site", "artifact", "state")


@query(
    "k12_bundle_tasks",
    f"with {_WANTED} select site, artifact as component, 'drop_in' as effort, '' as blocked_by from files where state = 'produced' union all select site, key, effort, case when key = 'mcp-card' and site % 6 = 0 then '404' else '' end from n join components on effort <> 'drop_in' and case when scenario in ('shop_on_store', 'find_local_inventory') then ecommerce else content end = 'Y'",
)
def k12_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, made = _bundled(spark, sf_dir)
    declared = sites.select("site", F.lit("mcp").alias("kind"), (F.col("site") % 6 != 0).alias("verified"), F.lit("404").alias("detail"))
    return handover.bundle_tasks(sites, handover.bundle_files(sites, made), declared).select("site", "component", "effort", "blocked_by")


_BOTS = "b as (select * from (values (0, 'OAI-SearchBot', 'search'), (1, 'PerplexityBot', 'search'), (2, 'ClaudeBot', 'search'), (3, 'Google-Extended', 'search'), (4, 'GPTBot', 'training'), (5, 'CCBot', 'training'), (6, 'anthropic-ai', 'training')) t(i, bot, kind))"


@query(
    "k13_robots_rules",
    f"""with {_BOTS}, p as (select n_nationkey as site, lower(n_name) as host, ['block_all', 'search_only', 'allow'][1 + n_nationkey % 3] as policy from nation),
    r as (select site, host, policy, string_agg('User-agent: ' || bot || chr(10) || case when policy = 'block_all' or (policy = 'search_only' and kind = 'training') then 'Disallow: /' else 'Allow: /' end || chr(10) || chr(10), '' order by i) as rules from p cross join b group by all)
    select site, '# AI crawler rules — add these to your existing robots.txt.' || chr(10) || chr(10) || rules || 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Content-Signal: ai-train=' || case policy when 'allow' then 'yes' else 'no' end || ', search=' || case policy when 'block_all' then 'no' else 'yes' end || ', ai-input=' || case policy when 'block_all' then 'no' else 'yes' end || chr(10) || chr(10)
      || case when site % 2 = 0 then 'Sitemap: https://' || host || '.example/sitemap.xml' || chr(10) || chr(10) else '' end
      || case when policy = 'search_only' then '# Note: on Cloudflare, blocking Training also blocks Googlebot, Bingbot' || chr(10) || '# and Applebot from 15 September 2026 — multi-purpose crawlers are judged' || chr(10) || '# by their strictest rule. Check your CDN''s AI crawler settings as well;' || chr(10) || '# these lines alone will not produce the outcome above.' || chr(10) else '' end as body from r""",
)
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    policy = F.get(F.array(*[F.lit(x) for x in ("block_all", "search_only", "allow")]), k % 3)
    sitemap = F.when(k % 2 == 0, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/sitemap.xml")))
    return table(spark, sf_dir, "nation").select(k.alias("site"), agents.robots_rules(policy, sitemap).alias("body"))


@query(
    "k13_header_file",
    """select n_nationkey as site, '# Cloudflare Pages _headers — agent-aware Link rels.' || chr(10) || chr(10) || '/*' || chr(10) || '  Link: </sitemap.xml>; rel="sitemap"' || chr(10) || case when n_nationkey % 2 = 0 then '  Link: </llms.txt>; rel="describedby"; type="text/markdown"' || chr(10) else '' end
    || case when n_nationkey % 3 = 0 then '  Link: </.well-known/ai-catalog.json>; rel="ai-catalog"' || chr(10) else '' end || case when n_nationkey % 5 = 0 then '  Link: <https://' || lower(n_name) || '.example/api>; rel="service-desc"; type="application/vnd.oai.openapi+json"' || chr(10) else '' end as body from nation""",
)
def k13_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    spec = F.when(k % 5 == 0, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/api")))
    return table(spark, sf_dir, "nation").select(k.alias("site"), agents.header_file(k % 2 == 0, k % 3 == 0, spec).alias("body"))


@query("k14_templates", "select n_nationkey, key, case when key = 'link-header' and n_nationkey % 4 = 0 then 'no' when key in ('webmcp', 'link-header', 'markdown-negotiation') then 'text' else 'https://' || lower(n_name) || '.example' end as shown from nation cross join (select unnest(['mcp-card', 'a2a-card', 'oauth-resource', 'skills', 'api-catalog', 'webmcp', 'link-header', 'markdown-negotiation']) as key)")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site that each template names: in the service documents read back from their JSON."""
    sites = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("site_url"), F.col("n_name").alias("site_name"), F.when(F.col("n_nationkey") % 4 == 0, "wix").otherwise("nginx").alias("platform"))
    t = agents.service_templates(sites)
    paths = {"mcp-card": "$.authentication.resourceMetadata", "a2a-card": "$.url", "oauth-resource": "$.resource", "skills": "$.skills[0].endpoint", "api-catalog": "$.linkset[0].anchor"}
    read = F.coalesce(*[F.when(F.col("key") == k, F.regexp_extract(F.get_json_object("body", p), "^https://[^/]*", 0)) for k, p in paths.items()])
    return t.select("n_nationkey", "key", F.coalesce(read, F.when(F.col("body").contains("sets no response headers"), "no").otherwise("text")).alias("shown"))


_GROUPS15 = "g as (select n_regionkey as site, n_nationkey as place, n_name || repeat('-', n_nationkey * 2) as grp, 1234 * (1 + n_nationkey) as urls, n_nationkey % 7 as tmpl, n_nationkey % 4 as multi, case n_nationkey % 3 when 0 then 'hub' when 1 then 'editorial' else 'faceted' end as intent, case n_nationkey % 2 when 0 then 'include_group' else 'promote_exemplars' end as verdict, case when n_nationkey % 5 = 0 then 'n*' end as declared, n_nationkey % 2 = 1 as keeps from nation)"


def _groups15(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), k % n)
    return table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("site"), k.alias("place"), F.concat("n_name", F.repeat(F.lit("-"), (k * 2).cast("int"))).alias("group"), ((k + 1) * 1234).alias("url_count"), (k % 7).alias("template_diversity"), (k % 4).alias("multi_listed"),
        pick(3, "hub", "editorial", "faceted").alias("intent"), pick(2, "include_group", "promote_exemplars").alias("verdict"), F.lit("low").alias("confidence"), F.when(k % 5 == 0, "n*").alias("declared"),
        F.when(k % 2 == 1, F.array(*[F.lit(f"/{i}") for i in range(4)])).alias("exemplars"), (k * 100).alias("total_clicks"), (k / 40).alias("coverage"), (k % 3 == 0).alias("overridden"),
    )


@query(
    "k15_plan_text",
    f"""with {_GROUPS15}, w as (select site, least(42, max(length(grp))) as width, count(*) as n, sum(urls) as total from g group by site), c as (select site, string_agg(n || ' ' || verdict, ', ' order by verdict) as verdicts from (select site, verdict, count(*) as n from g group by all) group by site),
    l as (select site, place, rpad(case when length(grp) <= width then grp else left(grp, cast(width - 1 as bigint)) || '…' end, cast(width as integer), ' ') || '  ' || lpad(format('{{:,}}', urls), 7, ' ') || ' ' || lpad(tmpl::varchar, 5, ' ') || ' ' || lpad(multi::varchar, 6, ' ') || ' ' || rpad(intent, 10, ' ') || ' ' || rpad(verdict, 18, ' ') || ' low'
      || case when declared is not null then chr(10) || repeat(' ', width + 4) || 'declared: ' || declared else '' end || case when keeps then chr(10) || repeat(' ', width + 4) || 'keep: /0, /1, /2' else '' end as line from g join w using (site)),
    h as (select site, rpad('GROUP', cast(width as integer), ' ') || '     URLS  TMPL  MULTI INTENT     VERDICT            CONF' as header from w)
    select site, any_value(header) || chr(10) || repeat('-', length(any_value(header))) || chr(10) || string_agg(line, chr(10) order by place) || chr(10) || chr(10) || any_value(n) || ' group(s), ' || any_value(format('{{:,}}', total::bigint)) || ' URLs. ' || any_value(verdicts) as body from l join h using (site) join w using (site) join c using (site) group by site""",
)
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.planning_table(_groups15(spark, sf_dir))


@query(
    "k15_metrics_table",
    f"with {_GROUPS15}, w as (select site, max(length(grp)) as width from g group by site) select site, rpad('GROUP', cast(any_value(width) as integer), ' ') || '     URLS   CLICKS  COVER  VERDICT' || chr(10) || string_agg(rpad(grp, cast(width as integer), ' ') || '  ' || lpad(format('{{:,}}', urls), 7, ' ') || ' ' || lpad(format('{{:,}}', place * 100), 8, ' ') || ' ' || lpad(round_even(place / 40 * 100, 0)::int::varchar, 4, ' ') || '%  ' || verdict || case when place % 3 = 0 then '  (overridden)' else '' end, chr(10) order by place desc) as body from g join w using (site) group by site",
)
def k15_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.metrics_table(_groups15(spark, sf_dir))


@query("k15_template_summary", f"with {_GROUPS15}, r as (select *, row_number() over (partition by site order by urls desc) as n, count(*) over (partition by site) - 3 as hidden from g) select site, 'URL templates, most populous first:' || chr(10) || string_agg('  ' || lpad(urls::varchar, 6, ' ') || '  ' || grp || '   e.g. ' || coalesce(declared, ''), chr(10) order by n) filter (n <= 3) || case when any_value(hidden) > 0 then chr(10) || '  ... ' || any_value(hidden) || ' further template(s) not shown' else '' end as body from r group by site")
def k15_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _groups15(spark, sf_dir).select("site", F.col("group").alias("template"), F.col("url_count").alias("count"), F.col("declared").alias("example"), F.col("place").alias("template_ord"))
    return handover.template_summary(rows, 3)


@query("k16_replace_by_key", "with o as (select c_mktsegment as segment, count(*) as n, c_nationkey as run from customer group by all) select segment, n, run from o where run % 3 <> 0 union all select 'all', sum(n), run from o where run % 3 = 0 group by run")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are written, and a third of them is written anew by key."""
    old = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{shared_folder(spark)}/siteindex/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    store.replace_by_key(old.select("segment", "n", "run"), path, "run")
    new = old.where("run % 3 = 0").groupBy("run").agg(F.sum("n").alias("n")).select(F.lit("all").alias("segment"), "n", "run")
    store.replace_by_key(new, path, "run")
    return spark.read.parquet(path).select("segment", "n", F.col("run").cast(old.schema["run"].dataType).alias("run"))


@query("k17_upsert", "with a as (select o_custkey, o_orderkey as version, o_orderstatus, o_orderkey % 3 = 0 as fresh from orders) select o_custkey, version, o_orderstatus from a qualify row_number() over (partition by o_custkey order by version desc, fresh desc) = 1")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderstatus", (F.col("o_orderkey") % 3 == 0).alias("fresh"))
    return store.upsert(rows.where("not fresh").drop("fresh"), rows.where("fresh").drop("fresh"), ["o_custkey"], "version")


_RUNS = "runs as (select o_orderkey as run, o_orderstatus as status from orders), pages_ as (select l_orderkey as run, l_linenumber as page from lineitem)"


@query(
    "k17_clone_delete",
    f"with {_RUNS}, r as (select * from runs union all select run + 1000000000, status from runs where run % 5 = 0), p as (select * from pages_ union all select run + 1000000000, page from pages_ where run % 5 = 0) select run, status, count(page) as pages from r left join p using (run) where run % 7 <> 1 group by all",
)
def k17_clone_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page"))
    named = runs.where("run % 5 = 0").select("run", (F.col("run") + 1_000_000_000).alias("clone"))
    root = f"{shared_folder(spark)}/siteindex/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    versions.commit(spark, root, store.clone_runs({"runs": runs, "pages": pages}, named), 0)
    versions.change(spark, root, lambda held: store.delete_runs(held, held["runs"].where("run % 7 = 1").select("run")))
    held = versions.tables(spark, root)
    counted = held["pages"].groupBy("run").agg(F.count("page").alias("pages"))
    return held["runs"].join(counted, "run", "left").select("run", "status", F.coalesce("pages", F.lit(0)).alias("pages"))


_LINKED = """g as (select page_id as ord, page_id // 50 as scope, url || case page_id % 9 when 0 then '/privacy-policy' when 1 then '/Terms' when 2 then '/returns' when 3 then '/contact-us' else '' end as url, case page_id % 4 when 0 then '' when 1 then 'Store locator' else 'Page ' || page_id end as title from pages),
k as (select *, case when contains(lower(url), 'privacy') then 'Privacy' when contains(lower(url), 'terms') then 'Terms' when contains(lower(url), 'returns') then 'Returns' end as policy from g)"""
_CONTACTS = f"({' or '.join(f'contains(lower(url), {chr(39)}{w}{chr(39)})' for w in ranking.CONTACT_URL)} or {' or '.join(f'contains(lower(title), {chr(39)}{w}{chr(39)})' for w in ranking.CONTACT_TITLE)})"


@query(
    "w15_link_split",
    f"""with {_LINKED}, n as (select *, row_number() over (partition by scope, policy order by ord) as pn, {_CONTACTS} as c, row_number() over (partition by scope, policy is null, {_CONTACTS} order by ord) as cn from k),
    o as (select *, row_number() over (partition by scope order by ord) as m from n where policy is null and not (c and cn = 1))
    select scope, ord, url, 'policy' as kind, policy as label from n where policy is not null and pn = 1 union all select scope, ord, url, 'contact', 'Contact' from n where policy is null and c and cn = 1
    union all select scope, ord, url, 'read', case when title = '' then url else title end from o where m <= 12""",
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    tail = F.when(i % 9 == 0, "/privacy-policy").when(i % 9 == 1, "/Terms").when(i % 9 == 2, "/returns").when(i % 9 == 3, "/contact-us").otherwise("")
    title = F.when(i % 4 == 0, "").when(i % 4 == 1, "Store locator").otherwise(F.concat(F.lit("Page "), i.cast("string")))
    pages = table(spark, sf_dir, "pages").select(i.alias("ord"), F.floor(i / 50).alias("scope"), F.concat("url", tail).alias("url"), title.alias("title"))
    contact = ranking.any_of(F.lower("url"), ranking.CONTACT_URL) | ranking.any_of(F.lower("title"), ranking.CONTACT_TITLE)
    return store.split_links(pages, contact)
