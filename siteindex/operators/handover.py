"""What is handed over with a run: bundles of files, the work that is left, and the text tables of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import site as s

#: Goals that sell, where each file is served, and what is said of it. Fixed values.
SELLING = ("shop_on_store", "find_local_inventory")
PLACES = {
    "robots.txt": ("/robots.txt", "text/plain", "Merge with the existing file; do not replace it."),
    "llms.txt": ("/llms.txt", "text/markdown", ""),
    "llms-full.txt": ("/llms-full.txt", "text/markdown", ""),
    "agents.md": ("/agents.md", "text/markdown", ""),
    "ai-catalog.json": ("/.well-known/ai-catalog.json", "application/ai-catalog+json", ""),
    "_headers": ("_headers", "text/plain", "Cloudflare Pages. On other hosts, set the same Link headers at the edge."),
}
#: Files that need nothing but the brief.
ALWAYS = ("robots.txt", "_headers")
NOT_MADE = " is called for by this scenario but was not generated — run the llms.txt generator for this site first."


def _files(spark: SparkSession) -> DataFrame:
    """(scenario, artifact, wanted): every file of every goal."""
    artifact = {c[0]: c[6] for c in s.COMPONENTS}
    rows = []
    for name, keys in s.SCENARIOS.items():
        wanted = {artifact[k] for k in keys}
        rows += [(name, a, a in wanted) for a in PLACES]
    return spark.createDataFrame(rows, "scenario string, artifact string, wanted boolean")


def bundle_files(sites: DataFrame, made: DataFrame) -> DataFrame:
    """(site, artifact, state, path, media_type, note): each file is produced, missing (called for, not made) or not needed.

    ``sites``: (site, scenario); ``made``: (site, artifact) of the documents there are.
    """
    every = sites.select("site", "scenario").join(F.broadcast(_files(sites.sparkSession)), "scenario")  # a fixed table
    known = every.join(made.select("site", "artifact", F.lit(True).alias("made")), ["site", "artifact"], "left")
    there = F.coalesce("made", F.lit(False)) | F.col("artifact").isin(*ALWAYS)
    state = F.when(~F.col("wanted"), "not needed").when(there, "produced").otherwise("missing")
    pick = lambda i: F.coalesce(*[F.when(F.col("artifact") == a, F.lit(x[i])) for a, x in PLACES.items()])
    note = F.when(state == "produced", pick(2)).when(state == "missing", F.concat("artifact", F.lit(NOT_MADE))).otherwise("")
    return known.select("site", "artifact", state.alias("state"), pick(0).alias("path"), pick(1).alias("media_type"), note.alias("note"))


def bundle_tasks(sites: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """(site, component, effort, what, blocked_by): uploads of the files produced, and a developer's work on components that apply.

    ``declared``: (site, kind, verified, detail) of endpoints that the site's owner named.
    """
    uploads = files.where("state = 'produced'").select("site", F.col("artifact").alias("component"), F.lit("drop_in").alias("effort"), F.concat(F.lit("Serve this at "), "path", F.lit(" as "), "media_type", F.lit(".")).alias("what"), F.lit("").alias("blocked_by"))
    parts = s.component_table(sites.sparkSession).where("effort <> 'drop_in'")
    applies = F.when(F.col("scenario").isin(*SELLING), F.col("ecommerce")).otherwise(F.col("content"))
    work = sites.join(F.broadcast(parts), applies == "Y")  # the components are a fixed table
    down = declared.where("kind = 'mcp' and not verified").select("site", F.coalesce(F.nullif("detail", F.lit("")), F.lit("not reachable")).alias("detail"), F.lit("mcp-card").alias("key"))
    held = work.join(down, ["site", "key"], "left")
    return uploads.unionByName(held.select("site", F.col("key").alias("component"), "effort", F.concat(F.lit("Make "), "key", F.lit(" live.")).alias("what"), F.coalesce("detail", F.lit("")).alias("blocked_by")))


def _right(value: Column, width: int) -> Column:
    """A number with its thousands apart, at the right of its column; wider ones push."""
    shown = F.format_number(value, 0)
    return F.lpad(shown, F.greatest(F.lit(width), F.length(shown)), F.lit(" "))


def _left(value: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.rpad(value, F.greatest(width, F.length(value)), F.lit(" "))


def _bodies(lines: DataFrame, head: Column, foot: Column | None = None) -> Column:
    parts = [head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")]
    return F.concat_ws("\n", *parts, *([foot] if foot is not None else []))


def planning_table(groups: DataFrame, most: int = 42) -> DataFrame:
    """(site, body): a line for each group with its evidence beside its verdict, what was declared and what to keep below it.

    ``groups``: site, place, group, url_count, template_diversity, multi_listed, intent,
    verdict, confidence, declared, exemplars.
    """
    widths = groups.groupBy("site").agg(F.least(F.lit(most), F.max(F.length("group"))).alias("width"))
    rows = groups.join(widths, "site")
    name = F.when(F.length("group") <= F.col("width"), F.col("group")).otherwise(F.concat(F.left("group", F.col("width") - 1), F.lit("…")))
    line = F.concat(
        _left(name, F.col("width")), F.lit("  "), _right(F.col("url_count"), 7), F.lit(" "), F.lpad(F.col("template_diversity").cast("string"), 5, " "), F.lit(" "),
        F.lpad(F.col("multi_listed").cast("string"), 6, " "), F.lit(" "), _left(F.col("intent"), 10), F.lit(" "), _left(F.col("verdict"), 18), F.lit(" "), F.col("confidence"),
    )
    indent = F.repeat(F.lit(" "), F.col("width") + 4)
    declared = F.when(F.coalesce("declared", F.lit("")) != "", F.concat(indent, F.lit("declared: "), "declared"))
    keep = F.when(F.size(F.coalesce("exemplars", F.array().cast("array<string>"))) > 0, F.concat(indent, F.lit("keep: "), F.array_join(F.slice("exemplars", 1, 3), ", ")))
    rows = rows.select("site", "width", "place", "url_count", "verdict", F.concat_ws("\n", line, declared, keep).alias("line"))
    verdicts = groups.groupBy("site", "verdict").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verdict", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["verdict"])), ", ").alias("verdicts"))
    header = F.concat(_left(F.lit("GROUP"), F.first("width")), F.lit(f"  {'URLS':>7} {'TMPL':>5} {'MULTI':>6} {'INTENT':<10} {'VERDICT':<18} CONF"))
    head = F.concat(header, F.lit("\n"), F.repeat(F.lit("-"), F.length(header)))
    made = rows.groupBy("site").agg(_bodies(rows, head).alias("body"), F.count(F.lit(1)).alias("n"), F.sum("url_count").alias("urls"))
    foot = F.concat(F.lit("\n\n"), F.col("n").cast("string"), F.lit(" group(s), "), F.format_number("urls", 0), F.lit(" URLs. "), "verdicts")
    return made.join(verdicts, "site").select("site", F.concat("body", foot).alias("body"))


def metrics_table(groups: DataFrame) -> DataFrame:
    """(site, body): groups by clicks, then URLs. ``groups``: site, group, url_count, total_clicks, coverage, verdict, overridden."""
    widths = groups.groupBy("site").agg(F.max(F.length("group")).alias("width"))
    order = W.Window.partitionBy("site").orderBy(F.desc("total_clicks"), F.desc("url_count"), "group")
    rows = groups.join(widths, "site").withColumn("place", F.row_number().over(order))
    share = F.concat(F.lpad(F.bround(F.col("coverage") * 100, 0).cast("int").cast("string"), 4, " "), F.lit("%"))
    line = F.concat(_left(F.col("group"), F.col("width")), F.lit("  "), _right(F.col("url_count"), 7), F.lit(" "), _right(F.col("total_clicks"), 8), F.lit(" "), share, F.lit("  "), "verdict", F.when(F.col("overridden"), "  (overridden)").otherwise(""))
    head = F.concat(_left(F.lit("GROUP"), F.first("width")), F.lit(f"  {'URLS':>7} {'CLICKS':>8} {'COVER':>6}  VERDICT"))
    rows = rows.withColumn("line", line)
    return rows.groupBy("site").agg(_bodies(rows, head).alias("body"))


def template_summary(templates: DataFrame, most: int = 60) -> DataFrame:
    """(site, body): templates by size with an example, ``most`` of them. ``templates``: site, template, count, example, template_ord."""
    order = W.Window.partitionBy("site").orderBy(F.desc("count"), "template_ord")
    shown = templates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    line = F.concat(F.lit("  "), F.lpad(F.col("count").cast("string"), 6, " "), F.lit("  "), "template", F.lit("   e.g. "), F.coalesce("example", F.lit("")))
    listed = shown.withColumn("line", line)
    bodies = listed.groupBy("site").agg(_bodies(listed, F.lit("URL templates, most populous first:")).alias("body"))
    hidden = templates.groupBy("site").agg((F.count(F.lit(1)) - most).alias("hidden"))
    rest = F.when(F.col("hidden") > 0, F.concat(F.lit("\n  ... "), F.col("hidden").cast("string"), F.lit(" further template(s) not shown"))).otherwise("")
    return bodies.join(hidden, "site").select("site", F.concat("body", rest).alias("body"))
