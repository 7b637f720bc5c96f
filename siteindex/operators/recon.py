"""URL templates by sibling counts, sitemap groups, plans and budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import urls
from ..functions.order import numbered_within
from ..lineage import written

#: A prefix with this many different next segments is variable. Fixed value.
COLLAPSE = 5
#: Templates that are seldom worth a page. Fixed values.
JUNK = (r"/page/\{", "/tag/", "/tags/", "/author/", r"/category/\{[^}]+\}/page", "/search", "/cart", "/checkout", "/account", "/login", "/wp-json", "/feed", r"\?", "/amp$", "/print$")
SAMPLE_ABOVE, SAMPLE_SIZE = 200, 25
UNSOURCED = "__unsourced__"


def sibling_counts(site_urls: DataFrame, part: tuple[str, ...]) -> DataFrame:
    """(part, prefix, siblings): different next segments under every concrete prefix."""
    segs = site_urls.select(*part, urls.segments(F.col("url")).alias("s")).where(F.size("s") > 0)
    steps = segs.select(*part, "s", F.posexplode("s").alias("i", "segment"))
    pairs = steps.select(*part, F.array_join(F.slice("s", 1, F.col("i")), "/").alias("prefix"), "segment").distinct()
    return pairs.groupBy(*part, "prefix").agg(F.count(F.lit(1)).alias("siblings"))


def templated(site_urls: DataFrame, part: tuple[str, ...] = ("site",), collapse: int = COLLAPSE) -> DataFrame:
    """``site_urls`` (part, url, ord) plus ``template`` and ``depth``.

    A segment under a prefix with ``collapse`` or more different segments becomes its
    placeholder; prefixes are concrete, so the counts are joined by prefix.
    """
    variable = sibling_counts(site_urls, part).where(F.col("siblings") >= collapse).drop("siblings")
    keyed = site_urls.withColumn("s", urls.segments(F.col("url")))
    # Distinct segment paths carry the joins; URLs that differ in query only share one.
    paths = keyed.select(*part, "s").distinct()
    steps = paths.where(F.size("s") > 0).select(*part, "s", F.posexplode("s").alias("i", "segment"))
    steps = steps.withColumn("prefix", F.array_join(F.slice("s", 1, F.col("i")), "/"))
    marked = steps.join(variable.withColumn("many", F.lit(True)), [*part, "prefix"], "left")
    piece = F.when(F.col("many"), F.coalesce(urls.segment_class(F.col("segment")), F.lit("{slug}"))).otherwise(F.col("segment"))
    rebuilt = marked.groupBy(*part, "s").agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("piece")))).alias("p"))
    rebuilt = rebuilt.select(*part, "s", F.concat(F.lit("/"), F.array_join(F.transform("p", lambda x: x["piece"]), "/")).alias("template"))
    out = keyed.join(rebuilt, [*part, "s"], "left")
    return out.withColumn("template", F.coalesce("template", F.lit("/"))).withColumn("depth", F.size("s")).drop("s")


def templates(site_urls: DataFrame, part: tuple[str, ...] = ("site",), collapse: int = COLLAPSE) -> DataFrame:
    """(part, template, count, examples, max_depth, template_ord): the first three URLs of each as examples."""
    order = W.Window.partitionBy(*part, "template").orderBy("ord")
    rows = templated(site_urls, part, collapse).withColumn("rank_", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("rank_") <= 3, F.struct("ord", "url"))))
    return rows.groupBy(*part, "template").agg(
        F.count(F.lit(1)).alias("count"),
        F.transform(first, lambda x: x["url"]).alias("examples"),
        F.max("depth").cast("bigint").alias("max_depth"),
        F.min("ord").alias("template_ord"),
    )


def heuristic_plan(counted: DataFrame) -> DataFrame:
    """``counted`` templates plus action, priority and reason, by shape alone."""
    junk = F.col("template").rlike("(?i)" + "|".join(JUNK))
    many = F.col("count") > SAMPLE_ABOVE
    action = F.when(junk, "exclude").when(many, "sample").otherwise("include")
    priority = F.when(junk, 5).when(many, 3).otherwise(F.least(F.lit(5), F.greatest(F.lit(1), F.col("max_depth"))))
    return counted.withColumn("action", action).withColumn("priority", priority.cast("bigint"))


def _trie(plan: DataFrame) -> DataFrame:
    """(site, node, key, child): the steps from a template's beginning to a longer one.

    A node is the beginning itself. A step's key is "=" and the segment, or "{" for any
    segment; templates with different placeholders there are different children.
    """
    steps = plan.select("site", "t_", F.explode(F.sequence(F.lit(1), F.size("t_"))).alias("i")).where(F.size("t_") > 0)
    segment = F.element_at("t_", F.col("i"))
    key = F.when(segment.startswith("{"), "{").otherwise(F.concat(F.lit("="), segment))
    prefix = lambda n: F.array_join(F.slice("t_", F.lit(1), n), "/")
    return steps.select("site", prefix(F.col("i") - 1).alias("node"), key.alias("key"), prefix(F.col("i")).alias("child")).distinct()


def matches(members: DataFrame, plan: DataFrame) -> DataFrame:
    """URLs with every template they match: as many segments, each equal or a placeholder.

    Distinct segment paths descend the trie of templates, a segment a round; each round
    joins by site, node and key, so that only steps that fit are made. Rounds are as many
    as the longest template has segments.
    """
    held = plan.withColumn("t_", F.filter(F.split("template", "/"), lambda x: x != ""))
    depth = held.agg(F.max(F.size("t_"))).first()[0]
    keyed = members.withColumn("s_", urls.segments(F.col("url")))
    # A path that ends waits at its node while longer ones go on.
    front = keyed.select("site", "s_").distinct().where(F.size("s_") <= F.lit(depth if depth is not None else -1)).withColumn("node", F.lit(""))
    trie = _trie(held)
    for i in range(depth or 0):
        here = F.get("s_", F.lit(i))
        keys = F.when(here.isNotNull(), F.array(F.concat(F.lit("="), here), F.lit("{"))).otherwise(F.array(F.lit("")))
        went = front.withColumn("key", F.explode(keys)).join(trie, ["site", "node", "key"], "left")
        front = went.where((F.col("key") == "") | F.col("child").isNotNull()).select("site", "s_", F.coalesce("child", "node").alias("node"))
    ends = held.withColumn("node", F.array_join("t_", "/")).withColumn("n_", F.size("t_")).drop("t_")
    met = front.withColumn("n_", F.size("s_")).join(ends, ["site", "node", "n_"]).drop("node", "n_")
    return keyed.join(met, ["site", "s_"]).drop("s_")


def even_sample(rows: DataFrame, part: tuple[str, ...], size: Column, order: str = "ord") -> DataFrame:
    """``rows`` with ``picked``: positions floor(i * n / size), or all where there are no more than ``size``."""
    r = numbered_within(rows.withColumn("size_", size), part, [F.col(order)], "at_", "n_")
    stride = F.col("n_") / F.col("size_")
    i = F.ceil(F.col("at_") / stride)
    # floor(i * stride) meets this position for i or, by rounding, a neighbour of it.
    hit = F.lit(False)
    for k in (-1, 0, 1):
        j = i + k
        hit = hit | ((j >= 0) & (j < F.col("size_")) & (F.floor(j * stride) == F.col("at_")))
    return r.withColumn("picked", F.when(F.col("size_") <= 0, False).otherwise((F.col("n_") <= F.col("size_")) | hit)).drop("at_", "n_", "size_")


def selection(site_urls: DataFrame, rules: DataFrame, cap: int, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """The crawl list of each site: (site, place, url), inside ``cap``, the homepage first.

    Included templates give all URLs and sampled ones an even sample; what is left of
    the budget goes to the sampled templates' other URLs in order of priority. A URL
    keeps its best place.
    """
    member = matches(site_urls, rules.where("action <> 'exclude'").select("site", "template", "action", "priority", "template_ord"))
    most = F.when(F.col("action") == "include", F.lit((1 << 31) - 1)).otherwise(F.lit(sample_size))
    # Written: the quotas below need the counts of what was picked before the rest is picked.
    member = written(even_sample(member, ("site", "template"), most))
    chosen = member.where("picked").drop("picked").withColumn("extra", F.lit(0))
    spent = chosen.groupBy("site").agg(F.count(F.lit(1)).alias("spent"))
    rest = member.where("not picked").drop("picked")
    sizes = rest.groupBy("site", "template", "priority", "template_ord").agg(F.count(F.lit(1)).alias("n_rest"))
    ahead = W.Window.partitionBy("site").orderBy("priority", "template_ord").rowsBetween(W.Window.unboundedPreceding, -1)
    room = sizes.withColumn("ahead", F.coalesce(F.sum("n_rest").over(ahead), F.lit(0))).join(spent, "site", "left")
    room = room.withColumn("take", F.greatest(F.lit(0), F.least("n_rest", F.lit(cap) - F.coalesce("spent", F.lit(0)) - F.col("ahead")))).select("site", "template", "take")
    more = even_sample(rest.join(room.where("take > 0"), ["site", "template"]), ("site", "template"), F.col("take")).where("picked").drop("picked", "take").withColumn("extra", F.lit(1))
    every = chosen.unionByName(more)
    once = W.Window.partitionBy("site", "url").orderBy("priority", "extra", "template_ord", "ord")
    listed = every.withColumn("rank_", F.row_number().over(once)).where("rank_ = 1")
    best = numbered_within(listed, ("site",), [F.col(c) for c in ("priority", "extra", "template_ord", "ord")], "place")
    # A homepage that is not listed comes first and moves the others by one.
    home = site_urls.select("site").distinct().withColumn("url", F.concat(F.lit("https://"), "site", F.lit("/")))
    absent = written(home.join(best.select("site", "url"), ["site", "url"], "left_anti"))
    moved = best.join(absent.select("site", F.lit(1).alias("moved")), "site", "left")
    final = moved.select("site", (F.col("place") + 1 + F.coalesce("moved", F.lit(0))).cast("int").alias("place"), "url")
    final = final.unionByName(absent.select("site", F.lit(1).alias("place"), "url"))
    return final.where(F.col("place") <= cap) if cap > 0 else final


def planning_rollup(site_urls: DataFrame, sample: int = 5) -> DataFrame:
    """(group, url_count, template_diversity, multi_listed, sample_urls) of each sitemap group.

    Template diversity restarts the prefixes inside every group.
    """
    named = site_urls.withColumn("group", F.coalesce("sitemap", F.lit(UNSOURCED)))
    diversity = templated(named, ("group",)).groupBy("group").agg(F.countDistinct("template").alias("template_diversity"))
    counted = named.groupBy("group").agg(F.count(F.lit(1)).alias("url_count"), F.count_if(F.col("listings") > 1).alias("multi_listed"))
    picked = even_sample(named, ("group",), F.lit(sample)).where("picked")
    listed = picked.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("sample_urls"))
    return counted.join(diversity, "group").join(listed, "group")


def heuristic_intents(groups: DataFrame) -> DataFrame:
    """``groups`` plus ``intent`` by name and shape."""
    name = F.lower("group")
    utility = name.contains("tag") | name.contains("author") | name.contains("search") | name.contains("page-sitemap-")
    n, d = F.col("url_count"), F.col("template_diversity")
    intent = F.when(utility, "utility").when((n >= 200) & (n / F.greatest(F.lit(1), d) >= 100), "faceted").when((n <= 20) & (d <= 3), "hub").when(d > 3, "editorial").otherwise("unknown")
    return groups.withColumn("intent", intent)


def most_specific(listings: DataFrame) -> DataFrame:
    """(url, sitemap): of a URL's sitemaps the one of most telling name, longest path, last name."""
    where = urls.path(F.col("sitemap"))
    name = F.element_at(F.split(where, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rank = F.struct(F.when(stem.rlike(r"^\d+$"), 0).otherwise(1).alias("a"), (F.size(urls.segments(F.col("sitemap"))) + F.length(stem)).alias("b"), F.col("sitemap").alias("c"))
    return listings.groupBy("url").agg(F.max_by("sitemap", rank).alias("sitemap"))


def drift(previous: DataFrame, current: DataFrame, fold: float = 2.0, floor: int = 50) -> DataFrame:
    """(group, was, now, change): added, removed, or resized by ``fold`` and no small group; none without a past."""
    from ..functions.patterns import fold_change

    both = previous.select("group", F.col("n").alias("was")).join(current.select("group", F.col("n").alias("now")), "group", "full_outer")
    resized = (F.greatest("was", "now") >= floor) & (fold_change(F.col("was"), F.col("now")) >= fold)
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(resized, "resized")
    return both.withColumn("change", change).where("change is not null")
