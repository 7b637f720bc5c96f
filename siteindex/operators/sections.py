"""Sections of an index: grouping, consolidation, order, and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranking, urls
from ..functions.order import numbered_within
from ..lineage import written

PINNED_FIRST = ("Main",)
PINNED_LAST = ("Contact", "Optional")
CATCH_ALL = "Pages"
LEAST_PAGES, FLAT_SHARE = 2, 0.6
#: Section order of each kind of site. Fixed values.
TEMPLATES = {
    "agency_services": ("Services", "Locations", "Industries", "Guides and Research", "Company", "Contact", "Optional"),
    "professional_services": ("Practice Areas", "People", "Insights", "Company", "Contact", "Optional"),
    "local_multi_location": ("Services", "Locations", "Company", "Contact", "Optional"),
    "ecommerce_retail": ("Categories", "Buying Guides", "Shipping and Returns", "Brand", "Contact", "Optional"),
    "publisher_media": ("Sections", "Flagship Reporting", "About and Standards", "Contact", "Optional"),
    "saas_product": ("Product", "Documentation", "API Reference", "Guides", "Pricing", "Company", "Contact", "Optional"),
    "catalog": ("Getting Started", "Core Concepts", "Guides", "API Reference", "Integrations", "Resources", "Contact", "Optional"),
    "workflow": ("Quickstart", "Setup & Configuration", "Features", "Workflows", "Troubleshooting", "Reference", "Contact", "Optional"),
    "index_export": ("Overview", "Documentation", "Tutorials", "API", "Examples", "Contact", "Optional"),
    "ecommerce": ("Brand Overview", "Product Categories", "Brand Portfolio", "Shopping Help", "Customer Service", "Store Locator", "Important Pages", "Contact", "Optional"),
}


def group_by_url(entries: DataFrame) -> DataFrame:
    """Main entries plus ``section``: Contact pages, else the first path segment."""
    section = F.when(ranking.is_contact(), F.lit("Contact")).otherwise(urls.section_of(F.col("url")))
    return entries.where(~ranking.is_optional()).withColumn("section", section)


def consolidate(pages: DataFrame) -> DataFrame:
    """Sections of one page become one, where most of a site's sections have one page."""
    sizes = pages.groupBy("site", "section").agg(F.count(F.lit(1)).alias("size_"))
    sizes = sizes.withColumn("single_", (F.col("size_") < LEAST_PAGES) & (F.col("section") != "Contact"))
    shape = sizes.groupBy("site").agg(F.count(F.lit(1)).alias("sections_"), F.count_if("single_").alias("singles_"))
    flat = (F.col("sections_") >= 3) & (F.col("singles_") / F.col("sections_") >= FLAT_SHARE)
    renamed = sizes.join(shape.select("site", flat.alias("flat_")), "site")
    renamed = renamed.select("site", "section", F.when(F.col("flat_") & F.col("single_"), F.lit(CATCH_ALL)).otherwise(F.col("section")).alias("new_"))
    return pages.join(renamed, ["site", "section"]).withColumn("section", F.col("new_")).drop("new_")


def section_rank(section: Column, pattern: str) -> Column:
    """Sort key: pinned first, the template's order, the rest by name, pinned last; null for Optional."""
    order = [s for s in TEMPLATES.get(pattern, TEMPLATES["catalog"]) if s not in PINNED_FIRST + PINNED_LAST]
    key = F.coalesce(
        *[F.when(section == s, F.struct(F.lit(0).alias("bucket"), F.lit(i).alias("at"), F.lit("").alias("name"))) for i, s in enumerate(PINNED_FIRST)],
        *[F.when(section == s, F.struct(F.lit(1).alias("bucket"), F.lit(i).alias("at"), F.lit("").alias("name"))) for i, s in enumerate(order)],
        *[F.when(section == s, F.struct(F.lit(3).alias("bucket"), F.lit(i).alias("at"), F.lit("").alias("name"))) for i, s in enumerate(PINNED_LAST)],
        F.struct(F.lit(2).alias("bucket"), F.lit(0).alias("at"), section.alias("name")),
    )
    return F.when(section != "Optional", key)


def ordered_sections(pages: DataFrame, pattern: str) -> DataFrame:
    """(site, section, pages, position) of the sections that have pages, Optional left out."""
    sizes = pages.groupBy("site", "section").agg(F.count(F.lit(1)).alias("pages")).withColumn("rank_", section_rank(F.col("section"), pattern)).where("rank_ is not null")
    return sizes.withColumn("position", F.row_number().over(W.Window.partitionBy("site").orderBy("rank_")) - 1).drop("rank_")


def manual_order(sections: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(site, section, position): listed sections first, the rest by name."""
    at = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(order)])
    rank = W.Window.partitionBy("site").orderBy(at.asc_nulls_last(), "section")
    return sections.withColumn("position", F.row_number().over(rank) - 1)


def render_index(pages: DataFrame, optional: DataFrame, pattern: str, generated: str, summaries: DataFrame | None = None) -> DataFrame:
    """(site, body): the index text of every site over (site, section, url, display_title, description, score, ord)."""
    line = F.concat(F.lit("- ["), F.col("display_title"), F.lit("]("), F.col("url"), F.lit("): "), F.col("description"))
    entry = F.struct((-F.col("score")).alias("a"), F.col("ord").alias("b"), line.alias("line"))
    lines_of = lambda e: F.array_join(F.transform(F.array_sort(e), lambda x: x["line"]), "\n")
    blocks = pages.groupBy("site", "section").agg(lines_of(F.collect_list(entry)).alias("lines"))
    blocks = blocks.withColumn("rank", section_rank(F.col("section"), pattern)).where("rank is not null")
    block = F.concat(F.lit("\n## "), F.col("section"), F.lit("\n\n"), F.col("lines"))
    bodies = blocks.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n").alias("sections"))
    extra = optional.groupBy("site").agg(lines_of(F.collect_list(entry)).alias("optional"))
    both = bodies.join(extra, "site", "full_outer")
    head = F.concat(F.lit("# "), F.col("site"), F.lit("\n\n> Official website content for "), F.col("site"), F.lit(".\n\nFor full page content, see ["), F.col("site"), F.lit("/llms-full.txt](https://"), F.col("site"), F.lit("/llms-full.txt)"))
    foot = F.lit(f"\n---\n*Generated {generated}. Recommend reviewing quarterly or after major site changes.*\n")
    tail = F.when(F.col("optional").isNotNull(), F.concat(F.lit("\n## Optional\n\n"), F.col("optional")))
    return both.select("site", F.concat(F.concat_ws("\n", head, "sections", tail, foot), F.lit("\n")).alias("body"))


def _taken(blocks: DataFrame, room: DataFrame, folded: int) -> DataFrame:
    """(site, place) of the blocks (site, place, size) that a greedy pass takes, in order of place, into ``room`` (site, room).

    A round takes every block before the first that overflows, by running sums in
    buckets of places; that block and all larger than what is left can never be taken.
    What remains of a site is folded in one array once it has at most ``folded`` blocks.
    """
    parts: list[DataFrame] = []
    left = blocks.join(room, "site").where("size <= room")
    while True:
        left = written(left)
        most = left.groupBy("site").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        if most <= folded:
            parts.append(_folded(left))
            break
        bucket = F.floor(F.col("place") / folded)
        sums = left.groupBy("site", bucket.alias("bucket")).agg(F.sum("size").alias("all_"))
        ahead = W.Window.partitionBy("site").orderBy("bucket")
        offsets = sums.select("site", "bucket", (F.sum("all_").over(ahead) - F.col("all_")).alias("ahead"))
        inside = W.Window.partitionBy("site", "bucket").orderBy("place")
        running = left.withColumn("bucket", bucket).join(offsets, ["site", "bucket"]).withColumn("upto", F.sum("size").over(inside) + F.col("ahead"))
        running = written(running.drop("bucket", "ahead"))
        # A site without overflow is done: all its blocks are taken.
        over = running.where("upto > room").groupBy("site").agg(F.min("place").alias("over"))
        marked = running.join(over, "site", "left")
        first = marked.where("over is null or place < over")
        parts.append(written(first.select("site", "place")))
        spent = first.groupBy("site").agg(F.sum("size").alias("spent"))
        rest = marked.where("place > over").join(spent, "site", "left").withColumn("room", F.col("room") - F.coalesce("spent", F.lit(0)))
        left = rest.where("size <= room").select("site", "place", "size", "room")
    if not parts:
        return blocks.select("site", "place").where(F.lit(False))
    taken = parts[0]
    for p in parts[1:]:
        taken = taken.unionByName(p)
    return taken


def _folded(left: DataFrame) -> DataFrame:
    sites = left.groupBy("site").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("place", "size"))).alias("blocks"))
    start = F.struct(F.col("room").cast("bigint").alias("room"), F.array().cast("array<bigint>").alias("taken"))

    def step(s, x):
        fits = x["size"] <= s["room"]
        return F.struct((s["room"] - F.when(fits, x["size"]).otherwise(0)).cast("bigint").alias("room"), F.when(fits, F.array_append(s["taken"], x["place"])).otherwise(s["taken"]).alias("taken"))

    return sites.select("site", F.explode(F.aggregate("blocks", start, step)["taken"]).alias("place"))


def greedy_full(pages: DataFrame, max_chars: int, folded: int = 10_000) -> DataFrame:
    """(site, body, omitted): blocks in order of score as long as they fit; smaller later ones still can.

    The choice is made on sizes and places alone. Texts are joined to what was taken,
    which is at most ``max_chars`` characters a site.
    """
    block = F.concat(F.lit("\n---\n\n## "), F.col("display_title"), F.lit("\n\nSource: "), F.col("url"), F.lit("\n\n"), F.col("markdown"), F.lit("\n"))
    head = F.concat(F.lit("# "), F.col("site"), F.lit("\n"))
    shown = pages.where("markdown <> ''")
    sized = shown.select("site", "ord", "score", F.length(block).cast("bigint").alias("size"))
    totals = written(sized.groupBy("site").agg(F.count(F.lit(1)).alias("blocks")).withColumn("room", (F.lit(max_chars) - F.length(head)).cast("bigint")))
    small = sized.where(F.col("size") <= F.lit(max_chars) - F.length(head))
    placed = written(numbered_within(small, ("site",), [F.desc("score"), F.col("ord")], "place").select("site", "ord", "place", "size"))
    taken = placed.join(_taken(placed.drop("ord"), totals.select("site", "room"), folded), ["site", "place"]).select("site", "ord", "place")
    texts = shown.join(taken, ["site", "ord"]).select("site", "place", block.alias("block"))
    bodies = texts.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("b"))
    joined = totals.join(bodies, "site", "left").withColumn("b", F.coalesce("b", F.array().cast(bodies.schema["b"].dataType)))
    omitted = F.col("blocks") - F.size("b")
    note = F.concat(F.lit("\n---\n\n*"), omitted.cast("string"), F.lit(f" lower-priority page(s) omitted to keep this file under {max_chars:,} characters.*\n"))
    body = F.concat(head, F.array_join(F.transform("b", lambda x: x["block"]), ""), F.when(omitted > 0, note).otherwise(""))
    return joined.select("site", body.alias("body"), omitted.cast("bigint").alias("omitted"))
