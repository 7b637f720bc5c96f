"""Review of generated files: validator checks, copy of link lines, summaries that must agree, edit gates.

Each check is an aggregate or an expression over a document's text or link rows, so
that any number of documents is reviewed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Openers, superlatives and spellings of link-line copy. Fixed values.
COPY_OPENERS = ("learn", "discover", "explore", "understand", "find out", "gain", "dive into", "unlock", "get to know", "read about", "take a look")
COPY_SUPERLATIVES = (
    "award-winning", "best", "leading", "top", "world-class", "dominate", "ultimate", "premier", "cutting-edge", "proven", "expert",
    "best-in-class", "unrivalled", "unrivaled", "market-leading",
)
COPY_LOCALES = (
    ("optimize", "optimise"), ("optimization", "optimisation"), ("analyze", "analyse"), ("organize", "organise"), ("recognize", "recognise"),
    ("prioritize", "prioritise"), ("specialize", "specialise"), ("customize", "customise"), ("maximize", "maximise"), ("minimize", "minimise"),
    ("personalize", "personalise"), ("color", "colour"), ("center", "centre"), ("catalog", "catalogue"), ("behavior", "behaviour"),
    ("favorite", "favourite"), ("license", "licence"), ("program", "programme"), ("traveled", "travelled"),
)
MIN_DESCRIPTION, MAX_DESCRIPTION, MAX_TITLE = 25, 160, 60
#: Validator limits, hints and patterns. Fixed values.
SIZE_WARN_KB = 50
CONTACT_HINTS = ("contact", "customer-service", "store-locator", "support")
LINK_LINE = r"^- \[.+\]\(https?://.+\): ?"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)]+)\)"
HTML_TAG = r"<(div|span|a |p |img |script|style)"
LEVELS = ("error", "warning", "info")
#: A position that is no inside of a word, in either engine's regular expressions.
EDGE = r"(^|$|[^\p{L}\p{N}_])"

#: Validator checks: level and the count of faults over ``validator_measures``.
VALIDATOR: dict[str, tuple[str, str]] = {
    "size": ("warning", f"case when bytes > {SIZE_WARN_KB * 1024} then 1 else 0 end"),
    "h1": ("error", "case when titled then 0 else 1 end"),
    "blockquote": ("error", "case when quoted then 0 else 1 end"),
    "sections": ("info", "case when sectioned then 0 else 1 end"),
    "relative-url": ("error", "relative"),
    "link-format": ("warning", "malformed"),
    "html": ("warning", "case when html then 1 else 0 end"),
    "contact": ("info", "case when contact then 0 else 1 end"),
    "full-reference": ("info", "case when companion then 0 else 1 end"),
}


def validator_measures(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """What the validator looks at, for documents (doc, text) and their pages (doc, url, title)."""
    lines = F.split("text", "\n")
    links = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(MARKDOWN_LINK), F.lit(1))))
    listed = F.filter(lines, lambda x: x.startswith("- "))
    hint = F.lower("url").rlike("|".join(CONTACT_HINTS)) | F.lower(F.coalesce("title", F.lit(""))).contains("contact")
    hinted = pages.groupBy("doc").agg(F.bool_or(hint).alias("hinted"))
    return docs.join(hinted, "doc", "left").select(
        "doc",
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.col("text").startswith("# ").alias("titled"),
        F.exists(F.slice(lines, 1, 5), lambda x: x.startswith(">")).alias("quoted"),
        F.col("text").contains("## ").alias("sectioned"),
        F.size(F.filter(links, lambda x: ~x.rlike("^https?://"))).alias("relative"),
        F.size(F.filter(listed, lambda x: ~x.rlike(LINK_LINE))).alias("malformed"),
        F.lower("text").rlike(HTML_TAG).alias("html"),
        (F.col("text").contains("## Contact") | F.coalesce("hinted", F.lit(False))).alias("contact"),
        F.col("text").contains("llms-full.txt").alias("companion"),
    )


def link_issues(links: DataFrame, status: DataFrame, shown: int = 5) -> DataFrame:
    """(doc, level, code, broken, examples): one warning for each document with links (doc, url) that did not resolve."""
    probed = links.distinct().join(status, "url")
    bad = probed.where(F.col("status").isNull() | (F.col("status") >= 400))
    named = F.concat("url", F.lit(" ("), F.coalesce(F.col("status").cast("string"), F.lit("unreachable")), F.lit(")"))
    first = F.row_number().over(W.Window.partitionBy("doc").orderBy("url"))
    rows = bad.select("doc", named.alias("name"), first.alias("n"))
    found = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("broken"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.col("name")))), ", ").alias("examples"))
    return found.select("doc", F.lit("warning").alias("level"), F.lit("broken-link").alias("code"), "broken", "examples")


def worst_level(found: DataFrame) -> DataFrame:
    """(doc, level) of findings (doc, severity, outcome): the worst failure, or ok."""
    rank = F.coalesce(*[F.when((F.col("outcome") == "fail") & (F.col("severity") == s), F.lit(k)) for k, s in enumerate(LEVELS)], F.lit(len(LEVELS)))
    names = F.array(*[F.lit(x) for x in (*LEVELS, "ok")])
    return found.groupBy("doc").agg(F.get(names, F.min(rank)).alias("level"))


def copy_problems(title: Column, description: Column) -> Column:
    """Names of what is wrong with one link line, in order; a line without description has no other fault of it."""
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    some = d != ""
    tests = {
        "no title": t == "",
        "long title": F.length(t) > MAX_TITLE,
        "no description": ~some,
        "short description": some & (F.length(d) < MIN_DESCRIPTION),
        "long description": F.length(d) > MAX_DESCRIPTION,
        "opener": F.lower(d).rlike("^(" + "|".join(COPY_OPENERS) + ")"),
        "superlative": F.lower(d).rlike(EDGE + "(" + "|".join(COPY_SUPERLATIVES) + ")" + EDGE),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def duplicate_descriptions(entries: DataFrame) -> DataFrame:
    """(scope, ord, url, first_url): entries whose description another URL of the scope had before (scope, ord, url, description)."""
    key = F.lower(F.trim("description"))
    by = W.Window.partitionBy("scope", "key").orderBy("ord")
    rows = entries.withColumn("key", key).where("key <> ''").withColumn("first_url", F.first("url").over(by))
    return rows.where("first_url <> url").select("scope", "ord", "url", "first_url")


def locale_conflicts(text: Column) -> Column:
    """The pairs of which a text spells both ways, in order of the list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return F.transform(F.array(words), lambda w: F.array_compact(F.array(*[F.when(F.array_contains(w, a) & F.array_contains(w, b), F.lit(f"{a} / {b}")) for a, b in COPY_LOCALES])))[0]


def blockquotes(docs: DataFrame) -> DataFrame:
    """(doc, quote): the first quoted line of each document (doc, text), trimmed; empty if there is none."""
    return docs.select("doc", F.trim(F.regexp_extract("text", r"(?m)^> ?(.*)$", 1)).alias("quote"))


def summaries_agree(index: DataFrame, full: DataFrame) -> DataFrame:
    """(doc, outcome) of index and full documents: skipped without either, failed where the full one has no quote or another one."""
    both = blockquotes(index).withColumnRenamed("quote", "mine").join(blockquotes(full).withColumnRenamed("quote", "other"), "doc", "full")
    fails = (F.col("other") == "") | ((F.col("mine") != "") & (F.col("mine") != F.col("other")))
    return both.select("doc", F.when(F.col("mine").isNull() | F.col("other").isNull(), "skipped").when(fails, "fail").otherwise("pass").alias("outcome"))


def edit_gate(was: DataFrame, now: DataFrame) -> DataFrame:
    """(run, rolled_back, broke): edits are kept unless ``now`` has error codes (run, code) that ``was`` has not.

    ``broke`` has the new codes in order; runs without errors after the edit are kept.
    """
    fresh = now.select("run", "code").distinct().join(was.select("run", "code").distinct(), ["run", "code"], "left_anti")
    new = fresh.groupBy("run").agg(F.array_join(F.sort_array(F.collect_set("code")), ", ").alias("broke"))
    runs = was.select("run").unionByName(now.select("run")).distinct()
    return runs.join(new, "run", "left").select("run", F.col("broke").isNotNull().alias("rolled_back"), F.coalesce("broke", F.lit("")).alias("broke"))


def gated(before: DataFrame, after: DataFrame, gate: DataFrame) -> DataFrame:
    """The rows (run, ...) that are stored: those after the edit, or before it for runs that are rolled back."""
    kept = after.join(gate.where("not rolled_back").select("run"), "run", "left_semi")
    return kept.unionByName(before.join(gate.where("rolled_back").select("run"), "run", "left_semi"))


def run_stages(stages: DataFrame, cancellations: DataFrame) -> DataFrame:
    """(run, done, status): stages (run, seq, started) begin unless a cancellation (run, at) came before.

    A stage that has begun runs to its end; no later stage starts after a request.
    """
    # Runs are many and stages more: hash joins hold a row for each cancelled run, and no stages are sorted.
    at = cancellations.groupBy("run").agg(F.min("at").alias("at"))
    first = stages.join(at.hint("shuffle_hash"), "run").where("started >= at").groupBy("run").agg(F.min("seq").alias("first"), F.lit(True).alias("any"))
    # The first stage that is stopped stops all that follow it; those without a place come last.
    stopped = F.when(F.col("seq").isNull(), F.col("any").isNotNull()).otherwise(F.coalesce(F.col("seq") >= F.col("first"), F.lit(False)))
    rows = stages.join(first.hint("shuffle_hash"), "run", "left").withColumn("stopped", stopped)
    return rows.groupBy("run").agg(F.count_if(~F.col("stopped")).alias("done"), F.when(F.bool_or("stopped"), "cancelled").otherwise("done").alias("status"))
