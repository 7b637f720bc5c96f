"""Markdown documents as tables of lines, and rules that aggregate them to findings.

Each rule gives one finding for a document: pass, fail with a count, or skipped where
what it needs was not given. Skipped rules leave the score's denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Words of the description and hygiene rules. Fixed values.
OPENERS = ("learn", "discover", "explore", "understand", "find out", "dive into", "unlock")
SUPERLATIVES = ("award-winning", "best", "leading", "top", "world-class", "dominate", "ultimate", "premier", "cutting-edge", "proven", "expert")
LOCALE_PAIRS = (
    ("optimize", "optimise"), ("analyze", "analyse"), ("organize", "organise"), ("recognize", "recognise"), ("prioritize", "prioritise"),
    ("specialize", "specialise"), ("customize", "customise"), ("maximize", "maximise"), ("color", "colour"), ("center", "centre"),
    ("catalog", "catalogue"), ("license", "licence"), ("behavior", "behaviour"), ("favorite", "favourite"),
)
IDENTITY = ("/about", "/about-us", "/contact", "/case-stud", "/our-work", "/portfolio", "/team", "/testimonial", "/clients")
AUTH = ("/login", "/signin", "/sign-in", "/account", "/admin", "/wp-admin", "/cart", "/checkout")
TRANSACTIONS = ("checkout", "add to cart", "place an order", "complete the purchase", "submit payment")
#: Weights and caps of a score by severity. Fixed values.
SEVERITY_WEIGHT = {"error": 5.0, "warning": 2.0, "info": 1.0}
SCORE_CAP = {"error": 49, "warning": 79}

#: Patterns of the line format. Fixed values.
LINK = r"^\s*-\s+\[([^\]]*)\]\(([^)\s]*)\)\s*(?:[:–—-]\s*(.*))?$"
HEADING = r"^(#{1,6})\s+(.*)$"
BREAK = r"^\s*(?:-(?:\s*-){2,}|\*(?:\s*\*){2,}|_(?:\s*_){2,})\s*$"
EMPHASISED = r"^\s*(?:\*[^\s].*\*|_[^\s].*_)\s*$"
FOOTER = r"^\s*(?:---+|\*[^*].*\*|_[^_].*_|<!--.*-->)\s*$"
SOURCE = r"^Source:\s*(\S+)\s*$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc, line, raw, level, heading, section, section_no, is_link, malformed, title, url, description).

    Fences toggle, so a line is inside one if the number of fence lines so far is odd.
    Sections start at level-2 headings; the current one is the last seen.
    """
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    by = W.Window.partitionBy("doc").orderBy("line")
    fence = F.ltrim("raw").rlike(r"^(```|~~~)")
    so_far = F.sum(fence.cast("int")).over(by.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    rows = rows.withColumn("fenced", fence | (so_far % 2 == 1))
    level = F.when(~F.col("fenced") & F.col("raw").rlike(HEADING), F.length(F.regexp_extract("raw", HEADING, 1)))
    rows = rows.withColumn("level", level).withColumn("heading", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("raw", HEADING, 2))))
    rows = rows.withColumn("section", F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(by))
    rows = rows.withColumn("section_no", F.sum((F.col("level") == 2).cast("int")).over(by))
    item = F.trim("raw").rlike(r"^[-*]") & ~F.col("raw").rlike(BREAK) & ~F.col("raw").rlike(EMPHASISED) & F.col("raw").contains("](")
    rows = rows.withColumn("is_link", F.col("section").isNotNull() & F.coalesce(F.col("level") != 2, F.lit(True)) & item)
    fine = F.col("raw").rlike(LINK)
    part = lambda i: F.when(F.col("is_link") & fine, F.trim(F.regexp_extract("raw", LINK, i)))
    return rows.select("*", (F.col("is_link") & ~fine).alias("malformed"), part(1).alias("title"), part(2).alias("url"), part(3).alias("description")).drop("fenced")


def findings(stats: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(doc, rule_id, severity, outcome, count): one row for each document and rule."""
    each = [F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.expr(e).cast("bigint").alias("count")) for r, (s, e) in rules.items()]
    rows = stats.select("doc", F.explode(F.array(*each)).alias("f")).select("doc", "f.*")
    return rows.withColumn("outcome", F.when(F.col("count").isNull(), "skipped").when(F.col("count") > 0, "fail").otherwise("pass"))


def report(found: DataFrame) -> DataFrame:
    """(doc, score, capped_by) of findings: share of applicable weight that passed, half-even, capped by the worst failure."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in SEVERITY_WEIGHT.items()])
    applicable, passed = F.col("outcome") != "skipped", F.col("outcome") == "pass"
    sums = found.groupBy("doc").agg(
        F.coalesce(F.sum(F.when(applicable, weight)), F.lit(0.0)).alias("applicable"),
        F.coalesce(F.sum(F.when(passed, weight)), F.lit(0.0)).alias("passed"),
        F.bool_or((F.col("severity") == "error") & (F.col("outcome") == "fail")).alias("error"),
        F.bool_or((F.col("severity") == "warning") & (F.col("outcome") == "fail")).alias("warning"),
    )
    raw = F.when(F.col("applicable") > 0, F.bround(100 * F.col("passed") / F.col("applicable"), 0)).otherwise(0)
    cap = F.when(F.col("error"), SCORE_CAP["error"]).when(F.col("warning"), SCORE_CAP["warning"]).otherwise(100)
    by = F.when(F.col("error"), "error").when(F.col("warning"), "warning")
    return sums.select("doc", F.least(raw, cap).cast("bigint").alias("score"), by.alias("capped_by"))


def companions(docs: DataFrame) -> DataFrame:
    """(doc, url): the companion files that documents (doc, text) refer to, by link or bare address."""
    links = F.filter(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), lambda u: u.contains("llms-full.txt") | u.contains("llms.txt"))
    bare = F.regexp_extract_all("text", F.lit(r"https?://\S*llms-full\.txt"), F.lit(0))
    return docs.select("doc", F.explode(F.array_union(links, bare)).alias("url"))


def full_pages(parsed: DataFrame) -> DataFrame:
    """``parsed`` plus ``source``, ``boundary`` (an H2 with a source within six lines) and ``page_no``."""
    by = W.Window.partitionBy("doc").orderBy("line")
    source = F.when(F.col("raw").rlike(SOURCE), F.regexp_extract("raw", SOURCE, 1))
    rows = parsed.withColumn("source", source)
    rows = rows.withColumn("boundary", F.coalesce((F.col("level") == 2) & F.max(F.col("source").isNotNull()).over(by.rowsBetween(1, 6)), F.lit(False)))
    return rows.withColumn("page_no", F.sum(F.col("boundary").cast("int")).over(by))


def repeated_blocks(pages: DataFrame, least_chars: int = 200, more_than: int = 3) -> DataFrame:
    """(doc, blocks, wasted_tokens): blocks that occur on more than ``more_than`` pages (doc, page, body)."""
    split = pages.select("doc", "page", F.explode(F.split("body", r"\n\s*\n")).alias("block"))
    rows = split.withColumn("block", F.btrim(F.regexp_replace("block", r"\s+", " "))).where(F.length("block") >= least_chars).distinct()
    counted = rows.groupBy("doc", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return counted.groupBy("doc").agg(F.count(F.lit(1)).alias("blocks"), F.floor(F.sum(F.length("block") * (F.col("n") - 1)) / 4).alias("wasted_tokens"))


#: Patterns and phrases of the agents rules. Fixed values.
PHONE = r"(?<![\w-])(?:\+\d{1,3}[\s-]?)?(?:\(\d{2,4}\)[\s-]?|\d{2,4}[\s-])\d{3,4}[\s-]?\d{3,4}(?![\w-])"
URL_IN_TEXT = r"https?://[^\s<>\")\]`]+"
CLAIMS = ("conforms to the agents.md spec", "compliant with agents.md")


def agent_measures(docs: DataFrame) -> DataFrame:
    """Measures of agents documents in one row each; no line table is needed.

    Columns: doc, text, shop, host (of the site, without www.), verified_hosts, broken (links
    that did not resolve; null: not checked), content_type (null: not fetched).
    """
    t = F.col("text")
    low = F.lower(t)
    before = F.substring_index(low, "## not supported", 1)
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: before.contains(w)))
    count = lambda p: F.regexp_count(t, F.lit(p))
    undated = F.regexp_replace(t, r"\d{4}-\d{2}-\d{2}", " ")
    phones = F.filter(F.regexp_extract_all(undated, F.lit(PHONE), F.lit(0)), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 8)
    hosts = F.transform(F.regexp_extract_all(t, F.lit(URL_IN_TEXT), F.lit(0)), lambda u: F.lower(F.regexp_extract(u, "^https?://([^/?#]*)", 1)))
    trusted = F.array_compact(F.array_union(F.array(F.col("host"), F.lit("ucp.dev")), F.coalesce("verified_hosts", F.array().cast("array<string>"))))
    paths = F.filter(F.split(t, "\n"), lambda x: x.rlike("`/([^/`][^`]*)?`") & ~x.contains("://") & F.ltrim(x).startswith("-"))
    return docs.select(
        "doc",
        "shop",
        count(r"(?m)^#\s").alias("h1s"),
        count(r"(?m)^##\s").alias("h2s"),
        F.length(F.trim(t)).alias("chars"),
        hits(TRANSACTIONS).alias("transactions"),
        F.regexp_count(t, F.lit(r"[\w.+-]+@[\w-]+\.[\w.-]+")).alias("emails"),
        F.size(phones).alias("phones"),
        F.size(paths).alias("relative"),
        t.contains("## Not supported").alias("limits"),
        t.rlike(r"(^|[^\p{L}\p{N}_])20\d{2}-\d{2}-\d{2}([^\p{L}\p{N}_]|$)").alias("dated"),
        F.when(F.col("host").isNotNull(), F.size(F.filter(hosts, lambda h: ~F.exists(trusted, lambda x: (x != "") & h.contains(x))))).alias("offsite"),
        F.size(F.filter(F.array(*[F.lit(x) for x in CLAIMS]), lambda x: low.contains(x))).alias("claims"),
        t.contains("llms.txt").alias("pointer"),
        "broken",
        "content_type",
    )


AGENT_RULES: dict[str, tuple[str, str]] = {
    "AGT-001": ("error", "case when h1s = 1 then 0 else 1 end"),
    "AGT-002": ("error", "case when h2s > 0 then 0 else 1 end"),
    "AGT-003": ("error", "case when chars >= 80 then 0 else 1 end"),
    "AGT-005": ("error", "case when shop is null then null when shop then 0 else transactions end"),
    "AGT-006": ("error", "emails + phones"),
    "AGT-007": ("error", "broken"),
    "AGT-008": ("warning", "relative"),
    "AGT-009": ("warning", "offsite"),
    "AGT-010": ("warning", "case when limits then 0 else 1 end"),
    "AGT-011": ("warning", "case when claims > 0 then 1 else 0 end"),
    "AGT-012": ("info", "case when dated then 0 else 1 end"),
    "AGT-013": ("info", "case when pointer then 0 else 1 end"),
    "AGT-014": ("error", "case when content_type is null then null when contains(content_type, 'html') then 1 when content_type <> '' and not (contains(content_type, 'text/markdown') or contains(content_type, 'text/plain') or contains(content_type, 'text/x-markdown')) then 1 else 0 end"),
}
