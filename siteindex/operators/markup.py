"""Pages as tables of elements, and the checks of their markup that need no rendering.

An element is a row (page, pos, tag and the attributes that the checks look at). Checks
are groups and joins over these rows: labels meet inputs, references meet ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements and roles that give a page structure. Fixed values.
LANDMARK_TAGS = ("main", "nav", "article", "section", "header", "footer", "aside")
LANDMARK_ROLES = ("main", "banner", "navigation", "contentinfo", "complementary", "region", "article")
#: Elements that are no controls by nature. Fixed values.
PLAIN_TAGS = ("div", "span", "li")
UNLABELLED_TYPES = ("hidden", "submit", "button")
#: Roles of WAI-ARIA. Fixed values.
DEPRECATED_ROLES = {"directory": "list"}
ABSTRACT_ROLES = ("command", "composite", "input", "landmark", "range", "roletype", "section", "sectionhead", "select", "structure", "widget", "window")
VALID_ROLES = (
    "alert", "alertdialog", "application", "article", "banner", "blockquote", "button", "caption", "cell", "checkbox", "code", "columnheader",
    "combobox", "comment", "complementary", "contentinfo", "definition", "deletion", "dialog", "document", "emphasis", "feed", "figure", "form",
    "generic", "grid", "gridcell", "group", "heading", "img", "insertion", "link", "list", "listbox", "listitem", "log", "main", "mark", "marquee",
    "math", "menu", "menubar", "menuitem", "menuitemcheckbox", "menuitemradio", "meter", "navigation", "none", "note", "option", "paragraph",
    "presentation", "progressbar", "radio", "radiogroup", "region", "row", "rowgroup", "rowheader", "scrollbar", "search", "searchbox", "separator",
    "slider", "spinbutton", "status", "strong", "subscript", "suggestion", "superscript", "switch", "tab", "table", "tablist", "tabpanel", "term",
    "textbox", "time", "timer", "toolbar", "tooltip", "tree", "treegrid", "treeitem",
)
EXTENSION_ROLES = ("doc-", "graphics-")
REFERENCES = ("aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "for")
CHECKS = ("semantic-html", "roles", "labels", "aria-roles", "unique-ids")
SHOWN, PROBLEMS = 60, 4


def attribute(markup: Column, name: str) -> Column:
    """Value of an element's attribute, quoted or bare; null where it is absent."""
    pattern = rf"""(?is)^<[a-z][^>]*?[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    part = lambda i: F.regexp_extract(markup, pattern, i)
    return F.when(markup.rlike(pattern), F.trim(F.concat(part(1), part(2), part(3))))


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda x: x != "")


def elements(pages: DataFrame, key: str = "page") -> DataFrame:
    """(key, pos, tag, markup, id, role, type, label_for, named, focusable, refs) of pages (key, html)."""
    tags = F.regexp_extract_all("html", F.lit(r"(<[a-zA-Z][^>]*>)"), F.lit(1))
    rows = pages.select(key, F.posexplode(tags).alias("pos", "markup"))
    has = lambda *names: F.col("markup").rlike(rf"(?i)[\s\"'](?:{'|'.join(names)})\s*=")
    return rows.select(
        key,
        "pos",
        F.lower(F.regexp_extract("markup", "^<([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"),
        "markup",
        F.nullif(attribute(F.col("markup"), "id"), F.lit("")).alias("id"),
        F.lower(attribute(F.col("markup"), "role")).alias("role"),
        F.lower(attribute(F.col("markup"), "type")).alias("type"),
        attribute(F.col("markup"), "for").alias("label_for"),
        has("aria-label", "aria-labelledby").alias("named"),
        has("tabindex", "onclick").alias("focusable"),
        F.flatten(F.array(*[_tokens(attribute(F.col("markup"), a)) for a in REFERENCES])).alias("refs"),
    )


def repeated_ids(parts: DataFrame, key: str = "page") -> DataFrame:
    """(key, id, n, referenced): ids that several elements of a page have, and whether a label or ARIA attribute points at them."""
    twice = parts.where("id is not null").groupBy(key, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    targets = parts.select(key, F.explode("refs").alias("id")).distinct().withColumn("referenced", F.lit(True))
    return twice.join(targets, [key, "id"], "left").select(key, "id", "n", F.coalesce("referenced", F.lit(False)).alias("referenced"))


def unlabelled_inputs(parts: DataFrame, key: str = "page") -> DataFrame:
    """(key, pos, markup, labelled) of the inputs that need a label."""
    kind = F.coalesce("type", F.lit(""))
    inputs = parts.where((F.col("tag") == "input") & ~kind.rlike(f"^({'|'.join(UNLABELLED_TYPES)})"))
    labels = parts.where((F.col("tag") == "label") & (F.coalesce("label_for", F.lit("")) != "")).select(key, F.col("label_for").alias("id")).distinct()
    met = inputs.join(labels.withColumn("met", F.lit(True)), [key, "id"], "left")
    return met.select(key, "pos", "markup", (F.col("named") | F.coalesce("met", F.lit(False))).alias("labelled"))


def role_problems(parts: DataFrame, spark: SparkSession, key: str = "page") -> DataFrame:
    """(key, role, rank, problem) of every role a page uses, each once; problem is null for a current one."""
    known = [(r, 0, f"{r} is deprecated (use {x})") for r, x in DEPRECATED_ROLES.items()] + [(r, 1, f"{r} is an abstract role and was never valid in markup") for r in ABSTRACT_ROLES] + [(r, 3, None) for r in VALID_ROLES]
    table = spark.createDataFrame(known, "role string, rank int, problem string")
    used = parts.select(key, F.explode(_tokens(F.col("role"))).alias("role")).distinct()
    extension = F.col("role").rlike(f"^({'|'.join(EXTENSION_ROLES)})")
    unknown = F.when(~extension, F.concat("role", F.lit(" is not a role in any ARIA specification")))
    joined = used.join(F.broadcast(table), "role", "left")  # the fixed vocabulary
    return joined.select(key, "role", F.coalesce("rank", F.lit(2)).alias("rank"), F.when(F.col("rank").isNull(), unknown).otherwise(F.col("problem")).alias("problem"))


def _state(key: str, check: str, state: Column, detail: Column) -> list[Column]:
    return [F.col(key), F.lit(check).alias("check"), state.alias("state"), detail.alias("detail")]


def _said(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for v, piece in zip(values, pieces[1:], strict=True):
        out += [v.cast("string"), F.lit(piece)]
    return F.concat(*out)


def markup_checks(pages: DataFrame, key: str = "page") -> DataFrame:
    """(key, check, state, detail): the five static checks of every page (key, html); state is pass, fail or n/a."""
    spark = pages.sparkSession
    parts = elements(pages, key)
    every = pages.select(key)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))

    landmark = F.coalesce(
        *[F.when(F.col("tag") == t, F.struct(F.lit(0).alias("kind"), F.lit(i).alias("at"), F.lit(t).alias("name"))) for i, t in enumerate(LANDMARK_TAGS)],
    )
    role = F.regexp_extract(F.coalesce("role", F.lit("")), f"^({'|'.join(LANDMARK_ROLES)})", 1)
    marks = parts.select(key, F.explode(F.array_compact(F.array(landmark, F.when(role != "", F.struct(F.lit(1).alias("kind"), F.lit(0).alias("at"), role.alias("name")))))).alias("m"))
    sets = marks.groupBy(key).agg(F.array_sort(F.collect_set("m")).alias("m"))  # at most fourteen
    tags = F.transform(F.filter("m", lambda x: x["kind"] == 0), lambda x: x["name"])
    roles = F.filter(F.transform(F.filter("m", lambda x: x["kind"] == 1), lambda x: x["name"]), lambda x: ~F.array_contains(tags, x))
    found = F.coalesce(F.concat(tags, F.transform(roles, lambda x: F.concat(F.lit("role="), x))), F.array().cast("array<string>"))
    semantic = every.join(sets, key, "left").withColumn("found", found)
    enough = F.size("found") >= 3
    missing = _said("only {} found; agents walking the accessibility tree have little structure to navigate", F.coalesce(F.nullif(F.array_join("found", ", "), F.lit("")), F.lit("none")))
    first = semantic.select(*_state(key, CHECKS[0], F.when(enough, "pass").otherwise("fail"), F.when(enough, F.concat(F.lit("landmarks: "), F.array_join(F.slice("found", 1, 6), ", "))).otherwise(missing)))

    loose = F.col("tag").isin(*PLAIN_TAGS) & F.col("focusable")
    bare = loose & F.col("role").isNull()
    clicks = parts.groupBy(key).agg(F.count_if(loose).alias("all"), F.count_if(bare).alias("bad"), F.min_by("markup", F.when(bare, F.col("pos"))).alias("eg"))
    fine = n("bad") == 0
    detail = F.when(n("all") == 0, "no focusable or clickable div in the markup").when(fine, _said("{} focusable element(s), all with a role", n("all"))).otherwise(_said("{} of {} focusable element(s) have no role, e.g. {}; an agent walking the tree cannot tell what they do", n("bad"), n("all"), F.left("eg", F.lit(SHOWN))))
    second = every.join(clicks, key, "left").select(*_state(key, CHECKS[1], F.when(fine, "pass").otherwise("fail"), detail))

    inputs = unlabelled_inputs(parts, key).groupBy(key).agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("labelled")).alias("bad"))
    detail = F.when(n("all") == 0, "no form inputs on this page").when(fine, _said("{} input(s), all labelled", n("all"))).otherwise(_said("{} of {} input(s) have no label", n("bad"), n("all")))
    third = every.join(inputs, key, "left").select(*_state(key, CHECKS[2], F.when(n("all") == 0, "n/a").when(fine, "pass").otherwise("fail"), detail))

    problem = F.struct("rank", "role", "problem")
    used = role_problems(parts, spark, key).groupBy(key).agg(F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), problem))).alias("p"))
    none = F.coalesce(F.size("p"), F.lit(0)) == 0
    detail = F.when(n("all") == 0, "no ARIA roles on this page").when(none, _said("{} role(s), all current", n("all"))).otherwise(F.array_join(F.transform(F.slice("p", 1, PROBLEMS), lambda x: x["problem"]), "; "))
    fourth = every.join(used, key, "left").select(*_state(key, CHECKS[3], F.when(n("all") == 0, "n/a").when(none, "pass").otherwise("fail"), detail))

    ids = parts.where("id is not null").groupBy(key).agg(F.count(F.lit(1)).alias("all"))
    twice = repeated_ids(parts, key).groupBy(key).agg(F.count(F.lit(1)).alias("bad"), F.min("id").alias("eg"), F.count_if("referenced").alias("wrong"), F.min(F.when(F.col("referenced"), F.col("id"))).alias("wrong_eg"))
    pointed = _said("{} duplicated id(s) are the target of an ARIA or label reference, e.g. {} -- those relationships resolve to the wrong element", n("wrong"), F.coalesce("wrong_eg", F.lit("")))
    detail = F.when(n("all") == 0, "no element ids on this page").when(fine, _said("{} id(s), all unique", n("all"))).when(n("wrong") > 0, pointed).otherwise(_said("{} duplicated id(s), e.g. {}", n("bad"), F.coalesce("eg", F.lit(""))))
    fifth = every.join(ids, key, "left").join(twice, key, "left").select(*_state(key, CHECKS[4], F.when(n("all") == 0, "n/a").when(fine, "pass").otherwise("fail"), detail))
    return first.unionByName(second).unionByName(third).unionByName(fourth).unionByName(fifth)
