"""What a site publishes for agents: probes, HTML checks, components, states, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components: family, priority, layer, effort, applies to (content, app_api, ecommerce), artifact, templated. Fixed values.
COMPONENTS = (
    ("cls", "page", "Must", 1, "code_change", "YYY", "", False),
    ("semantic-html", "page", "Must", 1, "code_change", "YYY", "", False),
    ("roles", "page", "Must", 1, "code_change", "YYY", "", False),
    ("cursor", "page", "Must", 1, "code_change", "YYY", "", False),
    ("labels", "page", "Must", 1, "code_change", "YYY", "", False),
    ("tap-targets", "page", "Must", 1, "code_change", "YYY", "", False),
    ("overlays", "page", "Must", 1, "code_change", "YYY", "", False),
    ("aria-roles", "page", "Must", 1, "code_change", "YYY", "", False),
    ("unique-ids", "page", "Must", 1, "code_change", "YYY", "", False),
    ("robots", "crawl", "Must", 2, "drop_in", "YYY", "robots.txt", False),
    ("content-signals", "crawl", "Should", 2, "drop_in", "YYY", "robots.txt", False),
    ("web-bot-auth", "crawl", "Optional", 2, "server_config", "CCC", "", False),
    ("llms-txt", "content", "Must", 2, "drop_in", "YYY", "llms.txt", False),
    ("llms-full", "content", "Optional", 2, "drop_in", "YCC", "llms-full.txt", False),
    ("sitemap", "content", "Must", 2, "drop_in", "YYY", "", False),
    ("agents-md", "agents", "Should", 2, "drop_in", "YYY", "agents.md", False),
    ("ai-catalog", "capabilities", "Optional", 2, "drop_in", "NCC", "ai-catalog.json", False),
    ("mcp-card", "capabilities", "Should", 2, "infrastructure", "CYC", "", True),
    ("a2a-card", "capabilities", "Optional", 2, "infrastructure", "NCN", "", True),
    ("oauth-resource", "capabilities", "Optional", 2, "infrastructure", "NCC", "", True),
    ("skills", "capabilities", "Optional", 2, "infrastructure", "NCN", "", True),
    ("api-catalog", "capabilities", "Optional", 2, "infrastructure", "NCC", "", True),
    ("commerce-protocols", "capabilities", "Optional", 2, "infrastructure", "NNC", "", False),
    ("link-header", "delivery", "Must", 2, "server_config", "YYY", "_headers", True),
    ("markdown-negotiation", "delivery", "Should", 2, "server_config", "YCC", "", True),
    ("webmcp", "delivery", "Should", 2, "code_change", "CYY", "", True),
)
SITE_TYPES = ("content", "app_api", "ecommerce")
#: Components that each stated goal calls for. Fixed values.
SCENARIOS = {
    "contact_local_business": ("robots", "llms-txt", "agents-md", "link-header"),
    "contact_agency": ("robots", "llms-txt", "agents-md", "link-header"),
    "book_appointment": ("robots", "llms-txt", "agents-md", "link-header"),
    "read_and_cite": ("robots", "llms-txt", "llms-full", "agents-md", "link-header"),
    "shop_on_store": ("robots", "llms-txt", "agents-md", "link-header", "ai-catalog"),
    "find_local_inventory": ("robots", "llms-txt", "agents-md", "link-header", "ai-catalog"),
    "use_the_api": ("robots", "llms-txt", "agents-md", "link-header", "ai-catalog"),
}
#: Document shape of each stated goal. Fixed values.
PROFILES = {
    "contact_local_business": "local_multi_location",
    "contact_agency": "agency_services",
    "book_appointment": "professional_services",
    "shop_on_store": "ecommerce_retail",
    "find_local_inventory": "ecommerce_retail",
    "read_and_cite": "publisher_media",
    "use_the_api": "saas_product",
}
_SHOP = ("identity", "personal_shopper", "commerce_protocol", "agent_flow", "read_only", "policies", "rate_limits", "not_supported")
_SERVICE = ("identity", "read_only", "contact", "policies", "not_supported")
#: Sections that each shape may carry, in order. Fixed values.
PROFILE_SECTIONS = {
    "ecommerce_retail": _SHOP,
    "ecommerce": _SHOP,
    "publisher_media": ("identity", "search_and_listings", "read_only", "attribution", "rate_limits", "policies", "not_supported"),
    "agency_services": _SERVICE,
    "professional_services": _SERVICE,
    "local_multi_location": _SERVICE,
    "saas_product": ("identity", "api_access", "read_only", "rate_limits", "contact", "policies", "not_supported"),
    "catalog": ("identity", "api_access", "read_only", "rate_limits", "not_supported"),
    "workflow": ("identity", "read_only", "rate_limits", "not_supported"),
    "index_export": ("identity", "read_only", "attribution", "rate_limits", "not_supported"),
}
#: Response headers that give a platform away, in order. Fixed values.
HEADER_SIGNS = (
    ("set-cookie", "_shopify_", "shopify"),
    ("link", "cdn.shopify.com", "shopify"),
    ("x-shopid", "", "shopify"),
    ("x-shopify-stage", "", "shopify"),
    ("server", "shopify", "shopify"),
    ("x-powered-by", "wordpress", "wordpress"),
    ("x-generator", "drupal", "drupal"),
    ("x-powered-by", "next.js", "nextjs"),
    ("x-wix-request-id", "", "wix"),
    ("x-hs-hub-id", "", "hubspot"),
    ("x-served-by", "squarespace", "squarespace"),
    ("server", "webflow", "webflow"),
)
#: Weight of a check's priority. Fixed values.
PRIORITY_WEIGHT = {"Must": 5, "Should": 2, "Optional": 1}


def component_table(spark: SparkSession) -> DataFrame:
    """(pos, key, family, priority, layer, effort, content, app_api, ecommerce, artifact, templated); 26 rows."""
    rows = [(i, k, f, p, la, e, *a, art, t) for i, (k, f, p, la, e, a, art, t) in enumerate(COMPONENTS)]
    return spark.createDataFrame(rows, "pos int, key string, family string, priority string, layer int, effort string, content string, app_api string, ecommerce string, artifact string, templated boolean")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def surface_state(status: Column, content_type: Column, expected: Column) -> Column:
    """present, soft_404, absent, wrong_type or unreachable; no status means no answer."""
    kind = media_type(content_type)
    return (
        F.when(status.isNull(), "unreachable")
        .when(status >= 400, "absent")
        .when(kind.contains("html"), "soft_404")
        .when((F.size(expected) > 0) & (kind != "") & ~F.array_contains(expected, kind), "wrong_type")
        .otherwise("present")
    )


def check_state(status: Column, content_type: Column, expected: Column) -> Column:
    """pass, fail or unreachable of one HTTP check."""
    kind = media_type(content_type)
    wrong = (F.size(expected) > 0) & (kind != "") & ~F.exists(expected, lambda e: kind.contains(e))
    return F.when(status.isNull(), "unreachable").when((status >= 400) | kind.contains("html") | wrong, "fail").otherwise("pass")


def platform(headers: Column, generator: Column, profile_endpoints: Column) -> Column:
    """Endpoint evidence, then header signs in order, then the generator; a shop plugin upgrades its host."""
    lower = F.transform_keys(headers, lambda k, v: F.lower(k))
    signs = [F.when(F.contains(F.lower(F.try_element_at(lower, F.lit(h))), F.lit(v)), F.lit(p)) for h, v, p in HEADER_SIGNS]
    named = [F.when(F.contains(F.lower(generator), F.lit(p)), F.lit(p)) for p in ("woocommerce", "wordpress", "drupal", "wix", "squarespace", "magento", "hubspot")]
    shop = F.when(F.exists(profile_endpoints, lambda e: e.contains("myshopify.com")), F.lit("shopify"))
    found = F.coalesce(shop, *signs, *named, F.lit("unknown"))
    return F.when((found == "wordpress") & F.contains(F.lower(generator), F.lit("woocommerce")), "woocommerce").otherwise(found)


def profile_services(body: Column) -> Column:
    """Services of a commerce profile: array of (name, version, transport, endpoint), endpoints only."""
    binding = "array<struct<version:string,transport:string,endpoint:string>>"
    root = F.from_json(body, f"ucp struct<version:string,services:map<string,{binding}>>, version string, services map<string,{binding}>")
    services = F.coalesce(root["ucp"]["services"], root["services"])
    rows = F.flatten(F.transform(F.map_entries(services), lambda e: F.transform(e["value"], lambda b: F.struct(e["key"].alias("name"), b["version"].alias("version"), b["transport"].alias("transport"), b["endpoint"].alias("endpoint")))))
    return F.filter(rows, lambda r: F.coalesce(r["endpoint"], F.lit("")) != "")


def worst_of(checks: DataFrame) -> DataFrame:
    """(site, key, state, failed): any failing page fails, all n/a is n/a, else pass."""
    g = checks.groupBy("site", "key").agg(F.count_if(F.col("state") == "fail").alias("failed"), F.every(F.col("state") == "n/a").alias("na"))
    return g.select("site", "key", F.when(F.col("failed") > 0, "fail").when(F.col("na"), "n/a").otherwise("pass").alias("state"), "failed")


def readiness_score(checks: DataFrame, components: DataFrame) -> DataFrame:
    """(site, score): weight passed over weight passed or failed; other states count nowhere."""
    weight = F.coalesce(*[F.when(F.col("priority") == p, F.lit(w)) for p, w in PRIORITY_WEIGHT.items()])
    both = checks.join(F.broadcast(components.select("key", "priority")), "key")  # 26 rows
    passed = F.sum(F.when(F.col("state") == "pass", weight).otherwise(0))
    judged = F.sum(F.when(F.col("state").isin("pass", "fail"), weight).otherwise(0))
    return both.groupBy("site").agg(F.when(judged > 0, F.bround(100 * passed / judged, 0)).otherwise(0).cast("bigint").alias("score"))


def component_states(sites: DataFrame, components: DataFrame, checks: DataFrame, marks: DataFrame, artifacts: DataFrame, probed: tuple[str, ...] = ("semantic-html", "roles", "labels", "aria-roles", "unique-ids")) -> DataFrame:
    """(site, key, family, effort, state) in order: not applicable, live, marked live, ready, template, missing."""
    applies = F.coalesce(*[F.when(F.col("site_type") == t, F.col(t)) for t in SITE_TYPES])
    # 26 components: the product with sites is 26 rows a site, made by a broadcast of a fixed table.
    every = sites.join(F.broadcast(components), F.lit(True))
    rows = (
        every.join(checks.select("site", "key", "state"), ["site", "key"], "left")
        .join(marks.select("site", "key", F.lit(True).alias("marked")), ["site", "key"], "left")
        .join(artifacts.select("site", "artifact", F.lit(True).alias("made")), ["site", "artifact"], "left")
    )
    markable = (F.col("layer") == 1) & ~F.col("key").isin(*probed)
    state = (
        F.when(applies == "N", "not_applicable")
        .when(F.col("state") == "pass", "live")
        .when(F.col("marked") & markable, "live")
        .when((F.col("artifact") != "") & F.col("made"), "ready")
        .when(F.col("templated"), "template")
        .otherwise("missing")
    )
    return rows.select("site", "key", "family", "effort", state.alias("state"))


def agent_sections(sites: DataFrame, evidence: DataFrame) -> DataFrame:
    """(site, section, pos, kept): the shape permits a section and there is evidence for it."""
    shapes = F.create_map(*[x for k, v in PROFILE_SECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    rows = sites.select("site", F.posexplode(F.try_element_at(shapes, F.col("profile"))).alias("pos", "section"))
    always = F.col("section").isin("identity", "not_supported")
    return rows.join(evidence.select("site", "section", F.lit(True).alias("seen")), ["site", "section"], "left").select("site", "section", "pos", (always | F.coalesce("seen", F.lit(False))).alias("kept"))


def profile_for(action: Column, detected: Column, sells: Column) -> Column:
    """A stated goal, else a detected shape, else a shop if the platform sells, else an agency."""
    shapes = F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair])
    return F.coalesce(F.try_element_at(shapes, action), F.nullif(detected, F.lit("")), F.when(sells, "ecommerce_retail"), F.lit("agency_services"))


def size_warnings(total: Column, html: Column, indexed: Column) -> Column:
    """Names of what stands out between listed, crawlable and indexed counts."""
    tests = {
        "assets": (total > 0) & (html < total),
        "orphans": indexed.isNotNull() & (html > 0) & (indexed > html * 3),
        "not kept": indexed.isNotNull() & (html > 0) & ~(indexed > html * 3) & (html > F.greatest(indexed * 3, F.lit(50))),
        "no count": indexed.isNull(),
        "no pages": html == 0,
        "huge": F.greatest(html, F.coalesce(indexed, F.lit(0))) >= 10_000,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def catalog_entries(surfaces: DataFrame, least: int = 2) -> DataFrame:
    """(site, entries): JSON of a site's verified surfaces, sitemaps left out, where there are enough."""
    fine = surfaces.where((F.col("state") == "present") & (F.col("kind") != "sitemap"))
    entry = F.to_json(F.struct("kind", "url"))
    g = fine.groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return g.where(F.size("e") >= least).select("site", F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")).alias("entries"))
