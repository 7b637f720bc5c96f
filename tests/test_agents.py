"""Agents documents of a shop, an agency with and without evidence, and a publisher; templates and rules."""

import json

from pyspark.sql import functions as F

from siteindex.operators import agents

FOOT = f"\n---\n\n*Generated 2026-08-20. {agents.CONVENTION}*\n"
SHOP = ("https://shop.example", "Shop Example", "> Sells footwear.", None, "ecommerce_retail", ["identity", "personal_shopper", "commerce_protocol", "agent_flow", "read_only", "policies", "rate_limits", "not_supported"], [], [("dev.shopping", "https://s.example/mcp", "mcp"), ("other", "https://s.example/x", "")], [("Products", "https://shop.example/products.json")], [("Refunds", "https://shop.example/refund")], None, " Up to 2 requests per second. ", "https://shop.example/llms.txt", "2026-04-08", ["2026-01-23", "2026-04-08"])
BARE = ("https://agency.example", "Agency", None, None, "agency_services", ["identity", "not_supported"], ["contact", "read_only"], None, None, None, None, None, None, None, None)
FULL = ("https://agency.example/", "", "> PR.\n", " Ask us first. ", "agency_services", ["identity", "read_only", "contact", "policies", "not_supported"], [], [], [("Services", "https://agency.example/s")], [("Privacy", "https://agency.example/p")], "https://agency.example/contact/", None, None, None, None)
NEWS = ("https://news.example", "News", "> Journalism.", None, "publisher_media", ["identity", "search_and_listings", "read_only", "attribution", "rate_limits", "not_supported"], [], [], [("Search", "https://news.example/search")], [], "", "One request per second.", None, None, None)
API = ("https://api.example", "API", "", None, "saas_product", ["identity", "api_access", "not_supported"], [], [], [("Docs", "https://api.example/docs")], [], "", "", "https://api.example/llms.txt", "", [])
UNPUBLISHED = ("https://store.example", "Store", "", None, "ecommerce", ["identity", "not_supported"], ["commerce_protocol"], [], [], [], "", "", "", "", [])


def rendered(spark, *rows):
    return [r["body"] for r in agents.render_agents(spark.createDataFrame(list(rows), agents.EVIDENCE).coalesce(1), "2026-08-20").collect()]


def test_a_shop(spark):
    (body,) = rendered(spark, SHOP)
    assert body == (
        "# Shop Example\n\n> Sells footwear.\n\n## About this site\n\nCanonical site: https://shop.example\n\nContent overview for language models: https://shop.example/llms.txt\n\n"
        f"## For agents acting on behalf of a user\n\n{agents.CONFIRM}\n{agents.LIVE}\n\n"
        "## Commerce protocol (UCP)\n\n- Protocol version: `2026-04-08`\n- Supported versions: `2026-01-23`, `2026-04-08`\n- Discovery: `GET https://shop.example/.well-known/ucp`\n- dev.shopping (MCP): `https://s.example/mcp`\n- other (endpoint): `https://s.example/x`\n\n"
        f"{agents.NEGOTIATE}\n\n## Typical agent flow\n\n" + "".join(f"{i}. {x}\n" for i, x in enumerate(agents.FLOW, 1)) + "\n## Read-only browsing (no authentication)\n\n- Products: `https://shop.example/products.json`\n\n"
        f"## Policies\n\n- Refunds: `https://shop.example/refund`\n\n{agents.GOVERN}\n\n## Rate limits\n\nUp to 2 requests per second.\n\n## Not supported\n\n{agents.NO_CHANGE}\n{FOOT}"
    )


def test_sites_that_sell_nothing(spark):
    bare, full, news = rendered(spark, BARE, FULL, NEWS)
    assert bare == f"# Agency\n\n## About this site\n\nCanonical site: https://agency.example\n\n## Not supported\n\n{agents.NO_SALE}\n{agents.NO_CONTACT}\n{agents.NO_CHANGE}\n{FOOT}"
    assert full.startswith("# https://agency.example/\n\n> PR.\n\n## About this site\n\nAsk us first.\n\n## Read-only") and f"## Contact\n\n- Enquiries: `https://agency.example/contact/`\n\n{agents.ENQUIRE}\n\n## Policies" in full
    assert agents.NO_CONTACT not in full and agents.NO_SALE in full
    assert "## Search and listings\n\n- Search: `https://news.example/search`\n\n## Read-only browsing" in news and "cite the source page URL on https://news.example. Do not" in news


def test_an_api_and_a_shop_without_protocol(spark):
    api, store = rendered(spark, API, UNPUBLISHED)
    assert "Canonical site: https://api.example\n\n## API and documentation\n\n- Docs: `https://api.example/docs`\n- Content overview for language models: `https://api.example/llms.txt`\n\n## Not" in api
    assert agents.NO_PROTOCOL in store and agents.NO_SALE not in store


def test_same_row_same_bytes_and_liquid(spark):
    one, two = rendered(spark, SHOP, SHOP)
    assert one == two
    row = spark.createDataFrame([(one,)], "b string").select(agents.render_liquid(F.col("b")).alias("x")).first()["x"]
    assert row.startswith("{%- comment -%}\n") and row.endswith("{%- endcomment -%}\n" + one)


def test_templates_are_json_and_name_their_site(spark):
    sites = spark.createDataFrame([(1, "https://www.x.example/", 'A "quoted" \\ name', "nginx"), (2, "https://y.example", None, "wix")], "id long, site_url string, site_name string, platform string")
    out = {(r["id"], r["key"]): r["body"] for r in agents.service_templates(sites).collect()}
    assert len(out) == 16
    for (i, key), body in out.items():
        if key in agents.SERVICES:
            assert next(iter(json.loads(body))) == "_comment" and json.loads(body)["_comment"] == agents.BANNER
    card = json.loads(out[1, "mcp-card"])
    assert card["name"] == 'A "quoted" \\ name' and card["endpoint"] == "https://mcp.x.example/REPLACE_ME" and card["capabilities"] == {"tools": True, "resources": True, "prompts": False}
    assert json.loads(out[2, "a2a-card"])["name"] == "REPLACE_ME" and json.loads(out[2, "oauth-resource"])["authorization_servers"] == ["https://auth.y.example"]
    assert "https://x.example/ |" in out[1, "link-header"] and out[2, "link-header"].startswith("Wix sets no")
    assert not any("\x01" in b or "u0001" in b for b in out.values())
