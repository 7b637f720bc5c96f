"""Files for agents, rendered as columns: the agents document, robots rules, header files and service templates.

A site is one row of nested evidence. Every section has a renderer, a column over that
row; a document is the kept sections' blocks in order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence of a site. ``sections`` are those kept, in order; ``omitted`` those that its shape permits but nothing supports.
EVIDENCE = (
    "site_url string, site_name string, summary string, guidance string, profile string, sections array<string>, omitted array<string>, "
    "capabilities array<struct<label:string,url:string,transport:string>>, read_only array<struct<label:string,url:string>>, policies array<struct<label:string,url:string>>, "
    "contact_url string, rate_limit string, llms_url string, version string, supported array<string>"
)
SHOPS = ("ecommerce_retail", "ecommerce")
#: Sentences of the agents document. Fixed values.
CONVENTION = "Follows the agents.md convention as published by Shopify (May 2026). agents.md is a convention rather than a ratified specification; the machine-readable contract for commerce is UCP, at /.well-known/ucp."
CONFIRM = "Confirm with the person you are acting for before completing any purchase."
LIVE = "Use live pricing and availability from the endpoints below rather than cached or remembered values, and do not state product claims that are not published on this site."
NEGOTIATE = "Negotiate capabilities from the discovery document rather than assuming them; only the services listed there are supported."
FLOW = (
    "Discover capabilities at `/.well-known/ucp`.",
    "Search or browse using the read-only endpoints below.",
    "Build a cart through the protocol endpoint.",
    "Present the order to the person you are acting for.",
    "Complete checkout only after they approve it.",
)
CITE = "When you quote or summarise this content, cite the source page URL on {}. Do not reproduce whole articles; link to them."
ENQUIRE = "Submit an enquiry only when the person you are acting for has asked you to, and pass on only details they have given you for that purpose."
GOVERN = "Read these before acting on this site; they govern what is permitted."
NO_SALE = "- This site does not sell through an agent protocol. There is no cart, checkout or ordering endpoint; do not attempt to transact here."
NO_PROTOCOL = "- No agent commerce protocol is published for this site yet. Do not attempt to transact programmatically; direct the person you are acting for to the site itself."
NO_CONTACT = "- No contact endpoint is published for agent use."
NO_CHANGE = "- Do not submit forms, create accounts, or take any action that changes state on this site without explicit instruction from the person you are acting for."
LISTS = {"read_only": "## Read-only browsing (no authentication)", "search_and_listings": "## Search and listings", "api_access": "## API and documentation"}
#: Crawlers of the robots rules, and what each policy signals. Fixed values.
SEARCH_BOTS = ("OAI-SearchBot", "PerplexityBot", "ClaudeBot", "Google-Extended")
TRAINING_BOTS = ("GPTBot", "CCBot", "anthropic-ai")
SIGNALS = {"block_all": "ai-train=no, search=no, ai-input=no", "search_only": "ai-train=no, search=yes, ai-input=yes", "allow": "ai-train=yes, search=yes, ai-input=yes"}
ROBOTS_NOTE = (
    "# Note: on Cloudflare, blocking Training also blocks Googlebot, Bingbot",
    "# and Applebot from 15 September 2026 — multi-purpose crawlers are judged",
    "# by their strictest rule. Check your CDN's AI crawler settings as well;",
    "# these lines alone will not produce the outcome above.",
)


def _text(name: str) -> Column:
    """A value without white space around it, or ""."""
    return F.btrim(F.coalesce(F.col(name), F.lit("")), F.lit(" \t\n\r\f\x0b"))


def _lines(*parts: Column | str) -> Column:
    """Lines of a block; arrays are lines each, nulls are left out."""
    arrays = [p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts]
    return F.array_join(F.flatten(F.array(*arrays)), "\n")


def _line(*parts: Column | str) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _maybe(when: Column, *lines: Column) -> Column:
    return F.when(when, F.flatten(F.array(*lines))).otherwise(F.array().cast("array<string>"))


def _listed(name: str) -> Column:
    return F.transform(F.coalesce(name, F.array().cast("array<struct<label:string,url:string>>")), lambda x: F.concat(F.lit("- "), x["label"], F.lit(": `"), x["url"], F.lit("`")))


def _has(section: str) -> Column:
    return F.array_contains("sections", section)


def section_blocks() -> dict[str, Column]:
    """The renderer of each section."""
    sells = F.col("profile").isin(*SHOPS)
    site, blank = F.col("site_url"), F.array(F.lit(""))
    overview = "Content overview for language models: "
    plain = F.coalesce(F.nullif(_text("guidance"), F.lit("")), F.concat(F.lit("Canonical site: "), site))
    capability = F.transform("capabilities", lambda c: F.concat(F.lit("- "), c["label"], F.lit(" ("), F.coalesce(F.nullif(F.upper(c["transport"]), F.lit("")), F.lit("endpoint")), F.lit("): `"), c["url"], F.lit("`")))
    versions = F.array_join(F.transform("supported", lambda v: F.concat(F.lit("`"), v, F.lit("`"))), ", ")
    none = F.array().cast("array<string>")
    missing = F.when(~sells, F.array(F.lit(NO_SALE))).when(~_has("commerce_protocol"), F.array(F.lit(NO_PROTOCOL))).otherwise(none)
    lists = {name: _lines(heading, "", _listed("read_only"), *([_maybe(_text("llms_url") != "", _line("- ", overview, "`", F.col("llms_url"), "`"))] if name == "api_access" else [])) for name, heading in LISTS.items()}
    return lists | {
        "identity": _lines("## About this site", "", F.array(plain), _maybe((_text("llms_url") != "") & ~_has("api_access"), blank, _line(overview, F.col("llms_url")))),
        "personal_shopper": _lines("## For agents acting on behalf of a user", "", CONFIRM, LIVE),
        "commerce_protocol": _lines(
            "## Commerce protocol (UCP)",
            "",
            _maybe(_text("version") != "", _line("- Protocol version: `", F.col("version"), "`")),
            _maybe(F.coalesce(F.size("supported"), F.lit(0)) > 0, _line("- Supported versions: ", versions)),
            _line("- Discovery: `GET ", F.regexp_replace(site, "/+$", ""), "/.well-known/ucp`"),
            F.coalesce(capability, none),
            "",
            NEGOTIATE,
        ),
        "agent_flow": _lines("## Typical agent flow", "", *[f"{i}. {x}" for i, x in enumerate(FLOW, 1)]),
        "attribution": _lines("## Attribution", "", _line(CITE.partition("{}")[0], site, CITE.partition("{}")[2])),
        "contact": _lines("## Contact", "", _line("- Enquiries: `", F.col("contact_url"), "`"), "", ENQUIRE),
        "policies": _lines("## Policies", "", _listed("policies"), "", GOVERN),
        "rate_limits": _lines("## Rate limits", "", F.array(_text("rate_limit"))),
        "not_supported": _lines("## Not supported", "", missing, _maybe(F.array_contains(F.coalesce("omitted", none), "contact"), F.array(F.lit(NO_CONTACT))), NO_CHANGE),
    }


def render_agents(sites: DataFrame, generated: str) -> DataFrame:
    """``sites`` (``EVIDENCE``) plus ``body``: the same row gives the same bytes."""
    blocks = F.create_map(*[x for name, block in section_blocks().items() for x in (F.lit(name), F.coalesce(block, F.lit("")))])
    named = F.col("blocks_")
    kept = F.filter(F.transform("sections", lambda s: F.coalesce(F.try_element_at(named, s), F.lit(""))), lambda b: b != "")
    title = F.concat(F.lit("# "), F.coalesce(F.nullif(_text("site_name"), F.lit("")), F.col("site_url")))
    summary = _text("summary")
    head = F.when(summary != "", F.array(title, summary)).otherwise(F.array(title))
    foot = F.array(F.lit("---"), F.lit(f"*Generated {generated}. {CONVENTION}*"))
    body = F.concat(F.array_join(F.concat(head, kept, foot), "\n\n"), F.lit("\n"))
    return sites.withColumn("blocks_", blocks).withColumn("body", body).drop("blocks_")


LIQUID = """{%- comment -%}
  agents.md.liquid
  Place at: templates/agents.md.liquid
  Serves:   /agents.md on the store's primary domain.

  This replaces the store's default agents.md. Only `request` and `agents` are
  objects of this template; other theme objects render empty, so that all below
  is literal.
{%- endcomment -%}
"""


def render_liquid(body: Column) -> Column:
    """A theme template that serves the document on a store that has an agents.md of its own."""
    return F.concat(F.lit(LIQUID), body)


def robots_rules(policy: Column, sitemap_url: Column) -> Column:
    """Rules to add to a robots.txt under a stated policy (block_all, search_only or allow)."""
    groups = lambda search, training: "".join(f"User-agent: {b}\n{rule}: /\n\n" for bots, rule in ((SEARCH_BOTS, search), (TRAINING_BOTS, training)) for b in bots)
    rules = {"block_all": groups("Disallow", "Disallow"), "search_only": groups("Allow", "Disallow"), "allow": groups("Allow", "Allow")}
    pick = lambda values, other: F.coalesce(*[F.when(policy == k, F.lit(v)) for k, v in values.items()], F.lit(other))
    sitemap = F.when(F.coalesce(sitemap_url, F.lit("")) != "", F.concat(F.lit("Sitemap: "), sitemap_url, F.lit("\n\n"))).otherwise("")
    note = F.when(policy == "search_only", "\n".join(ROBOTS_NOTE) + "\n").otherwise("")
    return F.concat(F.lit("# AI crawler rules — add these to your existing robots.txt.\n\n"), pick(rules, rules["allow"]), F.lit("User-agent: *\nAllow: /\nContent-Signal: "), pick(SIGNALS, SIGNALS["allow"]), F.lit("\n\n"), sitemap, note)


def header_file(has_index: Column, has_catalog: Column, openapi_url: Column) -> Column:
    """A ``_headers`` file whose Link rels name only files that will exist."""
    spec = F.coalesce(openapi_url, F.lit(""))
    return F.concat(
        F.lit('# Cloudflare Pages _headers — agent-aware Link rels.\n\n/*\n  Link: </sitemap.xml>; rel="sitemap"\n'),
        F.when(has_index, '  Link: </llms.txt>; rel="describedby"; type="text/markdown"\n').otherwise(""),
        F.when(has_catalog, '  Link: </.well-known/ai-catalog.json>; rel="ai-catalog"\n').otherwise(""),
        F.when(spec != "", F.concat(F.lit("  Link: <"), spec, F.lit('>; rel="service-desc"; type="application/vnd.oai.openapi+json"\n'))).otherwise(""),
    )


#: Marks of what a template leaves open. Fixed values.
PLACEHOLDER = "REPLACE_ME"
BANNER = "This is a starting point, not a file to publish. Every REPLACE_ME below is a claim about a service that does not answer yet. Stand it up, enter its URL in onboarding, and the tool will generate the real file once it verifies."
NO_HEADERS = ("shopify", "wix", "squarespace")
_SITE, _HOST, _NAME = "\x01site\x01", "\x01host\x01", "\x01name\x01"
#: Documents of services that don't exist yet. Fixed formats.
SERVICES = {
    "mcp-card": {"name": _NAME, "description": PLACEHOLDER, "version": "0.1.0", "endpoint": f"https://mcp.{_HOST}/{PLACEHOLDER}", "transport": "streamable-http", "capabilities": {"tools": True, "resources": True, "prompts": False}, "authentication": {"type": "oauth2", "resourceMetadata": f"{_SITE}/.well-known/oauth-protected-resource.json"}},
    "a2a-card": {"name": _NAME, "description": PLACEHOLDER, "url": f"{_SITE}/{PLACEHOLDER}", "version": "0.1.0", "capabilities": {"streaming": False, "pushNotifications": False}, "skills": [{"id": PLACEHOLDER, "name": PLACEHOLDER, "description": PLACEHOLDER, "tags": [PLACEHOLDER]}]},
    "oauth-resource": {"resource": _SITE, "authorization_servers": [f"https://auth.{_HOST}"], "bearer_methods_supported": ["header"], "scopes_supported": [PLACEHOLDER], "resource_documentation": f"{_SITE}/docs/{PLACEHOLDER}"},
    "skills": {"skills": [{"name": PLACEHOLDER, "description": PLACEHOLDER, "endpoint": f"{_SITE}/api/{PLACEHOLDER}", "parameters": {}}]},
    "api-catalog": {"linkset": [{"anchor": _SITE, "service-desc": [{"href": f"{_SITE}/{PLACEHOLDER}.json", "type": "application/vnd.oai.openapi+json"}]}]},
}
WEBMCP = f"""<!-- {BANNER} -->
<script>
  // Tools that an agent in the browser may call.
  if (navigator.modelContext) {{
    navigator.modelContext.registerTool({{
      name: "{PLACEHOLDER}",
      description: "{PLACEHOLDER}",
      inputSchema: {{ type: 'object', properties: {{}} }},
      async execute(input) {{
        throw new Error('{PLACEHOLDER}: not implemented');
      }},
    }});
  }}
</script>
"""
LINK_HEADER = f"""# Apply the block of your host.
# Cloudflare Pages, Netlify: _headers
/*
  Link: </llms.txt>; rel="describedby"; type="text/markdown"
  Link: </sitemap.xml>; rel="sitemap"
# nginx
#   add_header Link '</llms.txt>; rel="describedby"; type="text/markdown"' always;
# Check: curl -sI https://{_HOST}/ | grep -i '^link:'
"""
NEGOTIATION = f"""# Where the response is built: text/markdown asked for in Accept is answered with
# markdown, under that content type and with a smaller body.
# Check: curl -s -H 'Accept: text/markdown' https://{_HOST}/ | wc -c
"""


def service_templates(sites: DataFrame) -> DataFrame:
    """``sites`` (site_url, site_name, platform and others) times the eight templates: ``key`` and ``body``."""
    texts = {k: json.dumps({"_comment": BANNER, **v}, indent=2) + "\n" for k, v in SERVICES.items()}
    texts |= {"webmcp": WEBMCP, "link-header": LINK_HEADER, "markdown-negotiation": NEGOTIATION}
    quoted = lambda c: F.regexp_replace(F.get_json_object(F.to_json(F.struct(F.to_json(F.array(c)).alias("x"))), "$.x"), r'^\["|"\]$', "")
    host = F.regexp_replace(F.btrim(F.substring_index("site_url", "//", -1), F.lit("/")), r"^www\.", "")
    name = F.coalesce(F.nullif(_text("site_name"), F.lit("")), F.lit(PLACEHOLDER))
    # JSON writes a mark's control characters as escapes.
    mark = lambda m: (m, json.dumps(m)[1:-1])

    def filled(text: str) -> Column:
        out = F.lit(text)
        for value, m in ((quoted(F.col("site_url")), _SITE), (quoted(host), _HOST), (quoted(name), _NAME)):
            for form in mark(m):
                out = F.replace(out, F.lit(form), value)
        return out

    no_headers = F.concat(F.initcap("platform"), F.lit(" sets no response headers of one's own on the primary domain; a proxy before the site could.\n"))
    rows = [F.struct(F.lit(k).alias("key"), (F.when(_text("platform").isin(*NO_HEADERS), no_headers).otherwise(filled(t)) if k == "link-header" else filled(t)).alias("body")) for k, t in texts.items()]
    return sites.withColumn("t_", F.explode(F.array(*rows))).select(*sites.columns, "t_.key", "t_.body")
