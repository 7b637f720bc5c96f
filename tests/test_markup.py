"""Static checks of markup: each case of a page, and plain counts beside the element joins."""

import pytest

from siteindex.operators import markup

CASES = [
    # html, check, state, words of the detail
    ("<main><nav></nav><article></article></main>", "semantic-html", "pass", "landmarks: main, nav, article"),
    ("<div><div><div></div></div></div>", "semantic-html", "fail", "only none found; agents walking the accessibility tree"),
    ('<div role="main"><div role=\'banner\'></div><div ROLE=Navigation></div></div>', "semantic-html", "pass", "role=main"),
    ('<main role="main"></main><nav role="navigation">', "semantic-html", "pass", "landmarks: main, nav, role=navigation"),
    ('<div onclick="go()">x</div>', "roles", "fail", "1 of 1 focusable"),
    ('<div onclick="go()" role="button">x</div>', "roles", "pass", "all with a role"),
    ("<button>x</button><p>Just prose.</p>", "roles", "pass", "in the markup"),
    ('<div class="menu hamburger" tabindex="0"></div>', "roles", "fail", "hamburger"),
    ('<LI TabIndex=0>x</LI><a href="/i" tabindex="-1">x</a>', "roles", "fail", "1 of 1"),
    ("".join(f'<a href="/{i}" tabindex="-1">x</a>' for i in range(50)), "roles", "pass", ""),
    ('<label for="e">E</label><input id="e">', "labels", "pass", "1 input(s), all labelled"),
    ('<input id="e" type="text">', "labels", "fail", "1 of 1"),
    ('<input aria-label="Email" type="text"><input aria-labelledby=x>', "labels", "pass", "2 input(s)"),
    ('<input type="hidden"><input type=submit><input type=\'button\'>', "labels", "n/a", "no form inputs"),
    ("<label for=a>x</label><input id=a><input id=b>", "labels", "fail", "1 of 2"),
    ('<div role="dialogbox landmark"></div><ul role="directory"><p role="doc-toc">', "aria-roles", "fail", "directory is deprecated (use list); landmark is an abstract role and was never valid in markup; dialogbox is not a role"),
    ('<div role="banner"></div><img role="img"><svg role="graphics-symbol">', "aria-roles", "pass", "3 role(s)"),
    ("<p>x</p>", "aria-roles", "n/a", "no ARIA roles"),
    ('<label for="a">L</label><input id="a"><input id="a">', "unique-ids", "fail", "1 duplicated id(s) are the target of an ARIA or label reference, e.g. a"),
    ('<p id="b"></p><p id="b"></p><p id=c><p id=c>', "unique-ids", "fail", "2 duplicated id(s), e.g. b"),
    ('<div id="a"></div><div id="b"></div>', "unique-ids", "pass", "2 id(s), all unique"),
    ("<p data-id='x'>none</p>", "unique-ids", "n/a", "no element ids"),
    ("", "labels", "n/a", ""),
    (None, "semantic-html", "fail", ""),
]


@pytest.fixture(scope="module")
def checked(spark):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page long, html string")
    return {(r["page"], r["check"]): r for r in markup.markup_checks(pages).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_check(checked, i):
    _, check, state, words = CASES[i]
    assert checked[i, check]["state"] == state and words in checked[i, check]["detail"]
    assert {c for p, c in checked if p == i} == set(markup.CHECKS)


def test_ids_that_references_point_at(spark):
    html = '<i id="a"></i><i id="a"></i><i id="b" aria-describedby="a  c"></i><i id="b"></i><i id="b"></i><i id="c">'
    rows = markup.repeated_ids(markup.elements(spark.createDataFrame([(1, html), (2, '<i id="a"></i>')], "page long, html string"))).collect()
    assert sorted((r["page"], r["id"], r["n"], r["referenced"]) for r in rows) == [(1, "a", 2, True), (1, "b", 3, False)]
