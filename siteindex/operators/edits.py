"""Ordered edits of an index: ten operations on its site, sections and pages, each applied or refused with a reason.

A document's operations are a fold, since each refers to what those before it left: a
rename changes which section a later move or order names. Documents are independent, so
they are the key of the batch fold and of the streaming state; the step is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import ship

#: Reasons of refusal. Fixed values.
NO_NAME = "no name given"
NO_SUMMARY = "no summary given"
HEADING_IN_NOTES = "notes cannot contain headings"
NO_NAMES = "needs both the old and new name"
NO_TARGET = "no target section"
NOTHING = "nothing to set"
NO_DESCRIPTION = "a link line cannot have an empty description"
UNSUPPORTED = "unsupported operation"
SHOWN_URL = 70

PAGE = "ord long, title string, description string, section string, optional boolean, included boolean"
SITE = "site_name string, site_summary string, notes string, section_order array<string>, renames map<string,string>"
OPERATION = "doc long, seq long, op string, url string, section string, text string, title string, description string, flag boolean, sections array<string>"
RESULT = f"doc long, kind string, seq long, url string, op string, reason string, {PAGE}, {SITE}"
_PAGE, _SITE, _RESULT = ([c.split()[0] for c in x.split(", ")] for x in (PAGE, SITE, RESULT))


@dataclass
class Index:
    """What the operations of one document may touch. ``pages`` maps a URL to the values of ``PAGE``."""

    pages: MutableMapping[str, dict] = field(default_factory=dict)
    site_name: str = ""
    site_summary: str = ""
    notes: str = ""
    section_order: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)

    def sections(self) -> list[str]:
        """Names of the sections that have pages, in page order."""
        by_place = sorted(self.pages.values(), key=lambda p: p["ord"])
        return list(dict.fromkeys(p["section"] for p in by_place if p["section"]))


Handler = Callable[[Index, Any], str | None]


def _site(name: str, missing: str) -> Handler:
    def handle(index: Index, op: Any) -> str | None:
        if not op.text:
            return missing
        setattr(index, name, op.text)
        return None

    return handle


def _notes(index: Index, op: Any) -> str | None:
    if any(x.lstrip()[:1] == "#" for x in op.text.splitlines()):
        return HEADING_IN_NOTES
    index.notes = op.text
    return None


def _rename(index: Index, op: Any) -> str | None:
    old, new = op.section, op.text
    if not (old and new):
        return NO_NAMES
    inside = [u for u, p in list(index.pages.items()) if p["section"] == old]
    if not inside:
        return f"no section named {old!r}"
    for url in inside:
        index.pages[url] = {**index.pages[url], "section": new}
    index.renames = {**index.renames, old: new}
    index.section_order = [new if x == old else x for x in index.section_order]
    return None


def _reorder(index: Index, op: Any) -> str | None:
    known = index.sections()
    strange = [x for x in op.sections if x not in known]
    if strange:
        return f"unknown section(s): {', '.join(strange)}"
    index.section_order = [*op.sections, *(x for x in known if x not in op.sections)]
    return None


def _on_page(change: Callable[[dict, Any], tuple[dict, str | None]]) -> Handler:
    """An operation on a page that must exist under exactly this URL."""

    def handle(index: Index, op: Any) -> str | None:
        page = index.pages.get(op.url)
        if page is None:
            shown = op.url if len(op.url) <= SHOWN_URL else op.url[: SHOWN_URL - 3] + "..."
            return f"{shown or '(blank)'} is not a page in this run"
        changes, reason = change(page, op)
        if changes:
            index.pages[op.url] = {**page, **changes}
        return reason

    return handle


def _copy(page: dict, op: Any) -> tuple[dict, str | None]:
    """Titles are set even where the page then lacks a description, which refuses the operation."""
    changes = {k: v for k, v in (("title", op.title), ("description", op.description)) if v}
    if not changes:
        return {}, NOTHING
    described = (changes.get("description") or page["description"] or "").strip()
    return changes, None if described else NO_DESCRIPTION


HANDLERS: dict[str, Handler] = {
    "set_site_name": _site("site_name", NO_NAME),
    "set_site_summary": _site("site_summary", NO_SUMMARY),
    "set_notes": _notes,
    "rename_section": _rename,
    "move_page": _on_page(lambda p, op: ({"section": op.section, "optional": False}, None) if op.section else ({}, NO_TARGET)),
    "set_page_copy": _on_page(_copy),
    "set_optional": _on_page(lambda p, op: ({"optional": bool(op.flag)}, None)),
    "exclude_page": _on_page(lambda p, op: ({"included": False}, None)),
    "include_page": _on_page(lambda p, op: ({"included": True}, None)),
    "reorder_sections": _reorder,
}


def apply_one(index: Index, op: Any) -> str | None:
    """Applies one operation; why it was refused, or None."""
    handler = HANDLERS.get(op.op)
    return handler(index, op) if handler else UNSUPPORTED


def _operations(rows: pd.DataFrame) -> Iterator[Any]:
    """Operations in order, with empty values for missing ones."""
    rows = rows.sort_values("seq")
    texts = ["op", "url", "section", "text", "title", "description"]
    rows = rows.assign(**{c: rows[c].where(rows[c].notna(), "") for c in texts})
    rows = rows.assign(sections=[[] if x is None or isinstance(x, float) else list(x) for x in rows["sections"]])
    return rows.assign(flag=[x is not None and x == True for x in rows["flag"]]).itertuples(index=False)  # noqa: E712


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in _RESULT] for r in rows], columns=_RESULT).astype({"seq": "Int64", "ord": "Int64"})


def _site_row(doc: int, index: Index, seq: int | None) -> dict:
    return {"doc": doc, "kind": "site", "seq": seq, **{c: getattr(index, c) for c in _SITE}}


def edited(pages: DataFrame, sites: DataFrame, operations: DataFrame) -> DataFrame:
    """Rows of three kinds: each ``page`` and each ``site`` after all operations, and each ``operation`` with its reason of refusal (null: applied).

    ``pages``: doc, url and ``PAGE``; ``sites``: doc, site_name, site_summary, notes;
    ``operations``: ``OPERATION``. Documents without operations come out as they went in.
    """
    ship(pages.sparkSession)
    given = pages.withColumn("kind", F.lit("page")).unionByName(sites.withColumn("kind", F.lit("site")), allowMissingColumns=True)
    rows = given.unionByName(operations.withColumn("kind", F.lit("operation")), allowMissingColumns=True)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        doc = int(group["doc"].iloc[0])
        held = {r.url: {c: getattr(r, c) for c in _PAGE} for r in group[group["kind"] == "page"].sort_values("ord").itertuples(index=False)}
        index = Index(held)
        for r in group[group["kind"] == "site"].itertuples(index=False):
            index.site_name, index.site_summary, index.notes = r.site_name, r.site_summary, r.notes
        out = [{"doc": doc, "kind": "operation", "seq": op.seq, "op": op.op, "url": op.url, "reason": apply_one(index, op)} for op in _operations(group[group["kind"] == "operation"])]
        out += [{"doc": doc, "kind": "page", "url": u, **p} for u, p in held.items()]
        return _frame([*out, _site_row(doc, index, None)])

    return rows.groupBy("doc").applyInPandas(fold, RESULT)


class _Stored(MutableMapping):
    """Pages in a map state; what was written is remembered."""

    def __init__(self, state: Any) -> None:
        self.state, self.written = state, set()

    def __getitem__(self, url: str) -> dict:
        if not self.state.containsKey((url,)):
            raise KeyError(url)
        return dict(zip(_PAGE, self.state.getValue((url,)), strict=True))

    def __setitem__(self, url: str, page: dict) -> None:
        self.state.updateValue((url,), tuple(page[c] for c in _PAGE))
        self.written.add(url)

    def __delitem__(self, url: str) -> None:
        self.state.removeKey((url,))

    def __iter__(self) -> Iterator[str]:
        return iter([k[0] for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self)


class _Editing(StatefulProcessor):
    """The fold of :func:`edited`, a batch of operations at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "url string", PAGE)
        self.site = handle.getValueState("site", SITE)

    def handleInitialState(self, key: tuple, rows: pd.DataFrame, timers: Any) -> None:
        site = ("", "", "", [], {})
        for r in rows.itertuples(index=False):
            if r.kind == "site":
                site = (r.site_name, r.site_summary, r.notes, [], {})
            else:
                self.pages.updateValue((r.url,), (int(r.ord), r.title, r.description, r.section, bool(r.optional), bool(r.included)))
        self.site.update(site)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        doc = int(key[0])
        pages = _Stored(self.pages)
        index = Index(pages)
        if self.site.exists():
            held = self.site.get()
            index.site_name, index.site_summary, index.notes, order, renames = held
            index.section_order, index.renames = list(order or []), dict(renames or {})
        out, seq = [], None
        for op in _operations(pd.concat(list(rows))):
            out.append({"doc": doc, "kind": "operation", "seq": op.seq, "op": op.op, "url": op.url, "reason": apply_one(index, op)})
            seq = op.seq
        self.site.update(tuple(getattr(index, c) for c in _SITE))
        out += [{"doc": doc, "kind": "page", "seq": seq, "url": u, **pages[u]} for u in sorted(pages.written)]
        yield _frame([*out, _site_row(doc, index, seq)])

    def close(self) -> None:
        pass


def edit_stream(operations: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """A stream of the rows of :func:`edited`: each operation once, and the pages and site that a batch changed, with its last ``seq``.

    ``operations`` is a stream; a document's operations must arrive in order between
    batches. Needs the RocksDB state store.
    """
    ship(pages.sparkSession)
    start = pages.withColumn("kind", F.lit("page")).unionByName(sites.withColumn("kind", F.lit("site")), allowMissingColumns=True)
    return operations.groupBy("doc").transformWithStateInPandas(_Editing(), RESULT, "Update", "None", start.groupBy("doc"))


def latest_state(log: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of :func:`edited` out of the rows that :func:`edit_stream` has written, and the pages it began with."""
    values = [c for c in _PAGE if c != "ord"]
    rows = pages.select("doc", "url", "ord", *values, F.lit(None).cast("long").alias("seq"))
    rows = rows.unionByName(log.where("kind = 'page'").select("doc", "url", "ord", *values, "seq"))
    last = F.max_by(F.struct("ord", *values), F.struct(F.col("seq").isNotNull(), "seq")).alias("p")
    return rows.groupBy("doc", "url").agg(last).select("doc", "url", "p.*")
