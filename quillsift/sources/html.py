"""Pages as rows of elements and of form fields.

A page is read once, in the task that scans it. Elements are numbered in the order in
which they open (``pre``) and carry the number that has been reached when they close
(``last``), so an element holds another if the other's ``pre`` lies in its interval;
what is inside what is then told by numbers, without a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Elements without content, those whose text isn't shown, and what a user can act on.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template", "head"))
ACTIVE_TAGS = ("button", "a", "input", "textarea", "select")
ACTIVE_ROLES = ("button", "radio", "checkbox", "option", "listbox", "menuitemradio", "menuitemcheckbox", "switch", "combobox")
LABELS = ("aria-label", "placeholder", "", "title", "id")  # "" stands for the text inside
UNLABELLED = "(unlabeled)"
CONTROLS = ("input", "select", "textarea")
#: An open element of these is closed by the next of the same kind.
_CLOSED_BY_NEXT = frozenset(("p", "li", "option", "tr", "td", "th", "dt", "dd"))
ELEMENT = "page_id long, pre long, last long, depth long, tag string, attributes map<string,string>, inner string"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.text: list[str] = []
        self.chars = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and tag in _CLOSED_BY_NEXT and self.rows[self.open[-1]][3] == tag:
            self._close()
        self._say(" ")
        self.rows.append([len(self.rows), len(self.rows), len(self.open), tag, {k: v or "" for k, v in reversed(attrs)}, self.chars, self.chars])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._say(" ")
        if any(self.rows[i][3] == tag for i in self.open):
            while self.rows[self.open[-1]][3] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not any(self.rows[i][3] in HIDDEN for i in self.open):
            self._say(data)

    def handle_comment(self, data: str) -> None:
        self._say(" ")

    def _say(self, data: str) -> None:
        self.text.append(data)
        self.chars += len(data)

    def _close(self) -> None:
        row = self.rows[self.open.pop()]
        row[1], row[6] = len(self.rows) - 1, self.chars


def read(html: str | None, resolved: tuple[str, ...] | None = None) -> tuple[list[tuple], str]:
    """(pre, last, depth, tag, attributes, text inside) of every element, and all that is shown; tags part words, and runs of white space are one blank.

    Character references are resolved as a browser does; with ``resolved`` those names alone, and all others stand as written.
    """
    reader = _Reader()
    html = html or ""
    if resolved is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, resolved))});)", "&amp;", html)
    reader.feed(html)
    reader.close()
    while reader.open:
        reader._close()
    shown = "".join(reader.text)
    plain = lambda a, b: " ".join(shown[a:b].split())
    active = lambda tag, own: tag in (*ACTIVE_TAGS, "option", "body") or not own.keys().isdisjoint(("role", "onclick", "contenteditable", "aria-checked"))
    rows = [(*r[:5], plain(r[5], r[6]) if active(r[3], r[4]) else None) for r in reader.rows]
    return rows, plain(0, len(shown))


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, pre, last, depth, tag, attributes, inner) of all elements of pages (page_id, html); ``inner`` only of those that may be acted on, and of the body."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                rows, _ = read(html if isinstance(html, str) else None)
                yield pd.DataFrame([(page_id, *r) for r in rows], columns=[f.split()[0] for f in ELEMENT.split(", ")])

    _small_batches(pages)
    return pages.select(F.col("page_id").cast("long"), "html").filter(F.col("page_id").isNotNull()).mapInPandas(cut, ELEMENT)


def _has(name: str) -> Column:
    return F.array_contains(F.map_keys("attributes"), name)


def active(found: DataFrame) -> DataFrame:
    """The elements that a user can act on, by tag, role or handler."""
    role, editable = F.col("attributes")["role"], F.col("attributes")["contenteditable"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    return found.filter(F.col("tag").isin(*ACTIVE_TAGS) | yes(role.isin(*ACTIVE_ROLES)) | yes(editable == "true") | _has("onclick") | _has("aria-checked"))


def outermost(found: DataFrame) -> DataFrame:
    """Elements inside no other of ``found``: the furthest close of all that opened before is before they open. One sort a page, no join."""
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("last").over(before)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("pre"))).drop("_reach")


def label(inner: str = "inner") -> Column:
    """The first of the names of an element that isn't blank."""
    given = [F.col(inner) if k == "" else F.col("attributes")[k] for k in LABELS]
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in given), F.lit(UNLABELLED))


def manifest(pages: DataFrame, limit: int = 50) -> DataFrame:
    """(page_id, id, tag, label): the first ``limit`` outermost elements of each page that can be acted on, numbered from 1."""
    kept = outermost(active(elements(pages)))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).cast("long")
    return kept.select("page_id", nth.alias("id"), "tag", label().alias("label")).filter(F.col("id") <= limit)


#: Pages of a batch that a Python worker holds with all that is made of them, at most; a page may be megabytes.
BATCH_PAGES, BATCH_BYTES = 500, 16 << 20


def _small_batches(pages: DataFrame) -> None:
    """Bound the session's Arrow batches, which are only ever lowered."""
    conf = pages.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_PAGES), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))


FIELD = "page_id long, form long, field long, kind string, name string, required boolean, filled boolean, valid boolean"
PAGE = "page_id long, shown string, fields array<struct<form: bigint, field: bigint, kind: string, name: string, required: boolean, filled: boolean, valid: boolean>>"


def fields_of(rows: list[tuple]) -> list[dict]:
    """The controls of forms: where, what, whether a value is required, given, and allowed."""
    forms = [(pre, last) for pre, last, _, tag, _, _ in rows if tag == "form"]
    out = []
    for pre, last, _, tag, own, inner in rows:
        form = next((n for n, (a, b) in enumerate(forms) if a < pre <= b), None) if tag in CONTROLS else None
        if form is None:
            continue
        kind = own.get("type", "text").lower() if tag == "input" else tag
        if kind in ("checkbox", "radio"):
            group = [r[4] for r in rows if kind == "radio" and r[3] == "input" and r[4].get("type", "").lower() == "radio" and r[4].get("name") == own.get("name") and forms[form][0] < r[0] <= forms[form][1]]
            filled = "checked" in own or any("checked" in g for g in group)
        elif tag == "select":
            options = [r for r in rows if pre < r[0] <= last and r[3] == "option"]
            chosen = next((o for o in options if "selected" in o[4]), options[0] if options else None)
            filled = chosen is not None and (chosen[4]["value"] if "value" in chosen[4] else chosen[5] or "") != ""
        else:
            filled = (inner or "" if tag == "textarea" else own.get("value", "")) != ""
        barred = "disabled" in own or "readonly" in own or kind in ("hidden", "submit", "button", "reset", "image")
        required = "required" in own and not barred
        out.append({"form": form, "field": pre, "kind": kind, "name": own.get("name", ""), "required": required, "filled": filled, "valid": filled or not required})
    return out


def forms(pages: DataFrame, keep: tuple[str, ...] = (), resolved: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, shown, fields): the shown text of each page, and the fields of its forms; and the columns of ``pages`` named in ``keep``.

    ``resolved``: the names of the only character references that are resolved, of all if not given.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for html in pdf.pop("html"):
                rows, shown = read(html if isinstance(html, str) else None, resolved)
                out.append((shown, fields_of(rows)))
            yield pdf.assign(shown=[x[0] for x in out], fields=[x[1] for x in out])

    _small_batches(pages)
    held = pages.select(F.col("page_id").cast("long"), "html", *keep)
    kept = "".join(f", {held.schema[k].name} {held.schema[k].dataType.simpleString()}" for k in keep)
    return held.mapInPandas(cut, PAGE + kept)


def is_form_page(url: Column) -> Column:
    """Whether a page is one of the forms that say when they have been sent."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(F.contains(host, F.lit("docs.google.com")) & F.contains(path, F.lit("/forms/")), F.lit(False))


def confirmed(shown: Column, phrases: tuple[str, ...], first: int = 6000) -> Column:
    """Whether the shown text says, in its first characters, that a form has been sent."""
    text = F.substring(F.lower(shown), 1, first)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def unfilled(fields: Column) -> Column:
    """Whether a form of the page isn't valid yet."""
    return F.exists(fields, lambda f: ~f["valid"])
