"""HTML as tokens: elements of web pages with their attributes, texts and places in tables.

Pages are scanned once, from left to right, in Arrow batches where they lie. The scanner knows the three
forms of attributes (double and single quotes, bare), entities, comments, raw text of scripts and styles,
and end tags that are missing: an element ends where its own end tag stands, where an outer one ends, or where
another begins that can't be inside it (IMPLIED). Of attributes that repeat the last one counts. A null
page has no elements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements whose content is text, and what a tag's beginning ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
IMPLIED = {"a": ("a",), "option": ("option",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "p": ("p",)}
#: What an implied end doesn't reach beyond.
BORDERS = frozenset(("table", "select", "ul", "ol", "html"))
#: Elements of a batch, as far as a page allows.
HANDED_ON = 1 << 12
_SPACE = " \t\n\r\f"
_NAME_END = re.compile(r"[ \t\n\r\f/>]")
_ATTRIBUTE_END = re.compile(r"[ \t\n\r\f/>=]")
_BARE_END = re.compile(r"[ \t\n\r\f>]")


def _tag(s: str, at: int) -> tuple[str, dict[str, str], int] | None:
    """Name, attributes and end of the tag whose name begins at `at`; None if the page ends within it."""
    found = _NAME_END.search(s, at)
    if not found:
        return None
    name, i, attributes = s[at : found.start()].lower(), found.start(), {}
    while i < len(s):
        c = s[i]
        if c == ">":
            return name, attributes, i + 1
        if c in _SPACE or c == "/":
            i += 1
            continue
        found = _ATTRIBUTE_END.search(s, i + 1)  # a name may begin with =
        if not found:
            return None
        key, i, value = s[i : found.start()].lower(), found.start(), ""
        after = i
        while after < len(s) and s[after] in _SPACE:
            after += 1
        if after < len(s) and s[after] == "=":
            i = after + 1
            while i < len(s) and s[i] in _SPACE:
                i += 1
            if i < len(s) and s[i] in "\"'":
                end = s.find(s[i], i + 1)
                if end < 0:
                    return None
                value, i = s[i + 1 : end], end + 1
            else:
                found = _BARE_END.search(s, i)
                if not found:
                    return None
                value, i = s[i : found.start()], found.start()
        attributes[key] = unescape(value)
    return None


def tokens(s: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", characters, {}), ("start", name, attributes), ("end", name, {}) in their order."""
    i, n = 0, len(s)
    while i < n:
        j = s.find("<", i)
        if j < 0:
            j = n
        if j > i:
            yield "text", unescape(s[i:j]), {}
        if j == n:
            return
        after = s[j + 1 : j + 2]
        if s.startswith("<!--", j):
            end = s.find("-->", j + 4)
            i = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = s.find(">", j)
            i = n if end < 0 else end + 1
        elif after == "/":
            end = s.find(">", j)
            if end < 0:
                return
            name = s[j + 2 : end].split(maxsplit=1)
            if name:
                yield "end", name[0].lower(), {}
            i = end + 1
        elif after.isascii() and after.isalpha():
            found = _tag(s, j + 1)
            if not found:
                return
            name, attributes, i = found
            yield "start", name, attributes
            if name in RAW:
                close = re.compile(f"</{name}", re.I).search(s, i)
                end = close.start() if close else n
                text = s[i:end]
                yield "text", unescape(text) if name in ("textarea", "title") else text, {}
                i = end
        else:
            yield "text", "<", {}
            i = j + 1


class Element:
    __slots__ = ("tag", "attributes", "parts", "row", "cell", "select")

    def __init__(self, tag: str, attributes: dict[str, str], row: int, cell: int, select: str | None):
        self.tag, self.attributes, self.parts = tag, attributes, []
        self.row, self.cell, self.select = row, cell, select

    @property
    def text(self) -> str:
        return re.sub(r"[ \t\n\r\f\v]+", " ", "".join(self.parts)).strip(" ")


def scan(s: str, wanted: frozenset[str]) -> list[Element]:
    """The wanted elements in the order in which they begin."""
    out: list[Element] = []
    open_: list[tuple[str, Element | None]] = []
    there: Counter[str] = Counter()
    hearing: list[Element] = []  # open elements that texts are for
    rows: list[list[int]] = []  # open table rows: number, cells so far
    selects: list[str | None] = []
    n_rows = 0

    def close() -> None:
        tag, element = open_.pop()
        there[tag] -= 1
        if element is not None:
            hearing.remove(element)
        if tag == "tr":
            rows.pop()
        if tag == "select":
            selects.pop()

    for kind, name, attributes in tokens(s):
        if kind == "text":
            for e in hearing:
                if e.tag not in ("script", "style") and open_[-1][0] in ("script", "style"):
                    continue
                e.parts.append(name)
        elif kind == "end":
            if there[name]:
                while open_[-1][0] != name:
                    close()
                close()
        else:
            ended = IMPLIED.get(name, ())
            if any(there[t] for t in ended):
                k = len(open_) - 1
                while k >= 0 and open_[k][0] not in ended and open_[k][0] not in BORDERS:
                    k -= 1
                if k >= 0 and open_[k][0] in ended:
                    while len(open_) > k:
                        close()
            if name == "tr":
                rows.append([n_rows, 0])
                n_rows += 1
            if name == "td" and rows:
                rows[-1][1] += 1
            row, cell = (rows[-1][0], rows[-1][1] - 1) if rows else (-1, -1)
            if name == "select":
                selects.append(attributes.get("name"))
            element = None
            if name in wanted:
                element = Element(name, attributes, row, cell, selects[-1] if selects else None)
                out.append(element)
            if name not in VOID:
                open_.append((name, element))
                there[name] += 1
                if element is not None:
                    hearing.append(element)
    return out


def elements(pages: DataFrame, key: str, html: str, tags: list[str], base: str | None = None) -> DataFrame:
    """key, pos (among these, from 0), tag, attributes, text (white space collapsed), row and cell (of the
    enclosing table row, in the page's and the row's order from 0, else -1), select_name, url: the element's
    href joined to the page's address in column `base`; null without one."""
    wanted = frozenset(tags)
    kind = pages.select(key).schema[0].dataType.simpleString()

    def batch_of(keys: pa.Array, held: list[tuple[int, int, Element, str | None]]) -> pa.RecordBatch:
        of, pos, found, urls = zip(*held)
        return pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(of)), pa.array(pos, pa.int32()), pa.array([e.tag for e in found]), pa.array([list(e.attributes.items()) for e in found], pa.map_(pa.string(), pa.string())),
                pa.array([e.text for e in found]), pa.array([e.row for e in found], pa.int32()), pa.array([e.cell for e in found], pa.int32()), pa.array([e.select for e in found], pa.string()), pa.array(urls, pa.string()),
            ],
            ["key", "pos", "tag", "attributes", "text", "row", "cell", "select_name", "url"],
        )

    def run(batches):
        for batch in batches:
            keys, held = batch.column("key"), []
            for i, (s, address) in enumerate(zip(batch.column("html"), batch.column("base"))):
                address = address.as_py()
                held += [(i, k, e, _joined(address, e.attributes.get("href"))) for k, e in enumerate(scan(s.as_py() or "", wanted))]
                if len(held) >= HANDED_ON:
                    yield batch_of(keys, held)
                    held = []
            if held:
                yield batch_of(keys, held)

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"), (F.col(base) if base else F.lit(None)).cast("string").alias("base"))
    schema = f"key {kind}, pos int, tag string, attributes map<string,string>, text string, row int, cell int, select_name string, url string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _joined(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href.strip())
    except ValueError:  # an address that is none
        return None
