"""Fields of stored pages by lists of selectors over a parsed element tree.

A page is parsed once, by the standard library's parser, for all its fields.  A field has
selectors in order of trust; the first whose first element has a text within the
field's length window gives the value.  Selectors know tags, #id, .class, [name],
[name=value], [name*=part], :contains(text), descendants (space) and children (>).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose pages are held as text at once.
ROWS = 64
#: Elements without content, and those that a sibling of the same name ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = frozenset("p li tr td th option dt dd".split())

_PART = re.compile(r"""([\w-]+|\*)|\#([\w+-]+)|\.([\w+-]+)|\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]|:contains\(([^)]*)\)""")


class Element:
    __slots__ = ("tag", "attrs", "parent", "order", "words")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, order: int):
        self.tag, self.attrs, self.parent, self.order, self.words = tag, attrs, parent, order, []

    def text(self) -> str:
        return " ".join("".join(self.words).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.every: list[Element] = []
        self.open: list[Element] = []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS and self.open and self.open[-1].tag == tag:
            self.open.pop()
        one = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.every))
        self.every.append(one)
        if tag not in VOID:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1].tag in ("script", "style"):
            return
        for one in self.open:
            one.words.append(data)


def parse(html: str | None) -> list[Element]:
    """All elements in document order."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.every


def compiled(selector: str) -> list[tuple[str, list[tuple]]]:
    """Steps from the left: (how it hangs on the one before, its tests)."""
    steps, how = [], " "
    for word in re.findall(r"""(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+|>""", selector.strip()):
        if word == ">":
            how = ">"
            continue
        tests, at = [], 0
        while at < len(word):
            m = _PART.match(word, at)
            if not m:
                raise ValueError(f"unknown selector {selector!r} at {word[at:]!r}")
            tag, ident, name, attr, op, value, text = m.groups()
            if tag:
                tests.append(("tag", tag.lower()))
            elif ident:
                tests.append(("id", ident))
            elif name:
                tests.append(("class", name))
            elif attr:
                tests.append((op or "has", attr.lower(), value or ""))
            else:
                tests.append(("text", text.strip("\"'")))
            at = m.end()
        steps.append((how, tests))
        how = " "
    if not steps:
        raise ValueError("an empty selector")
    return steps


def _passes(e: Element, tests: list[tuple]) -> bool:
    for kind, *what in tests:
        if kind == "tag":
            ok = what[0] in ("*", e.tag)
        elif kind == "id":
            ok = e.attrs.get("id") == what[0]
        elif kind == "class":
            ok = what[0] in e.attrs.get("class", "").split()
        elif kind == "text":
            ok = what[0] in e.text()
        else:
            held = e.attrs.get(what[0])
            ok = held is not None and (kind == "has" or (what[1] in held if kind == "*=" else held == what[1]))
        if not ok:
            return False
    return True


def _hangs(e: Element, steps: list[tuple], root: Element | None) -> bool:
    """Whether ``e`` meets the last step and its ancestors below ``root`` the others."""
    how, tests = steps[-1]
    if not _passes(e, tests):
        return False
    if len(steps) == 1:
        return how != ">" or e.parent is root
    up = e.parent
    while up is not None and up is not root:
        if _hangs(up, steps[:-1], root):
            return True
        if how == ">":
            return False
        up = up.parent
    return False


def select(every: list[Element], steps: list[tuple], root: Element | None = None) -> Iterator[Element]:
    """Elements that meet a compiled selector, in document order; below ``root`` alone
    where that is given."""
    for e in every:
        if root is not None:
            up = e.parent
            while up is not None and up is not root:
                up = up.parent
            if up is None:
                continue
        if _hangs(e, steps, root):
            yield e


@dataclass(frozen=True)
class Field:
    """Selectors by trust; texts (or values of ``attr``) shorter than ``least`` or longer than
    ``most`` don't count.  ``every``: all values of the first selector that has any."""

    selectors: tuple[str, ...]
    least: int = 1
    most: int = 10_000
    attr: str | None = None
    every: bool = False

    def value(self, elements: list[Element], steps: list[list[tuple]]):
        for one in steps:
            found = []
            for e in select(elements, one):
                v = e.attrs.get(self.attr, "").strip() if self.attr else e.text()
                if self.least <= len(v) <= self.most:
                    found.append(v)
                if not self.every:  # the first element alone speaks for a selector
                    break
            if found:
                return found if self.every else found[0]
        return [] if self.every else None


#: The stores' selectors, in their order, and their titles' length windows.
STORE_FIELDS: dict[str, dict[str, Field]] = {
    "amazon": {
        "title": Field(("h1#title #productTitle", "#productTitle", "h1#title", "#titleSection h1", ".product-title-word-break"), 11, 249),
        "price": Field(("#corePriceDisplay_desktop_feature_div .priceToPay .a-price-whole", "#corePriceDisplay_desktop_feature_div .a-price-whole")),
        "original_price": Field(("#corePriceDisplay_desktop_feature_div span[data-a-strike='true'] .a-offscreen", "#corePriceDisplay_desktop_feature_div .basisPrice .a-text-price .a-offscreen", "span[data-a-strike='true']")),
        "availability": Field(("#availability span", ".a-color-success", ".a-color-state", "[data-feature-name='availability'] span")),
    },
    "flipkart": {
        "title": Field(("span.VU-ZEz", "h1 span:contains(GB):contains(RAM)", "span:contains(GB):contains(RAM)")),
        "price": Field(("div.Nx9bqj", "div.CxhGGd")),
        "original_price": Field(("div.yRaY8j.A6+E6v", "div.A6+E6v")),
        "availability": Field(()),
    },
    "croma": {"title": Field(("h1.pd-title",)), "price": Field(("span#pdp-product-price",)), "original_price": Field(("span#old-price",)), "availability": Field(())},
    "reliance": {"title": Field((".product-name",)), "price": Field((".product-price",)), "original_price": Field((".product-marked-price",)), "availability": Field(())},
}


@dataclass(frozen=True)
class Block:
    """Links in blocks whose ``heading`` element has exactly the text ``says``."""

    block: str
    heading: str
    says: str
    link: str


#: Where a store lists similar products.
SIMILAR = {"flipkart": Block(".pq8uUv", "div.jOp9db", "Similar Products", "a.VJA3rP")}


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def select_fields(pages: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """page_id, url and a column for each field, null (an empty array for
    ``every``) where no selector gives a value.  ``pages`` needs page_id, url, html."""
    steps = {name: [compiled(s) for s in f.selectors] for name, f in fields.items()}
    kinds = {name: pa.list_(pa.string()) if f.every else pa.string() for name, f in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            rows = [[f.value(tree, steps[name]) for name, f in fields.items()] for tree in map(parse, batch.column("html").to_pylist())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", *fields])

    schema = ", ".join(f"`{n}` {'array<string>' if f.every else 'string'}" for n, f in fields.items())
    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {key}, url string, {schema}")


def block_links(pages: DataFrame, block: Block) -> DataFrame:
    """page_id, pos and link of every anchor of the page's blocks with that heading."""
    outer, heading, link = (compiled(s) for s in (block.block, block.heading, block.link))

    def links(html: str | None) -> list[str]:
        tree, out = parse(html), []
        for one in select(tree, outer):
            if "".join(e.text() for e in select(tree, heading, one)) == block.says:
                out += [h for e in select(tree, link, one) if (h := e.attrs.get("href"))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            rows = [(k, pos, h) for k, html in enumerate(batch.column("html").to_pylist()) for pos, h in enumerate(links(html))]
            at, pos, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(found, pa.string())], names=["page_id", "pos", "link"])

    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {key}, pos int, link string")
