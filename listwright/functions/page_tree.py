"""A page as nodes: one pass over its HTML, then elements, texts and links are looked up among the nodes.

``with_tree`` puts a page's text and its nodes into one row, so that facts of a page need neither joins nor a shuffle.
A node is an interval: ``pre`` numbers its opening tag among all tags of the page, ``until`` the tag that ends it, so one node
stands in another if its ``pre`` lies between the two; ``start`` and ``end`` cut its text out of the page's.

Pages are often broken. An element ends where the depth of its own tag name returns to zero, where HTML implies its end (list
items, cells, paragraphs, headings, links), or with the page. So misnested tags of other names neither end nor lose it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import listwright
from listwright.functions.text import trim_blanks

ATTRIBUTES = ("id", "class", "itemprop", "href", "src")
TEXT = "#text"

_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^>=]*+)*+"""
_PIECE = re.compile(
    rf"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<(/?)([a-z][^\s/>]*+)(?:({_REST})>|([^>]*)>)|<[^>]*>", re.I | re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""")
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_CELLS = frozenset(("td", "th"))
_LISTS = frozenset(("ul", "ol", "menu"))
_ENDS_CELL = frozenset("td th tr thead tbody tfoot".split())
_ENDS_PARAGRAPH = _HEADINGS | frozenset(
    "p div ul ol li dl table td th tr article section nav main aside header footer address form body html".split()
)

NODE = pa.struct(
    [("tag", pa.string()), ("pre", pa.int32()), ("until", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    + [(name, pa.string()) for name in ATTRIBUTES]
)
NODE_SQL = "tag string, pre int, until int, start int, end int, " + ", ".join(f"{name} string" for name in ATTRIBUTES)


_NO_ATTRIBUTES = (None,) * len(ATTRIBUTES)


def _attributes(tag_text: str) -> tuple:
    if "=" not in tag_text:
        return _NO_ATTRIBUTES
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag_text):
        name = name.lower()
        if name in ATTRIBUTES and name not in found:
            value = value[1:-1] if value[0] in "\"'" else value
            found[name] = entities.unescape(value) if "&" in value else value
    return tuple(map(found.get, ATTRIBUTES))


# Depths that are counted, and kinds that no end tag of their own ends.
_LIST, _TABLE = 0, 1
_IMPLIED = frozenset(("li", "cell", "a", "heading", "p"))


def _rule(name: str) -> tuple:
    """What a tag of this name ends, as (kind, depth that counts), where it opens and where it closes; its kind, the depth that it
    changes, the depth that it stands at, and whether it is always empty."""
    both, closing = [], []
    if name == "li":
        both.append(("li", _LIST))
    if name in _LISTS:
        closing.append(("li", _LIST))
    if name in _ENDS_CELL:
        both.append(("cell", _TABLE))
    if name == "table":
        closing.append(("cell", _TABLE))
    if name == "a":
        both.append(("a", None))
    if name in _HEADINGS:
        both.append(("heading", None))
    if name in _ENDS_PARAGRAPH:
        both.append(("p", None))
    kind = "cell" if name in _CELLS else "heading" if name in _HEADINGS else name
    changes = _LIST if name in _LISTS else _TABLE if name == "table" else None
    stands = {"li": _LIST, "cell": _TABLE}.get(kind)
    return tuple(both), (*closing, *both), kind, changes, stands, name in _EMPTY


_RULES = {name: _rule(name) for name in _EMPTY | _HEADINGS | _CELLS | _LISTS | _ENDS_CELL | _ENDS_PARAGRAPH | _IMPLIED}


def page_nodes(html: str, wanted: frozenset[str] | None = None) -> tuple[str, list[list]]:
    """A page's text, and its nodes as rows of NODE: all, or those of some tag names (and '#text' for stretches of text)."""
    nodes: list[list] = []
    texts: list[str] = []
    open_nodes: dict[str, list] = {}  # by name or kind of end: (node, depth of lists or tables)
    depth = [0, 0]  # of lists, of tables
    chars = tags = last = 0
    with_text = wanted is None or TEXT in wanted

    def add_text(piece: str) -> int:
        piece = entities.unescape(piece) if "&" in piece else piece
        if with_text:
            nodes.append([TEXT, tags, tags, chars, chars + len(piece), *_NO_ATTRIBUTES])
        texts.append(piece)
        return len(piece)

    for piece in _PIECE.finditer(html):
        start, end = piece.span()
        if start > last:
            chars += add_text(html[last:start])
        last = end
        closing, name, tag_text, broken = piece.groups()
        if not name:
            continue
        tags += 1
        name = name.lower()
        on_open, on_close, kind, changes, stands, empty = _RULES.get(name) or ((), (), name, None, None, False)
        for ended, least in on_close if closing else on_open:
            if held := open_nodes.get(ended):
                while held and (least is None or held[-1][1] >= depth[least]):
                    node = held.pop()[0]
                    if node is not None:
                        node[2], node[4] = tags, chars
        if changes is not None:
            depth[changes] += -1 if closing else 1
        if closing:
            if kind not in _IMPLIED and (held := open_nodes.get(kind)):
                node = held.pop()[0]
                if node is not None:
                    node[2], node[4] = tags, chars
            continue
        node = None
        if wanted is None or name in wanted:
            node = [name, tags, None, chars, None, *_attributes(broken if tag_text is None else tag_text)]
            nodes.append(node)
        if empty:
            if node is not None:
                node[2], node[4] = tags, chars
        else:
            open_nodes.setdefault(kind, []).append((node, 0 if stands is None else depth[stands]))
    if last < len(html):
        chars += add_text(html[last:])
    tags += 1
    for node in nodes:
        if node[2] is None:
            node[2], node[4] = tags, chars
    return "".join(texts), nodes


# Bytes of HTML whose nodes are held at a time; of at least one page.
HELD = 1 << 22


def _slices(batch: pa.RecordBatch, at: str) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if held and held + (size or 0) > HELD:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    yield batch.slice(start)


def _trees(at: str, schema: pa.Schema, wanted: frozenset[str] | None, kinds: dict[str, frozenset[str] | None], kind: str | None):
    def trees(batches) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, at)):
            texts, nodes, offsets = [], [], [0]
            pages = batch.column(at).to_pylist()
            for html, of_kind in zip(pages, batch.column(kind).to_pylist() if kind else [None] * len(pages)):
                text, found = (None, []) if html is None else page_nodes(html, kinds.get(of_kind, wanted))
                texts.append(text)
                nodes += found
                offsets.append(len(nodes))
            columns = list(zip(*nodes)) if nodes else [()] * len(NODE)
            rows = pa.StructArray.from_arrays([pa.array(c, field.type) for c, field in zip(columns, NODE)], fields=list(NODE))
            kept = batch.drop_columns([at])
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string()), held.cast(schema.field("nodes").type)], schema=pa.schema([*kept.schema, *schema]))

    return trees


def with_tree(
    pages: DataFrame,
    tags: set[str] | None = None,
    html: str = "html",
    tags_of: dict[str, set[str] | None] | None = None,
    kind: str | None = None,
) -> DataFrame:
    """``pages`` with ``text`` and ``nodes`` in place of the HTML. ``tags`` names the nodes that are wanted (None: all); ``tags_of``
    does so by the value of the column ``kind``, for the values that it has.

    Of a null page the text is null and there are no nodes. A page is one row's work; the nodes of few pages are held at a time.
    """
    def wish(names: set[str] | None) -> frozenset[str] | None:
        return None if names is None else frozenset(names)

    kinds = {value: wish(names) for value, names in (tags_of or {}).items()}
    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in pages.schema if field.name != html)
    schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE))])
    cloudpickle.register_pickle_by_value(listwright)
    pages = pages.withColumn(html, F.col(html).cast("string"))
    return pages.mapInArrow(_trees(html, schema, wish(tags), kinds, kind), f"{kept}, text string, nodes array<struct<{NODE_SQL.replace(' string', ':string').replace(' int', ':int')}>>")


def marked(node: Column, tag: str | None = None, attribute: str | None = None, value: str | None = None) -> Column:
    """Whether a node has a tag name, and ``value`` as one of an attribute's words."""
    test = F.lit(True) if tag is None else node["tag"] == tag
    if attribute is None:
        return test
    # Only what holds the value at all is split into words.
    held = F.contains(node[attribute], F.lit(value)) & F.array_contains(F.split(node[attribute], r"\s+"), value)
    return test & F.coalesce(held, F.lit(False))


def elements(nodes: Column, tag: str | None, attribute: str | None = None, value: str | None = None) -> Column:
    """All such nodes, in the order in which they open."""
    return F.filter(nodes, lambda node: marked(node, tag, attribute, value))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def last(nodes: Column) -> Column:
    return F.get(F.reverse(nodes), F.lit(0))


def within(nodes: Column, outer: Column) -> Column:
    """Those that stand in ``outer``; none if that is null."""
    return F.filter(nodes, lambda node: (node["pre"] > outer["pre"]) & (node["pre"] < outer["until"]))


def raw_text(text: Column, node: Column) -> Column:
    return F.substr(text, node["start"] + 1, node["end"] - node["start"])


def text_of(text: Column, node: Column) -> Column:
    """A node's text, trimmed; NULL if there is no node."""
    return trim_blanks(raw_text(text, node))
