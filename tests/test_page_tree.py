"""Pages as nodes: broken and misnested markup, attributes, references, and the facts that the column functions give."""

import random

import pytest
from pyspark.sql import functions as F

from listwright.functions import html as H
from listwright.functions import page_tree as T
from listwright.functions.page_tree import page_nodes
from listwright.operators import facts as X


def shown(html, tag, attribute=None, value=None):
    """Text of the first such element, None if there is none."""
    text, nodes = page_nodes(html)
    names = ["tag", "pre", "until", "start", "end", *T.ATTRIBUTES]
    for node in (dict(zip(names, n)) for n in nodes):
        if node["tag"] == tag and (attribute is None or value in (node[attribute] or "").split()):
            return text[node["start"] : node["end"]].strip(" \t\r\n\f")
    return None


CASES = [
    ('<ul><li class="phone">514-555-1234<li class="website">w</ul>t', "li", "class", "phone", "514-555-1234"),
    ('<li class="phone">a<ul><li>b</li></ul>c</li>d', "li", "class", "phone", "abc"),
    ('<h1 title="a>b" itemprop="name">N</h1>', "h1", "itemprop", "name", "N"),
    ('<h1 title="x itemprop=name">no</h1><h1 itemprop=name>N', "h1", "itemprop", "name", "N"),
    ("<h1 title=it's itemprop='x name'>N</h1>", "h1", "itemprop", "name", "N"),
    ("<div class=q><diva>1</diva><DIV >2</div\n>3</Div>4", "div", "class", "q", "123"),
    ("<div class=q>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "y</div>z", "div", "class", "q", "xy"),
    ("<div class=q><b>1</div>2</b>3", "div", "class", "q", "1"),
    ("<b class=q>1<div>2</b>3</div>", "b", "class", "q", "12"),
    ("<p class=q>1<div>2</div>", "p", "class", "q", "1"),
    ("<table><tr><td class=q>1<table><tr><td>2</table>3<td>4", "td", "class", "q", "123"),
    ("<h2 class=q>1<h3>2", "h2", "class", "q", "1"),
    ("<a class=q href=x>1<a>2", "a", "class", "q", "1"),
    ("<p>", "p", None, None, ""),
    ("", "p", None, None, None),
    ("<!-- <p>no</p> --><script><p>no</script><p>&eacute;&amp;&copy x &bogus; &#233;", "p", None, None, "é&© x &bogus; é"),
]


@pytest.mark.parametrize(("html", "tag", "attribute", "value", "wanted"), CASES)
def test_elements(html, tag, attribute, value, wanted):
    assert shown(html, tag, attribute, value) == wanted


def test_equals_column_functions(spark):
    """On random markup, the first element of each kind is the one that the regular expressions cut out."""
    chance = random.Random(1)
    tags = ["div", "p", "li", "ul", "td", "table", "tr", "a", "h1", "h3", "span", "b"]
    pieces = [f"<{t}>" for t in tags] + [f"</{t}>" for t in tags] + [f'<{t} class="x q" title="a>b">' for t in tags] + ["t ", "u&amp;", "v"]
    htmls = ["".join(chance.choices(pieces, k=chance.randint(1, 25))) for _ in range(300)]
    looked = ["div", "li", "td", "a", "h1", "span", "b", "table", "p"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")
    slow = df.select("page_id", *[H.first_element_text(F.col("html"), t, "class", "q").alias(t) for t in looked]).collect()
    for row in slow:
        html = htmls[row["page_id"]]
        for tag in looked:
            assert shown(html, tag, "class", "q") == row[tag], (tag, html)


def test_marker_cells(spark):
    image = '<img src="/mapfiles/marker-noalpha.png">'
    cases = {
        f"<td>{image}<td>5 Rue X<tr><td>no": "5 Rue X",
        f"<td>{image}</td></tr><tr><td>no</td>": None,
        f"<table><tr><td>{image}</td><td>5, Rue (514) 273-7443</td></tr></table>": "5, Rue (514) 273-7443",
        f"<table><tr><td>{image}</td></tr></table><td>no</td>": None,
        "<td>none": None,
    }
    rows = [(i, "search", None, None, h) for i, h in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, source string, lookup_key string, url string, html string")
    tree = T.with_tree(df)
    got = {r["page_id"]: r["c"] for r in tree.select("page_id", X._marker_cell(F.col("text"), F.col("nodes")).alias("c")).collect()}
    assert list(got[i] for i in range(len(cases))) == list(cases.values())


def test_pages_are_held_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD", 40)
    htmls = {i: f"<p>{'x' * (i % 50)}<a href=/{i}>l{i}</a>" for i in range(200)} | {200: None, 201: ""}
    df = spark.createDataFrame(list(htmls.items()), "page_id long, html string").coalesce(1)
    rows = T.with_tree(df).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: None if h is None else page_nodes(h)[0] for i, h in htmls.items()}
    assert all([n["href"] for n in r["nodes"] if n["tag"] == "a"] == [f"/{r['page_id']}"] for r in rows if r["page_id"] < 200)


def test_trees_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<a href=''>é😀</a><a>t", "z")], "page_id long, html string, nodes_of string")
    rows = {r["page_id"]: r for r in T.with_tree(df).collect()}
    assert (rows[1]["text"], rows[1]["nodes"], rows[2]["text"], rows[2]["nodes"]) == (None, [], "", [])
    assert rows[3]["nodes_of"] == "z" and [n["tag"] for n in rows[3]["nodes"]] == ["a", "#text", "a", "#text"]
    links = [tuple(r) for r in X.anchors(df).collect()]
    assert links == [(3, 0, "", "é😀", False)]
    nodes = X.page_nodes(df)
    inside = X.nodes_within(nodes.filter("tag = 'a'"), nodes.filter("tag = 'b'"))
    assert inside.count() == 0 and X.page_nodes(df.limit(0)).count() == 0


def test_nodes_wanted_by_kind(spark):
    """Facts of a kind of page get the nodes that they are made of, not all."""
    html = '<h1 class="t">Name</h1><p>much <b>else</b></p><a href="/x">link</a>'
    pages = spark.createDataFrame([(i, kind, html) for i, kind in enumerate(("profile", "review", "other", None))], "page_id int, source string, html string")
    trees = T.with_tree(pages, set(), tags_of={"profile": {"a"}, "review": None}, kind="source")
    found = {r["source"]: [n["tag"] for n in r["nodes"]] for r in trees.collect()}
    everything = [node[0] for node in page_nodes(html)[1]]
    assert found == {"profile": ["a"], "review": everything, "other": [], None: []}
    assert {r["text"] for r in trees.collect()} == {"Namemuch elselink"}
