"""Trees in reading order against recursive walks."""

import json
import random
import sys

import pytest

from factloom.operators import trees
from factloom.sources import files, html


def walk(children, node=None):
    for child in sorted(children.get(node, []), key=lambda x: x[1]):
        yield child[0]
        yield from walk(children, child[0])


@pytest.mark.parametrize("shape", ["random", "deep", "wide"])
def test_paths_equal_a_walk(spark, shape):
    rnd, rows, children = random.Random(7), [], {}
    for tree in (1, 2):
        for n in range(300):
            parent = None if n == 0 or (shape == "random" and rnd.random() < 0.02) else n - 1 if shape == "deep" else 0 if shape == "wide" else rnd.randrange(n)
            place = sum(r[0] == tree and r[2] == parent for r in rows)
            rows.append((tree, n, parent, place))
    shuffled = rnd.sample(rows, len(rows))
    got = trees.paths(spark.createDataFrame(shuffled, "tree int, node int, parent int, place int"), ["tree"])
    for tree in (1, 2):
        children = {}
        for t, n, parent, place in rows:
            if t == tree:
                children.setdefault(parent, []).append((n, place))
        sys.setrecursionlimit(5000)
        assert [r.node for r in got.filter(f"tree = {tree}").orderBy("path").collect()] == list(walk(children))


def test_cycles_raise_and_orphans_are_roots(spark):
    made = lambda rows: spark.createDataFrame(rows, "tree int, node int, parent int, place int")
    assert trees.paths(made([(1, 5, 99, 3), (1, 6, 5, 0)]), ["tree"]).count() == 2
    assert trees.paths(made([]), ["tree"]).count() == 0
    with pytest.raises(ValueError, match="ancestors"):
        trees.paths(made([(1, 1, 2, 0), (1, 2, 1, 0), (1, 3, None, 0)]), ["tree"])


def test_page_nodes_nest():
    rows = list(html.nodes_of("<ul><li>a<li><b>b</b> c</ul><p>d<br>e<p>f</i></p><script>if (a<b) x</script><!-- <p> -->g"))
    up = {n: p for n, p, *_ in rows}
    kinds = {n: k for n, _, _, k, _ in rows}
    assert [(t, kinds.get(up[n])) for n, _, _, k, t in rows if k == "#text"] == [("a", "li"), ("b", "b"), ("c", "li"), ("d", "p"), ("e", "p"), ("f", "p"), ("g", None)]
    assert [k for _, p, _, k, _ in rows if p is None] == ["ul", "p", "p", "script", "#text"]
    assert list(html.nodes_of("")) == [] and list(html.nodes_of("<")) == []


def test_layout_chunks(spark, tmp_path):
    ref = lambda *xs: [{"$ref": f"#/{x}"} for x in xs]
    text = lambda label, said, page=1: {"label": label, "text": said, "prov": [{"page_no": page}]}
    grid = lambda x: {"grid": [[{"text": x, "column_header": True}]]}
    chunk = {
        "body": {"children": ref("texts/1", "groups/1", "tables/0", "texts/9")},
        "groups": [{"children": ref("texts/2", "tables/1")}, {"children": ref("texts/0", "groups/0", "tables/2")}],
        "texts": [text("text", "zero"), text("section_header", " One "), text("caption", "Two")],
        "tables": [
            {"label": "table", "captions": ref("texts/0"), "prov": [{"page_no": 4}], "data": grid("a")},
            {"label": "table", "captions": [], "prov": [], "data": grid("b")},
            {"label": "document_index", "captions": [], "prov": [], "data": grid("c")},
        ],
    }
    (tmp_path / "doc").mkdir()
    for name, value in {"p0001-0002.json": chunk, "p0003-0004.json": {"body": {"children": ref("tables/0")}, "groups": [], "texts": [], "tables": chunk["tables"][1:2]}, "manifest.json": {}}.items():
        (tmp_path / "doc" / name).write_text(json.dumps(value))
    got = trees.layout_items(files.layout_chunks(spark, str(tmp_path))).orderBy("chunk", "path").collect()
    assert [(r.kind, r.text or r.grid[0][0].text, r.section, r.page) for r in got] == [
        ("text", " One ", "One", 1), ("text", "zero", "One", 1), ("text", "Two", "Two", 1), ("table", "b", "Two", None), ("table", "a", "zero", 4), ("table", "b", "", None),
    ]


def test_paths_broadcast_no_nodes(spark):
    rows = [(t, n, n - 1 if n else None, 0) for t in range(3) for n in range(40)]
    placed = trees.paths(spark.createDataFrame(rows, "tree int, node int, parent int, place int"), ["tree"])
    assert "Broadcast" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.count() == len(rows)
