"""Trees as rows (node, parent, place among its siblings), put in reading order without walking them.

A node's path is the places of its ancestors and its own, from the root on; paths compare as a walk that takes parents
before children and siblings by place. Each round joins a node with the ancestor that its path begins below and so doubles
the path's reach: a tree of depth d takes about log2(d) joins, however wide it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.database import written

#: Labels of a layout's items that head what follows, and of tables that are no tables (fixed values).
HEADS, CONTENTS = ("section_header", "title", "caption"), "document_index"


def paths(nodes: DataFrame, tree: list[str], node: str = "node", parent: str = "parent", place: str = "place") -> DataFrame:
    """nodes with path (array of places from the root). A null parent, or one that isn't there, makes a root.

    Every node has one parent and one row. A cycle raises: it has no root, whatever the number of rounds.

    Places and ids pack so well that a table of all nodes can lie in less than a broadcast's limit of files and still be
    hundreds of MB as rows, so its joins are merges.
    """
    at = [F.col(c).alias(f"_t{i}") for i, c in enumerate(tree)]
    keys = [f"_t{i}" for i in range(len(tree))]
    state = written(nodes.select(*at, F.col(node).alias("_node"), F.col(parent).alias("_top"), F.array(place).alias("path")), "paths")
    most = math.ceil(math.log2(max(2, state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0))) + 1
    for _ in range(most):
        if not state.filter("_top is not null").take(1):
            break
        up = state.select(*keys, F.col("_node").alias("_at"), F.col("_top").alias("_next"), F.col("path").alias("_above"))
        met = state.join(up.withColumnRenamed("_at", "_top").hint("merge"), [*keys, "_top"], "left")
        state = written(met.select(*keys, "_node", F.col("_next").alias("_top"), F.concat(F.coalesce("_above", F.array().cast("array<int>")), "path").alias("path")), "paths")
    else:
        if state.filter("_top is not null").take(1):
            raise ValueError("nodes are their own ancestors")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(tree, keys)]
    return nodes.join(state.drop("_top").hint("merge"), [*same, F.col(node) == F.col("_node")]).drop(*keys, "_node")


def in_sections(items: DataFrame, tree: list[str], head: Column, text: str = "text", order: str = "path") -> DataFrame:
    """items with section: the text of the last item that is a head, itself included; empty before the first."""
    place = Window.partitionBy(*tree).orderBy(order)
    return items.withColumn("section", F.coalesce(F.last(F.when(head, F.trim(text)), ignorenulls=True).over(place), F.lit("")))


_REF = "struct<`$ref`: string>"
#: A chunk of a layout reader's output: a tree of references into lists of texts, tables and nested groups.
LAYOUT = (
    f"body struct<children: array<{_REF}>>, groups array<struct<children: array<{_REF}>>>, "
    "texts array<struct<label: string, text: string, prov: array<struct<page_no: int>>>>, "
    f"tables array<struct<label: string, captions: array<{_REF}>, prov: array<struct<page_no: int>>, "
    "data: struct<grid: array<array<struct<text: string, column_header: boolean>>>>>>"
)


def layout_edges(chunks: DataFrame) -> DataFrame:
    """doc, chunk, node (a reference), parent (null below the body), place: what hangs below what in each chunk."""
    ref = lambda c: F.transform(c, lambda x: x["$ref"])
    body = chunks.select("doc", "chunk", F.lit(None).cast("string").alias("parent"), F.posexplode(ref(F.col("body.children"))).alias("place", "node"))
    groups = chunks.select("doc", "chunk", F.posexplode("groups").alias("_g", "group"))
    below = groups.select("doc", "chunk", F.concat(F.lit("#/groups/"), "_g").alias("parent"), F.posexplode(ref(F.col("group.children"))).alias("place", "node"))
    return body.unionByName(below)


def layout_items(chunks: DataFrame) -> DataFrame:
    """doc, chunk, path, kind (text or table), label, page, text, grid, section of what the body reaches, in reading order
    by chunk and path. A table's section is its caption, else the last head before it in its chunk; tables of contents are
    left out."""
    listed = lambda kind: chunks.select("doc", "chunk", F.posexplode(kind).alias("_i", "_x")).withColumn("node", F.concat(F.lit(f"#/{kind}/"), "_i"))
    page = F.try_element_at("_x.prov", F.lit(1))["page_no"].alias("page")
    none = F.lit(None).cast("array<array<struct<text: string, column_header: boolean>>>").alias("grid")
    texts = listed("texts").select("doc", "chunk", "node", F.lit("text").alias("kind"), "_x.label", page, "_x.text", none, F.lit(None).cast("string").alias("caption"))
    named = listed("texts").select("doc", "chunk", F.col("node").alias("_ref"), F.trim("_x.text").alias("_said"))
    captions = F.transform("_x.captions", lambda x: x["$ref"])
    first = F.get(F.filter(captions, lambda r: r.startswith("#/texts/")), F.lit(0))
    tables = listed("tables").withColumn("_ref", first).join(named, ["doc", "chunk", "_ref"], "left")
    tables = tables.select("doc", "chunk", "node", F.lit("table").alias("kind"), "_x.label", page, F.lit(None).cast("string").alias("text"), F.col("_x.data.grid").alias("grid"), F.col("_said").alias("caption"))
    placed = paths(layout_edges(chunks), ["doc", "chunk"]).select("doc", "chunk", "node", "path")
    items = placed.join(texts.unionByName(tables), ["doc", "chunk", "node"])
    out = in_sections(items, ["doc", "chunk"], (F.col("kind") == "text") & F.col("label").isin(*HEADS))
    named_by = F.when(F.col("kind") == "table", F.coalesce(F.nullif(F.col("caption"), F.lit("")), "section")).otherwise(F.col("section"))
    kept = out.filter(~((F.col("kind") == "table") & F.coalesce(F.col("label") == CONTENTS, F.lit(False))))
    return kept.withColumn("section", named_by).select("doc", "chunk", "path", "kind", "label", "page", "text", "grid", "section")
