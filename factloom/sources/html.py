"""Elements and texts of web pages as rows of a tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end, and those that end one of their kind that is open, unless one of the others is open above it
#: (fixed values of the format).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"p": "div article section ul ol li table td th body nav", "li": "ul ol", "tr": "table", "td": "tr table", "th": "tr table"}
_ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
NODES = "node int, parent int, place int, kind string, text string"


def nodes_of(html: str) -> Iterator[tuple]:
    """(node, parent, place, kind, text) of a page in order; a text's kind is #text. Ends that nothing opened are left out."""
    open_: list[tuple[str, int]] = []
    below: dict[int | None, int] = {}
    n = 0

    def put(kind: str, text: str | None) -> tuple:
        nonlocal n
        up = open_[-1][1] if open_ else None
        place = below.get(up, 0)
        below[up] = place + 1
        n += 1
        return n - 1, up, place, kind, text

    for m in _TOKEN.finditer(html):
        token = m[0]
        tag = _NAME.match(token)
        if tag is None:
            if token[0] != "<" and token.strip():
                yield put("#text", token.strip())
            continue
        name = tag[2].lower()
        if tag[1]:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                del open_[at:]
            continue
        for i in range(len(open_) - 1, -1, -1) if name in _ENDS else ():
            if open_[i][0] == name:
                del open_[i:]
                break
            if open_[i][0] in _ENDS[name]:
                break
        row = put(name, None)
        yield row
        if name not in VOID and not token.endswith("/>") and m[1] is None:
            open_.append((name, row[0]))


def html_nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row for each element and each text of every page: key and NODES. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in NODES.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 3 + [pa.string()] * 2
        for b in batches:
            for k, text in zip(b.column(0), b.column(1)):
                rows = list(nodes_of(text.as_py() or ""))
                if rows:
                    yield pa.record_batch([pa.repeat(k, len(rows)), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [key, *names])

    return pages.select(key, F.col(html)).mapInArrow(made, f"`{key}` {kind}, {NODES}")
