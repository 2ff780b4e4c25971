"""Repeated rows in exact dedup."""

import collections
import re

from factloom.llm import exact_dedup
from tests.llm.cases import TEXTS, docs


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_of_repeated_rows_one_is_kept(spark):
    texts = TEXTS + [(20, "again and again")] * 5 + [(20, "again  and\nagain"), (21, "again and again"), (20, "another text"), (None, "no id"), (22, "no id")]
    d = docs(spark, texts)
    got = exact_dedup.drop_copies(d)
    assert got.columns == d.columns
    least = {}
    for i, t in texts:
        least[normal(t)] = min((x for x in (i, least.get(normal(t))) if x is not None), default=None)
    assert collections.Counter((r.doc_id, normal(r.text)) for r in got.collect()) == collections.Counter((i, t) for t, i in least.items())
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in d.collect()}
