"""Queries that read all of their tables."""

import re

from factloom.operators import filing
from factloom.plans import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_column_streams_work_down_the_page(spark, tmp_path):
    texts = [(1, "one    two\n\nthree", "a"), (2, "", "b"), (3, None, "c")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["column_streams"](spark, str(tmp_path)).select("doc_id", "line_no", "bucket", "text").collect()]
    want = []
    for i, t, s in texts:
        for k, x in enumerate(t.split("\n") if t is not None else []):
            line = f"{x}     right side     {s}"
            for m in re.finditer(r"(?:(?! {3}).)+", line):
                if m[0].strip():
                    want.append((i, k + 1, round((m.start() + len(m[0]) - len(m[0].lstrip(" "))) / 20), m[0].strip()))
    assert sorted(got) == sorted(want)


def test_filing_takes_only_equal_texts_for_prints(spark, tmp_path):
    head = "The same sixty characters stand at the head of all of these documents. "
    texts = [(2, head + "a " * 400, "x"), (1, head + "b " * 400, "y"), (3, head + "a  " * 400, "z"), (4, head + "c " * 400, "src3"), (5, head + "c\t" * 400, "w"), (7, head + "a\n" * 400, "v")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.key: r.reason for r in registry.QUERIES["filing_plan_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "none", 3: "print", 5: "print", 7: "none"}


def test_undo_numbers_a_journal_over_tasks(spark):
    rows = [((i * 7919) % 5000, ("create", "delete", "move")[i % 3], i % 50) for i in range(5000)]
    made = filing.undo(spark.createDataFrame(rows, "op_seq long, op string, path long"))
    back = {"create": "delete", "delete": "create", "move": "move"}
    assert sorted(tuple(r) for r in made.select("step", "op_seq", "op", "path").collect()) == [(k + 1, n, back[o], p) for k, (n, o, p) in enumerate(sorted(rows, reverse=True))]
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert filing.undo(spark.createDataFrame([], "op_seq long, op string, path long")).count() == 0
