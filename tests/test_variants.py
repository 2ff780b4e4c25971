"""Comparison of two readings against plain counters."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import variants

ROW = "doc int, page int, symbol string, parameter string, min double, typ double, max double"


def plain(a, b, text):
    """Counts of one document by loops over single rows."""
    name = lambda r: re.sub("[^a-z0-9]", "", (r[1] or r[2] or "").lower())
    low = lambda r: tuple((v is not None, v or 0) for v in r[3:])
    key = lambda r: (r[0], *r[3:])
    out = {"rows_base": len(a), "rows_variant": len(b)}
    ca, cb = Counter(map(key, a)), Counter(map(key, b))
    out["agree"] = sum((ca & cb).values())
    sa, sb = Counter((key(r), name(r)) for r in a), Counter((key(r), name(r)) for r in b)
    out["same_symbol"] = sum((sa & sb).values())
    out["only_base"], out["only_variant"] = sum((ca - cb).values()), sum((cb - ca).values())

    def seen(r):
        values = [re.sub(r"\.0$", "", str(v)) for v in r[3:] if v is not None]
        return bool(values) and all(re.search(rf"(?<![\d.]){re.escape(v)}(?!\d)", text.get(r[0], "")) for v in values)

    out["witnessed_base"] = sum(seen(r) for r in a if (ca - cb)[key(r)] > 0)
    out["witnessed_variant"] = sum(seen(r) for r in b if (cb - ca)[key(r)] > 0)

    def rest(x, y, identity, order, skip):
        """Both sides without as many of each identity as the other has, in order."""
        n = Counter(identity(r) for r in x if not skip(r)) & Counter(identity(r) for r in y if not skip(r))
        left = []
        for side in (x, y):
            m, kept = Counter(n), []
            for r in sorted(side, key=order):
                if not skip(r) and m[identity(r)] > 0:
                    m[identity(r)] -= 1
                else:
                    kept.append(r)
            left.append(kept)
        return sum(n.values()), *left

    _, a, b = rest(a, b, lambda r: (key(r), name(r)), key_order, lambda r: False)
    _, a, b = rest(a, b, key, name, lambda r: False)
    out["moved"], a, b = rest(a, b, lambda r: (name(r), *r[3:]), lambda r: r[0], lambda r: not name(r))
    out["changed"], *_ = rest(a, b, lambda r: (r[0], name(r)), low, lambda r: not name(r))
    return out


def key_order(r):
    return str(r)


def test_report_equals_loops(spark):
    rnd = random.Random(11)
    value = lambda: rnd.choice([None, 1.0, 2.0, 2.5, -3.0])
    row = lambda: (rnd.randrange(1, 4), rnd.choice(["V_IN", "vin", "Iq", "", None]), rnd.choice(["Vin", None]), value(), value(), value())
    docs = {d: ([row() for _ in range(rnd.randrange(0, 25))], [row() for _ in range(rnd.randrange(1, 25))]) for d in range(12)}
    text = {(d, p): rnd.choice(["1 and 2.5; -3", "2.5.1 12 x1", "", "1.0 2"]) for d in docs for p in (1, 2)}
    side = lambda i: spark.createDataFrame([(d, *r) for d, x in docs.items() for r in x[i]], ROW)
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in text.items()], "doc int, page int, text string")
    got = {r.doc: r.asDict() for r in variants.report(side(0), side(1), pages).collect()}
    for d, (a, b) in docs.items():
        want = plain(a, b, {p: text.get((d, p), "") for p in (1, 2)})
        assert {k: got[d][k] for k in variants.COUNTS} == want, d
    assert all(got[None][k] == sum(got[d][k] for d in docs) for k in variants.COUNTS)
    n = variants.changes(side(0), side(1)).count()
    assert n == got[None]["changed"]


def test_moved_and_changed(spark):
    a = [(1, 1, "Vin", None, 3.0, None, 36.0), (1, 1, "Iq", None, None, 5.0, None), (1, 1, "Iq", None, None, 9.0, None), (1, 2, "T", None, 1.0, 1.0, 1.0)]
    b = [(1, 2, "VIN", None, 3.0, None, 36.0), (1, 1, "iq", None, None, 10.0, None), (1, 1, "iq", None, None, 6.0, None), (1, 2, "T", None, 1.0, 1.0, 1.0), (1, 2, "T", None, 1.0, 1.0, 1.0)]
    left, right = spark.createDataFrame(a, ROW), spark.createDataFrame(b, ROW)
    row = variants.report(left, right, spark.createDataFrame([], "doc int, page int, text string")).filter("doc = 1").first()
    assert (row.agree, row.moved, row.changed, row.only_base, row.only_variant) == (1, 1, 2, 3, 4)
    assert sorted((r.was.typ, r.now.typ) for r in variants.changes(left, right).collect()) == [(5.0, 6.0), (9.0, 10.0)]


def test_side_counts(spark):
    registers = spark.createDataFrame([(1, "0x01", ["a", "b"]), (1, "?", None), (2, None, [])], "doc int, address string, fields array<string>")
    assert sorted(tuple(r) for r in variants.register_counts(registers).collect()) == [(1, 2, 1, 2), (2, 1, 0, 0)]
    items = spark.createDataFrame([(1, "text", "x" * 30), (1, "text", "a normal line of some words"), (1, "page_header", "y" * 40), (1, "text", " ")], "doc int, label string, text string")
    assert [tuple(r) for r in variants.run_together_share(items).collect()] == [(1, 50.0)]


def test_a_page_is_read_before_its_rows_meet_it(spark):
    text = "3.3.1 and -2, 13.5 x7"
    df = spark.createDataFrame([(text,)], "text string").select(variants.numbers_read(F.col("text")).alias("n"))
    assert set(df.first().n) == {"3", "3.3", "3.3.1", "2", "-2", "13", "13.5", "7"}
    rows = spark.createDataFrame([(1, 1, "a", None, float(i), None, None) for i in range(9)], ROW)
    pages = spark.createDataFrame([(1, 1, text)], "doc int, page int, text string")
    report = variants.report(rows, rows.limit(0), pages)
    assert report.filter("doc = 1").first().witnessed_base == 3
    # the numbers are taken from the pages below the join, and no row carries the text
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join LeftOuter")]
    assert "regexp_extract_all" not in joined and plan.count("regexp_extract_all") > 0
