"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, weighted by tokens. Raking scales the cells until their
sums meet the target share of every source, language and topic at once; a cell's scale, relative to what it has, is the
calibrated weight of its documents. Documents are then drawn with probabilities in proportion to it, by a hash of their
id, so that the draw is the same wherever and however often it is made.

Up to BROADCAST_ROWS cells are raked in one task, whose windows need no exchange; more are raked by joins.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, forget, small, staged

DIMENSIONS = ("_source", "_lang", "_topic")
#: Exponent on present shares that gives the default targets: below 1, small sources gain.
TEMPER = 0.7
ROUNDS, MOST_ROUNDS, CLOSE = 10, 100, 1e-6
#: A value's default target is at most this many times its present share, before targets are made to sum to 1.
LIFT = 2.0
#: Bounds of the default topics: words in all, share of bars, characters a line, words a sentence.
FEW_WORDS, BARS, LIST_LINE, TERSE, WORDY = 50, 0.01, 40, 8, 20


def topic(text: Column) -> Column:
    """The form of a whole text: none, table, list, short, terse, wordy or plain.

    Counts over all of it decide: its words, and what a line and a sentence have of them. A caller who has topics gives
    them as a column.
    """
    n = F.length(text)
    count = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    lines, words, sentence = count("\n") + 1, count(" ") + 1, count(".") + 1
    return (
        F.when(n == 0, "none").when(count("|") / n >= BARS, "table").when((lines >= 5) & (n / lines < LIST_LINE), "list").when(words < FEW_WORDS, "short")
        .when(words / sentence < TERSE, "terse").when(words / sentence >= WORDY, "wordy").otherwise("plain")
    )


def celled(docs: DataFrame, topics: Column | None = None) -> DataFrame:
    """_row (a row of docs), _source, _lang, _topic (nulls as a value of their own) and _tokens (words, 1 at least)."""
    text = F.coalesce("text", F.lit(""))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    words = F.greatest(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1))
    own = topic(text) if topics is None else topics
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), named(F.col("source")).alias("_source"), named(F.col("lang")).alias("_lang"),
        named(own).alias("_topic"), words.cast("double").alias("_tokens"),
    )


def targets(cells: DataFrame, wanted: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with the target share of their value in each dimension, as _to_<dimension>.

    wanted: shares by dimension (source, lang, topic) and value; a dimension that it lacks gets tempered present shares,
    a value that it lacks within a named dimension gets 0. Shares are of what occurs, and need not sum to 1.
    """
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("_sum"))
        given = (wanted or {}).get(d[1:])
        if given is None:
            tempered = have.select(d, "_sum", F.pow("_sum", F.lit(TEMPER)).alias("_share"))
            both = tempered.agg(F.sum("_sum"), F.sum("_share")).first()
            # tempered shares, lifted to LIFT times the present ones at most
            share = F.least(F.pow("_sum", F.lit(TEMPER)) / F.lit(both[1] or 1.0), LIFT * F.col("_sum") / F.lit(both[0] or 1.0))
        else:
            share = F.coalesce(F.create_map(*[F.lit(x) for k, v in given.items() for x in (f"={k}", float(v))])[F.col(d)], F.lit(0.0))
        have = have.withColumn("_share", share)
        total = have.agg(F.sum("_share")).first()[0] or 1.0
        have = have.select(d, (F.col("_share") / F.lit(total)).alias(f"_to{d}"))
        cells = cells.join(have, d)
    return cells


def _sums(cells: DataFrame, d: str, alone: bool) -> DataFrame:
    if alone:
        return cells.withColumn("_sum", F.sum("weight").over(Window.partitionBy(d)))
    return cells.join(cells.groupBy(d).agg(F.sum("weight").alias("_sum")), d)


def rake(cells: DataFrame, alone: bool) -> DataFrame:
    """cells (dimensions, tokens, _to_<dimension>) with weight, shares that meet the targets as closely as cells can, and gap.

    Both ways of raking take the same rounds: ROUNDS more until no share of a source, language or topic is CLOSE or more
    off its target, MOST_ROUNDS at most. gap is the largest distance that is left; CLOSE or more of it also warns (cells
    whose targets contradict each other never get there).
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    out = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    if not total:
        return out.withColumn("gap", F.lit(0.0))
    done, gap, kept = 0, math.inf, None
    while done < MOST_ROUNDS and gap >= CLOSE:
        rounds = min(ROUNDS, MOST_ROUNDS - done)
        for k in range(rounds):
            for d in DIMENSIONS:
                ratio = F.when(F.col("_sum") > 0, F.col(f"_to{d}") / F.col("_sum")).otherwise(F.lit(0.0))
                out = _sums(out.coalesce(1) if alone else out, d, alone).withColumn("weight", F.col("weight") * ratio).drop("_sum")
            if not alone or k == rounds - 1:
                out = staged(out, "raked")
                if kept is not None:
                    forget(kept)
                kept = out
        done += rounds
        gap = _gap(out)
    if gap >= CLOSE:
        warnings.warn(f"raking: after {done} rounds a share is {gap:.3g} off its target", stacklevel=2)
    return out.withColumn("gap", F.lit(gap))


def _gap(cells: DataFrame) -> float:
    """The largest distance between the share of a value of any dimension and its target."""
    off = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"_to{d}")).alias("off")).select("off") for d in DIMENSIONS]
    return reduce(DataFrame.union, off).agg(F.max("off")).first()[0] or 0.0


def calibrated(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, topics: Column | None = None) -> DataFrame:
    """celled docs with _ratio (calibrated share a token), _chance, the probability of being drawn, and _gap (see rake).

    The cell with the largest ratio is drawn whole and sets the scale of all others, so that no cell, however small,
    misses its share.
    """
    rows = celled(docs, topics)
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("_tokens").alias("tokens")), "cells")
    n = cells.count()
    raked = rake(staged(targets(cells, wanted), "targets"), n <= BROADCAST_ROWS)
    ratio = raked.withColumn("_ratio", F.col("weight") / F.col("tokens"))
    top = ratio.agg(F.max("_ratio")).first()[0] or 1.0
    chance = ratio.select(*[F.col(d).alias(f"{d}_") for d in DIMENSIONS], "_ratio", (F.col("_ratio") / F.lit(top)).alias("_chance"), F.col("gap").alias("_gap"))
    on = [F.col(d) == F.col(f"{d}_") for d in DIMENSIONS]
    return rows.join(small(chance, n), on).drop(*[f"{d}_" for d in DIMENSIONS])


def _drawn() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("_row.doc_id")), 11) / F.lit(float(1 << 53)) < F.col("_chance")


def calibrate_documents(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, topics: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, drawn and gap for every row.

    weight is the row's calibrated share: those of a source, language or topic sum to its target, up to gap. Sources and
    languages are as in docs (nulls stay null). Extra columns are ignored; otherwise as sample_to_targets.
    """
    rows = calibrated(docs, wanted, topics)
    return rows.select(
        "_row.doc_id", "_row.source", "_row.lang", F.expr("substring(_topic, 2)").alias("topic"), F.col("_tokens").cast("long").alias("tokens"),
        (F.col("_ratio") * F.col("_tokens")).alias("weight"), F.col("_chance").alias("probability"), _drawn().alias("drawn"), F.col("_gap").alias("gap"),
    )


def sample_to_targets(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, topics: Column | None = None) -> DataFrame:
    """The rows of docs (all columns, whatever their names) that are drawn.

    Null sources and languages are values of their own; null and empty texts weigh one token, and very long ones what
    they hold. Rows that share a doc_id share their draw. An empty table gives no rows. topics: a column of docs, or an
    expression over them, instead of topic(text).
    """
    return calibrated(docs, wanted, topics).filter(_drawn()).select("_row.*")
