"""Regular-expression and full-text search with provenance, within rows wherever a document fits in one."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.database import Table, shared_folder


#: Bytes of a table's files that one task indexes; their postings are about 40 times as much while they are sorted.
TASK_BYTES = 4 << 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _having(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows that may have a matching line, by one look at the whole text. Patterns that look around themselves, or at a
    text's ends, may match a line and not the text; they have all rows."""
    around = ("(?!", "(?=", "(?<", "\\A", "\\z", "\\Z", "\\G")
    return df if any(x in pattern for x in around) else df.filter(F.col(text).rlike(f"(?m){pattern}"))


def find(df: DataFrame, pattern: str, keep: list[str], context: int = 1, text: str = "text") -> DataFrame:
    """Every line that matches, with its number from 1 and the lines around it. No shuffle: a document is one row."""
    rows = _having(df, text, pattern).select(*keep, lines_of(F.col(text)).alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda h: h.line.rlike(pattern))
    rows = rows.withColumn("_hit", F.explode(hits))
    at = F.col("_hit.at")
    return rows.select(
        *keep, (at + 1).alias("line_no"), F.col("_hit.line").alias("line"),
        F.array_join(F.slice("_lines", F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context))), "\n").alias("before"),
        F.array_join(F.slice("_lines", at + 2, F.lit(context)), "\n").alias("after"),
    )


def look_back(df: DataFrame, pattern: str, name: str, keep: list[str], frame: int = 5, text: str = "text") -> DataFrame:
    """For each matching line the nearest of the `frame` lines above it that starts with `name`; blank lines count."""
    rows = _having(df, text, pattern).select(*keep, lines_of(F.col(text)).alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda h: h.line.rlike(pattern))
    rows = rows.withColumn("_hit", F.explode(hits))
    at = F.col("_hit.at")
    above = F.filter(F.slice("_lines", F.greatest(at - frame, F.lit(0)) + 1, F.least(at, F.lit(frame))), lambda x: x.rlike(name))
    nearest = F.regexp_extract(F.try_element_at(above, F.lit(-1)), name, 0)
    return rows.select(*keep, (at + 1).alias("line_no"), F.coalesce(nearest, F.lit("<unnamed>")).alias("owner"))


def split_pages(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows (page, text) of a page-marked document: a head before the first `---` line is dropped, bodies are stripped."""
    mark = "(?m)^=== PAGE (\\d+) ===$"
    body = F.element_at(F.split(F.col(text), "\n---\n", 2), -1)
    numbers, parts = F.regexp_extract_all(body, F.lit(mark), F.lit(1)), F.split(body, mark, -1)
    pages = F.arrays_zip(numbers.alias("n"), F.slice(parts, F.lit(2), F.size(numbers)).alias("t"))
    rows = df.select(*keep, F.explode(pages).alias("p"))
    return rows.select(*keep, F.col("p.n").cast("int").alias("page"), F.regexp_replace(F.regexp_replace("p.t", "^\\s+", ""), "\\s+$", "").alias("text"))


@functools.cache
def _folds() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, with that letter for each; and marks, which stand for nothing.

    The rule is Unicode's canonical decomposition; it needs no list. Syllables of scripts that compose by other means
    than marks stay as they are.
    """
    whole, plain, marks = [], [], []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            whole.append(c)
            plain.append(d[0])
    return "".join(whole + marks), "".join(plain)


def folded(text: Column) -> Column:
    """text in lower case without marks: letters with accents as their base letters, however they are encoded."""
    return F.translate(F.lower(text), *_folds())


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits, without marks."""
    return F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, pos): the postings of a full-text index, positions from 0, and for each text a row of the empty term whose
    position is its number of tokens. Null texts have none."""
    t = F.concat(tokens(F.col(text)), F.array(F.lit("")))
    return df.select(key, F.posexplode(t).alias("pos", "term")).select(key, "term", "pos")


def stored_index(spark: SparkSession, path: str, key: str, text: str = "text") -> DataFrame:
    """The postings of the parquet table at path, written once to the shared folder and read from there while the table's
    files keep their names, sizes and times.

    A file of postings is sorted by term, so that a filter of terms reads only the pages that hold them, and a frequent
    term lies in all files. Writing moves no posting between tasks; texts are dealt again only where the table has fewer
    partitions than the session has cores, or than it has TASK_BYTES: a task sorts the postings of its texts, so that its
    memory does not grow with the table.
    """
    docs = spark.read.parquet(path)
    files = docs.groupBy("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").count()
    stamp, size = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")), F.coalesce(F.sum("file_size"), F.lit(0))).first()
    name = hashlib.sha1(f"{path} {key} {text} {stamp}".encode()).hexdigest()
    made, stored = postings(docs, key, text), Table(spark, f"{shared_folder(spark)}/postings-{name}")
    if not stored.manifest():
        least = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        few = docs.rdd.getNumPartitions() < least
        dealt = postings(docs.select(key, text).repartition(least), key, text) if few else made
        stored.replace(dealt.sortWithinPartitions("term"))
    return stored.read(made.schema)


def _is(term: str) -> Column:
    """Whether a posting is of term; one that ends in * is a prefix."""
    return F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term


def _any(terms: list[str]) -> Column:
    out = F.lit(False)
    for x in terms:
        out = out | _is(x)
    return out


def match_terms(index: DataFrame, key: str, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """Keys that have every term of `every`, one of `some` if any are given, and none of `none`; one aggregate."""
    found = index.filter(_any([*every, *some, *none])).groupBy(key)
    tests = [F.bool_or(_is(x)) for x in every] + ([F.bool_or(_any(some))] if some else []) + [~F.bool_or(_is(x)) for x in none]
    return found.agg(*[t.alias(f"_t{i}") for i, t in enumerate(tests)]).filter(" and ".join(f"_t{i}" for i in range(len(tests)))).select(key)


def match_phrase(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, hits): how often the words, 63 at most, follow one another."""
    if len(words) > 63:
        raise ValueError("a phrase has 63 words at most")
    at = F.array(*[F.when(F.col("term") == w, F.struct((F.col("pos") - i).alias("start"), F.lit(1 << i).cast("long").alias("bit"))) for i, w in enumerate(words)])
    starts = index.filter(F.col("term").isin(*words)).select(key, F.inline(F.array_compact(at)))
    whole = starts.groupBy(key, "start").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == (1 << len(words)) - 1)
    return whole.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def match_near(index: DataFrame, key: str, a: str, b: str, most: int = 10) -> DataFrame:
    """Keys in which two different terms stand with at most `most` tokens between them: of all postings of both, the nearest
    two of different terms are neighbours."""
    w = Window.partitionBy(key).orderBy("pos")
    both = index.filter(F.col("term").isin(a, b)).withColumns({"_term": F.lag("term").over(w), "_pos": F.lag("pos").over(w)})
    return both.filter((F.col("term") != F.col("_term")) & (F.col("pos") - F.col("_pos") - 1 <= most)).select(key).distinct()


def match_query(index: DataFrame, key: str, text: str) -> DataFrame:
    """Keys that a query of words finds: NEAR(a b) and NEAR(a b, n) are proximity, ten tokens unless n says otherwise; NEAR
    without brackets is a word like any other."""
    near = re.fullmatch(r"\s*NEAR\(\s*(\w+)\s+(\w+)\s*(?:,\s*(\d+)\s*)?\)\s*", text)
    if near:
        return match_near(index, key, near[1].lower(), near[2].lower(), int(near[3] or 10))
    return match_terms(index, key, [w.lower() for w in re.findall(r"\w+\*?", text)])


def bm25(index: DataFrame, key: str, terms: list[str], k: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, rank) of keys with any term. Document counts and the mean length come from one aggregate of the same rows."""
    rows = index.filter(F.col("term").isin("", *terms)).groupBy(key).agg(
        F.sum(F.when(F.col("term") == "", F.col("pos"))).alias("_n"), *[F.count_if(F.col("term") == x).alias(f"_f{i}") for i, x in enumerate(terms)])
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    rank = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (s["n"] - s[f"d{i}"] + 0.5) / (s[f"d{i}"] + 0.5))
        f = F.col(f"_f{i}")
        rank = rank + F.lit(idf) * f * (k + 1) / (f + k * (1 - b + b * F.col("_n") / F.lit(s["mean"] or 1.0)))
    return rows.select(key, rank.alias("rank")).filter("rank > 0")


def snippet(text: Column, term: str, around: int = 6) -> Column:
    """At most 2 * around + 1 words about the first hit, which is bracketed."""
    words = F.split(text, "\\s+")
    at = F.array_position(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}]", "")), term).cast("int")
    cut = F.slice(words, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + around + 1)
    marked = F.transform(cut, lambda w: F.when(F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}]", "") == term, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(at > 0, F.array_join(marked, " "))


def dense_island(df: DataFrame, group: str, place: str, share: float = 0.4) -> DataFrame:
    """(group, first, last, anchor): the run of adjacent places around the one with most rows that have `share` of it."""
    n = df.groupBy(group, place).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    n = n.withColumn("top", F.max("n").over(w)).withColumn("anchor", F.max_by(place, F.struct("n", -F.col(place))).over(w))
    n = n.filter(F.col("n") >= share * F.col("top"))
    n = n.withColumn("run", F.col(place) - F.row_number().over(w.orderBy(place)))
    n = n.withColumn("own", F.max(F.when(F.col(place) == F.col("anchor"), F.col("run"))).over(w)).filter("run = own")
    return n.groupBy(group).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("anchor").alias("anchor"))
