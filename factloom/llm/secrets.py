"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. The ledger records which rule versions have seen which
blob, and what each of them found. A scan takes one row of each blob that lacks a current rule version, runs only the
missing rules on it, and appends to the ledger; what current rule versions found is then joined back to every row (path)
that has that blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose capture group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order that breaks ties between spans with equal starts. Runs of one class match to their end, so that for
#: the last two a length in the pattern equals dropping shorter matches.
RULES = (
    Rule("assign", 1, "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)

_PIECES = "array<struct<gap:int,match:string>>"
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
LEDGER = f"blob string, checked array<string>, spans {_SPANS}"


def pieces(text: Column, rule: Rule) -> Column:
    """array of struct(gap, match): the length of what stands before each match, and the match; empty for most texts,
    which are looked at once."""
    cut = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"))
    return F.when(text.rlike(rule.pattern), F.filter(cut, lambda x: x["match"].isNotNull())).otherwise(F.array().cast(_PIECES))


def placed(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, checked, spans from blob, checked, pieces (an array for each rule): places in code points are sums over what
    stands before, by a window over a text's matches, so that a text of many matches costs no more than their number."""
    held = F.filter(F.transform("pieces", lambda x, i: F.struct(i.alias("rank"), x.alias("piece"))), lambda x: F.size(x["piece"]) > 0)
    each = found.repartition("blob").withColumn("row", F.monotonically_increasing_id()).select("blob", "checked", "row", F.explode_outer(held).alias("x"))
    each = each.select("blob", "checked", "row", "x.rank", F.posexplode_outer("x.piece").alias("at", "x"))
    before = Window.partitionBy("blob", "row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("x.gap") + F.length("x.match")).over(before).cast("int"))
    long = [F.when(F.col("rank") == i, F.length(F.regexp_extract("x.match", r.pattern, r.group)) >= r.least) for i, r in enumerate(rules)]
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.length("x.match")).alias("start"), "rank", of("kind").alias("kind"), "end", of("name").alias("rule"))
    kept = F.when(F.col("x").isNotNull() & F.coalesce(*long), span)
    made = each.groupBy("blob", "row").agg(F.first("checked").alias("checked"), F.array_sort(F.collect_list(kept)).cast(_SPANS).alias("spans"))
    # rows that repeat a doc_id and its text were each scanned
    return made.groupBy("blob").agg(F.first("checked").alias("checked"), F.first("spans").alias("spans"))


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, checked, spans): one for each blob of docs that some rule version hasn't seen.

    ledger: earlier rows of this kind, or None. Only the rule versions that are missing run.
    """
    wanted = F.array(*[F.lit(r.name) for r in rules])
    reps = docs.groupBy(blob(F.col("text")).alias("blob")).agg(F.min("doc_id").alias("_rep"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("checked"))).alias("_seen"))
        reps = reps.join(seen, "blob", "left").withColumn("_todo", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
    else:
        reps = reps.withColumn("_todo", wanted)
    reps = reps.filter(F.size("_todo") > 0).select(F.col("blob").alias("_blob"), "_rep", "_todo")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), blob(F.col("text")).alias("blob"))
    # the narrow side is hashed, so that texts move once and aren't sorted
    one = texts.join(reps.hint("shuffle_hash"), (F.col("doc_id").eqNullSafe(F.col("_rep"))) & (F.col("blob") == F.col("_blob")))
    found = F.array(*[F.when(F.array_contains("_todo", r.name), pieces(F.col("_text"), r)).otherwise(F.array().cast(_PIECES)) for r in rules])
    return placed(one.select("blob", F.col("_todo").alias("checked"), found.alias("pieces")), rules)


def join_back(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of docs (doc_id) with the spans that the given rule versions have found in its blob, and no others."""
    return with_spans(docs.select("doc_id", blob(F.col("text")).alias("blob")), ledger, rules)


def with_spans(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """paths (blob and others) with the spans of each one's blob."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    current = F.filter("spans", lambda s: rank[s.rule].isNotNull())
    placed = F.transform(current, lambda s: s.withField("rank", rank[s.rule]))
    hits = ledger.select("blob", placed.alias("spans")).filter(F.size("spans") > 0)
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    # sorted, equal spans are neighbours
    hits = hits.select("blob", F.filter("all", lambda s, i: (i == 0) | (s != F.get(F.col("all"), i - 1))).alias("spans"))
    return paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


class Ledger:
    """The ledger as tables in a folder that scans append to and that later sessions open again: `blobs` has what rule
    versions found in each blob, `paths` which blob each path had in each version of the corpus."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame | None:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/blobs") if self._there("blobs") else None

    def record(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is new: blobs that the ledger lacks with all rules, those it has with the versions that they lack."""
        scan_unseen(docs, self.rows(), rules).write.mode("append").parquet(f"{self.path}/blobs")

    def commit(self, docs: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> None:
        """Record docs (doc_id, text) as a version of the corpus. A version that is committed again replaces its paths."""
        self.record(docs, rules)
        docs.select("doc_id", blob(F.col("text")).alias("blob")).write.mode("overwrite").parquet(f"{self.path}/paths/version={version}")

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """version, doc_id, blob, spans: findings of the given rule versions in all paths of all versions."""
        paths = self.spark.read.schema("doc_id long, blob string, version string").parquet(f"{self.path}/paths")
        return with_spans(paths, self.rows(), rules)


#: The rule books of the scans that scan_documents makes, one after another: an earlier one, and the present one.
BOOKS = (RULES[:2], RULES)


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, books: tuple[tuple[Rule, ...], ...] = BOOKS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob for every row.

    Each rule book is a scan over the ledger that those before it left, so that a later one runs its new rule versions
    only; the last one's findings are returned. Null texts count as empty: no spans, the SHA-256 of nothing. Spans of
    different kinds may overlap. Very long texts are scanned whole. Repeated rows are all returned; an empty table gives
    an empty result; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    ledger = ledger or Ledger(docs.sparkSession)
    for rules in books:
        ledger.record(docs, rules)
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    kinds = [r.kind for r in books[-1]]
    return join_back(docs, ledger.rows(), books[-1]).select("doc_id", *[count(k) for k in kinds], F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"), "blob")
