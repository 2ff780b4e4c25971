"""A plan that gives every file of an old folder tree exactly one fate: move, merge, topic, archive, delete, or ? for a
person to decide.

Groups (copies of a document, files that would take one name) are resolved by a minimum that is joined back: a group of
any size is a partial minimum in each task, and its rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import readers

#: Notes that are indexes, prefixes of names that stay as they are, and kinds of other files (fixed values).
INDEXES = ("component index", "#datasheets", "datasheet parameter tables")
KEPT = ("SUPERSEDED - ", "DUPLICATE - ")
ASSETS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "html", "htm")
EXPORTS = ("csv", "xlsx", "xls")
FILE = "source string, action string, target string, category string, reason string"
#: Kinds of rows, in the order in which the first of several takes a name.
_DOCUMENT, _NOTE, _OTHER = range(3)


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    name = _base(path)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _folder(path: Column) -> Column:
    """The folder that a file's category is named by: attachments count as their parent's."""
    parts = F.split(path, "/")
    up = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.lower(F.try_element_at(up, F.lit(-1)))
    return F.array_join(F.when(last == "attachments", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(up), "/")


def noted(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """notes (path, links) with stem, n (documents that are linked) and doc, the one that a note is about: its only link,
    if both names are of one part or the document's says nothing."""
    known = docs.groupBy(F.lower(_base(F.col("path"))).alias("_name")).agg(F.max("path").alias("_doc"))
    links = notes.select("path", F.explode(F.array_distinct(F.transform("links", lambda x: F.lower(F.trim(_base(x)))))).alias("_name"))
    met = links.join(known, "_name").groupBy("path").agg(F.count_distinct("_doc").alias("n"), F.max("_doc").alias("doc"))
    rows = notes.select("path").join(met, "path", "left").select("path", _stem(F.col("path")).alias("stem"), F.coalesce("n", F.lit(0)).alias("n"), "doc")
    opaque = readers.opaque_name(_stem(F.col("doc")))
    about = (F.col("n") == 1) & (readers.same_part(F.col("stem"), _stem(F.col("doc"))) | opaque)
    return rows.withColumns({"opaque": F.coalesce(about & opaque, F.lit(False)), "doc": F.when(about, F.col("doc"))})


def named(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """docs (path, sha) with name, keep (the path of the copy that stays).

    Of copies that stays which a note names, then which has a clean name, the shortest, the first. A note names a document
    whose own name says nothing; of several the last by path.
    """
    names = notes.filter("opaque").groupBy(F.col("doc").alias("_doc")).agg(F.max_by("stem", "path").alias("_said"))
    rows = docs.join(names, docs.path == F.col("_doc"), "left")
    stem = _stem(F.col("path"))
    said = scalars.clean_name(F.col("_said"))
    kept = stem.startswith(KEPT[0]) | stem.startswith(KEPT[1])
    rows = rows.select("path", "sha", "_said", F.coalesce(said, F.when(kept, stem).otherwise(scalars.clean_name(stem))).alias("name"))
    order = F.struct(F.col("_said").isNull(), scalars.clean_name(stem) != stem, F.length(_base(F.col("path"))), "path")
    best = rows.groupBy(F.col("sha").alias("_sha")).agg(F.min(order).alias("_best"))
    return rows.join(best, F.col("sha").eqNullSafe(F.col("_sha"))).select("path", "sha", "name", F.when(F.col("sha").isNull(), F.col("path")).otherwise(F.col("_best.path")).alias("keep"))


def plan(docs: DataFrame, notes: DataFrame, others: DataFrame) -> DataFrame:
    """FILE for every file. docs: path, sha. notes: path, links (file names). others: path. Paths are unique.

    A file whose new name another takes first isn't moved but left to a person, and so is what would merge into it.
    """
    about = noted(notes, docs)
    at = named(docs, about)
    gone = at.filter("path != keep").select("path", F.lit("delete").alias("action"), F.lit("").alias("target"), F.lit("").alias("category"), F.concat(F.lit("same content as "), _base(F.col("keep"))).alias("reason"))
    stay = at.filter("path = keep")
    suffix = F.lower(F.regexp_extract(_base(F.col("path")), r"(\.[^.]*)$", 1))
    renamed = F.when(F.col("name") == _stem(F.col("path")), "document").otherwise(F.concat(F.lit("document, renamed from "), _stem(F.col("path"))))
    moves = stay.select("path", F.lit("move").alias("action"), F.concat(F.lit("Library/"), "name", F.lit("/"), "name", suffix).alias("target"), _folder(F.col("path")).alias("category"), renamed.alias("reason"), F.lit(_DOCUMENT).alias("kind"))

    # a note about a copy that goes is about the one that stays; a topic named like a document is about that
    names = at.select(F.col("path").alias("_p"), "keep").join(stay.select(F.col("path").alias("_k"), F.col("name").alias("_name")), F.col("keep") == F.col("_k")).select("_p", F.col("_k").alias("_doc"), "_name")
    like = stay.groupBy(F.lower("name").alias("_low")).agg(F.min(F.struct("path", "name")).alias("_like"))
    rows = about.join(names, about.doc == F.col("_p"), "left").join(like, F.lower("stem") == F.col("_low"), "left")
    index = F.lower("stem").isin(*INDEXES)
    merged, alike = F.col("_doc").isNotNull(), F.col("_like").isNotNull()
    action = F.when(index, "archive").when(merged | alike, "merge").otherwise("topic")
    name = F.when(merged, F.col("_name")).otherwise(F.col("_like.name"))
    target = F.when(index, F.concat(F.lit("0archive/"), _base(F.col("path")))).when(merged | alike, F.concat(F.lit("Library/"), name, F.lit("/"), name, F.lit(".md"))).otherwise(F.concat(F.lit("Topics/"), _base(F.col("path"))))
    reason = F.when(index, "an index by hand").when(merged, "note about one document").when(alike, "named like a document").otherwise(F.concat(F.lit("links "), F.col("n"), F.lit(" documents")))
    into = F.when(~index & merged, F.col("_doc")).when(~index & alike, F.col("_like.path"))
    notes_ = rows.select("path", action.alias("action"), target.alias("target"), F.lit("").alias("category"), reason.alias("reason"), F.lit(_NOTE).alias("kind"), into.alias("into"))

    kind = F.lower(F.regexp_extract(_base(F.col("path")), r"\.([^.]*)$", 1))
    asset, export = kind.isin(*ASSETS), kind.isin(*EXPORTS)
    rest = others.select(
        "path", F.when(asset | export, "move").otherwise("?").alias("action"), F.when(asset, F.concat(F.lit("Attachments/"), _base(F.col("path")))).when(export, F.concat(F.lit("Parametrics/"), _base(F.col("path")))).otherwise("").alias("target"),
        F.lit("").alias("category"), F.when(asset, "embedded file").when(export, "export of parameters").otherwise("another kind of file").alias("reason"), F.lit(_OTHER).alias("kind"),
    )
    none = F.lit(None).cast("string").alias("into")
    every = moves.select("*", none).unionByName(notes_).unionByName(rest.select("*", none))
    settled = without_clashes(every)
    lost = settled.filter(F.col("action") == "?").select(F.col("path").alias("_lost"))
    settled = settled.join(lost, settled.into == F.col("_lost"), "left")
    orphan = (F.col("action") == "merge") & F.col("_lost").isNotNull()
    done = settled.select(
        "path", F.when(orphan, "?").otherwise(F.col("action")).alias("action"), F.when(orphan, "").otherwise(F.col("target")).alias("target"), "category",
        F.when(orphan, "its document is to be decided").otherwise(F.col("reason")).alias("reason"),
    )
    return done.unionByName(gone).withColumnRenamed("path", "source")


def without_clashes(rows: DataFrame) -> DataFrame:
    """rows (path, kind, action, target, reason and others): of those that write files of one name, whatever the folder and
    case, the first by kind and path does, and the others become ?."""
    writes = F.col("action").isin("move", "topic", "archive") & (F.col("target") != "")
    low = F.when(writes, F.lower(_base(F.col("target"))))
    first = rows.withColumn("_low", low).filter("_low is not null").groupBy("_low").agg(F.min(F.struct("kind", "path", "target")).alias("_first"))
    met = rows.withColumn("_low", low).join(first, "_low", "left")
    later = F.coalesce((F.col("_first.kind") != F.col("kind")) | (F.col("_first.path") != F.col("path")), F.lit(False))
    return met.withColumns({
        "action": F.when(later, "?").otherwise(F.col("action")), "reason": F.when(later, F.concat(F.lit("name is taken by "), "_first.target")).otherwise(F.col("reason")),
        "target": F.when(later, "").otherwise(F.col("target")),
    }).drop("_low", "_first")
