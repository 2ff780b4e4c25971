"""What the first pages of a document of any maker state of its part, by candidates that carry a score.

Several evidences may speak for one field: the file's name, a line of its own, a line that has the name in it, a number
beside a word. Each is a candidate with a score, its place and what it was read from; the best by score, then by place, is
the reading. All of it is within a document's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Shapes of part numbers and stock codes, words that are none, and names of packages and interfaces (fixed values).
PART, STOCK, NO_PARTS = "^[A-Za-z]{1,6}[0-9][A-Za-z0-9-]{1,20}$", "(?i)^C[0-9]{5,}$", ("MOSFET", "IC", "MODULE", "CHIP", "ELEC", "TECH", "PUBLIC", "ASIC", "SEMI")
PACKAGES = ("SOT-?23", "SOT-?89", "SOT-?363", "SC-?70", "T?SSOP", "MSOP", "HSOP", "SOP", "WQFN", "QFN", "DFN", "LGA", "WLCSP", "TO-?92", "TO-?252", "TO-?263", "TO-?220F?", "SOD", "DO", "DIP")
INTERFACES = ("I2C", "SPI", "SMBUS", "UART", "PMBUS")
#: Pages and lines that are read, and characters of pages that interfaces and frequencies are looked for in.
PAGES, LINES, TITLE_LINES, HEAD = 3, 8, 15, 3000
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_RANGE = rf"(?<![0-9.]){_NUMBER}\s*V?\s*(?:to|~|–|-|\.\.\.)\s*{_NUMBER}\s*V"
#: A vendor's document number, whose documents have a reader of their own (a fixed value).
VENDOR = "(?i)^SL[A-Z]{2,}"



def _given(value: Column, score: int, place: Column | int, evidence: Column) -> Column:
    """A candidate; null where value is null or empty."""
    back = -(F.lit(place) if isinstance(place, int) else place)
    made = F.struct(F.lit(score).alias("score"), back.cast("int").alias("back"), value.alias("value"), F.left(evidence, F.lit(180)).alias("evidence"))
    return F.when(F.length(value) > 0, made)


def _best(*candidates: Column) -> Column:
    """The candidate with the largest score; of equals the first by place."""
    return F.array_max(F.filter(F.array(*candidates), lambda c: c.isNotNull()))


def _among(candidates: Column) -> Column:
    return F.array_max(F.filter(candidates, lambda c: c.isNotNull()))


def is_part(word: Column) -> Column:
    return F.coalesce(word.rlike(PART) & ~word.rlike(STOCK) & ~F.upper(word).isin(*NO_PARTS), F.lit(False))


def part_of_stem(stem: Column) -> Column:
    """The candidate that a file's name gives: the longest part within a dated download's name, the first word, a later
    word, a part within a word, the name itself."""
    dated = F.regexp_replace(F.regexp_extract(stem, "^[0-9]{10,}_(.+)$", 1), "_C[0-9]+$", "")
    within = F.filter(F.split(dated, "-"), is_part)
    longest = F.array_max(F.transform(within, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    first = F.split(stem, r"[\s-]")[0]
    words = F.filter(F.split(stem, r"[\s_]+"), is_part)
    inner = F.filter(F.regexp_extract_all(stem, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z]{2,6}[0-9][A-Za-z0-9-]{1,20})"), F.lit(1)), is_part)
    return _best(
        _given(longest, 30, 0, stem), _given(F.when(first.rlike(PART) & ~first.rlike(STOCK), first), 20, 0, stem), _given(F.get(words, F.lit(0)), 15, 0, stem), _given(F.get(inner, F.lit(0)), 10, 0, stem), _given(stem, 1, 0, stem),
    )


def part(lines: Column, hint: Column) -> Column:
    """The part's candidate: a line that is one, letters set apart included, or a word of a line that has the hint; else the
    hint (a candidate itself)."""
    said = hint["value"]

    def of_line(line: Column, i: Column) -> Column:
        dense = F.replace(line, F.lit(" "), F.lit(""))
        apart = line.rlike("^[A-Za-z0-9]( [A-Za-z0-9]){3,}$") & dense.rlike(PART)
        held = F.filter(F.split(line, r"\s+"), lambda w: w.rlike(PART) & F.contains(F.upper(w), F.upper(said)))
        word = F.when(F.contains(F.upper(line), F.upper(said)), F.get(held, F.lit(0)))
        return _given(F.when(apart, dense).when(line.rlike(PART), line).otherwise(word), 40, i, line)

    return F.coalesce(_among(F.transform(F.slice(lines, 1, LINES), of_line)), hint)


def title(lines: Column, name: Column) -> Column:
    """The first line with the part and more; else a long line that is no address; else the part."""
    head = F.slice(lines, 1, TITLE_LINES)
    more = lambda x, i: _given(F.when(F.contains(F.upper(x), F.upper(name)) & (F.length(x) > F.length(name) + 5), x), 3, i, x)
    long = lambda x, i: _given(F.when((F.length(x) > 20) & ~F.lower(x).rlike(r"^(https?://|www\.)"), x), 2, i, x)
    return F.coalesce(_among(F.transform(head, more)), _among(F.transform(head, long)), _given(name, 1, 0, name))


def _spans(text: Column, words: str, score: int) -> list[Callable[[int], Column]]:
    """Candidates of a range's ends: the range after one of the words, and before one, in the same line and near it."""
    out = []
    for place, pattern in enumerate((rf"(?i)(?:{words})[^\n]{{0,40}}?{_RANGE}", rf"(?i){_RANGE}[^\n]{{0,40}}?(?:{words})")):
        found = F.regexp_extract(text, pattern, 0)
        out.append(lambda k, found=found, pattern=pattern, place=place: _given(F.regexp_extract(found, _RANGE_ONLY, k), score, place, found))
    return out


_RANGE_ONLY = "(?i)" + _RANGE


def voltages(text: Column) -> dict[str, Column]:
    """Candidates of vin_min, vin_max, vout_min, vout_max: ranges beside a word, for the input any range, or a largest value."""
    out = {}
    for name, words in (("vin", "input|VIN|supply"), ("vout", "output|VOUT")):
        spans = _spans(text, words, 3)
        if name == "vin":
            plain = F.regexp_extract(text, _RANGE_ONLY, 0)
            spans.append(lambda k, plain=plain: _given(F.regexp_extract(plain, _RANGE_ONLY, k), 2, 0, plain))
        for k, end in ((1, "min"), (2, "max")):
            single = []
            if (name, end) == ("vin", "max"):
                most = F.regexp_extract(text, rf"(?i)(?:up\s+to|maximum|max\.?)\s*{_NUMBER}\s*V", 0)
                single = [_given(F.regexp_extract(most, _NUMBER, 1), 1, 0, most)]
            out[f"{name}_{end}"] = _best(*[s(k) for s in spans], *single)
    return out


def current(text: Column) -> Column:
    """The candidate of the largest output current: a value before a word of currents, else after one."""
    before = F.regexp_extract(text, rf"(?i){_NUMBER}\s*[-–]?\s*A\b[^\n]{{0,40}}?(?:output|charg|inductor|switch|peak|continuous|drain|current)", 0)
    after = F.regexp_extract(text, rf"(?i)(?:output|charg|peak|continuous|drain|max)[^\n]{{0,40}}?(?<![0-9.]){_NUMBER}\s*[-–]?\s*A\b", 0)
    amps = rf"(?i){_NUMBER}\s*[-–]?\s*A\b"
    return _best(_given(F.regexp_extract(before, amps, 1), 2, 0, before), _given(F.regexp_extract(after, amps, 1), 1, 0, after))


def frequency(text: Column) -> Column:
    """The candidate of the largest frequency: the last that the head of the text names, in kHz."""
    named = F.regexp_extract_all(F.left(text, F.lit(HEAD)), F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?\s*[-–]?\s*[kM]Hz)\b"), F.lit(1))
    last = F.try_element_at(named, F.lit(-1))
    value = F.regexp_extract(last, _NUMBER, 1).try_cast("double") * F.when(F.lower(last).contains("mhz"), 1000.0).otherwise(1.0)
    return _given(F.regexp_replace(value.cast("string"), r"\.0$", ""), 1, 0, last)


def packages(text: Column) -> Column:
    """array of struct(code, type, pins) of the packages that a page names, each once by first mention."""
    names = "|".join(f"{p}(?:-?[0-9]+)?[A-Z]?" for p in PACKAGES)
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Za-z0-9])({names})(?![A-Za-z0-9])"), F.lit(1))
    plain = F.transform(found, lambda c: F.replace(F.upper(c), F.lit("-"), F.lit("")))
    first = F.filter(F.transform(found, lambda c, i: F.struct(c.alias("code"), (F.array_position(plain, F.replace(F.upper(c), F.lit("-"), F.lit(""))) == i + 1).alias("new"))), lambda x: x["new"])
    return F.transform(first, lambda x: F.struct(
        x["code"].alias("code"), F.upper(F.split(x["code"], "-?[0-9]")[0]).alias("type"), F.regexp_extract(x["code"], "-([0-9]+)$", 1).try_cast("int").alias("pins"),
    ))


def features(text: Column) -> Column:
    """At most 20 bullets of more than 8 characters, each once: of the section of features, else of the head of the text."""
    section = F.split(text, r"(?i)(?:features?|highlights?)\s*\n", 2)
    after = F.split(F.get(section, F.lit(1)), r"(?i)applications?|description|general\s+desc|pin\s+desc|absolute\s+max|ordering", 2)[0]
    part_ = F.when(F.size(section) > 1, after).otherwise(F.left(text, F.lit(HEAD)))
    lines = F.filter(F.transform(F.split(part_, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[•·●■◆□▪*]|^[–-]\s{1,3}[A-Z]|^n\s{1,3}[A-Z]"))
    said = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^(?:[•·●■◆□▪*]\s*|[–n-]\s{1,3})", ""))), lambda x: F.length(x) > 8)
    keys = F.transform(said, lambda x: F.lower(F.left(x, F.lit(60))))
    once = F.filter(F.transform(said, lambda x, i: F.struct(x.alias("x"), (F.array_position(keys, F.lower(F.left(x, F.lit(60)))) == i + 1).alias("new"))), lambda s: s["new"])
    return F.slice(F.transform(once, lambda s: s["x"]), 1, 20)


def interfaces(text: Column) -> Column:
    """Interfaces that the head of the text names, sorted."""
    found = F.regexp_extract_all(F.left(text, F.lit(HEAD + 1000)), F.lit(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(INTERFACES)})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def cleaned(text: Column) -> Column:
    """A page's text without codes of unknown glyphs, runs of blanks and of empty lines."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\(cid:[0-9]+\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def read(pages: DataFrame, key: str = "doc") -> DataFrame:
    """key, a struct (value, evidence, score) for each of part, title, vin_min, vin_max, vout_min, vout_max, iout_max (A)
    and freq_max (kHz), and packages, features, interfaces, doc_id and reader of each document of pages (key, stem, page,
    text). reader says whose rules a document is to be read by: `vendor` for a vendor's document number, else `generic`."""
    first = pages.filter(F.col("page").between(1, PAGES)).select(key, "stem", "page", cleaned(F.col("text")).alias("_t"))
    docs = first.groupBy(key).agg(F.min("stem").alias("stem"), F.array_sort(F.collect_list(F.struct("page", "_t"))).alias("_p"))
    docs = docs.withColumns({"_one": F.coalesce(F.get(F.filter("_p", lambda p: p["page"] == 1), F.lit(0))["_t"], F.lit("")), "_all": F.array_join(F.transform("_p", lambda p: p["_t"]), "\n\n")})
    docs = docs.withColumns({"_lines": F.filter(F.transform(F.split("_one", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "_hint": part_of_stem(F.coalesce("stem", F.lit("")))})
    docs = docs.withColumn("part", part(F.col("_lines"), F.col("_hint")))
    fields = {"part": F.col("part"), "title": title(F.col("_lines"), F.col("part.value")), **voltages(F.col("_all")), "iout_max": current(F.col("_all")), "freq_max": frequency(F.col("_all"))}
    second = F.coalesce(F.get("_lines", F.lit(1)), F.lit(""))
    number = F.regexp_extract(second, r"(?:^|[^A-Za-z0-9])([A-Z]{4,}[0-9A-Z]*)(?![A-Za-z0-9])", 1)
    shown = [F.struct(c["value"].alias("value"), c["evidence"].alias("evidence"), c["score"].alias("score")).alias(n) for n, c in fields.items()]
    lists = [packages(F.col("_one")).alias("packages"), features(F.col("_all")).alias("features"), interfaces(F.col("_all")).alias("interfaces")]
    return docs.select(key, *shown, *lists, F.nullif(number, F.lit("")).alias("doc_id"), F.when(number.rlike(VENDOR), "vendor").otherwise("generic").alias("reader"))
