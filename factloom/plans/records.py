"""Queries of the record-level operators, over the driver's tables; what those lack are lines of part rows, picked from lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import records
from factloom.plans.classification import pick
from factloom.plans.registry import query, table
from factloom.plans.scalars import numbers_sql


def at(values: list[str | None], step: int) -> str:
    """pick by part and line; steps keep the cells of a line apart."""
    return pick(values, f"(p_partkey + {step} * seq)")


def lines(n: int, **cells: str) -> str:
    """SQL of both dialects: n lines for each part row, its key being doc or the first cell's name."""
    return "(select " + ", ".join(f"{v} as {k}" for k, v in cells.items()) + f" from part, (values {', '.join(f'({i})' for i in range(1, n + 1))}) as s(seq)) as t"


def made(spark: SparkSession, d: str, lines: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(f"select * from {lines}")


# --- ranges and anomalies

_SPECS = lines(
    5, doc="p_partkey", seq="seq", section=at(["Recommended operating conditions", "Absolute maximum", "RECOMMENDED OPERATING conditions", "Electrical", "Recommended operating"], 1),
    symbol=at(["VIN", "V_IN", "fsw", "Vin", "VIN", "IQ", None], 2), parameter=at(["input voltage", "UVLO input voltage", "", None, "input voltage at switching", "junction", "supply", "Input voltage"], 3),
    min=at(["-0.3", "2.9", "3.0 12 36", "1", "−0.5", "4.5", "0.2", None, "x"], 5), typ=at([None, "2", None, "12"], 1), max=at(["40", None, "900m", "2", "36"], 3), unit=at(["V", "V", "MHz"], 1), page="p_partkey % 11 + seq",
)
_WANTED, _EXCLUDED = r"(?i)\bv\s*_?in\b|input voltage", "(?i)abs(olute)?\\s*max|storage|junction|ripple|accuracy|uvlo|undervoltage|threshold|logic|leakage"
_SCALE = "case upper(trim(unit)) when 'HZ' then 1e-3 when 'MHZ' then 1e3 when 'GHZ' then 1e6 else 1.0 end::double"


@query(rf"""with f as (select *, coalesce(symbol, '') || ' ' || coalesce(parameter, '') as blob from {_SPECS}), k as (select * from f where contains(lower(section), 'recommended operating') and regexp_matches(blob, '{_WANTED}') and not regexp_matches(blob, '{_EXCLUDED}')),
o as (select *, row_number() over (partition by doc order by seq) as r from k), n as (select doc, page, {numbers_sql("concat_ws(' ', min, typ, max)", _SCALE)} as n from o where r = 1)
select doc, n[1] as lo, case when len(n) > 1 then n[-1] end as hi, page from n""")
def roc_ranges(spark: SparkSession, d: str) -> DataFrame:
    return records.section_range(made(spark, d, _SPECS), ["doc"], _WANTED, _EXCLUDED, "recommended operating")


_ENDS = """select p_partkey as k, (p_size % 9)::double as vin_min, (p_size % 11)::double as vin_max, case when p_partkey % 3 = 0 then (p_size % 9)::double else 1.5::double end as vout_min,
 case when p_partkey % 3 = 0 then (p_size % 11)::double when p_partkey % 7 = 0 then 1.0::double else 5.0::double end as vout_max, case when p_partkey % 4 <> 0 then 0.8::double end as page1_vout_min, case when p_partkey % 5 <> 0 then 15.0::double end as page1_vout_max,
 case when p_partkey % 2 = 0 then 'high' else 'medium' end as vin_confidence, case when p_partkey % 13 = 0 then 'none' else 'high' end as vout_confidence from part"""


def _same(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) <= 0.01::double * greatest(abs({a}), abs({b})), false)"


@query(f"""with e as ({_ENDS}), t as (select *, {_same('vout_min', 'vin_min')} and {_same('vout_max', 'vin_max')} as echo, page1_vout_min is not null and page1_vout_max is not null and not ({_same('page1_vout_min', 'vin_min')} and {_same('page1_vout_max', 'vin_max')}) as back from e),
u as (select k, vin_min, vin_max, echo, back, case when echo then case when back then page1_vout_min end else vout_min end as lo, case when echo then case when back then page1_vout_max end else vout_max end as hi, vin_min = 0 as zero,
  case when vin_min = 0 then 'low' else vin_confidence end as vin_c, case when echo then case when back then 'low' else 'none' end else vout_confidence end as vout_c from t),
v as (select *, coalesce(vin_min > vin_max, false) as vin_bad, coalesce(lo > hi, false) as vout_bad from u),
w as (select k, case when not vin_bad then vin_min end as vin_min, case when not vin_bad then vin_max end as vin_max, case when not vout_bad then lo end as vout_min, case when not vout_bad then hi end as vout_max, case when vin_bad then 'none' else vin_c end as vin_confidence,
  case when vout_bad then 'none' else vout_c end as vout_confidence, concat_ws(',', case when echo then 'vout_echoes_vin' end, case when echo and back then 'vout_from_page1_fallback' end, case when zero then 'vin_min_zero_suspect' end, case when vin_bad then 'vin_range_inverted' end, case when vout_bad then 'vout_range_inverted' end) as flags from v),
x as (select *, coalesce((['low', 'medium', 'high'])[least(nullif(list_position(['low', 'medium', 'high'], vin_confidence), 0), nullif(list_position(['low', 'medium', 'high'], vout_confidence), 0))], 'none') as least_ from w)
select k, vin_min, vin_max, vout_min, vout_max, vin_confidence, vout_confidence, flags, case when least_ <> 'none' and (vout_confidence = 'none' or flags <> '') then 'low' else least_ end as overall from x""")
def anomaly_rules(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    lo, hi = (s % 9).cast("double"), (s % 11).cast("double")
    ends = table(spark, d, "part").select(
        k.alias("k"), lo.alias("vin_min"), hi.alias("vin_max"), F.when(k % 3 == 0, lo).otherwise(1.5).alias("vout_min"), F.when(k % 3 == 0, hi).when(k % 7 == 0, 1.0).otherwise(5.0).alias("vout_max"),
        F.when(k % 4 != 0, 0.8).alias("page1_vout_min"), F.when(k % 5 != 0, 15.0).alias("page1_vout_max"), F.when(k % 2 == 0, "high").otherwise("medium").alias("vin_confidence"), F.when(k % 13 == 0, "none").otherwise("high").alias("vout_confidence"),
    )
    out = records.anomalies(ends).withColumn("flags", F.concat_ws(",", "flags"))
    return out.select("k", "vin_min", "vin_max", "vout_min", "vout_max", "vin_confidence", "vout_confidence", "flags", "overall")


_READINGS = lines(3, doc="p_partkey", seq="seq", page="case when (p_partkey + seq) % 3 <> 0 then p_partkey % 11 + seq end", lo=f"cast({at(['3.0', '5.0', '5.1', '1.0', None], 2)} as double)", hi=f"cast({at([None, '36.0', None, '2.0'], 3)} as double)")


@query(f"""select doc, coalesce(arg_min(page, seq) filter (page is not null and coalesce(abs(lo - 5.0) <= 0.25, false) and hi is null), arg_min(page, seq) filter (page is not null)) as page from {_READINGS} group by doc""")
def value_pages(spark: SparkSession, d: str) -> DataFrame:
    reads = made(spark, d, _READINGS).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "page", F.col("lo").cast("double").alias("min"), F.col("hi").cast("double").alias("max")))).alias("r"))
    return reads.select("doc", records.value_page(F.col("r"), F.lit(5.0), F.lit(None).cast("double")).alias("page"))


# --- cascades and selections

_MAKERS = [("Brand#1", "North"), ("Brand#23", ""), ("Brand#2", "South"), ("Brand#4", "")]


@query("select p_partkey, case " + " ".join(f"when starts_with(p_brand, '{p}') then " + (f"'{v}'" if v else "lower(p_type)") for p, v in _MAKERS) + " else lower(p_type) end as maker from part")
def first_prefix_or_stop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", records.first_prefix(F.col("p_brand"), _MAKERS, F.lower("p_type")).alias("maker"))


@query("""with s as (select p_partkey, ([['page1'], ['page1', 'roc'], ['prose'], ['page1', 'prose', 'roc']])[p_partkey % 4 + 1] as sources, case when p_size % 3 = 0 then 'fsw' else 'vin' end as key, p_type like 'P%' as converts from part)
select p_partkey, key, array_to_string(sources, ',') as sources from s where converts or (key <> 'fsw' and len(list_filter(sources, lambda x: x <> 'page1')) > 0)""")
def relevant_params(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lists = F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in (["page1"], ["page1", "roc"], ["prose"], ["page1", "prose", "roc"])])
    rows = table(spark, d, "part").select("p_partkey", F.element_at(lists, (k % 4 + 1).cast("int")).alias("sources"), F.when(F.col("p_size") % 3 == 0, "fsw").otherwise("vin").alias("key"), F.col("p_type").startswith("P").alias("converts"))
    return records.relevant(rows, F.col("converts")).select("p_partkey", "key", F.array_join("sources", ",").alias("sources"))


@query("""select c_custkey, case when c_acctbal > 0 then 'layout' when c_nationkey % 3 = 0 then 'plain' when c_nationkey % 3 = 1 then 'ocr' else 'none' end as reader,
 case when c_acctbal > 0 then c_name when c_nationkey % 3 = 0 then c_mktsegment when c_nationkey % 3 = 1 then 'scan' else 'no text' end as text from customer""")
def page_text_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    best = records.page_text(F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), F.col("c_name"))).otherwise("  "), F.when(n % 3 == 0, F.col("c_mktsegment")), F.when(n % 3 == 1, "scan "))
    return table(spark, d, "customer").select("c_custkey", best.alias("x")).select("c_custkey", "x.reader", "x.text")


@query("""with a as (select o_orderkey as k, o_orderpriority as v from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then '' else o_orderstatus end as v from orders where o_orderkey % 4 <> 0)
select coalesce(a.k, b.k) as k, coalesce(case when length(b.v) > 0 then b.v end, a.v) as v from a full join b on a.k = b.k""")
def stored_never_emptied(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    old = orders.filter(k % 3 != 0).select(k.alias("k"), F.col("o_orderpriority").alias("v"))
    new = orders.filter(k % 4 != 0).select(k.alias("k"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("v"))
    return records.upserted(old, new, "k", "v")


@query("""select p_partkey, case when p_size % 2 = 0 then 'name=' || p_name || ';size=' || p_size || ';state=done' else 'name=' || p_name || ';state=done' end as props from part""")
def frontmatter_edit(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    props = F.create_map(F.lit("name"), F.col("p_name"), F.lit("old"), F.lit("x"), F.lit("state"), F.lit("open"), F.lit("size"), size.cast("string"))
    props = F.map_filter(props, lambda k, _: (k != "size") | (size % 2 == 0))
    after = records.edited(props, F.create_map(F.lit("state"), F.lit("done")), ["old"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(after)), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    return table(spark, d, "part").select("p_partkey", shown.alias("props"))


# --- carry-forward and order

_ROWS = lines(6, tab="p_partkey", seq="seq", label=at(["Inputs", "VIN", "IIN", "Outputs", "Limits", "VOUT", "Late"], 3), val=at([None, "3", None, "1", None], 2), unit=at([None, "V", "A", None], 1))


@query(f"""select tab, seq, label, last_value(case when val is null and unit is null then label end ignore nulls) over (partition by tab order by seq) as grp from {_ROWS} qualify val is not null or unit is not null""")
def sub_group_carry(spark: SparkSession, d: str) -> DataFrame:
    opens = F.col("val").isNull() & F.col("unit").isNull()
    rows = records.carried(made(spark, d, _ROWS).withColumn("opens", opens), ["tab"], "seq", F.when(F.col("opens"), F.col("label")), "grp")
    return rows.filter("not opens").select("tab", "seq", "label", "grp")


_ITEMS = lines(
    6, doc="p_partkey", seq="seq", label=at(["heading", "text", "text", "heading", "text"], 3),
    text=at(["Journal of Things", "A title", "Ann B. Cee, Dee Eff", "Abstract", "Gee Aitch, Eye Jay", "plain words, not names", "Kay Ell, Em En"], 2),
)
_AUTHORS = "^[A-Z][a-z]+( [A-Z][a-z.]*)+(, [A-Z][a-z]+( [A-Z][a-z.]*)+)+$"


@query(rf"""with h as (select *, last_value(case when label = 'heading' then text end ignore nulls) over (partition by doc order by seq rows between unbounded preceding and 1 preceding) as title from {_ITEMS})
select doc, arg_min(title, seq) as title, arg_min(text, seq) as authors from h where label <> 'heading' and title is not null and regexp_matches(text, '{_AUTHORS}') group by doc""")
def paper_title(spark: SparkSession, d: str) -> DataFrame:
    return records.heading_before(made(spark, d, _ITEMS), "doc", F.col("text").rlike(_AUTHORS))


_SYMBOLS = lines(5, tab="p_partkey", seq="seq", symbol=at(["V", "IN", "IOUT", "f", "SW", "R", "a", "b", "DD"], 5))


@query(f"""with recursive o as (select * from {_SYMBOLS}), r(tab, seq, symbol, given) as (select tab, seq, case when length(symbol) = 1 and exists (select 1 from o n where n.tab = o.tab and n.seq = 2) then symbol || (select n.symbol from o n where n.tab = o.tab and n.seq = 2) else symbol end, length(symbol) = 1 and exists (select 1 from o n where n.tab = o.tab and n.seq = 2) from o where seq = 1
 union all select o.tab, o.seq, case when r.given then null when length(o.symbol) = 1 and n.symbol is not null then o.symbol || n.symbol else o.symbol end, not r.given and length(o.symbol) = 1 and n.symbol is not null from r join o on o.tab = r.tab and o.seq = r.seq + 1 left join o n on n.tab = o.tab and n.seq = o.seq + 1) select tab, seq, symbol from r""")
def symbol_fragments(spark: SparkSession, d: str) -> DataFrame:
    return records.joined_fragments(made(spark, d, _SYMBOLS), "tab", "seq").select("tab", "seq", "symbol")


# --- predicates and small aggregates

@query("select event_id, (event_id % 40)::bigint as page from events where event_id % 40 between 12 and 18")
def page_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("page", F.col("event_id") % 40).filter(F.col("page").between(12, 18)).select("event_id", "page")


@query(r"""select p_partkey, regexp_matches(upper(p_brand) || '-' || p_size, '^[A-Z]+[#A-Z]*[0-9]+-[0-9]{2}$') as part_like from part""")
def looks_like_part(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.upper("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", name.rlike("^[A-Z]+[#A-Z]*[0-9]+-[0-9]{2}$").alias("part_like"))


@query("""select l_orderkey, count(*) filter (length(l_returnflag || l_linestatus || l_linenumber) <= 2 + l_linenumber // 3) >= 0.5 * count(*) as symbols from lineitem group by l_orderkey""")
def symbol_column(spark: SparkSession, d: str) -> DataFrame:
    short = F.length(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))) <= 2 + F.expr("l_linenumber div 3")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count_if(short) >= 0.5 * F.count(F.lit(1))).alias("symbols"))


@query("""with t as (select conv_id, bool_or(turn < 8 and length(trim(text)) >= 20) as layer, sum(length(text)) / greatest(count(*), 1) as mean from conversations group by conv_id) select conv_id, coalesce(layer, false) as text_layer, coalesce(mean, 0) <= 200 as scanned from t""")
def text_layer_probe(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("turn") < 8) & (F.length(F.trim("text")) >= 20)).alias("layer"), (F.sum(F.length("text")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean"))
    return pages.select("conv_id", F.coalesce("layer", F.lit(False)).alias("text_layer"), (F.coalesce("mean", F.lit(0)) <= 200).alias("scanned"))


_CHUNKS = lines(
    4, doc="p_partkey", name="case (p_partkey + seq) % 5 when 0 then 'notes.txt' when 1 then 'other.json' else concat('p', lpad(cast(20 * seq - 19 as varchar(9)), 4, '0'), '-', lpad(cast(20 * seq - p_partkey % 7 as varchar(9)), 4, '0'), case p_partkey % 2 when 0 then '.json' else '.pages.json' end) end",
)


@query(rf"""select doc, sum(regexp_extract(name, '^p([0-9]+)-([0-9]+)\.', 2)::bigint - regexp_extract(name, '^p([0-9]+)-([0-9]+)\.', 1)::bigint + 1)::bigint as pages from {_CHUNKS} where regexp_matches(name, '^p([0-9]+)-([0-9]+)\.') group by doc""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.regexp_extract("name", "^p([0-9]+)-([0-9]+)\\.", k).try_cast("bigint")
    return made(spark, d, _CHUNKS).filter(at(1).isNotNull()).groupBy("doc").agg(F.sum(at(2) - at(1) + 1).alias("pages"))


@query("""with t as (select count(*) as n from lineitem where l_linenumber = 1) select n as registers, n >= 1000 as enough from t""")
def register_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_linenumber = 1").agg(F.count(F.lit(1)).alias("registers")).select("registers", (F.col("registers") >= 1000).alias("enough"))


@query("""select doc_id, left(text, 180) as evidence, array_to_string(list_distinct_first[1:12], ' ') as sample from (select doc_id, text, list_filter(string_split(text, ' '), lambda x, i: list_position(string_split(text, ' '), x) = i and x <> '') as list_distinct_first from documents where text is not null and length(text) < 3000)""")
def bounded_lists(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: w != "")
    return table(spark, d, "documents").filter(F.length("text") < 3000).select("doc_id", F.left("text", F.lit(180)).alias("evidence"), F.array_join(F.slice(words, 1, 12), " ").alias("sample"))


# --- identifiers and values

@query(r"""select p_partkey, case when p_size % 5 = 0 then 'C' || (p_partkey * 7) when p_size % 3 = 0 then 'C' || p_partkey end as lcsc from part""")
def supplier_code(spark: SparkSession, d: str) -> DataFrame:
    """The code on the card, else the one that the file's name carries."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.col("p_name"), F.when(s % 3 == 0, F.concat(F.lit("_C"), k.cast("string"))).otherwise("_Cx"), F.lit(".pdf"))
    card = F.when(s % 5 == 0, F.concat(F.lit("C"), (k * 7).cast("string")))
    found = F.nullif(F.regexp_extract(name, "_(C[0-9]+)\\.pdf$", 1), F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.coalesce(card, found).alias("lcsc"))


@query("""select p_partkey, case p_partkey % 4 when 0 then null when 1 then p_size::double when 2 then p_size + 0.5::double else null end as num from part""")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit(" "), s)).when(k % 4 == 2, F.concat(s, F.lit(".5 "))).otherwise(F.concat(s, F.lit("x")))
    trimmed = F.trim(cell)
    return table(spark, d, "part").select("p_partkey", F.when(trimmed.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double")).alias("num"))


_COLUMNS = [("Iq (typ) (mA)", "iq_ua", 1e3), ("Iq (A)", "iq_ua", 1e6), ("Vin (V)", "vin", 1.0)]


@query("""with m as (select * from (values ('Iq (typ) (mA)', 'iq_ua', 1e3), ('Iq (A)', 'iq_ua', 1e6), ('Vin (V)', 'vin', 1.0)) t(header, field, factor)), x as (select p_partkey, (['Iq (typ) (mA)', 'Iq (A)', 'Vin (V)', 'Other'])[p_partkey % 4 + 1] as header, p_size / 8.0::double as value from part)
select p_partkey, coalesce(field, x.header) as field, round_even(value * coalesce(factor, 1.0)::double, 6) as value from x left join m on x.header = m.header""")
def export_column_scaling(spark: SparkSession, d: str) -> DataFrame:
    headers = F.array(*[F.lit(x) for x in ("Iq (typ) (mA)", "Iq (A)", "Vin (V)", "Other")])
    rows = table(spark, d, "part").select("p_partkey", F.element_at(headers, (F.col("p_partkey") % 4 + 1).cast("int")).alias("header"), (F.col("p_size") / F.lit(8.0)).alias("value"))
    mapping = spark.createDataFrame(_COLUMNS, "header string, field string, factor double")
    out = rows.join(F.broadcast(mapping), "header", "left")
    return out.select("p_partkey", F.coalesce("field", "header").alias("field"), F.bround(F.col("value") * F.coalesce("factor", F.lit(1.0)), 6).alias("value"))


@query(r"""select p_partkey, regexp_replace(regexp_replace(p_size || '-V  ' || p_name, '([0-9])-([VAW])', '\1\2', 'g'), '\s+', ' ', 'g') as text, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') as key from part""")
def text_normal(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit("-V  "), F.col("p_name"))
    text = F.regexp_replace(F.regexp_replace(text, "([0-9])-([VAW])", "$1$2"), "\\s+", " ")
    return table(spark, d, "part").select("p_partkey", text.alias("text"), F.regexp_replace(F.lower(F.concat("p_name", "p_brand")), "[^a-z0-9]", "").alias("key"))


_CELL = f"case when p_partkey % 13 = 0 then 'none' else concat({at(['', '-', 'typ ', '−', ''], 1)}, {at(['3.0', '2.2', '500', '.25', '12', '400', '7'], 2)}, {at(['', ' '], 1)}, {at(['', 'm', 'k', '', 'M', 'u', 'G', '', 'n'], 4)}, {at(['V', 'Hz', 'A', '', 'v', 'MHz', 'W', 'kHz'], 3)}) end"
_HINTED = lines(2, k="2 * p_partkey + seq", cell=_CELL)
_HINT = r"(?i)([-+−]?[0-9]*\.?[0-9]+)\s*([" + "".join(scalars.SI) + r"])?\s*(V|A|W|HZ|KHZ|MHZ|GHZ)?"


def _factors(of: str, values: dict[str, float]) -> str:
    return f"case {of} " + " ".join(f"when '{k}' then {v!r}::double" for k, v in values.items()) + " else 1.0::double end"


@query(rf"""with g as (select k, regexp_extract(cell, '{_HINT}', 1) as n, regexp_extract(cell, '{_HINT}', 2) as p, upper(regexp_extract(cell, '{_HINT}', 3)) as u from {_HINTED})
select k, round_even(try_cast(replace(n, '−', '-') as double) * {_factors("p", scalars.SI)} * {_factors("case when u = '' then 'V' else u end", scalars.UNITS)}, 6) as value from g""")
def hinted_values(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, _HINTED).select("k", scalars.value_of(F.col("cell"), "V").getField("value").alias("value"))


# --- sources and targets

@query("""with f as (select c_custkey as k, c_mktsegment || c_custkey % 20 as stem, (['csv', 'xlsx', 'txt'])[c_custkey % 3 + 1] as kind from customer) select k, stem, kind from f where kind in ('csv', 'xlsx') and not (kind = 'csv' and stem in (select stem from f where kind = 'xlsx'))""")
def export_folder(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    files = table(spark, d, "customer").select(k.alias("k"), F.concat("c_mktsegment", (k % 20).cast("string")).alias("stem"), F.element_at(F.array(F.lit("csv"), F.lit("xlsx"), F.lit("txt")), (k % 3 + 1).cast("int")).alias("kind"))
    sheets = files.filter("kind = 'xlsx'").select("stem").distinct()
    return files.filter("kind = 'xlsx'").unionByName(files.filter("kind = 'csv'").join(sheets, "stem", "left_anti"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'archive/' || year(o_orderdate) when o_orderpriority like '1%' then 'urgent' else 'library/' || lower(o_orderstatus) end || '/' || o_orderkey || '.pdf' as target from orders""")
def target_paths(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("archive/"), F.year("o_orderdate").cast("string"))).when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise(F.concat(F.lit("library/"), F.lower("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", F.concat(folder, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("target"))


@query("""with x as (select o_custkey, o_orderkey, o_orderpriority as name, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as r from orders) select o_orderkey, name || case when r > 1 then '-' || r else '' end as filed from x""")
def name_clash_suffix(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").withColumn("r", r)
    return rows.select("o_orderkey", F.concat(F.col("o_orderpriority"), F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("filed"))
