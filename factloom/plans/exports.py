"""Exports that Spark writes of the part table, a file for each brand, read again through the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query, table
from factloom.sources import exports
from factloom.sources.database import scratch

_HEAD = f"{exports.MARKER},{{0}}\n{exports.DATED},2026-01-02\n\n{exports.KEY_HEADER},Price,Size,\n"


def _written(spark: SparkSession, d: str) -> str:
    """A folder with a csv file for each brand: a preamble, the header and the rows, one part twice."""
    part = table(spark, d, "part")
    once = part.selectExpr("p_brand", "p_partkey", "p_retailprice as price", "p_size as size", "0 as again")
    twice = part.filter("p_partkey % 9 = 0").selectExpr("p_brand", "p_partkey", "p_retailprice + 1", "p_size", "1")
    line = F.format_string("lm-%d x,%s, %d ,note", F.col("p_partkey"), F.col("price").cast("string"), F.col("size"))
    rows = once.union(twice).select("p_brand", "again", "p_partkey", line.alias("line"))
    body = rows.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("again", "p_partkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    at = scratch(spark, "exports")
    text = F.concat(F.replace(F.lit(_HEAD), F.lit("{0}"), F.concat(F.lit("Brand "), "p_brand")), "body")
    body.select(F.translate("p_brand", "#", "-").alias("brand"), text.alias("value")).repartition("brand").write.partitionBy("brand").text(f"{at}/text")
    # one file a brand, named as an export is
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(fs.Path(f"{at}/files"))
    for folder in files.globStatus(fs.Path(f"{at}/text/brand=*")):
        name = folder.getPath().getName().split("=")[1]
        for f in files.globStatus(fs.Path(f"{folder.getPath()}/part-*")):
            files.rename(f.getPath(), fs.Path(f"{at}/files/{name}.csv"))
    return f"{at}/files"


_CELLS = """c as (select replace(p_brand, '#', '-') || '.csv' as file, 'Brand ' || p_brand as category, '2026-01-02' as date, 'LM' || p_partkey || 'X' as part,
  p_retailprice + case when p_partkey % 9 = 0 then 1 else 0 end as price, p_size as size from part)"""


@query(f"with {_CELLS} select file, category, date, part, 'Price' as header, price as value from c union all select file, category, date, part, 'Size', size from c")
def export_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of two headers of all exports, below their preambles; of a part that comes twice the last row."""
    cells = exports.read_exports(spark, _written(spark, d)).filter(F.col("header").isin("Price", "Size"))
    return cells.withColumn("value", F.col("value").cast("double"))


@query(f"""with {_CELLS}, v as (select part, 'Price' as field, price as value from c union all select part, 'Size', size from c)
select part, field, case when part = 'LM9X' and field = 'Size' then 36.5 else value end as value, part = 'LM9X' and field = 'Size' as overridden from v union all select 'TPS1', 'Size', 7, true""")
def export_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Exports in columns, with a person's overrides laid on top."""
    folder = _written(spark, d)
    said = '{"_README": ["x"], "lm-9 x": {"Size": 36.5, "why": "wrong", "checked": "2026-01-01"}, "TPS-1": {"Size": 7, "why": "missing"}}'
    spark.createDataFrame([(said,)], "value string").write.text(f"{folder}-over")
    wide = exports.read_exports(spark, folder, wide="true")
    values = wide.select("part", F.expr("stack(2, 'Price', Price, 'Size', Size) as (field, value)")).withColumn("value", F.col("value").cast("double"))
    return exports.with_overrides(values, exports.read_overrides(spark, f"{folder}-over")).drop("why")
