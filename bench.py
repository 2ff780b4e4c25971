"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from factloom.operators import search
from factloom.plans import registry

HEADLINE = (
    "search_context", "look_back_five", "fts_all_terms", "fts_phrase", "fts_rank", "contamination_find", "exact_duplicates", "fingerprint_twins", "version_supersession", "evidence_fusion", "reconcile_export",
    "export_match_richest", "longest_prefix", "corroborated_rows", "precision_recall", "quality_gates", "multiset_difference", "merged_row_split", "register_assembly", "html_sections", "claim_extraction", "sql_aggregate",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("factloom-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    # the index that the fts queries read is built once, and timed by itself
    began = time.time()
    search.stored_index(spark, f"{folder}/documents.parquet", "doc_id")
    took["fts_index_build"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
