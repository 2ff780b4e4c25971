"""Queries whose rows are made from part rows read them."""

import pytest

from factloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chunk_coverage", "curated_sections", "hinted_values", "orphan_labels", "paper_title", "roc_ranges", "sub_group_carry", "summary_addresses", "symbol_fragments", "value_pages"])
def test_reads_part(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert any("part.parquet" in f for f in df.inputFiles())
    assert df.count() > 50
