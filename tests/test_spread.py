from __future__ import annotations

import pytest

from citelake import plans
from citelake.plans import tables
from citelake.registry import QUERIES

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One file a table; keys beyond what a month of arXiv numbers holds."""
    plans.load()
    path = tmp_path_factory.mktemp("one")
    parts = [(k, "red bolt", "Brand#11", "SMALL TIN", k % 50, 1.0) for k in (1, 2, 3, *range(89_995, 90_007), 1_234_567, 123_456_789)]
    spark.createDataFrame(parts, PART).coalesce(1).write.parquet(str(path / "part.parquet"))
    lines = [(k, p[0], 1, 1, 3.0, "N") for k, p in enumerate(parts)]
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(str(path / "lineitem.parquet"))
    return str(path)


@pytest.mark.parametrize(
    "name",
    ["same_person_names", "author_overlaps", "version_match_scores", "joined_fragments", "identifier_mismatches", "enriched_records"],
)
def test_rows_of_one_file_are_worked_on_by_many_tasks(spark, folder, name):
    assert QUERIES[name](spark, folder).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_rows(spark):
    assert tables.spread(spark.range(100), "id", each=1).rdd.getNumPartitions() == 100


def test_identifiers_of_large_keys_stay_apart(spark, folder):
    for r in QUERIES["identifier_mismatches"](spark, folder).collect():
        k = r["p_partkey"]
        expected = "arxiv_id" if k % 3 == 0 else ("title" if k % 2 == 0 else "arxiv_id") if k % 3 == 1 else None
        assert r["mismatch"] == expected, k
