"""Intermediate tables: where they go, and that they go away."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pytest

from citelake import storage


def _files(table):
    return list(Path(table.materialized_at.removeprefix("file:")).glob("*.parquet"))


def test_discarded_tables_are_gone(spark):
    kept, gone = (storage.materialize(spark.range(5), "t") for _ in range(2))
    assert kept.count() == gone.count() == 5
    storage.discard(gone)
    assert _files(kept) and not _files(gone)
    storage.discard(kept)


def test_only_the_result_of_a_step_stays(spark):
    before = storage.materialize(spark.range(2), "before")
    written = []

    def inner():
        written.append(storage.materialize(spark.range(3), "inner"))
        return written[-1].where("id > 0")

    def step():
        found = storage.only(spark, inner, "found")
        written.append(found)
        with ThreadPoolExecutor(1) as others:  # work of another thread of the driver
            written.append(others.submit(storage.materialize, spark.range(4), "other").result())
        return found.where("id > 1")

    out = storage.only(spark, step, "out")
    assert out.count() == 1 and [bool(_files(t)) for t in (before, out, *written)] == [True, True, False, False, True]
    storage.discard(before, out, written[-1])


def test_a_step_that_fails_leaves_nothing(spark):
    written = []

    def step():
        written.append(storage.materialize(spark.range(3), "inner"))
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        storage.only(spark, step, "out")
    assert not _files(written[0])


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert storage.shared_dir(session("spark://x:7077", "hdfs://a/b")) == "hdfs://a/b"
    assert storage.shared_dir(session("local[4]", None)).startswith("file://")
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(master, None))
