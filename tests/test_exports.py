"""Exports that become visible together, and what changes them."""
from __future__ import annotations

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditframe.sources import exports as X
from tests.conftest import rows


@pytest.fixture
def target():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def tables(make):
    return {"a": make("id INT, t STRING", (1, "x"), (2, None), (2, None)), "b": make("k STRING, m MAP<STRING,INT>", ("z", {"q": 1}))}


def test_round_trip(spark, target, tables):
    manifest = X.write_export(tables, target, "one")
    assert rows(manifest, "name", "rows") == [("a", 3), ("b", 1)]
    assert rows(X.read_export(spark, target, "one", "a")) == rows(tables["a"])
    assert X.read_export(spark, target, "one", "b").schema.simpleString() == tables["b"].schema.simpleString()
    assert rows(X.export_problems(spark, target, "one")) == []
    with pytest.raises(KeyError):
        X.read_export(spark, target, "one", "c")


def test_a_killed_export_is_invisible_and_can_be_run_again(spark, target, tables):
    broken = {**tables, "b": tables["b"].select(F.raise_error(F.lit("killed")).cast("string").alias("k"))}
    with pytest.raises(Exception, match="killed"):
        X.write_export(broken, target, "one")
    assert os.path.exists(f"{target}/tables/one/a")
    with pytest.raises(FileNotFoundError):
        X.read_export(spark, target, "one", "a")
    X.write_export(tables, target, "one")
    X.write_export(tables, target, "one")  # again: nothing changes
    assert rows(X.read_export(spark, target, "one", "a")) == rows(tables["a"])
    assert rows(X.export_problems(spark, target, "one")) == []


def test_a_changed_or_missing_table_is_found(spark, target, tables):
    X.write_export(tables, target, "one")
    tables["a"].where("t is null").write.mode("overwrite").parquet(f"{target}/tables/one/a")
    assert rows(X.export_problems(spark, target, "one")) == [("a", "differs")]
    for read in (lambda d: d.count(), lambda d: d.collect()):
        with pytest.raises(Exception, match="is not what the manifest"):
            read(X.read_export(spark, target, "one", "a"))
    # A table that is there twice over is another table, too.
    tables["b"].write.mode("append").parquet(f"{target}/tables/one/b")
    assert rows(X.export_problems(spark, target, "one")) == [("a", "differs"), ("b", "differs")]


def test_export_of_empty_tables(spark, target, tables):
    X.write_export({"a": tables["a"].limit(0)}, target, "one")
    assert rows(X.read_export(spark, target, "one", "a")) == [] and rows(X.export_problems(spark, target, "one")) == []
    assert len(glob.glob(f"{target}/manifests/one/part-*")) == 1
