"""Stages are found again by later runs over the same files, parameters and code, and by no others."""

import os
import shutil
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barflow.operators import backtests
from barflow.session import fingerprint, kept, prune, stored
from barflow.sources.bars import hourly


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr("barflow.session.shared_folder", lambda spark: f"file://{tmp_path}/shared")
    return tmp_path


def stages(folder):
    return {str(p.parent) for p in Path(folder, "shared/kept").rglob("_SUCCESS")}


def test_a_second_run_reads_the_stages_of_the_first(spark, folder, small):
    src = folder / "data"
    src.mkdir()
    shutil.copy(f"{small}/events.parquet", src / "events.parquet")
    p = backtests.PairParams(top=None, lookback=5, least=5)
    run = lambda p: sorted(map(str, backtests.mean_reversion(hourly(spark, str(src)), p).book.collect()))
    first = run(p)
    seen = stages(folder)
    times = {x: os.stat(x).st_mtime_ns for x in seen}
    assert seen and run(p) == first and stages(folder) == seen and {x: os.stat(x).st_mtime_ns for x in seen} == times
    other = run(replace(p, every=3))
    more = stages(folder)
    assert more > seen and other != first and run(p) == first and stages(folder) == more
    os.utime(src / "events.parquet", (1, 1))  # the file has changed
    assert run(p) == first and stages(folder) > more


def test_fingerprints_tell_plans_files_and_parameters_apart(spark, folder):
    for k in range(2):
        spark.range(5).withColumn("x", F.lit(k)).write.parquet(f"{folder}/t{k}")
    t = [spark.read.parquet(f"{folder}/t{k}") for k in range(2)]
    prints = [fingerprint(t[0]), fingerprint(t[1]), fingerprint(t[0].where("x > 0")), fingerprint(t[0].where("x > 1")), fingerprint(t[0], 1), fingerprint(t[0].select("id"))]
    assert len(set(prints)) == 6 and None not in prints and fingerprint(spark.read.parquet(f"{folder}/t0")) == prints[0]
    assert fingerprint(spark.createDataFrame([(1,)], "a int")) is None and fingerprint(t[0].join(spark.createDataFrame([(1,)], "id long"), "id")) is None


def test_broken_stages_are_not_found_and_old_ones_go(spark, folder):
    spark.range(5).write.parquet(f"{folder}/t")
    t = spark.read.parquet(f"{folder}/t")
    bad = t.withColumn("y", F.expr("CASE WHEN id = 3 THEN raise_error('no') ELSE 1 END"))
    with pytest.raises(Exception, match="no"):
        kept(bad, "s")
    assert not stages(folder)
    for k in range(3):
        assert kept(t, "s", k).count() == 5
    assert len(stages(folder)) == 3 and prune(spark, 1) >= 2 and len(stages(folder)) == 1
    assert stored(spark.createDataFrame([(1,)], "a int"), "s").count() == 1
