"""Keyed rotation of several portfolios against the plain machine, over restarts, late ticks and delisted names."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from barflow.streaming import keyed
from barflow.streaming.bars import Rotator

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
RULE = Rotator(3, 2, 4, 5, 2, 1000.0)


def ticks(seed):
    """(portfolio, symbol, ts, value) in the order of arrival: several ticks an hour, gaps, a name that ends, worthless prices."""
    rnd, out = random.Random(seed), []
    for p in ("x", "y", "z"):
        for s in "ABCDE":
            level = 20.0
            for h in range(60):
                level *= 1 + rnd.gauss(0.004, 0.03)
                if s == "E" and h > 20 or rnd.random() < 0.03:
                    continue
                out += [(p, s, START + timedelta(hours=h, minutes=rnd.randrange(60), seconds=k), level * (1 + 0.001 * k)) for k in range(2)]
        out.append((p, "A", START + timedelta(hours=5), -1.0))
    return sorted(out, key=lambda x: (x[2], x[:2]))


def expected(rows, until):
    """Orders of a plain machine for each portfolio over the bars that end by `until`."""
    orders = []
    for p in sorted({r[0] for r in rows}):
        bars = {}
        for _, s, ts, v in sorted((r for r in rows if r[0] == p and r[3] > 0), key=lambda r: (r[2], r[3])):
            bars.setdefault(ts.replace(minute=0, second=0), {})[s] = v
        machine = RULE.resumed(None)
        for ts in sorted(bars):
            if ts + timedelta(hours=1) <= until:
                machine.bar(ts, bars[ts])
        orders += [(p, *o) for o in machine.orders]
    return orders


def run(spark, src, folder):
    schema = "portfolio string, symbol string, ts timestamp, value double"
    stream = keyed.rotate(spark.readStream.schema(schema).parquet(str(src)), RULE)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/orders").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return [(r.portfolio, r.ts.replace(tzinfo=None), r.symbol, r.side, r.shares) for r in spark.read.schema(keyed.ORDERS).parquet(f"{folder}/orders").collect()]


def test_portfolios_restart_and_leave_late_ticks_out(spark, tmp_path):
    rows = ticks(7)
    src = tmp_path / "ticks"
    src.mkdir()

    def feed(name, part):
        df = pd.DataFrame(part, columns=["portfolio", "symbol", "ts", "value"])
        df["ts"] = df["ts"].astype("datetime64[us, UTC]")
        df.to_parquet(src / f"{name}.parquet")
        return run(spark, src, tmp_path)

    cut, cut2 = (START + timedelta(hours=h, minutes=30) for h in (18, 40))
    feed("a", [r for r in rows if r[2] < cut])
    late = [(p, s, START + timedelta(hours=3, minutes=59, seconds=59), 999.0) for p in "xyz" for s in "ABC"]  # far behind the watermark
    feed("b", [r for r in rows if cut <= r[2] < cut2] + late)
    got = feed("c", [r for r in rows if r[2] >= cut2])
    until = max(r[2] for r in rows) - timedelta(hours=2)
    want = [(p, ts.replace(tzinfo=None), s, side, n) for p, ts, s, side, n in expected(rows, until)]
    assert sorted(got) == sorted(want) and len({p for p, *_ in got}) == 3 and len(got) > 20


def test_other_state_stores_are_refused(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            keyed.rotate(spark.createDataFrame([], "portfolio string, symbol string, ts timestamp, value double"), RULE)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
