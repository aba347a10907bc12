import itertools
import random

import pytest
from pyspark.sql import functions as F

from riverflux.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, *range(40)]), rng.randint(0, 9) if i % 11 else None, "x") for i in range(900)]
    return data, spark.createDataFrame(data, "id long, k int, v int, n string").repartition(7)


def ordered(data):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))


def test_numbers_are_consecutive_in_the_order(rows):
    data, df = rows
    out = ordering.numbered(df, ["k", "id"], "at", 5).collect()
    assert [r.id for r in sorted(out, key=lambda r: r["at"])] == [r[0] for r in ordered(data)]
    assert sorted(r["at"] for r in out) == list(range(5, 905))
    ties = ordering.numbered(df, [F.lit(1)], "at").collect()
    again = ordering.numbered(df.repartition(3), [F.lit(1)], "at").collect()
    assert {(r.id, r["at"]) for r in ties} == {(r.id, r["at"]) for r in again}


@pytest.mark.parametrize("block", [1, 16, 1 << 16])
def test_running_sums_match_a_loop(rows, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    data, df = rows
    want = dict(zip([r[0] for r in ordered(data)], itertools.accumulate(r[2] or 0 for r in ordered(data))))
    assert {r.id: r.upto for r in ordering.running_sum(df, ["k", "id"], "v").collect()} == want


def test_deals_are_even(rows):
    data, df = rows
    for n, k in ((900, 7), (23, 5), (3, 5)):
        out = ordering.dealt(df.where(F.col("id") < n), ["id"], k, "fold").orderBy("id").collect()
        sizes = [n // k + (i < n % k) for i in range(k)]
        assert [r.fold for r in out] == [i + 1 for i, size in enumerate(sizes) for _ in range(size)]


def test_draws_follow_the_weights(rows):
    data, df = rows
    at = [0.0, 0.1, 0.5, 0.999]
    out = {r.draw: r.id for r in ordering.drawn(df, ["k", "id"], "v", at).collect()}
    positive = [r for r in ordered(data) if (r[2] or 0) > 0]
    total = sum(r[2] for r in positive)
    want = {u: next(r[0] for r, s in zip(positive, itertools.accumulate(r[2] for r in positive)) if s > u * total) for u in at}
    assert out == want
    assert ordering.drawn(df.where("v < 0"), ["id"], "v", at).count() == 0


def test_blocks_hold_what_frames_need(spark):
    df = spark.range(100).select(F.col("id").alias("i"))
    out = ordering.in_blocks(df, "i", 2, 3, 10).collect()
    inside = [(r.block, r.i) for r in out if r.inside]
    assert sorted(inside) == [(i // 10, i) for i in range(100)]
    for b in range(10):
        assert {r.i for r in out if r.block == b} == {i for i in range(b * 10 - 2, b * 10 + 13) if 0 <= i < 100}


def test_no_window_takes_all_rows_into_one_task(spark, rows):
    for df in (ordering.numbered(rows[1], ["id"]), ordering.running_sum(rows[1], ["id"], "v"), ordering.dealt(rows[1], ["id"], 3)):
        assert "SinglePartition" not in df._jdf.queryExecution().toString()


def test_temporary_tables_go_with_their_scope(spark, tmp_path):
    import os

    from riverflux import scratch
    from riverflux.plans.queries import QUERIES

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    tables = lambda: {n for n in os.listdir(root) if n.startswith("table-")}
    before = tables()
    with scratch.temporary_tables(spark):
        QUERIES["cv_accuracy"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")).write.parquet(str(tmp_path / "out"))
        assert tables() > before
    assert tables() == before and spark.read.parquet(str(tmp_path / "out")).count() == 6
