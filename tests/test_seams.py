"""Model seams, tensors, configuration, logging, workers."""

import logging
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import config, log
from quarry.operators import bootstrap, seams, tensors
from quarry.plans.durable import cut, shared_dir, sized
from quarry.plans.spread import spread


def test_config():
    text = "infer:\n  k: 10  # candidates\n  name: 'x'\nseed: 0\n- weight: 5.0\n"
    assert config.flat_values(text) == {"k": "10", "name": "x", "seed": "0", "weight": "5.0"}
    assert config.known(["a", "zz"], {"a": 1, "b": 2}) == ["a"] and config.known([], {"a": 1, "b": 2}) == ["a", "b"]
    assert config.DEFAULT.candidates == 10 and seams.schedule(3) == pytest.approx([0.7, 1.0, 1.3])


def test_log(tmp_path):
    x = log.logger("t1", str(tmp_path))
    x.info("hello")
    assert len(log.logger("t1").handlers) == 2 and "hello" in (tmp_path / "t1.log").read_text()
    assert x.level == logging.INFO


def test_generated_and_scored(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, prompt string")
    g = seams.generated(df, "id", "prompt", lambda ps, t: [f"{p}{t:.1f}" for p in ps], seams.schedule(3))
    assert sorted((r.id, r.k, r.text) for r in g.collect()) == [(1, 0, "a0.7"), (1, 1, "a1.0"), (1, 2, "a1.3"), (2, 0, "0.7"), (2, 1, "1.0"), (2, 2, "1.3")]
    s = seams.scored(g.withColumn("text", F.when(F.col("id") == 1, F.col("text"))), "text", lambda ts: [len(t) for t in ts])
    assert {(r.id, r.score) for r in s.collect()} == {(1, 4.0), (2, None)}
    with pytest.raises(Exception):
        seams.generated(df, "id", "prompt", lambda ps, t: [], [1.0]).count()


def test_tokenized(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, t string")
    got = {r.id: (r.ids, r.mask) for r in seams.tokenized(df, "id", "t", lambda t: [len(w) for w in t.split(" ")], 2, 9).collect()}
    assert got == {1: ([1, 1], [1, 1]), 2: ([0, 0], [1, 1])}


def test_collated(spark):
    df = spark.createDataFrame([(0, "v1", {"lung": [1.0, 2.0]}), (0, "v2", {"heart": [3.0, 4.0]}), (1, "v3", {"lung": [5.0, 6.0]}), (2, "v4", None)], "b int, v string, t map<string,array<double>>")
    got = {(r.b, r.v, r.region): r["values"] for r in tensors.collated(df, "b", "v", "t", 2).collect()}
    assert got == {(0, "v1", "lung"): [1.0, 2.0], (0, "v1", "heart"): [0.0, 0.0], (0, "v2", "heart"): [3.0, 4.0], (0, "v2", "lung"): [0.0, 0.0], (1, "v3", "lung"): [5.0, 6.0]}


def test_arrays_of_tensors(spark):
    df = spark.createDataFrame([([0, 1, 0, 1], [1.0, 2.0, 3.0, 4.0]), ([0, 0, 0, 0], [1.0, 2.0, 3.0, 4.0])], "m array<int>, x array<double>")
    r = df.select(tensors.foreground(F.col("m")).alias("f"), tensors.resized(F.col("x"), 2).alias("r"), tensors.running_counts(F.col("m")).alias("c")).collect()
    assert tuple(r[0].f) == (1, 3) and r[1].f is None and r[0].r == [2.0, 4.0] and r[0].c == [0, 1, 1, 2]
    a = [df.select(tensors.augmented(F.col("x"), F.lit(3), s).alias("a")).first().a for s in (1, 1, 2)]
    assert a[0] == a[1] != a[2] and len(a[0]) == 4


def test_decoded(spark):
    df = spark.createDataFrame([("p", bytearray(b"\x01\x02"))], "path string, content binary")
    r = tensors.decoded(df, lambda c: np.frombuffer(c, np.uint8).reshape(1, 2)).first()
    assert (r.shape, r["values"]) == ([1, 2], [1.0, 2.0])


def test_numpy_draws(spark):
    got = sorted((r.b, r.row) for r in bootstrap.numpy_draws(spark, 2, 5, 0).collect())
    rng = np.random.default_rng(0)
    assert got == sorted((b, int(x)) for b in range(2) for x in rng.integers(0, 5, size=5))


def test_plans(spark):
    df = spark.range(10)
    c = cut(df, "t")
    assert c.count() == 10 and "parquet" in c.inputFiles()[0] and shared_dir(spark) in c.inputFiles()[0].replace("file:///", "file:///")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(sized(df, limit=10)) and not hinted(sized(df, limit=9))
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    many = spark.range(0, 10, 1, 9)
    assert spread(many) is many


def test_tables_of_a_scope_are_removed(spark):
    from quarry.plans import durable

    with durable.scope():
        c = cut(spark.range(5), "scoped")
        at = c.inputFiles()[0].removeprefix("file://")
        assert c.count() == 5 and os.path.exists(at)
    assert not os.path.exists(at)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)
