"""Files read and written, and resumable streaming."""

import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources import labels, predictions, shards, sinks
from quarry.streaming import resume


def test_csv_keeps_breaks_quotes_nulls_and_order(spark, tmp_path):
    data = [(1, "v_a_1", 'a "quoted"\nline', "x"), (2, "v_a", None, "y"), (3, "w", "", " z "), (4, None, "t", "u\r\nv"), (5, "va", "again", "x")]
    df = spark.createDataFrame(data, "sample_id long, volume_name string, GT_combined_report string, Pred_combined_report string")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    back = predictions.read_csv(spark, str(tmp_path / "c"), "sample_id long, volume_name string, GT_combined_report string, Pred_combined_report string")
    assert [tuple(r)[:4] for r in back.orderBy("ingest_ord").collect()] == data
    n = predictions.normalised(back)
    assert {(r.id, r.gt) for r in n.collect()} == {("va", 'a "quoted"\nline'), ("w", ""), (None, "t")}
    sinks.append_csv(df, str(tmp_path / "c"))
    assert predictions.read_csv(spark, str(tmp_path / "c")).count() == 10


def test_layouts(spark):
    b = spark.createDataFrame([("1", "g", "f")], "AccessionNo string, GroundTruth string, Findings string")
    assert predictions.layout(b) == ("AccessionNo", "GroundTruth", "Findings")
    with pytest.raises(ValueError):
        predictions.layout(b.select("Findings"))
    t = spark.createDataFrame([("a", "x"), ("b", None)], "id string, report string")
    assert [r.text for r in predictions.training_texts(t).collect()] == ["x"]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", labels=np.array([[1, 0], [0, 1]], dtype=bool), volumes=np.array(["v1", "v2"]))
    got = {(r.volumes, tuple(r.labels)) for r in labels.read_npz(spark, str(tmp_path)).collect()}
    assert got == {("v1", (1, 0)), ("v2", (0, 1))}


def test_labellers(spark):
    df = spark.createDataFrame([(1, "A nodule is seen. No consolidation."), (2, None)], "id long, t string")
    got = {r.id: r.labels for r in labels.lexicon_labels(df, "id", "t").collect()}
    assert got[1][9] == 1 and got[1][15] == 0 and sum(got[2]) == 0
    m = labels.model_labels(df.filter("t is not null"), "id", "t", lambda ts: np.array([[0.5, 0.6] for _ in ts]))
    assert m.first().labels == [0, 1]


def test_shards(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("s"), (F.col("id") % 2).cast("string"), F.lit(".tar")).alias("shard"), F.lit("é").alias("t"))
    assert sorted(map(tuple, shards.write_shards(df, str(tmp_path), "id", "shard").collect())) == [("s0.tar", 5), ("s1.tar", 5)]
    with tarfile.open(tmp_path / "s0.tar", "a") as tar:
        (tmp_path / "notes.json").write_text("{}")
        tar.add(tmp_path / "notes.json", "notes.json")
        tar.add(tmp_path / "notes.json", "7.txt")
    (tmp_path / "broken.tar").write_bytes(b"not a tar file" * 100)
    back = shards.read_shards(spark, str(tmp_path))
    got = back.select("idx", F.get_json_object(F.col("content").cast("string"), "$.t").alias("t")).collect()
    assert sorted(r.idx for r in got) == list(range(10)) and {r.t for r in got} == {"é"}
    assert back.rdd.getNumPartitions() == 3
    with pytest.raises(Exception):
        shards.read_shards(spark, str(tmp_path), strict="true").count()


def test_shard_audit_and_stream(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("s"), (F.col("id") % 2).cast("string"), F.lit(".tar")).alias("shard"))
    at = (tmp_path / "tar").as_uri()
    shards.write_shards(df, at, "id", "shard").collect()
    whole = (tmp_path / "tar" / "s0.tar").read_bytes()
    (tmp_path / "tar" / "s2.tar").write_bytes(whole[:2300])  # ends inside the header of its third member
    (tmp_path / "tar" / "s3.tar").write_bytes(whole[:2562])  # ends inside its third member
    (tmp_path / "tar" / "s4.tar").write_bytes(whole[:2048])  # ends after its second member
    got = {r.shard: r for r in shards.read_shards(spark, at, audit="true").collect()}
    assert (got["s0.tar"].members, got["s0.tar"].skipped, got["s0.tar"].error) == (5, 0, None)
    for cut in ("s2.tar", "s3.tar", "s4.tar"):
        assert got[cut].members == 2 and "ReadError" in got[cut].error
    assert shards.read_shards(spark, at).filter("shard = 's2.tar'").count() == 2
    for cut in ("s2.tar", "s3.tar", "s4.tar"):
        (tmp_path / "tar" / cut).unlink()

    def run():
        rows = shards.stream_shards(spark, at).select("shard", "idx")
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 10 and run() == 10
    shards.write_shards(df.withColumn("shard", F.lit("s9.tar")), at, "id", "shard").collect()
    assert run() == 20
    with pytest.raises(Exception):
        shards.read_shards(spark, str(tmp_path / "nowhere")).count()


def test_ingest_keeps_the_least_row_of_a_key(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id long, t string").coalesce(1).write.parquet(src)
    resume.ingest(spark, src, "id long, t string", sink, cp, "id")
    spark.createDataFrame([(1, "0"), (3, "d")], "id long, t string").write.mode("append").parquet(src)
    resume.ingest(spark, src, "id long, t string", sink, cp, "id")
    assert sorted((r.id, r.t) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_json_text_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 0.5)], "k string, x int, y double")
    assert sinks.summary_json(df).first().json == '{"k":"a","x":null,"y":0.5}'
    assert sinks.markdown(df).first().line == "| a |  | 0.5 |"
    sinks.write_json(df, str(tmp_path / "j"))
    assert predictions.read_json(spark, str(tmp_path / "j")).first().k == "a"
    sinks.write_text(df, "k", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "a"


def test_volumes(spark, tmp_path):
    d = tmp_path / "data" / "p1" / "acc1"
    os.makedirs(d)
    (d / "acc1_a.nii.gz").write_bytes(b"xx")
    (d / "other.txt").write_text("no")
    r = predictions.volumes(spark, str(tmp_path)).collect()
    assert [(x.accession, x.name, x.length) for x in r] == [("acc1", "acc1_a", 2)]


def test_ingest_resumes_without_repeats(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id long, t string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).write.parquet(f"{src}/1")
    resume.ingest(spark, src, schema, sink, cp, "id")
    resume.ingest(spark, src, schema, sink, cp, "id")
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2]
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.parquet(f"{src}/2")
    resume.ingest(spark, src, schema, sink, cp, "id", transform=lambda d: d.withColumn("n", F.length("t")))
    assert sorted(r.id for r in spark.read.option("mergeSchema", True).parquet(sink).collect()) == [1, 2, 3]
