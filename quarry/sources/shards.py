"""Tar shards as a Spark data source: one partition for each shard, read front to back.

Folders may lie on any file system that Arrow knows (local, HDFS, S3, ...)."""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry import schemas

DAMAGE = (tarfile.TarError, EOFError, zlib.error)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Ending:
    """A stream that knows its last block: an archive ends with zeros, or it was cut between members."""

    def __init__(self, stream):
        self.stream, self.head, self.tail = stream, b"", b""

    def read(self, n: int) -> bytes:
        got = self.stream.read(n)
        self.head = self.head or got[:6]
        self.tail = (self.tail + got)[-512:]
        return got

    def whole(self) -> bool:
        while self.read(1 << 20):
            pass
        packed = self.head.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ"))  # these check their own end
        return packed or len(self.tail) == 512 and not any(self.tail)


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Shards:
    """Listing and reading of the shards of a folder."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", ".json")
        self.strict = options.get("strict", "false").lower() == "true"
        self.audit = options.get("audit", "false").lower() == "true"

    def paths(self) -> list[str]:
        files, root = located(self.folder)
        # listed anew for each query, so there is no stale index
        return sorted(i.path for i in files.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(".tar"))

    def read(self, part: _Shard) -> Iterator[tuple]:
        """Members, or with ``audit`` one row on the shard. A damaged shard gives the members before the
        damage; failures of the file system are none and are raised."""
        files, name = located(self.folder)[0], os.path.basename(part.path)
        members = skipped = 0
        error = None
        with files.open_input_stream(part.path) as opened:
            stream = _Ending(opened)
            try:
                with tarfile.open(fileobj=stream, mode="r|*") as tar:
                    for m in tar:
                        stem = os.path.basename(m.name)[: -len(self.suffix)] if m.name.endswith(self.suffix) else ""
                        if not m.isfile() or not stem.isdigit():
                            if self.strict and m.isfile() and m.name.endswith(self.suffix):
                                raise ValueError(f"{m.name} in {part.path} has no number")
                            skipped += 1
                            continue
                        body = tar.extractfile(m).read()
                        members += 1
                        if not self.audit:
                            yield name, m.name, int(stem), body
                if not stream.whole():
                    raise tarfile.ReadError("the archive has no end")
            except DAMAGE as e:
                if self.strict:
                    raise
                error = f"{type(e).__name__}: {e}"
        if self.audit:
            yield name, members, skipped, error


class _Reader(_Shards, DataSourceReader):
    def partitions(self) -> list[_Shard]:
        return [_Shard(p) for p in self.paths()]


class _StreamReader(_Shards, DataSourceStreamReader):
    """New shards in the order of their names: one with a lower name than those seen is not read."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        paths = self.paths()
        return {"last": paths[-1] if paths else ""}

    def partitions(self, start: dict, end: dict) -> list[_Shard]:
        return [_Shard(p) for p in self.paths() if start["last"] < p <= end["last"]]


class ShardSource(DataSource):
    """``spark.read.format("tar_shards").load(folder)``: ``shard, member, idx, content``; or a stream of
    them with ``spark.readStream``.

    Options: ``suffix`` of the members, ``strict`` to fail on damage instead of skipping it, ``audit`` for
    ``shard, members, skipped, error`` of each shard instead of its members."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        audit = self.options.get("audit", "false").lower() == "true"
        return "shard string, members long, skipped long, error string" if audit else schemas.SHARD_MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_shards(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ShardSource)
    return spark.read.format("tar_shards").options(**options).load(folder)


def stream_shards(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ShardSource)
    return spark.readStream.format("tar_shards").options(**options).load(folder)


def write_shards(df: DataFrame, folder: str, idx: str, shard: str, suffix: str = ".json") -> DataFrame:
    """Write rows as JSON members, one tar file for each value of ``shard``; returns ``shard, n``.

    ``folder`` must be visible to all executors. Rows are sorted by shard and number in Spark and
    streamed into the files, so that a shard of any size fits. A shard is written under another name
    and renamed, so a task that is run again leaves one whole file."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = located(folder)
        files.create_dir(root, recursive=True)
        name, n, stream, tar, done = None, 0, None, None, []

        def close() -> None:
            if tar is not None:
                tar.close()
                stream.close()
                files.move(part, f"{root}/{name}")
                done.append((name, n))

        for b in batches:
            for s, i, body in zip(b["shard"], b["idx"], b["body"]):
                if s != name:
                    close()
                    name, n, part = s, 0, f"{root}/{s}.{uuid.uuid4().hex}.part"
                    stream = files.open_output_stream(part)
                    tar = tarfile.open(fileobj=stream, mode="w|")
                data = json.dumps(json.loads(body), ensure_ascii=False).encode()
                m = tarfile.TarInfo(f"{int(i):06d}{suffix}")
                m.size = len(data)
                tar.addfile(m, io.BytesIO(data))
                n += 1
        close()
        yield pd.DataFrame(done, columns=["shard", "n"])

    body = F.to_json(F.struct(*(c for c in df.columns if c != shard)), {"ignoreNullFields": "false"})
    rows = df.select(F.col(shard).cast("string").alias("shard"), F.col(idx).cast("long").alias("idx"), body.alias("body"))
    return rows.repartition("shard").sortWithinPartitions("shard", "idx").mapInPandas(each, "shard string, n long")
