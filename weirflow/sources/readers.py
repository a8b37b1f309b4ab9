"""Sources, bounded and streaming: CSV tuples, text, tweets, integers, network probes, synthetic records, sockets."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.scalar import json_text, pack_ip_pair
from ..storage import new_folder

if TYPE_CHECKING:
    import pyarrow as pa

_CSV = {"comment": "#", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "DROPMALFORMED"}


def csv_tuples(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated integers, blanks trimmed, lines beginning with # left out."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def csv_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream; files_per_trigger paces it."""
    return spark.readStream.schema(schema).options(**_CSV).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder, or a single file: as a pattern, which streams take for either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def in_event_order(df: DataFrame, path: str, at: str) -> str:
    """A folder whose files, one a micro-batch, come in the order of column at, so that no watermark passes rows to come.

    That is path, from which df reads, where its files' times rise as at does and no two overlap in it; else df is written
    once more to the shared folder, in as many files, each a range of at, and their times are set to the order.
    """
    spark, files = df.sparkSession, len(df.inputFiles())
    if files < 2:
        return path
    file = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time").alias("time")
    edges = sorted(spark.read.parquet(path).select(*file, at).groupBy("file_path", "time").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low is not null").collect(), key=lambda e: e["time"])
    if all(a["time"] < b["time"] and a["high"] <= b["low"] for a, b in pairwise(edges)):
        return path
    folder = new_folder(spark, "ordered")
    df.repartitionByRange(files, at).write.parquet(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: sorted((x for x in system.listStatus(where) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
    first = int(time.time()) - files
    for i, part in enumerate(listed()):
        system.setTimes(part.getPath(), (first + i) * 1000, -1)
    if [x.getModificationTime() for x in listed()] != [(first + i) * 1000 for i in range(len(listed()))]:
        raise ValueError(f"{folder}: the store keeps no times of files, by which streams order them")
    return folder


def replay(df: DataFrame, start: Column, step_us: int, order: str) -> DataFrame:
    """Overwrites ts by start + i * step, i being the value of the column order: event time at a constant rate."""
    return df.withColumn("ts", F.timestamp_micros(F.unix_micros(start) + F.col(order).cast("long") * step_us))


def epochs(df: DataFrame, index: str, per_epoch: int, epoch_us: int = 1_000_000, start_us: int = 10_000_000, gap_us: int = 0) -> DataFrame:
    """Event time of a replayed source: records are spread evenly over epochs, with a session gap between them."""
    i = F.col(index).cast("long")
    epoch = F.floor(i / per_epoch)
    within = F.floor((i - epoch * per_epoch) * epoch_us / per_epoch)
    return df.withColumn("ts", F.timestamp_micros((start_us + epoch * (epoch_us + gap_us) + within).cast("long")))


def pseudo_source(spark: SparkSession, base: DataFrame, index: str, n: int, start_us: int, delta_us: int, offset: int = 0) -> DataFrame:
    """n records taken in a circle from base (rows numbered from 0 in index), beginning at offset, with new event times."""
    size = base.count()
    turns = spark.range(n).withColumn(index, F.pmod(F.col("id") + offset, F.lit(max(size, 1))))
    return turns.join(base, index).withColumn("ts", F.timestamp_micros(F.lit(start_us) + F.col("id") * delta_us)).drop("id")


def random_kv(spark: SparkSession, n: int, seed: int = 0, start_us: int = 0, delta_us: int = 1) -> DataFrame:
    """Test records: keys 1000 to 10999, values 0 to 9, rising event times."""
    ids = spark.range(n)
    return ids.select((F.floor(F.rand(seed) * 10000) + 1000).alias("k"), F.floor(F.rand(seed + 1) * 10).alias("v"), F.timestamp_micros(F.lit(start_us) + F.col("id") * delta_us).alias("ts"))


def pack_longs(batch: pa.RecordBatch) -> bytes:
    """Records of little-endian 64-bit integers, one a row."""
    import numpy as np

    if any(c.null_count for c in batch.columns):
        raise ValueError("a record has no form for null")
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("<i8").tobytes()


def pack_probes(batch: pa.RecordBatch) -> bytes:
    """Rows (sd_ip, rtt) as records that netmon_binary() reads."""
    name, rtt = (c.to_pylist() for c in batch.columns)
    names = [n.encode() for n in name]
    if max(map(len, names), default=0) > 32:
        raise ValueError("a name takes 32 bytes at most")
    return b"".join(n.ljust(32, b"\0") + struct.pack("<q", t) for n, t in zip(names, rtt, strict=True))


def packed(df: DataFrame, pack: Callable[[pa.RecordBatch], bytes], each: int = 100_000) -> DataFrame:
    """(content): df's rows in buffers of at most so many records, packed where the rows are."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, each - n)
                held.append(pack(part))
                n, batch = n + part.num_rows, batch.slice(part.num_rows)  # noqa: PLW2901
                if n == each:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["content"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["content"])

    return df.mapInArrow(run, "content binary")


def write_buffers(buffers: DataFrame, path: str) -> None:
    """Each buffer as a file, written by the tasks that hold them. Spark's only writer of plain bytes is the one for lines,
    so a newline follows the last record: an incomplete record, which readers leave out."""
    buffers.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def from_buffers(buffers: DataFrame, columns: list[str]) -> DataFrame:
    """Records of little-endian 64-bit integers, one after another in each buffer; an incomplete last one is left out."""
    return _records(buffers, 8 * len(columns)).select(*(_int64(F.col("part"), 8 * i).alias(c) for i, c in enumerate(columns)))


def from_buffer(spark: SparkSession, raw: bytes, columns: list[str], each: int = 100_000) -> DataFrame:
    """from_buffers() of one that the driver holds, sent in pieces of so many records."""
    step = 8 * len(columns) * each
    return from_buffers(spark.createDataFrame([(raw[i : i + step],) for i in range(0, len(raw), step)], "content binary"), columns)


def _int64(part: Column, at: int) -> Column:
    """A little-endian 64-bit integer, at bytes into a binary column."""
    octets = [F.conv(F.hex(F.substring(part, at + 1 + j, 1)), 16, 10).cast("long") for j in range(8)]
    return reduce(Column.bitwiseOR, (F.shiftleft(b, 8 * j) for j, b in enumerate(octets)))


def _records(buffers: DataFrame, width: int) -> DataFrame:
    """(part): the records of width bytes of each buffer in content; an incomplete last one is left out."""
    whole = buffers.select("content", F.floor(F.length("content") / width).cast("int").alias("n")).where("n > 0")
    return whole.select("content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(F.substring(F.col("content"), F.col("i") * width + 1, F.lit(width)).alias("part"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(content): the files of path as buffers. A file is one task's."""
    return spark.read.format("binaryFile").load(path).select("content")


def raw_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """from_buffers() of files that executors read."""
    return from_buffers(_files(spark, path), columns)


def offset_range(spark: SparkSession, first: int, end: int, splits: int) -> DataFrame:
    """Offsets first to end - 1 in so many splits, each read by a task of its own."""
    return spark.range(first, end, 1, splits).withColumnRenamed("id", "offset")


def two_outputs(df: DataFrame, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """A source of integers for both inputs of a join: (value, side) with side 0 and 1. Nothing is kept, both read the source."""
    return tuple(df.select(F.col(value), F.lit(side).alias("side")) for side in (0, 1))


def from_values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def text_slices(df: DataFrame, size: int, column: str = "text") -> DataFrame:
    """Slices of size characters, without regard to lines."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(column) - 1, F.lit(0)), F.lit(size))
    return df.withColumn("at", F.explode(starts)).withColumn(column, F.substring(F.col(column), F.col("at") + 1, F.lit(size))).drop("at")


def tweets(lines: DataFrame, column: str = "text", field: str = "text") -> DataFrame:
    """The text of JSON lines; malformed lines are left out."""
    return lines.withColumn(column, json_text(F.col(column), field)).where(F.col(column).isNotNull())


def integers(spark: SparkSession, path: str) -> DataFrame:
    """Files of one integer a line, the first of which is the count of the rest. The first lines' places, one a file, are
    broadcast; other rows stay where they are."""
    lines = spark.read.option("wholetext", False).text(path)
    numbered = lines.select(F.col("value").cast("long").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    head = numbered.groupBy("file").agg(F.min(F.when(F.col("at") == 0, F.col("i"))).alias("i")).select("i")
    return numbered.join(F.broadcast(head), "i", "left_anti").where("v is not null").select("v")


def write_integers(df: DataFrame, path: str, each: int = 4_000_000) -> None:
    """Such files of df's only column, a long: every task writes its own, of so many numbers at most, and holds those of one file
    until they are counted."""

    def counted(batches):
        import pyarrow as pa

        def file(parts: list):
            yield pa.RecordBatch.from_arrays([pa.array([str(sum(map(len, parts)))])], ["value"])
            for part in parts:
                yield pa.RecordBatch.from_arrays([part.cast(pa.string())], ["value"])

        held, n = [], 0
        for batch in batches:
            rest = batch.column(0)
            while len(rest):
                held.append(rest[: each - n])
                n, rest = n + len(held[-1]), rest[each - n :]
                if n == each:
                    yield from file(held)
                    held, n = [], 0
        if n:
            yield from file(held)

    df.mapInArrow(counted, "value string").write.option("maxRecordsPerFile", each + 1).text(path)


def netmon_binary(spark: SparkSession, path: str) -> DataFrame:
    """Records of 32 bytes 'a.b.c.d-e.f.g.h' filled with zeros and a little-endian 64-bit round-trip time."""
    part = F.col("part")
    name = F.regexp_replace(F.substring(part, 1, 32).cast("string"), "\\x00+$", "")
    return _records(_files(spark, path), 40).select(name.alias("sd_ip"), _int64(part, 32).alias("rtt")).withColumn("ippair", pack_ip_pair(F.col("sd_ip")))


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, each stamped with its arrival."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().select(F.col("value").alias("text"), F.col("timestamp").alias("ts"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """Records in JSON from a topic; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def rate_stream(spark: SparkSession, per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select((F.col("value") % 1000).alias("k"), F.col("value").alias("v"), F.col("timestamp").alias("ts"))


def produce(df: DataFrame, path: str, bundles: int, order: str = "ts") -> None:
    """A load generator's part: df as that many files, one after another in the order of event time, for a file stream
    to pick up; streams take files by their time, so each is complete before the next begins."""
    at = df.agg(F.percentile_approx(order, [i / bundles for i in range(1, bundles)], 10_000).alias("cuts")).first()["cuts"] if bundles > 1 else []
    edges = [None, *(at or []), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)


def fan_out(df: DataFrame, n: int) -> list[DataFrame]:
    """One input for n consumers, each of which reads it anew: nothing is held that someone would have to let go."""
    return [df] * n


class Paced(DataSource):
    """A source that replays records at a target rate: epoch after epoch of per_epoch records, a session gap after each.

    Options: epochs; per_epoch; splits, the tasks of an epoch; every_ms, after which the next epoch is due (0: all are due
    at once); epoch_us, gap_us and start_us of event time. Records are (i, ts), numbered from 0; an epoch's are spread evenly
    over it. What is late to be asked for is handed out with the next batch, so a slow consumer sets the pace.
    """

    @classmethod
    def name(cls) -> str:
        return "paced"

    def schema(self) -> str:
        return "i bigint, ts timestamp"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _PacedReader(self.options)


class _Part(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        get = lambda name, default: int(options.get(name, default))
        self.epochs, self.per_epoch, self.splits, self.every_ms = get("epochs", 10), get("per_epoch", 1000), get("splits", 2), get("every_ms", 1000)
        self.epoch_us, self.gap_us, self.start_us = get("epoch_us", 1_000_000), get("gap_us", 0), get("start_us", 10_000_000)
        self.began = time.monotonic()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        due = self.epochs if not self.every_ms else int((time.monotonic() - self.began) * 1000) // self.every_ms + 1
        return {"epoch": min(self.epochs, due)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        edges = [e * self.per_epoch + self.per_epoch * s // self.splits for e in range(start["epoch"], end["epoch"]) for s in range(self.splits)]
        return [_Part(a, b) for a, b in zip(edges, [*edges[1:], end["epoch"] * self.per_epoch], strict=True)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: _Part):
        import numpy as np
        import pyarrow as pa

        i = np.arange(partition.first, partition.end)
        epoch, within = i // self.per_epoch, i % self.per_epoch
        ts = self.start_us + epoch * (self.epoch_us + self.gap_us) + within * self.epoch_us // self.per_epoch
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ts, pa.timestamp("us", "UTC"))], ["i", "ts"])


def paced_stream(spark: SparkSession, **options: int) -> DataFrame:
    """A stream of Paced."""
    spark.dataSource.register(Paced)
    return spark.readStream.format("paced").options(**options).load()
