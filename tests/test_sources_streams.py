"""Sources from hand-made files; streams against the bounded form; sinks and progress."""

import struct

import pytest
from pyspark.sql import functions as F

from weirflow import schemas, storage
from weirflow.operators import aggregate as a
from weirflow.operators import windowing as w
from weirflow.plans import catalog
from weirflow.sources import readers
from weirflow.sources import readers as r
from weirflow.streaming import runtime


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "kv", "a.csv", "# k, v, ts\n 1 ,\t5, 2024-01-01 00:00:00\nbroken,line,here\n2,6,2024-01-01 00:00:01\n")
    assert sorted((x["k"], x["v"]) for x in r.csv_tuples(spark, path, schemas.KV).collect()) == [(1, 5), (2, 6)]
    query = runtime.memory_sink(r.csv_stream(spark, path, schemas.KV), "csv_rows")
    runtime.drain(query)
    assert spark.table("csv_rows").count() == 2


def test_integers_leave_out_the_count(spark, tmp_path):
    path = write(tmp_path / "n", "n.txt", "3\n7\n8\n9\n")
    assert sorted(x["v"] for x in r.integers(spark, path).collect()) == [7, 8, 9]


def test_integers_are_written_by_all_tasks(spark, tmp_path):
    """No task has all rows: several files, each after its count."""
    r.write_integers(spark.range(0, 1000, 1, 3).select((F.col("id") - 500).alias("v")), str(tmp_path / "n"), 100)
    files = [f.read_text().split() for f in (tmp_path / "n").glob("part-*")]
    assert sorted(map(len, files)) == [34, 34, 35] + [101] * 9
    assert all(int(f[0]) == len(f) - 1 for f in files)
    assert sorted(x["v"] for x in r.integers(spark, str(tmp_path / "n")).collect()) == list(range(-500, 500))


def test_integer_file_is_no_single_task(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).select(F.lit(1).cast("long").alias("l_suppkey"), F.lit("A").alias("l_returnflag"), (F.col("id") % 7).cast("double").alias("l_quantity"), F.current_timestamp().alias("l_shipdate"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    kept, readers.integers = readers.integers, lambda session, path: seen.append(path) or kept(session, path)
    try:
        found = sorted(map(tuple, catalog.QUERIES["integer_file"](spark, str(tmp_path)).collect()))
    finally:
        readers.integers = kept
    assert found == [(0, 58)] + [(i, 57) for i in range(1, 7)]
    assert len(spark.read.text(seen[0]).inputFiles()) > 1


def test_text(spark, tmp_path):
    path = write(tmp_path / "t", "t.txt", '{"text": "hello"}\n{"text": \n{"other": 1}\n')
    assert [x["text"] for x in r.tweets(r.text_lines(spark, path)).collect()] == ["hello"]
    df = spark.createDataFrame([("abcdefg",), ("",), (None,)], "text string")
    assert sorted(x["text"] for x in r.text_slices(df, 3).collect() if x["text"] is not None) == ["", "abc", "def", "g"]


def test_network_probes(spark, tmp_path):
    one = b"10.0.0.1-10.0.0.2".ljust(32, b"\0") + struct.pack("<q", 1234567)
    two = b"255.255.255.255-1.1.1.1".ljust(32, b"\0") + struct.pack("<q", -5)
    path = write(tmp_path / "p", "p.bin", one + two)
    rows = {x["sd_ip"]: (x["rtt"], x["ippair"]) for x in r.netmon_binary(spark, path).collect()}
    assert rows["10.0.0.1-10.0.0.2"] == (1234567, 0x0A000001 << 32 | 0x0A000002)
    assert rows["255.255.255.255-1.1.1.1"][0] == -5


def test_buffers_and_values(spark):
    raw = struct.pack("<6q", 1, 2, 3, 4, 5, 6)
    assert [tuple(x) for x in r.from_buffer(spark, raw, ["k", "v", "t"]).collect()] == [(1, 2, 3), (4, 5, 6)]
    assert r.from_values(spark, [(1, "a")], "k long, s string").first()["s"] == "a"


def test_synthetic_times(spark):
    base = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, s string")
    rows = sorted((x["ts"], x["s"]) for x in r.pseudo_source(spark, base, "i", 5, 0, 10, 2).collect())
    assert [s for _, s in rows] == ["c", "a", "b", "c", "a"]
    times = [x[0] for x in r.epochs(base, "i", 2, gap_us=500_000).select(F.unix_micros("ts")).orderBy("i").collect()]
    assert times == [10_000_000, 10_500_000, 11_500_000]
    assert r.replay(base, F.timestamp_micros(F.lit(0)), 7, "i").select(F.unix_micros("ts").alias("t")).agg(F.sum("t")).first()[0] == 21
    one, two = r.fan_out(base, 2)
    assert one.count() == two.count() == 3
    left, right = r.two_outputs(base, "i")
    assert sorted(map(tuple, left.unionByName(right).collect())) == [(i, side) for i in range(3) for side in (0, 1)]
    parts = r.offset_range(spark, 5, 15, 4)
    assert parts.rdd.getNumPartitions() == 4
    assert sorted(x["offset"] for x in parts.collect()) == list(range(5, 15))


def test_raw_files(spark, tmp_path):
    path = write(tmp_path / "raw", "a.bin", struct.pack("<4q", 1, -2, 3, 1 << 62) + b"rest")
    write(tmp_path / "raw", "b.bin", b"")
    assert sorted(map(tuple, r.raw_file(spark, path, ["k", "v"]).collect())) == [(1, -2), (3, 1 << 62)]


def sent(spark, monkeypatch, data, duck, name):
    """A query's rows beside its SQL's, where no rows may pass the driver before the result is asked for."""

    def refuse(self, *_, **__):
        raise AssertionError("rows pass the driver")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "toLocalIterator", refuse)
        m.setattr(type(spark.range(1)), "collect", refuse)
        df = catalog.QUERIES[name](spark, data)
    want = duck.execute(catalog.ORACLES[name])
    return sorted(map(tuple, df.select(*[d[0] for d in want.description]).collect())), sorted(want.fetchall())


def test_probes_are_written_by_executors(spark, monkeypatch, data, duck):
    found, want = sent(spark, monkeypatch, data, duck, "network_probes")
    assert found == want


def test_raw_files_are_written_by_executors(spark, monkeypatch, data, duck):
    found, want = sent(spark, monkeypatch, data, duck, "raw_file")
    assert found == want


def test_raw_buffers_stay_with_executors(spark, monkeypatch, data, duck):
    found, want = sent(spark, monkeypatch, data, duck, "raw_buffer")
    assert found == want


@pytest.mark.parametrize("name", ["raw_file", "network_probes", "raw_buffer"])
def test_task_results_do_not_grow_with_rows(spark, tmp_path, name):
    """Bytes that tasks send to the driver, as Spark counts them: less than one for each further row."""
    context = spark.sparkContext._jsc.sc()

    def stages() -> dict[int, int]:
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    def results(n: int) -> int:
        rows = spark.range(0, n, 1, 4).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 65_536).alias("user_id"), F.lit("a").alias("event_type"), (F.col("id") % 10_007 / 4).alias("value"), F.lit("{}").alias("props"), F.current_timestamp().alias("ts"))
        rows.write.parquet(str(tmp_path / str(n) / "events.parquet"))
        last = max(stages(), default=-1)
        catalog.QUERIES[name](spark, str(tmp_path / str(n))).write.format("noop").mode("overwrite").save()
        assert any(k > last for k in stages())
        return sum(size for k, size in stages().items() if k > last)

    assert results(20_400) - results(400) < 20_000


def test_a_buffer_in_pieces(spark):
    raw = struct.pack("<10q", *range(10)) + b"rest"
    assert sorted(map(tuple, r.from_buffer(spark, raw, ["k", "v"], 2).collect())) == [(i, i + 1) for i in range(0, 10, 2)]
    assert r.from_buffer(spark, b"", ["k"]).collect() == []


def test_written_buffers(spark, tmp_path):
    """So many records a file, every byte of them as it was, read again as records or probes."""
    rows = spark.range(-500, 500, 1, 3).select(F.col("id").alias("k"), (F.col("id") * 18_014_398_509_481_985).alias("v"))
    r.write_buffers(r.packed(rows, r.pack_longs, 100), str(tmp_path / "longs"))
    assert sorted(f.stat().st_size // 16 for f in (tmp_path / "longs").glob("part-*")) == [33, 33, 34] + [100] * 9
    assert sorted(map(tuple, r.raw_file(spark, str(tmp_path / "longs"), ["k", "v"]).collect())) == sorted(map(tuple, rows.collect()))
    probes = spark.createDataFrame([("255.255.255.255-255.255.255.254", -1), ("1.2.3.4-5.6.7.8", 1 << 62)], "sd_ip string, rtt long")
    r.write_buffers(r.packed(probes, r.pack_probes), str(tmp_path / "probes"))
    assert sorted(map(tuple, r.netmon_binary(spark, str(tmp_path / "probes")).select("sd_ip", "rtt").collect())) == sorted(map(tuple, probes.collect()))
    with pytest.raises(Exception, match="no form for null"):
        r.packed(rows.withColumn("v", F.lit(None).cast("long")), r.pack_longs).count()


def test_paced_source(spark):
    """Epochs come as time passes, whole, with gaps in event time between them."""
    batches = []
    rows = r.paced_stream(spark, epochs=3, per_epoch=10, every_ms=500, gap_us=500_000)
    query = runtime.batch_sink(rows.select("i", F.unix_micros("ts").alias("t")), lambda batch, number: batches.append(sorted(map(tuple, batch.collect()))))
    try:
        for _ in range(200):
            if sum(map(len, batches)) == 30:
                break
            query.awaitTermination(0.1)
    finally:
        query.stop()
    found = sorted(x for b in batches for x in b)
    assert found == [(i, 10_000_000 + i // 10 * 1_500_000 + i % 10 * 100_000) for i in range(30)]
    assert sum(1 for b in batches if b) > 1
    assert all(len(b) % 10 == 0 for b in batches)


def test_watermark_policy_is_given_back(spark):
    before = spark.conf.get(runtime.POLICY)
    with runtime.least_watermark(spark):
        assert spark.conf.get(runtime.POLICY) == "min"
    assert spark.conf.get(runtime.POLICY) == before


def test_a_cluster_needs_a_shared_folder():
    """Only where driver and executors are one process is a folder of one's own a shared one."""

    class Nothing:
        def get(self, *_):
            return None

        def isDefined(self):  # noqa: N802
            return False

        getCheckpointDir = sc = lambda self: self  # noqa: E731, N815

    class Session:
        conf = Nothing()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            _jsc = Nothing()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_root(Session)
    assert [storage.one_process(m) for m in ("local", "local[8]", "local-cluster[2,1,1024]", "yarn")] == [True, True, False, False]


def test_rate_and_socket_sources_start(spark):
    rate = runtime.memory_sink(r.rate_stream(spark, 100), "rate_rows")
    try:
        assert rate.isActive
    finally:
        rate.stop()
    assert r.socket_stream(spark, "127.0.0.1", 9).columns == ["text", "ts"]


@pytest.fixture()
def produced(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 5).alias("k"), (F.col("id") * 7 % 101).alias("v"), F.timestamp_seconds(F.col("id")).alias("ts"))
    r.produce(rows, str(tmp_path / "in"), 6)
    return rows, str(tmp_path / "in")


def test_stream_equals_bounded_windows(spark, produced, tmp_path):
    rows, path = produced
    stream = w.fixed(runtime.watermarked(r.parquet_stream(spark, path, rows.schema)), "1 minute")
    out = runtime.run_available(runtime.without_zone(a.windowed(stream, "MEDV_BYKEY", "k")), "median")
    bounded = runtime.without_zone(a.windowed(w.fixed(rows, "1 minute"), "MEDV_BYKEY", "k")).where("w_end <= timestamp_ntz'1970-01-01 00:09:49'")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, bounded.collect()))
    assert out.count() == 45


def test_late_rows_go_one_by_one(spark, tmp_path):
    schema = "k long, v long, ts timestamp"
    # A watermark counts for late rows from the second micro-batch after the one that raised it.
    late = [[(1, 1, 0), (1, 1, 100)], [(1, 1, 101)], [(1, 10, 1), (1, 10, 99), (1, 10, 200)], [(1, 0, 400)]]
    for i, part in enumerate(late):
        df = spark.createDataFrame(part, "k long, v long, s long").select("k", "v", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "late" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late" / "*"))
    out = runtime.run_available(runtime.without_zone(a.sum_by(w.fixed(runtime.watermarked(stream), "10 seconds"), "window")), "late")
    sums = {x["w_start"].minute * 60 + x["w_start"].second: x["sum"] for x in out.collect()}
    assert sums == {0: 1, 90: 10, 100: 2, 200: 10}


def test_sinks_and_progress(spark, produced):
    rows, path = produced
    seen, batches = runtime.Throughput(), []
    spark.streams.addListener(seen)
    try:
        query = runtime.batch_sink(r.parquet_stream(spark, path, rows.schema, 2), lambda batch, number: batches.append(batch.count()), "append", available_now=True)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(seen)
    assert sum(batches) == 600
    assert len(batches) == 3
    assert sum(x["rows"] for x in seen.seen) == 600


@pytest.mark.parametrize("spread", [False, True])
def test_streams_of_files_in_any_order_lose_no_rows(spark, tmp_path, spread):
    """Files whose times run against event time, or whose ranges overlap: the windows that the last watermark closed are whole."""
    for name, rows, per in (
        ("documents", spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Word w"), F.col("id") % 3).alias("text")), 400),
        ("events", spark.range(300).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
                                           F.expr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01 00:00:00')").alias("ts")), 100),
    ):
        for i in range(3):
            part = rows.where(F.col(rows.columns[0]) % 3 == i if spread else F.floor(F.col(rows.columns[0]) / per) == 2 - i)
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))
    words = catalog.QUERIES["stream_word_count"](spark, str(tmp_path))
    assert words.where("word = 'WORD'").groupBy("n").count().collect() == [(20, 49)]
    sums = catalog.QUERIES["stream_sum_by_key"](spark, str(tmp_path))
    assert sums.groupBy("sum").count().collect() == [(2400, 12)]


def test_files_in_order_are_read_where_they_are(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    assert r.in_event_order(spark.read.parquet(path), path, "id") == path
