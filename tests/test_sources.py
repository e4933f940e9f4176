"""Readers and writers, and streams against the batch form."""

import zipfile

import pytest
from pyspark.sql import functions as F

from flowkit.sources import files
from flowkit.streaming import slots as stream

HEADER = "frame_time,ip_src,ip_dst,ip_proto,pkttype,tcp_srcport,tcp_dstport,tcp_len"
ROW = '"Apr 30, 2019 07:51:15.381121000 CDT",10.0.0.1,8.8.8.8,6,4,4000,443,17'


@pytest.fixture
def captures(tmp_path):
    for part, name in (("p1", "maps_open_1"), ("p2", "mail_read_2")):
        (tmp_path / part).mkdir()
        (tmp_path / part / f"{name}.csv").write_text(f"{HEADER}\n{ROW}\n{ROW}\n")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name in ("p1/maps_open_1.csv", "p2/mail_read_2.csv"):
            z.write(tmp_path / name, name)
    return tmp_path


def test_captures(spark, captures):
    df = files.list_captures(files.read_packet_csv(spark, f"{captures}/p*"))
    assert sorted((r.partition, r.app, r.n) for r in df.groupBy("partition", "app").agg(F.count("tcp_len").alias("n")).collect()) == [("p1", "maps", 2), ("p2", "mail", 2)]
    assert df.where("udp_length IS NOT NULL").count() == 0 and files.list_captures(df, ["mail"]).count() == 2
    z = files.read_packet_zip(spark, f"{captures}/all.zip")
    assert sorted((r.member, r.row_pos) for r in z.collect()) == [("p1/maps_open_1.csv", 0), ("p1/maps_open_1.csv", 1), ("p2/mail_read_2.csv", 0), ("p2/mail_read_2.csv", 1)]
    assert z.first()["frame_time"].startswith("Apr 30")


def test_tables(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("label,a0,b0,a1,b1\nx,1,2,3,4\n")
    wide = files.read_wide_features(spark, str(tmp_path / "wide.csv"), 2, "label")
    assert sorted((r.slot, r.feature, r.value, r.label) for r in wide.collect()) == [(0, 0, 1.0, "x"), (0, 1, 2.0, "x"), (1, 0, 3.0, "x"), (1, 1, 4.0, "x")]
    with pytest.raises(ValueError, match="multiple"):
        files.read_wide_features(spark, str(tmp_path / "wide.csv"), 3, "label")
    (tmp_path / "lists.csv").write_text("APP,SIZE,Delta_Time,DIR\n3,\"['1', '2']\",\"[0, 5]\",\"[1, -1]\"\n".replace("'1'", "1").replace("'2'", "2"))
    assert files.dataset(spark, "flow_lists", str(tmp_path / "lists.csv")).first()["SIZE"] == [1.0, 2.0]
    (tmp_path / "series.csv").write_text("date,OT,x\n2020-01-01 00:00:00,1,2\n")
    assert files.read_series_csv(spark, str(tmp_path / "series.csv")).columns == ["date", "x", "OT"]
    assert files.read_series_csv(spark, str(tmp_path / "series.csv"), features="S").columns == ["date", "OT"]
    (tmp_path / "anomaly.csv").write_text("t,a,label\n1,,Attack\n2,NaN,Normal\n")
    assert [tuple(r) for r in files.read_anomaly_series(spark, str(tmp_path / "anomaly.csv"), "t", "label").collect()] == [(0.0, 1), (0.0, 0)]
    (tmp_path / "samples.ts").write_text("@x\n1,2:3,4:b\n5,6:7,8:a\n")
    s = files.read_labeled_samples(spark, str(tmp_path / "samples.ts"))
    assert s.count() == 8 and {(r.label, r.code) for r in s.collect()} == {("a", 0), ("b", 1)}
    (tmp_path / "tree" / "chat").mkdir(parents=True)
    (tmp_path / "tree" / "chat" / "timeseries_1.csv").write_text("a\n1\n")
    assert files.read_directory_tree(spark, str(tmp_path / "tree")).first()["label"] == "chat"


def test_flow_arrays(spark, tmp_path):
    df = spark.createDataFrame([("f", [0.0, 1.5], [10, 20], [1, 0])], "file_names string, timestamps array<double>, sizes array<long>, directions array<long>")
    df.write.parquet(str(tmp_path / "f"))
    assert [tuple(r) for r in files.read_flow_arrays(spark, str(tmp_path / "f")).orderBy("position").collect()] == [("f", 0, 0.0, 10, 1), ("f", 1, 1.5, 20, 0)]


def test_writers(spark, tmp_path):
    df = spark.range(4).withColumn("w", F.col("id") % 2)
    files.write_features(df, str(tmp_path / "t"), "w")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_features(df, str(tmp_path / "t"), "w")
    files.replace_partitions(spark.createDataFrame([(9, 1)], "id long, w long"), str(tmp_path / "t"), "w")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 2, 9]
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json_record(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    d = files.file_digests(spark, str(tmp_path / "j"), "part-*")
    assert d.count() >= 1


def test_streams(spark, tmp_path):
    rows = [("c", "a", 1, "b", 2, 6, "a" if k % 2 else "b", 1_000_000 * k, k, float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, src string, t_ns long, row_pos long, payload double")
    df = df.withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.absolute_slots(s, "2 milliseconds", "1 second").writeStream.format("memory").queryName("abs_slots").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.packets for r in spark.table("abs_slots").collect()) == [2, 2, 2]


def test_stateful_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("c", "a", 1, "b", 2, 6, "a" if k % 2 else "b", 1_000_000 * k, k, float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, src string, t_ns long, row_pos long, payload double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.relative_slots(s, 2_000_000, 4_000_000).writeStream.format("memory").queryName("rel_slots").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.row_pos, r.slot, r.fwd) for r in spark.table("rel_slots").collect()) == [(0, 0, True), (1, 0, False), (2, 1, True), (3, 1, False), (4, 2, True)]


def test_stateful_stream_ends_flows(spark, tmp_path):
    """Three batches: a late start has no slot, a flow keeps its count, and one that paused for long starts anew."""
    pytest.importorskip("google.protobuf")
    schema = "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, src string, t_ns long, row_pos long, payload double"
    second = 1_000_000_000

    def packet(capture, src, t, k):
        return (capture, "a", 1, "b", 2, 6, src, t, k, 1.0)

    batches = [
        [packet("c", "a", 100 * second, 0), packet("c", "b", 101 * second, 1)],
        [packet("c", "b", 99 * second, 2), packet("c", "a", 103 * second, 3), packet("c", "a", 105 * second, 4)],
        [packet("other", "a", 500 * second, 5)],
        [packet("c", "b", 501 * second, 6), packet("c", "a", 200 * second, 7)],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            q = stream.relative_slots(s, second, 4 * second, "10 seconds").writeStream.format("memory").queryName("ended_slots").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    found = sorted((r.row_pos, r.slot, r.fwd, r.nth) for r in spark.table("ended_slots").collect())
    assert found == [(0, 0, True, 1), (1, 1, False, 2), (2, None, False, 3), (3, 3, True, 4), (5, 0, True, 1), (6, 0, True, 1)]


def test_windows_of_either_end(spark, tmp_path):
    rows = [("c", "a", 1, "b", 2, 6, "a" if k % 3 else "b", k, float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, src string, ms long, payload double")
    df = df.withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    found = stream.absolute_slots(df, "2 milliseconds", "1 second").orderBy("start").collect()
    assert [(r.packets, r.payload, r.packets_a, r.payload_a, r.packets_b, r.payload_b) for r in found] == [(2, 1.0, 1, 1.0, 1, 0.0), (2, 5.0, 1, 2.0, 1, 3.0), (2, 9.0, 2, 9.0, 0, 0.0)]
