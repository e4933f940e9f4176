"""Readers and writers over files that each query first writes from the given tables, with SQL that skips the files.

The files go to a folder of the query's own beside the checkpoints, which driver and executors share, and are read back with
the reader under test, so work grows with the tables.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.operators.components import shared_folder
from flowkit.plans.evaluation_queries import VEC
from flowkit.plans.flow_queries import biflows
from flowkit.plans.packets import FLOWS, KEY, PK, RAW, packets, raw_packets, table
from flowkit.plans.registry import query
from flowkit.sources import files


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


#: Columns of raw_packets() that a capture file has, by the file's name for them.
_NAMES = {"frame_time": "frame_time", "src": "ip_src", "dst": "ip_dst", "pkttype": "pkttype", "tcp_srcport": "tcp_srcport", "tcp_len": "tcp_len", "udp_length": "udp_length"}
_READ = list(_NAMES.values())


def _captures(s: SparkSession, d: str) -> DataFrame:
    p = raw_packets(s, d).repartition("capture_id").sortWithinPartitions("capture_id", "row_pos")
    return p.select("capture_id", *[F.col(a).cast("string").alias(b) for a, b in _NAMES.items()])


def _written_captures(s: SparkSession, d: str) -> str:
    """A folder for each capture with its packets in order, as CSV, written by the tasks as streams: there are as many files
    as captures, and Spark's writer took about 22 ms of a task for each, on a local file system."""
    at = scratch(s, "captures")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyarrow import csv

        system, root = files._system(at)
        number, now, out, rows, done = TaskContext.get().partitionId(), None, None, None, 0
        for b in batches:
            start = 0
            for capture, run in groupby(b.column(0).to_pylist()):
                n = sum(1 for _ in run)
                part = b.slice(start, n).select(_READ)
                start += n
                if rows is None or capture != now:
                    if rows:
                        rows.close()
                        out.close()
                    now, done = capture, done + 1
                    folder = f"{root}/capture_id={'__HIVE_DEFAULT_PARTITION__' if capture is None else capture}"
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/part-{number:05d}.csv")
                    rows = csv.CSVWriter(out, part.schema)
                rows.write_batch(part)
        if rows:
            rows.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["captures"])

    _captures(s, d).mapInArrow(write, "captures long").write.format("noop").mode("overwrite").save()
    return at


_SQL_READ = """SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY row_pos) - 1 AS row_pos, frame_time, src AS ip_src, dst AS ip_dst, CASE WHEN k = 99 THEN 'abc' ELSE CAST(pkttype AS VARCHAR) END AS pkttype,
  CASE WHEN proto <> 17 AND k <> 94 THEN CAST(sport AS VARCHAR) END AS tcp_srcport, CASE WHEN proto <> 17 AND k <> 95 THEN CAST(CAST(payload_ AS BIGINT) AS VARCHAR) END AS tcp_len, CASE WHEN proto = 17 THEN CAST(CAST(payload_ AS BIGINT) AS VARCHAR) END AS udp_length"""
_SQL_CAPTURES = RAW + ", file AS (" + _SQL_READ + " FROM (SELECT r.capture_id, r.row_pos, r.frame_time, r.src, r.dst, r.k, p.pkttype, p.proto, p.sport, p.payload AS payload_ FROM raw r JOIN pk p ON r.row_pos = p.row_pos))"

query("a1_read_packet_csv", f"WITH {_SQL_CAPTURES} SELECT * FROM file")(lambda s, d: files.read_packet_csv(s, _written_captures(s, d), tuple(_READ)).select(F.regexp_extract("file", r"capture_id=([^/]+)/", 1).alias("capture_id"), "row_pos", *_READ))
query("a3_list_captures", f"WITH {PK} SELECT 'capture_id=' || capture_id AS partition, capture_id LIKE 'cap_%' AS named, count(*) AS n FROM pk GROUP BY ALL")(
    lambda s, d: files.list_captures(files.read_packet_csv(s, _written_captures(s, d), ("frame_time",))).groupBy("partition", F.col("app").startswith("part").alias("named")).agg(F.count(F.lit(1)).alias("n"))
)


def _written_archives(s: SparkSession, d: str) -> str:
    """An archive for each task with a member for each of its captures, written as a stream."""
    at = scratch(s, "archives")

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        number, done, now, member = TaskContext.get().partitionId(), [], None, None
        with files.created(f"{at}/part-{number:05d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for r in b.to_pylist():
                    if r["capture_id"] != now:
                        if member:
                            member.close()
                        now = r["capture_id"]
                        member = io.TextIOWrapper(z.open(f"{now}.csv", "w", force_zip64=True), "utf-8", newline="")
                        csv.writer(member).writerow(_READ)
                        done.append(now)
                    csv.writer(member).writerow([r[c] for c in _READ])
            if member:
                member.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["capture_id"])

    _captures(s, d).mapInArrow(archive, "capture_id string").write.format("noop").mode("overwrite").save()
    return at


query("a2_read_packet_zip", f"WITH {_SQL_CAPTURES} SELECT * FROM file")(
    lambda s, d: files.read_packet_zip(s, _written_archives(s, d), tuple(_READ)).select(F.regexp_replace("member", r"\.csv$", "").alias("capture_id"), "row_pos", *_READ)
)


def _flow_lists(s: SparkSession, d: str) -> DataFrame:
    """Flows with lists of their packets in order of time."""
    p = packets(s, d).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("t_ns", "row_pos", "payload", F.when(F.col("out"), 1).otherwise(-1).alias("dir")))).alias("x"))
    return p.select("capture_id", F.transform("x", lambda r: r["t_ns"] / 1e9).alias("timestamps"), F.transform("x", lambda r: r["payload"]).alias("sizes"), F.transform("x", lambda r: r["dir"]).alias("directions"))


def _flow_arrays(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "arrays")
    files.write_features(_flow_lists(s, d), at)
    return files.read_flow_arrays(s, at)


query("a4_read_flow_arrays", f"WITH {PK} SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, row_pos) - 1 AS position, round(t_ns / 1e9, 3) AS timestamps, payload AS sizes, CASE WHEN out THEN 1 ELSE -1 END AS directions FROM pk")(
    lambda s, d: _flow_arrays(s, d).select("capture_id", "position", F.round("timestamps", 3).alias("timestamps"), "sizes", "directions")
)


def _json_lists(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "lists")
    lists = {"SIZE": "sizes", "DIR": "directions"}
    files.write_csv(_flow_lists(s, d).select("capture_id", *[F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x.cast("int").cast("string"), F.lit("'"))), ", "), F.lit("]")).alias(name) for name, c in lists.items()]), at)
    # numbers in single quotes are JSON text; as doubles they come back only without the quotes
    read = s.read.option("header", True).option("escape", '"').csv(at)
    files.write_csv(read.select("capture_id", *[F.replace(F.col(c), F.lit("'"), F.lit("")).alias(c) for c in lists]), f"{at}-plain")
    return files.read_flow_json_lists(s, f"{at}-plain", tuple(lists))


query("a5_read_flow_json_lists", f"WITH {PK} SELECT capture_id, count(*) AS n, sum(payload) AS size, sum(CASE WHEN out THEN 1.0 ELSE -1.0 END) AS balance FROM pk GROUP BY capture_id")(
    lambda s, d: _json_lists(s, d).select("capture_id", F.size("SIZE").cast("long").alias("n"), F.aggregate("SIZE", F.lit(0.0), lambda a, x: a + x).alias("size"), F.aggregate("DIR", F.lit(0.0), lambda a, x: a + x).alias("balance"))
)


def _tree(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "tree")
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string"), F.col("label").cast("string").alias("class"))
    e.write.partitionBy("class").option("header", True).csv(at)
    return files.read_directory_tree(s, at, "part-*")


query("a6_read_directory_tree", "SELECT CAST(vec_id AS VARCHAR) AS vec_id, 'class=' || label AS label FROM embeddings")(lambda s, d: _tree(s, d).select("vec_id", "label"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "wide")
    cells = [F.get("embedding", F.lit(k)).cast("double").alias(f"f{k % 8}_{k // 8}") for k in range(64)]
    files.write_csv(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), *cells), at)
    return files.read_wide_features(s, at, 8, "id")


query("a7_read_wide_features", f"WITH {VEC} SELECT series AS id, step // 8 AS slot, step % 8 AS feature, value FROM vec")(lambda s, d: _wide(s, d).select(F.col("label").cast("long").alias("id"), "slot", F.col("feature").cast("long").alias("feature"), "value"))


def _series(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "series")
    files.write_csv(table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), F.col("value").alias("OT"), F.col("user_id").alias("x")), at)
    return files.read_series_csv(s, at)


query("a8_read_series_csv", "SELECT epoch_us(ts) AS at, CAST(user_id AS DOUBLE) AS x, value AS OT FROM events")(lambda s, d: _series(s, d).select(F.unix_micros("date").alias("at"), "x", "OT"))


def _anomalies(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "anomaly")
    e = table(s, d, "events")
    files.write_csv(e.select("ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias(" a "), F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("b"), F.when(F.col("event_type") == "purchase", "Attack").otherwise("Normal").alias("label")), at)
    return files.read_anomaly_series(s, at, "ts", "label")


query("a9_read_anomaly_series", "SELECT CAST(event_id AS DOUBLE) AS id, CASE WHEN event_id % 7 > 0 THEN value ELSE 0 END AS a, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS b, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events")(_anomalies)


def _samples(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "samples")
    halves = [F.array_join(F.transform(F.slice("embedding", k, 32), lambda x: x.cast("double").cast("string")), ",") for k in (1, 33)]
    lines = table(s, d, "embeddings").select(F.concat(halves[0], F.lit(":"), halves[1], F.lit(":class"), F.col("label").cast("string")).alias("value"))
    lines.unionByName(s.range(1).select(F.lit("@header").alias("value"))).write.text(at)
    return files.read_labeled_samples(s, at)


query("a11_read_labeled_samples", f"WITH {VEC} SELECT 'class' || label AS label, dense_rank() OVER (ORDER BY 'class' || label) - 1 AS code, step // 32 AS dim, step % 32 AS step, value FROM vec")(
    lambda s, d: _samples(s, d).select("label", F.col("code").cast("long").alias("code"), F.col("dim").cast("long").alias("dim"), F.col("step").cast("long").alias("step"), "value")
)


def _index(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "index")
    files.write_flow_index(biflows(s, d).withColumn("flow_id", F.concat_ws("|", *KEY.split(", "))), at, "flow_id")
    return s.read.parquet(at)


query("a12_write_flow_index", f"WITH {FLOWS} SELECT concat_ws('|', {KEY}) AS flow_id, packets FROM flows")(lambda s, d: _index(s, d).select("flow_id", "packets"))


def _records(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "records")
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    files.write_json_record(e, at)
    files.write_csv(e, f"{at}-csv")
    both = s.read.schema("event_id long, user_id long, event_type string, value double").json(at)
    return both.join(s.read.option("header", True).schema(both.schema).csv(f"{at}-csv"), ["event_id", "user_id", "event_type", "value"])


query("a13_write_records", "SELECT event_id, user_id, event_type, value FROM events")(_records)


def _replaced(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "table")
    e = table(s, d, "events").select("event_id", "value")
    files.replace_table(e.where("event_id % 2 = 0"), at)
    old = files.read_table(s, at)
    files.replace_table(e.withColumn("value", F.col("value") * 2), at)
    return files.read_table(s, at).join(old.select("event_id", F.col("value").alias("old")), "event_id", "left")


query("a14_replace_table", "SELECT event_id, value * 2 AS value, CASE WHEN event_id % 2 = 0 THEN value END AS old FROM events")(_replaced)
