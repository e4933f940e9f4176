"""Readers and writers: packet captures, flow lists, feature tables, series and digests."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a packet capture; all text, as captures hold broken values.
PACKET_COLUMNS = ("frame_time", "ip_src", "ip_dst", "ip_proto", "pkttype", "tcp_srcport", "tcp_dstport", "tcp_len", "udp_srcport", "udp_dstport", "udp_length")

#: Bytes above which a file is digested as a stream, and of a chunk of a tree digest.
LARGE, CHUNK = 256 << 20, 64 << 20


def _text_schema(columns) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _walk(system, path) -> Iterator:
    """The files below a folder that Spark's readers would list, one by one."""
    found = system.listStatusIterator(path)
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if name.startswith(".") or name.startswith("_") and "=" not in name:
            continue
        if f.isDirectory():
            yield from _walk(system, f.getPath())
        else:
            yield f


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """The columns of the first file under path that has any; the other files are not looked at."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(sc._jsc.hadoopConfiguration())
    for top in system.globStatus(at) or ():
        for f in _walk(system, top.getPath()) if top.isDirectory() else [top]:
            columns = spark.read.option("header", True).csv(f.getPath().toString()).columns if f.getLen() else []
            if columns:
                return columns
    return None


def read_packet_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = PACKET_COLUMNS, recursive: bool = True) -> DataFrame:
    """The columns of all captures under path with file and row_pos, the row's place in its file from 0.

    The files share one header, in any order of columns; a file with another header raises an error. A column that they
    lack is null. Bad bytes become replacement characters, torn rows have nulls. Files too small to be split are read once
    and their rows numbered by file. Rows of larger files are counted in each block of a file first; the sums over the blocks
    before, a small table, give the places, however the files are split.
    """
    read = spark.read.option("header", True).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE").option("enforceSchema", False)
    header = _header(spark, path) if recursive else None
    if header:  # else Spark infers it, which lists all files once more
        read = read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    lines = read.csv(path)
    cells = [(F.col(f"`{c}`") if c in lines.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    whole = F.col("_metadata.file_size") <= _never_split(spark)  # Spark leaves out the other files when it plans a scan
    small = lines.where(whole).select(*cells, *at)
    small = small.select(*columns, "file", (F.row_number().over(Window.partitionBy("file").orderBy("__id")) - 1).cast("long").alias("row_pos"))
    lines = lines.where(~whole)
    blocks = lines.select(*at).groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__rows"), F.min("__id").alias("__first"))
    before = F.sum("__rows").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))  # a block's ids follow each other
    large = lines.select(*cells, *at).join(blocks, ["file", "__block"]).select(*columns, "file", (F.col("__id") + F.col("__shift")).alias("row_pos"))
    return small.unionByName(large)


def _never_split(spark: SparkSession) -> int:
    """Bytes up to which Spark never splits a file: a split holds at least the lesser of these two."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(size(spark.conf.get(f"spark.sql.files.{x}")) for x in ("maxPartitionBytes", "openCostInBytes"))


def opened(path: str):
    """A file by its URI or local path, for reads of ranges, on any file system that pyarrow knows (local, HDFS, S3, GCS)."""
    system, name = _system(path)
    return system.open_input_file(name)


def created(path: str):
    """A new file, and its folder, to write to as a stream."""
    system, name = _system(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name)


def _system(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """archive, member, start, size and method of the members of zip archives, from their directories; nothing else is read."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                with opened(archive) as f, zipfile.ZipFile(f) as z:
                    rows = [(archive, m.filename, m.header_offset, m.compress_size, m.compress_type) for m in z.infolist() if m.filename.endswith(suffix)]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", "member", "start", "size", "method"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(listed, "archive string, member string, start long, size long, method int")


class _Inflated(io.RawIOBase):
    """A member's bytes from its local header on, read by ranges and inflated as they are asked for."""

    def __init__(self, file, start: int, size: int, method: int) -> None:
        file.seek(start)
        head = file.read(30)
        file.seek(start + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        self.file, self.left, self.held = file, size, b""
        if head[:4] != b"PK\x03\x04" or method not in (0, 8):
            raise zipfile.BadZipFile("no local header, or a method other than stored and deflated")
        self.engine = zlib.decompressobj(-15) if method == 8 else None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            part = self.engine.unconsumed_tail if self.engine else b""
            if not part and self.left:
                part = self.file.read(min(self.left, 1 << 20))
                self.left -= len(part)
                if not part:
                    raise zipfile.BadZipFile("the archive ends within the member")
            if not part:
                if self.engine and not self.engine.eof:
                    raise zipfile.BadZipFile("the member ends too early")
                return 0
            self.held = self.engine.decompress(part, 1 << 20) if self.engine else part
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def read_packet_zip(spark: SparkSession, path: str, columns: tuple[str, ...] = PACKET_COLUMNS, torn: str = "fail") -> DataFrame:
    """Captures from the members of zip archives: member, row_pos and the columns.

    Each member is read and inflated as a stream by a task of its own choice, so one archive of any size keeps many tasks
    busy. A member that can't be read to its end is an error that names it; with torn="keep" its rows up to there stay,
    followed by one whose columns are all null.
    """
    kept = list(columns)
    members = zip_members(spark, path)
    schema = pa.schema([("member", pa.string()), ("row_pos", pa.int64()), *[(c, pa.string()) for c in kept]])

    def rows(archive: str, member: str, start: int, size: int, method: int) -> Iterator[dict]:
        import csv

        n = 0
        try:
            with opened(archive) as f:
                text = io.TextIOWrapper(io.BufferedReader(_Inflated(f, start, size, method)), "utf-8", errors="replace", newline="")
                for n, r in enumerate(csv.DictReader(text), 1):
                    yield {"member": member, "row_pos": n - 1, **{c: r.get(c) or None for c in kept}}
        except (zipfile.BadZipFile, zlib.error) as e:
            if torn != "keep":
                raise ValueError(f"{archive}, member {member}, after {n} rows: {e}") from e
            yield {"member": member, "row_pos": n, **dict.fromkeys(kept)}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                held = []
                for r in rows(**m):
                    held.append(r)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "archive", "member").mapInArrow(read, f"member string, row_pos long, {_text_schema(kept)}")


def _folder(file: str) -> Column:
    """The name of a file's folder. The pattern meets the last two names alone: over a whole path it starts anew at each
    character, for each row."""
    return F.regexp_extract(F.substring_index(file, "/", -2), r"^([^/]+)/[^/]+$", 1)


def list_captures(df: DataFrame, apps: list[str] | None = None, file: str = "file") -> DataFrame:
    """Adds partition (the file's folder), capture_id (its name) and app (up to the first underscore); keeps named apps."""
    name = F.regexp_extract(F.substring_index(file, "/", -1), r"^([^/]+)\.csv$", 1)
    out = df.withColumns({"partition": _folder(file), "capture_id": name, "app": F.substring_index(name, "_", 1)})
    return out.where(F.col("app").isin(apps)) if apps else out


def read_flow_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Flows with array columns (timestamps, sizes, directions), one row per packet: flow, position and the three values."""
    f = spark.read.parquet(path)
    others = [c for c in f.columns if c not in ("timestamps", "sizes", "directions")]
    p = f.select(*others, F.posexplode(F.arrays_zip("timestamps", "sizes", "directions")).alias("position", "x"))
    return p.select(*others, "position", "x.timestamps", "x.sizes", "x.directions")


def read_flow_json_lists(spark: SparkSession, path: str, lists: tuple[str, ...] = ("SIZE", "Delta_Time", "DIR")) -> DataFrame:
    """Flows whose list columns are JSON text with single quotes, as arrays of doubles."""
    f = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return f.withColumns({c: F.from_json(F.regexp_replace(c, "'", '"'), "array<double>") for c in lists})


def read_directory_tree(spark: SparkSession, root: str, glob: str = "timeseries_*.csv") -> DataFrame:
    """All files of the pattern below root with label, the folder that holds them."""
    f = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)
    return f.withColumn("label", _folder("_metadata.file_path"))


def read_wide_features(spark: SparkSession, path: str, n_features: int, label: str | None = None) -> DataFrame:
    """A wide table as rows: row, slot, feature, value (and label). The number of columns must be a multiple of n_features."""
    f = spark.read.option("header", True).csv(path)
    names = [c for c in f.columns if c != label]
    if len(names) % n_features:
        raise ValueError(f"{len(names)} columns are no multiple of {n_features}")
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    f = f.select(F.monotonically_increasing_id().alias("row"), *([F.col(f"`{label}`").alias("label")] if label else []), F.posexplode(cells).alias("pos", "value"))
    return f.withColumns({"slot": F.floor(F.col("pos") / n_features), "feature": F.col("pos") % n_features}).drop("pos")


def read_series_csv(spark: SparkSession, path: str, target: str = "OT", features: str = "M") -> DataFrame:
    """date and the channels as doubles, the target last; features: S (target alone), M or MS (all)."""
    f = spark.read.option("header", True).csv(path)
    others = [c for c in f.columns if c not in ("date", target)] if features in ("M", "MS") else []
    return f.select(F.to_timestamp("date").alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in [*others, target]])


def read_anomaly_series(spark: SparkSession, path: str, time: str | None = None, label: str | None = None) -> DataFrame:
    """Channels as doubles with missing values 0, without the time column; a label column becomes 0 or 1."""
    f = spark.read.option("header", True).csv(path)
    cell = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    channels = [cell(c).alias(c.strip()) for c in f.columns if c not in (time, label)]
    marks = [(F.trim(F.col(f"`{label}`")).isin("1", "1.0", "Attack", "true")).cast("int").alias("label")] if label else []
    return f.select(*channels, *marks)


def read_ragged_series(info: DataFrame, values: DataFrame, pattern: str) -> DataFrame:
    """id, group, frequency, horizon and values without missing ones, of the series of one seasonal pattern."""
    clean = values.select("id", F.filter("values", lambda x: x.isNotNull() & ~F.isnan(x)).alias("values"))
    return info.where(F.col("group") == pattern).join(clean, "id")


def read_labeled_samples(spark: SparkSession, path: str) -> DataFrame:
    """Multivariate samples from text, one line each, dimensions parted by colons and the label last: sample, dim, step,
    value, label and its code. Lines that start with @ or # are skipped."""
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:[@#]|$)"))
    parts = F.split("value", ":")
    t = t.select(F.monotonically_increasing_id().alias("sample"), F.slice(parts, 1, F.size(parts) - 1).alias("dims"), F.trim(F.element_at(parts, -1)).alias("label"))
    codes = t.select("label").distinct().withColumn("code", F.row_number().over(_order("label")) - 1)
    t = t.join(codes, "label").select("sample", "label", "code", F.posexplode("dims").alias("dim", "x"))
    return t.select("sample", "label", "code", "dim", F.posexplode(F.split("x", ",")).alias("step", "v")).select("sample", "label", "code", "dim", "step", F.col("v").try_cast("double").alias("value"))


def _order(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def write_flow_index(df: DataFrame, path: str, key: str = "flow_id") -> None:
    """The rows of an index of flows, sorted by a key that must be there and distinct in every row; an existing table is refused."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][0]} stands in {bad[0].n} rows")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def write_features(df: DataFrame, path: str, partition: str | None = None) -> None:
    """As Parquet; an existing table is refused."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that df has and no others; readers see the old files until the job commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table at path: a version is written to a folder of its own, then the file CURRENT is switched to name it
    in one rename. Readers that began before keep the old version; a write that fails leaves it in place."""
    sc = df.sparkSession.sparkContext
    version = f"version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    new, current = (sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"{version}.current", "CURRENT"))
    out = new.getFileSystem(sc._jsc.hadoopConfiguration()).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(new, current, over)


def _current(spark: SparkSession, path: str) -> str:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of the table at path that is current now."""
    return spark.read.parquet(f"{path}/{_current(spark, path)}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the current one, for when no reader of theirs is left; the number deleted."""
    sc, kept = spark.sparkContext, _current(spark, path)
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(sc._jsc.hadoopConfiguration())
    old = [f.getPath() for f in system.listStatus(root) if f.getPath().getName() not in (kept, "CURRENT", ".CURRENT.crc")]
    for p in old:
        system.delete(p, True)
    return sum(p.getName().startswith("version-") and not p.getName().endswith(".current") for p in old)


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def file_digests(spark: SparkSession, path: str, glob: str = "*", most: int = LARGE) -> DataFrame:
    """file, bytes and sha256 of every file that isn't empty (Spark's readers skip empty ones). One above most bytes is read
    as a stream, 1 MB at a time."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                h = hashlib.sha256()
                with opened(name) as f:
                    while part := f.read(1 << 20):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "length", "sha256"])

    f = _listed(spark, path, glob)
    small = f.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = f.select("path", "length").where(F.col("length") > most).repartition("path").mapInArrow(digest, "path string, length long, sha256 string")
    return small.unionByName(large).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), "sha256")


def tree_digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """file, bytes, chunks and tree_sha256: the digest of the joined hexadecimal digests of a file's chunks of so many bytes.

    Chunks are read side by side, by ranges, so the time for one large file falls with the tasks. Empty files are left out."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, left = hashlib.sha256(), chunk
                with opened(name) as f:
                    f.seek(k * chunk)
                    while left and (part := f.read(min(left, 1 << 20))):
                        h.update(part)
                        left -= len(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["path", "length", "k", "sha256"])

    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk))
    f = _listed(spark, path, glob).select("path", "length")
    each = f.withColumn("k", F.explode(chunks)).repartition("path", "k").mapInArrow(digest, "path string, length long, k long, sha256 string")
    out = each.groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("k", "sha256")))["sha256"].alias("d"))
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.size("d").cast("long").alias("chunks"), F.sha2(F.array_join("d", ""), 256).alias("tree_sha256"))


def limit_rows_read(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


#: Named datasets: functions from (spark, path) to a DataFrame.
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "packets": read_packet_csv, "packets_zip": read_packet_zip, "flow_arrays": read_flow_arrays, "flow_lists": read_flow_json_lists, "tree": read_directory_tree, "series": read_series_csv, "anomaly": read_anomaly_series, "samples": read_labeled_samples,
}


def dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dataset of the registry by name."""
    if name not in DATASETS:
        raise KeyError(f"no dataset named {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, path)


