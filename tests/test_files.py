"""Row places, archives by member, digests of large files and versions of a table."""

import hashlib
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from flowkit.sources import files

HEADER = ",".join(files.PACKET_COLUMNS[:4])


def lines(n, seed):
    rng = random.Random(seed)
    return [f"{k},10.0.0.{rng.randrange(9)},{'x' * rng.randrange(40)},6" for k in range(n)]


@pytest.mark.parametrize("split", ["128m", "700b", "5k"])
def test_row_places_do_not_depend_on_splits(spark, tmp_path, split):
    for name, n in (("a_1", 400), ("b_2", 1), ("c_3", 90), ("d_4", 0)):
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *lines(n, n)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = files.list_captures(files.read_packet_csv(spark, str(tmp_path)))
        found = {}
        for r in df.collect():
            found.setdefault(r.capture_id, []).append((r.row_pos, int(r.frame_time)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {k: sorted(v) for k, v in found.items()} == {"a_1": [(k, k) for k in range(400)], "b_2": [(0, 0)], "c_3": [(k, k) for k in range(90)]}


@pytest.mark.parametrize("cost", ["0", "1500", "4m"])
def test_row_places_of_files_read_once_and_of_split_files(spark, tmp_path, cost):
    """Files up to the cost of an opening are never split and read once; larger ones are split into blocks of 1,500 bytes."""
    want = {"none": 0, **{f"f{k}": k * 7 + 1 for k in range(9)}, "large": 300}
    for name, n in want.items():
        (tmp_path / f"{name}_x.csv").write_text("\n".join([HEADER, *lines(n, n)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500" if cost != "4m" else "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        found = {}
        for r in files.list_captures(files.read_packet_csv(spark, str(tmp_path))).collect():
            found.setdefault(r.app, []).append((r.row_pos, int(r.frame_time)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {k: sorted(v) for k, v in found.items()} == {k: [(r, r) for r in range(n)] for k, n in want.items() if n}


def test_captures_are_listed_once(spark, tmp_path):
    """The header comes from one file: 40 folders take one job for the list and one for the header."""
    (tmp_path / "a_first").mkdir()
    (tmp_path / "a_first" / "_hidden.csv").write_text("other\n1\n")
    (tmp_path / "a_first" / "empty.csv").write_text("")
    for k in range(40):
        (tmp_path / f"f{k:02d}").mkdir()
        (tmp_path / f"f{k:02d}" / f"a_{k}.csv").write_text("\n".join([HEADER, *lines(3, k)]) + "\n")
    spark.sparkContext.setJobGroup("captures", "reads captures")
    try:
        df = files.read_packet_csv(spark, str(tmp_path))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("captures"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.count() == 120 and df.agg(F.sum("row_pos")).first()[0] == 120
    assert jobs == 2


def test_written_captures_are_one_file_each(spark):
    """The folder of a capture holds its file and nothing else, with its packets in order; Spark's writer adds checksum files."""
    from flowkit.plans import file_queries

    sf = "/root/testdata/sf0.001"
    at = file_queries._written_captures(spark, sf).removeprefix("file:")
    folders = sorted(os.listdir(at))
    want = {r.capture_id: r.n for r in file_queries.raw_packets(spark, sf).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert folders == sorted(f"capture_id={c}" for c in want)
    for f in folders:
        (name,) = os.listdir(f"{at}/{f}")
        with open(f"{at}/{f}/{name}") as text:
            assert len(text.read().splitlines()) == want[f.removeprefix("capture_id=")] + 1


def test_folders_and_names_of_odd_paths(spark):
    """As the patterns over whole paths give them."""
    paths = ["file:///a/b c/x_1.csv", "a//x.csv", "x_1.csv", "/x.csv", "a/b/", "a/.csv", "a/x.CSV", "a/b/x.csv.csv", "", None, "s3://k/é=ü/_y.csv", "/".join(["p" * 300] * 9) + "/q_r_s.csv"]
    df = files.list_captures(spark.createDataFrame([(p,) for p in paths], "file string"))
    whole = [F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("f"), F.regexp_extract("file", r"([^/]+)\.csv$", 1).alias("n")]
    for r in df.select("*", *whole).collect():
        assert (r.partition, r.capture_id) == (r.f, r.n)
        assert r.capture_id is None or r.app == r.capture_id.split("_")[0]


@pytest.fixture
def archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for k in range(12):
            z.writestr(f"p{k % 3}/cap_{k}.csv", "\n".join([HEADER, *lines(30 + k, k)]), zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("p0/empty.csv", HEADER + "\n")
        z.writestr("notes.txt", "not a capture")
    return tmp_path / "all.zip"


def places(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.member, []).append((r.row_pos, r.frame_time))
    return {k: sorted(v) for k, v in out.items()}


WANT = {f"p{k % 3}/cap_{k}.csv": [(n, str(n)) for n in range(30 + k)] for k in range(12)}


def test_members_of_one_archive_run_in_several_tasks(spark, archive):
    df = files.read_packet_zip(spark, str(archive))
    assert places(df) == WANT
    assert df.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert files.zip_members(spark, str(archive)).count() == 13


def test_an_archive_above_two_gigabytes(spark, archive):
    """The members lie behind 3 GB that hold nothing: a sparse file."""
    large, data = archive.parent / "large.zip", archive.read_bytes()
    with open(large, "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(data)
    assert os.path.getsize(large) > 3 << 30 and places(files.read_packet_zip(spark, str(large))) == WANT


def test_a_torn_member(spark, archive):
    data = bytearray(archive.read_bytes())
    with zipfile.ZipFile(archive) as z:
        m = z.getinfo("p1/cap_7.csv")
    at = m.header_offset + 30 + len(m.filename) + m.compress_size // 2
    data[at : at + 40] = b"\xff" * 40
    archive.write_bytes(bytes(data))
    with pytest.raises(Exception, match="cap_7.csv"):
        files.read_packet_zip(spark, str(archive)).collect()
    found = places(files.read_packet_zip(spark, str(archive), torn="keep"))
    torn = found.pop("p1/cap_7.csv")
    assert found == {k: v for k, v in WANT.items() if k != "p1/cap_7.csv"} and torn[-1][1] is None and len(torn) <= 38


def test_digests_of_large_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    contents = {"one": b"x", "edge": os.urandom(3 << 20), "more": os.urandom((3 << 20) + 5)}
    for name, data in {**contents, "none": b""}.items():
        (tmp_path / "in" / name).write_bytes(data)
    for most in (1 << 20, 256 << 20):
        found = {r.file: (r.bytes, r.sha256) for r in files.file_digests(spark, str(tmp_path / "in"), most=most).collect()}
        assert found == {k: (len(d), hashlib.sha256(d).hexdigest()) for k, d in contents.items()}
    tree = {r.file: (r.bytes, r.chunks, r.tree_sha256) for r in files.tree_digests(spark, str(tmp_path / "in"), chunk=1 << 20).collect()}
    for name, data in contents.items():
        parts = [hashlib.sha256(data[k : k + (1 << 20)]).hexdigest() for k in range(0, len(data), 1 << 20)]
        assert tree[name] == (len(data), len(parts), hashlib.sha256("".join(parts).encode()).hexdigest())


def test_a_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(3 << 30)
    h, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        h.update(zeros)
    assert [(r.bytes, r.sha256) for r in files.file_digests(spark, str(tmp_path / "sparse")).collect()] == [(3 << 30, h.hexdigest())]
    assert files.tree_digests(spark, str(tmp_path / "sparse")).first().chunks == 48


def test_versions_of_a_table(spark, tmp_path):
    at = str(tmp_path / "table")
    files.replace_table(spark.range(5), at)
    old = files.read_table(spark, at)
    files.replace_table(spark.range(7).withColumn("more", F.lit(1)), at)
    assert old.count() == 5 and files.read_table(spark, at).columns == ["id", "more"] and files.read_table(spark, at).count() == 7
    with pytest.raises(Exception, match="broken"):
        files.replace_table(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id")), at)
    assert files.read_table(spark, at).count() == 7
    assert files.drop_old_versions(spark, at) >= 1 and files.read_table(spark, at).count() == 7
    assert sorted(n for n in os.listdir(at) if not n.startswith(".")) == sorted(["CURRENT", files._current(spark, at)])


def test_flow_index(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("flow_id"), (F.col("id") * 2).alias("packets")).repartition(4)
    files.write_flow_index(df, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 50
    for bad in (df.unionByName(df.limit(1)), df.withColumn("flow_id", F.when(F.col("flow_id") > 0, F.col("flow_id")))):
        with pytest.raises(ValueError, match="flow_id"):
            files.write_flow_index(bad, str(tmp_path / "other"))
