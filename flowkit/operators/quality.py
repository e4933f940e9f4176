"""Audits of packets, slots and tables: zero shares, precision, boundaries, comparisons and check tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators.flows import KEY


def zero_ratio(slots: DataFrame, n_slots: int, w_seconds: float, numbers: tuple[int, ...] = tuple(range(8)), key: tuple[str, ...] = KEY) -> DataFrame:
    """Share of exact zeros, slots that are all zero, least and greatest value over the full grid.

    slots holds only the slots with packets; absent ones are counted, not made. Their time axis is zero in slot 0 alone.
    """
    own = F.aggregate(F.array(*[(F.col(f"f{k}") == 0).cast("long") for k in numbers]), F.lit(0).cast("long"), lambda a, x: a + x)
    flows = slots.groupBy(*key).agg(F.count(F.lit(1)).alias("present"), F.sum(own).alias("zeros"), F.count_if(own == len(numbers)).alias("empty"), F.min(F.least(*[F.col(f"f{k}") for k in numbers], F.lit(float("inf")))).alias("lo"), F.max(F.greatest(*[F.col(f"f{k}") for k in numbers], F.lit(float("-inf")))).alias("hi"), F.max((F.col("slot") == 0).cast("int")).alias("first"))
    absent = n_slots - F.col("present")
    timed = 7 in numbers
    zeros = F.col("zeros") + absent * (len(numbers) - int(timed)) + (F.lit(0) if not timed else 1 - F.col("first"))
    empty = F.col("empty") + (absent if not timed else 1 - F.col("first"))
    return flows.agg(
        F.count(F.lit(1)).alias("flows"), (F.sum(zeros) / (F.count(F.lit(1)) * n_slots * len(numbers))).alias("zero_ratio"), F.sum(empty).alias("all_zero_slots"),
        F.least(F.min("lo"), F.min(F.when(absent > 0, 0.0))).alias("min"), F.greatest(F.max("hi"), F.lit((n_slots - 1) * w_seconds if timed else None)).alias("max"),
    )


def nonempty_slots(slots: DataFrame, n_slots: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Mean number and percentage of slots with packets per flow."""
    per = slots.groupBy(*key).agg(F.count_if(F.col("f1") + F.col("f4") > 0).alias("n"))
    return per.agg(F.avg("n").alias("mean_slots"), (F.avg("n") * 100 / n_slots).alias("percent"))


def zero_ratio_pivot(table: DataFrame, durations: list[int]) -> DataFrame:
    """window by duration; the durations are named, so that Spark need not look for them."""
    return table.groupBy("window").pivot("duration", durations).agg(F.first("zero_ratio"))


def sum_per_sample(slots: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    total = F.col("f0") + F.col("f1") + F.col("f2") + F.col("f3") + F.col("f4") + F.col("f5") + F.col("f6") + F.col("f7")
    return slots.groupBy(*key).agg(F.sum(total).alias("total"), (F.sum(total) / F.count(F.lit(1))).alias("mean"))


def quality_profile(slots: DataFrame, numbers: tuple[int, ...] = tuple(range(8))) -> DataFrame:
    """NaN, infinite and negative cells, rows and nulls."""
    cells = [F.col(f"f{k}") for k in numbers]
    total = lambda p: sum((F.sum(F.coalesce(p(c), F.lit(False)).cast("long")) for c in cells[1:]), F.sum(F.coalesce(p(cells[0]), F.lit(False)).cast("long")))
    return slots.agg(F.count(F.lit(1)).alias("rows"), total(F.isnan).alias("nan"), total(lambda c: F.abs(c) == float("inf")).alias("inf"), total(lambda c: c < 0).alias("negative"), total(F.isnull).alias("missing"))


def slot_mismatch_audit(packets: DataFrame, widths_ms: list[int], horizon_ms: int) -> DataFrame:
    """For each width the packets that a float computation puts in another slot."""
    p = packets.withColumn("w_ms", F.explode(F.array(*[F.lit(w).cast("long") for w in widths_ms])))
    slots = scalar.num_slots(F.lit(horizon_ms).cast("long"), F.col("w_ms"))
    exact = scalar.slot_exact(F.col("elapsed_ns"), F.col("w_ms") * 1_000_000, slots)
    naive = F.least(scalar.slot_naive_division(F.col("elapsed_ns"), F.col("w_ms")), slots - 1)
    return p.groupBy("w_ms").agg(F.count(F.lit(1)).alias("packets"), F.count_if(exact != naive).alias("misplaced"))


def boundary_adjacency(packets: DataFrame, w_ns: int) -> DataFrame:
    """Packets on a slot boundary and a microsecond below and above one."""
    r = F.pmod(F.col("elapsed_ns"), F.lit(w_ns).cast("long"))
    return packets.agg(F.count_if(r == 0).alias("exactly"), F.count_if(r == w_ns - 1000).alias("below"), F.count_if(r == 1000).alias("above"))


def window_invariance(multi: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Flows whose packets or payload differ between widths: none, if slots lose nothing."""
    per = multi.groupBy(*key, "w_ns").agg(F.sum(F.col("f1") + F.col("f4")).alias("packets"), F.sum(F.col("f0") + F.col("f3")).alias("payload"))
    per = per.groupBy(*key).agg(F.count_distinct("packets").alias("p"), F.count_distinct("payload").alias("q"), F.max("packets").alias("packets"), F.max("payload").alias("payload"))
    return per.agg(F.count(F.lit(1)).alias("flows"), F.count_if((F.col("p") > 1) | (F.col("q") > 1)).alias("varying"), F.sum("packets").alias("packets"), F.sum("payload").alias("payload"))


def timestamp_precision_profile(raw: DataFrame, column: str = "frame_time") -> DataFrame:
    """Rows by number of fractional digits, with the finest place in use and rows that use more than microseconds."""
    p = scalar.timestamp_precision(F.col(column))
    return raw.select(*[c.alias(n) for n, c in p.items()]).groupBy("digits").agg(F.count(F.lit(1)).alias("rows"), F.max("finest").alias("finest"), F.count_if("sub_us").alias("sub_us"))


def check_table(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """name, failures and verdict (PASS or FAIL) for each predicate that all rows should meet; null counts as failure."""
    counts = [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"c{k}") for k, p in enumerate(checks.values())]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{k}").alias("failures"), F.when(F.col(f"c{k}") == 0, "PASS").otherwise("FAIL").alias("verdict")) for k, n in enumerate(checks)])
    return df.agg(*counts).select(F.inline(rows))


def compare_implementations(a: DataFrame, b: DataFrame, key: list[str], exact: list[str], tolerant: dict[str, float]) -> DataFrame:
    """One row: rows on one side only, mismatches of exact columns, and of others the greatest difference and its excess."""
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in [*key, *exact, *tolerant]], F.lit(True).alias("in_b"))
    on = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"b_{c}"))
        on = same if on is None else on & same
    j = a.select(*key, *exact, *tolerant, F.lit(True).alias("in_a")).join(b, on, "full")
    both = F.col("in_a") & F.col("in_b")
    aggs = [F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(both).alias("common")]
    aggs += [F.count_if(both & ~F.col(c).eqNullSafe(F.col(f"b_{c}"))).alias(f"{c}_differs") for c in exact]
    for c, most in tolerant.items():
        d = F.abs(F.col(c) - F.col(f"b_{c}"))
        aggs += [F.coalesce(F.max(d), F.lit(0.0)).alias(f"{c}_max_diff"), F.count_if(d > most).alias(f"{c}_beyond")]
    return j.agg(*aggs)


def field_disagreement(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """For each column the common rows whose values differ, nulls being equal to each other."""
    j = a.select(*key, *columns).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    counts = j.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in columns])))


def common_population(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys with where they occur: both, only_a or only_b."""
    x, y = a.select(*key).distinct().withColumn("in_a", F.lit(True)), b.select(*key).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, key, "full")
    return j.select(*key, F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both").alias("where"))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether the rows agree as a multiset, by counts of both sides in one aggregation."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__d")).unionByName(b.select(*cols, F.lit(-1).alias("__d")))
    left = both.groupBy(*cols).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return left.agg(F.count_if(F.col("__d") > 0).alias("only_a"), F.count_if(F.col("__d") < 0).alias("only_b"), (F.count(F.lit(1)) == 0).alias("equal"))


def hash_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """file and status (OK, MISSING or CHANGED) of every recorded digest."""
    j = recorded.select("file", "sha256").join(current.select("file", F.col("sha256").alias("now")), "file", "left")
    return j.select("file", F.when(F.col("now").isNull(), "MISSING").when(F.col("now") != F.col("sha256"), "CHANGED").otherwise("OK").alias("status"))
