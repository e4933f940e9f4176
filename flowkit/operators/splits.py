"""Train and validation splits: quotas, groups, folds, scaling and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions.scalar import hash64
from flowkit.operators.components import checkpoint, release

#: Groups of a class up to which all its subsets are weighed at once, and groups that a round adds to a larger class.
MASK_GROUPS, ROUND_GROUPS = 16, 8


def quotas(counts: DataFrame, frac: float, label: str = "label") -> DataFrame:
    """label, n, quota: ceil(frac * all) rows shared by largest remainder; ties go to the lesser label."""
    everything = Window.partitionBy()
    total = F.ceil(F.round(F.sum("n").over(everything) * frac, 9))
    exact = total * F.col("n") / F.sum("n").over(everything)
    q = counts.withColumns({"base": F.floor(exact), "rest": exact - F.floor(exact), "total": total})
    q = q.withColumn("missing", F.col("total") - F.sum("base").over(everything))
    place = F.row_number().over(Window.orderBy(F.round("rest", 9).desc(), label))
    return q.withColumn("quota", F.col("base") + (place <= F.col("missing")).cast("long")).select(label, "n", "quota")


def _ranked(df: DataFrame, id_column: str, label: str, seed: int) -> DataFrame:
    """Adds nth, a pseudorandom place in the class. Classes of any size: places are counted by hash buckets first."""
    h = hash64(seed, F.col(id_column))
    df = df.withColumns({"__h": h, "__bucket": F.shiftrightunsigned(h, 52)})
    sizes = df.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(label, "__bucket", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy("__h", id_column))
    return df.withColumn("__in", inside).join(sizes, [label, "__bucket"]).withColumn("nth", F.col("__before") + F.col("__in")).drop("__h", "__bucket", "__in", "__before")


def stratified_holdout(df: DataFrame, id_column: str, label: str, frac: float, seed: int) -> DataFrame:
    """df with side (train or val): exact quotas by class, members by hash."""
    q = quotas(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), frac, label).select(label, "quota")
    rows = _ranked(df, id_column, label, seed).join(q, label)
    return rows.withColumn("side", F.when(F.col("nth") <= F.col("quota"), "val").otherwise("train")).drop("nth", "quota")


def capture_holdout(flows: DataFrame, capture: str, label: str, frac: float, seed: int) -> DataFrame:
    """Whole captures to one side, stratified by label; flows take the side of their capture."""
    captures = flows.select(capture, label).dropDuplicates([capture])
    sides = stratified_holdout(captures, capture, label, frac, seed).select(capture, "side")
    return flows.join(sides, capture)


def grouped_exhaustive_split(groups: DataFrame, target: float = 0.2, min_val: int = 20, min_train: int = 50, pinned: str | None = None, mask_groups: int = MASK_GROUPS) -> DataFrame:
    """From (label, group, n): label, groups (those for validation), share and relaxed.

    All subsets of a class's groups count. The share closest to target wins, then fewer groups, then the first by name. At
    least min_train rows stay for training; min_val is given up where nothing meets it. Groups whose pinned column is true
    stay in training. A class without a possible subset has nulls.

    Classes of up to mask_groups free groups try all subsets as bit masks. For larger ones, of any number of groups, a
    table holds each sum of rows that some subset reaches with the best subset for it, and grows by ROUND_GROUPS groups a
    round: it has no more rows than the class.
    """
    free = ~F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(True)
    item = F.struct("group", "n")
    c = groups.groupBy("label").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.when(free, item))).alias("free"), F.count(F.lit(1)).alias("all"))
    few = _mask_sums(c.where(F.size("free") <= mask_groups), "free")
    sums = few.select("label", "total", "all", F.size("free").alias("k"), "v", "names")
    most = c.where(F.size("free") > mask_groups).agg(F.max(F.size("free")).alias("k")).first().k
    if most is not None:
        sums = sums.unionByName(_table_sums(c.where(F.size("free") > mask_groups), most, min_train))
    whole = (F.size("names") == F.col("k")) & (F.col("k") == F.col("all"))
    fits = ~whole & (F.col("total") - F.col("v") >= min_train) & (F.col("v") >= 1)
    rank = F.struct(F.round(F.abs(F.col("v") / F.col("total") - target), 12), F.size("names"), "names")
    found = F.struct(F.col("names").alias("groups"), (F.col("v") / F.col("total")).alias("share"))
    strict = F.min_by(F.when(fits & (F.col("v") >= min_val), found), F.when(fits & (F.col("v") >= min_val), rank))
    loose = F.min_by(F.when(fits, found), F.when(fits, rank))
    out = sums.groupBy("label").agg(strict.alias("a"), loose.alias("b"))
    pick = F.coalesce("a", "b")
    return out.select("label", pick["groups"].alias("groups"), pick["share"].alias("share"), F.col("a").isNull().alias("relaxed"))


def _mask_sums(c: DataFrame, items: str) -> DataFrame:
    """A row for each non-empty subset of the array items (one row without a subset if it is empty): names and v, its rows."""
    k = F.size(items)
    c = c.withColumn("mask", F.explode_outer(F.when(k > 0, F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), k) - 1))))
    chosen = F.filter(items, lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1)
    c = c.withColumn("chosen", chosen)
    return c.withColumns({"v": F.aggregate("chosen", F.lit(0).cast("long"), lambda a, x: a + x["n"]), "names": F.transform("chosen", lambda x: x["group"])})


def _table_sums(c: DataFrame, most: int, min_train: int) -> DataFrame:
    """label, total, all, k, v and names: for each sum v that some subset reaches, the one of fewest groups, first by name.

    Groups go in by name, so of subsets with equal sums and sizes the first so far stays first with whatever follows."""
    c = checkpoint(c)
    state = c.select("label", F.lit(0).cast("long").alias("v"), F.array().cast("array<string>").alias("names"))
    for at in range(0, most, ROUND_GROUPS):
        part = c.select("label", (F.col("total") - min_train).alias("__most"), F.slice("free", at + 1, ROUND_GROUPS).alias("__items"))
        part = _mask_sums(part.where(F.size("__items") > 0), "__items").groupBy("label", "__most", F.col("v").alias("__v"))
        part = part.agg(F.min(F.struct(F.size("names").alias("n"), F.col("names").cast("array<string>").alias("names")))["names"].alias("__names"))
        part = part.select(F.col("label").alias("__label"), "__most", "__v", "__names")
        added = state.join(part, F.col("label").eqNullSafe(F.col("__label"))).where(F.col("v") + F.col("__v") <= F.col("__most"))
        added = added.select("label", (F.col("v") + F.col("__v")).alias("v"), F.concat("names", "__names").alias("names"))
        best = F.min(F.struct(F.size("names").alias("n"), "names"))["names"].alias("names")
        before, state = state, checkpoint(state.unionByName(added).groupBy("label", "v").agg(best))
        if at:
            release(before)
    all_ = c.select(F.col("label").alias("__label"), "total", "all", F.size("free").alias("k"))
    return state.join(all_, F.col("label").eqNullSafe(F.col("__label"))).select("label", "total", "all", "k", "v", "names")


def matched_control_split(df: DataFrame, id_column: str, label: str, counts: DataFrame, seed: int, pinned: str | None = None) -> DataFrame:
    """Random rows of each class, as many as counts (label, n_val) says; pinned rows stay in training."""
    free = df if pinned is None else df.where(~F.coalesce(F.col(pinned), F.lit(False)))
    chosen = _ranked(free.select(id_column, label), id_column, label, seed).join(counts.select(label, "n_val"), label).where(F.col("nth") <= F.col("n_val"))
    val = chosen.select(id_column).withColumn("side", F.lit("val"))
    return df.join(val, id_column, "left").withColumn("side", F.coalesce("side", F.lit("train")))


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """df with fold: whole groups, dealt in a snake by size within their most common class."""
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("main"), F.sum("n").alias("size"))
    place = F.row_number().over(Window.partitionBy("main").orderBy(F.col("size").desc(), hash64(seed, F.col(group)), group)) - 1
    turn = F.pmod(place, F.lit(2 * k))
    return df.join(main.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).alias("fold")), group)


def pick_fold(folds: DataFrame, label: str, k: int) -> DataFrame:
    """fold and deviation: the fold whose class shares are nearest to 1/k in the worst class."""
    per = folds.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(label))
    worst = per.withColumn("dev", F.abs(share - 1.0 / k)).groupBy("fold").agg(F.max("dev").alias("dev"))
    return worst.agg(F.min_by("fold", F.struct("dev", "fold")).alias("fold"), F.min("dev").alias("deviation"))


def split_audit(split: DataFrame, rows: DataFrame, row: str, group: str, label: str) -> DataFrame:
    """name, failures and verdict: every row on one side, no group on both, every class on both."""
    j = rows.select(row, group, label).join(split.select(row, "side"), row, "full")
    covered = j.agg(F.count_if(F.col("side").isNull() | F.col(label).isNull()).alias("c"))
    twice = split.groupBy(row).agg(F.count_distinct("side").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    straddle = j.groupBy(group).agg(F.count_distinct("side").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    classes = j.where(F.col(label).isNotNull()).groupBy(label).agg(F.count_distinct("side").alias("n")).agg(F.count_if(F.col("n") < 2).alias("c"))
    checks = {"coverage": covered, "overlap": twice, "straddling": straddle, "both_sides": classes}
    out = None
    for name, c in checks.items():
        one = c.select(F.lit(name).alias("name"), F.col("c").alias("failures"), F.when(F.col("c") == 0, "PASS").otherwise("FAIL").alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


def split_registry_load(record: DataFrame, rows: DataFrame, row: str, label: str, expected: str) -> DataFrame:
    """rows with the side of a frozen split; a fingerprint of the labels other than the expected one raises an error."""
    from flowkit.operators.groups import label_fingerprint

    now = label_fingerprint(rows, row, label)
    ok = F.assert_true(F.col("fingerprint") == expected, F.lit("the labels are not those of the split")).isNull()
    return rows.join(record.select(row, "side"), row).join(F.broadcast(now.where(ok).select(F.col("rows").alias("__rows")))).drop("__rows")  # one row


def undersample_balance(df: DataFrame, id_column: str, label: str, seed: int) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__least"))
    return _ranked(df, id_column, label, seed).join(F.broadcast(least)).where(F.col("nth") <= F.col("__least")).drop("nth", "__least")  # one row


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Adds code: the place of the label among the sorted distinct ones, from 0."""
    codes = df.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(codes, label)


def class_counts(df: DataFrame, label: str, side: str, capture: str) -> DataFrame:
    """Rows and distinct captures of each class on each side."""
    return df.groupBy(label).pivot(side, ["train", "val"]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(capture).alias("captures")).na.fill(0)


def class_weights(df: DataFrame, label: str, method: str = "balanced") -> DataFrame:
    """label, n, weight: n_all / (classes * n), or 1 / n for inverse."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    w = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")) if method == "balanced" else 1 / F.col("n")
    return c.withColumn("weight", w)


def scaler(train: DataFrame, key: list[str], value: str) -> DataFrame:
    """mean and deviation (population) per feature; a deviation below 1e-8 counts as 1."""
    s = train.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))
    return s.withColumn("dev", F.when(F.col("dev") < 1e-8, 1.0).otherwise(F.col("dev")))


def standardize(rows: DataFrame, fitted: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.join(fitted, key).withColumn(value, (F.col(value) - F.col("mean")) / F.col("dev")).drop("mean", "dev")


def inverse_standardize(rows: DataFrame, fitted: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.join(fitted, key).withColumn(value, F.col(value) * F.col("dev") + F.col("mean")).drop("mean", "dev")


def normalise(df: DataFrame, value: str, method: str, sample: str | None = None) -> DataFrame:
    """standardization or minmax, over all rows or per sample; a small number keeps flat samples finite."""
    if sample is None:
        stats = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        df = df.join(F.broadcast(stats))  # one row
    else:
        w = Window.partitionBy(sample)
        df = df.withColumns({"m": F.avg(value).over(w), "s": F.stddev_samp(value).over(w), "lo": F.min(value).over(w), "hi": F.max(value).over(w)})
    eps = 2.220446049250313e-16
    out = (F.col(value) - F.col("m")) / (F.col("s") + eps) if method == "standardization" else (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)
    return df.withColumn(value, out).drop("m", "s", "lo", "hi")


def chronological_split(df: DataFrame, order: str, borders: tuple[int, int], look_back: int, series: str | None = None) -> DataFrame:
    """Rows with part: train up to the first border, then val and test, each reaching look_back steps back.

    borders are numbers of rows; a row in the look-back of the next part occurs once for each part.
    """
    w = Window.partitionBy(*([series] if series else [])).orderBy(order)
    n = F.row_number().over(w) - 1
    a, b = borders
    parts = F.array_compact(F.array(F.when(F.col("__n") < a, "train"), F.when((F.col("__n") >= a - look_back) & (F.col("__n") < b), "val"), F.when(F.col("__n") >= b - look_back, "test")))
    return df.withColumn("__n", n).withColumn("part", F.explode(parts)).drop("__n")


def subsample_long(df: DataFrame, sample: str, step: str, limit: int = 256, factor: int = 2) -> DataFrame:
    """Every factor-th step of samples that are longer than limit."""
    length = F.count(F.lit(1)).over(Window.partitionBy(sample))
    return df.withColumn("__len", length).where((F.col("__len") <= limit) | (F.col(step) % factor == 0)).drop("__len")


def experiment_grid(spark, axes: dict[str, list], results: DataFrame) -> DataFrame:
    """Every combination of the axes with its result: status OK, or PENDING where there is none.

    The axes are short lists that a person writes down.
    """
    grid = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.join(F.broadcast(one))
    out = grid.join(results.withColumn("__found", F.lit(True)), list(axes), "left")
    return out.withColumn("status", F.when(F.col("__found"), "OK").otherwise("PENDING")).drop("__found")


def pending_work(grid: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return grid.join(done.select(*key), key, "left_anti")


def map_split_to_order(split: DataFrame, a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The side of each row of b that is the same physical row as one of a; split addresses rows of a by row."""
    return split.join(a.select("row", *key), "row").select(*key, "side").join(b.select(F.col("row").alias("row_b"), *key), key).select("row_b", "side")


def side_complement(every: DataFrame, val: DataFrame, row: str) -> DataFrame:
    return every.join(val.select(row), row, "left_anti")


