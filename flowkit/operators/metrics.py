"""Evaluation of predictions, forecasts, anomaly scores and run ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators.components import before_in_range, checkpoint


def confusion_matrix(preds: DataFrame, classes: int) -> DataFrame:
    """y_true, y_pred, n and percent of the truth class, for all classes 0 .. classes-1."""
    n = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    one = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = preds.sparkSession.range(1).select(F.explode(one).alias("y_true")).select("y_true", F.explode(one).alias("y_pred"))
    out = grid.join(n, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    return out.withColumn("percent", scalar.safe_div(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy("y_true"))))


def classification_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support by class and for macro avg, weighted avg and accuracy; 0 where undefined."""
    cells = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"))
    both = both.unionByName(cells.select(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))
    c = both.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "said")])
    p, r = scalar.safe_div(F.col("tp"), F.col("said")), scalar.safe_div(F.col("tp"), F.col("support"))
    c = c.withColumns({"precision": p, "recall": r, "f1": scalar.safe_div(2 * p * r, p + r)})
    names = ("precision", "recall", "f1")
    by_class = c.select(F.col("label").cast("string").alias("label"), *names, "support")
    macro = c.agg(F.lit("macro avg").alias("label"), *[F.avg(x).alias(x) for x in names], F.sum("support").alias("support"))
    weighted = c.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in names], F.sum("support").alias("support"))
    accuracy = c.agg(F.lit("accuracy").alias("label"), *[(F.sum("tp") / F.sum("support")).alias(x) for x in names], F.sum("support").alias("support"))
    return by_class.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def forecast_errors(pairs: DataFrame) -> DataFrame:
    """MAE, MSE, RMSE, MAPE and MSPE over rows (pred, truth)."""
    e, q = F.col("pred") - F.col("truth"), (F.col("pred") - F.col("truth")) / F.col("truth")
    return pairs.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(q)).alias("mape"), F.avg(q * q).alias("mspe"))


def rse_corr(pairs: DataFrame, channel: str) -> DataFrame:
    """Root relative squared error over all cells; correlation by channel with its denominator sqrt(sum of products of
    squares), averaged."""
    overall = pairs.agg(F.avg("truth").alias("m"))
    e, d = F.col("truth") - F.col("pred"), F.col("truth") - F.col("m")
    rse = pairs.join(F.broadcast(overall)).agg((F.sqrt(F.sum(e * e)) / F.sqrt(F.sum(d * d))).alias("rse"))
    means = pairs.groupBy(channel).agg(F.avg("truth").alias("mt"), F.avg("pred").alias("mp"))
    t, p = F.col("truth") - F.col("mt"), F.col("pred") - F.col("mp")
    corr = pairs.join(means, channel).groupBy(channel).agg((F.sum(t * p) / F.sqrt(F.sum(t * t * p * p))).alias("c")).agg(F.avg("c").alias("corr"))
    return rse.join(F.broadcast(corr))  # one row each


def masked_errors(pairs: DataFrame, mask: str = "mask") -> DataFrame:
    """Errors of the cells that were masked out (mask 0)."""
    return forecast_errors(pairs.where(F.col(mask) == 0))


def m4_scores(forecast: DataFrame, insample: DataFrame, frequency: int) -> DataFrame:
    """series, smape, mape and mase from forecast (series, step, pred, truth) and insample (series, step, value)."""
    a = F.abs(F.col("truth")) + F.abs(F.col("pred"))
    e = F.abs(F.col("pred") - F.col("truth"))
    s = forecast.groupBy("series").agg(F.avg(200 * e / F.when(a == 0, 1.0).otherwise(a)).alias("smape"), F.avg(100 * e / F.when(F.col("truth") == 0, 1.0).otherwise(F.abs("truth"))).alias("mape"), F.avg(e).alias("mae"))
    lag = F.lag("value", frequency).over(Window.partitionBy("series").orderBy("step"))
    naive = insample.withColumn("d", F.abs(F.col("value") - lag)).groupBy("series").agg(F.avg("d").alias("naive"))
    return s.join(naive, "series").select("series", "smape", "mape", scalar.safe_div(F.col("mae"), F.col("naive")).alias("mase"))


def m4_owa_summary(scores: DataFrame, naive: DataFrame) -> DataFrame:
    """group, n, smape, mase and owa; scores and naive have (series, group, smape, mase).

    Groups other than Yearly, Quarterly and Monthly are summed up as Others; Average is over all series.
    """
    main = F.when(F.col("group").isin("Yearly", "Quarterly", "Monthly"), F.col("group")).otherwise("Others")
    j = scores.join(naive.select("series", F.col("smape").alias("n_smape"), F.col("mase").alias("n_mase")), "series").withColumn("group", F.explode(F.array(main, F.lit("Average"))))
    g = j.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("smape", "mase", "n_smape", "n_mase")])
    owa = (scalar.safe_div(F.col("smape"), F.col("n_smape")) + scalar.safe_div(F.col("mase"), F.col("n_mase"))) / 2
    return g.select("group", "n", "smape", "mase", owa.alias("owa"))


def masked_losses(pairs: DataFrame, frequency_scale: str = "scale") -> DataFrame:
    """MAPE, sMAPE and MASE with mask weights; divisions by zero count as 0. pairs: pred, truth, mask, scale."""
    e = F.abs(F.col("pred") - F.col("truth"))
    w = scalar.safe_div(F.col("mask"), F.col("truth"))
    s = scalar.safe_div(e, F.abs("pred") + F.abs("truth")) * F.col("mask")
    m = e * scalar.safe_div(F.col("mask"), F.col(frequency_scale))
    return pairs.agg(F.avg(F.abs((F.col("pred") - F.col("truth")) * w)).alias("mape"), (200 * F.avg(s)).alias("smape"), F.avg(m).alias("mase"))


def exact_percentiles(df: DataFrame, value: str, places: dict[str, float], *keys: str) -> DataFrame:
    """Exact percentiles by keys, linear between neighbours, nulls left out; without keys always one row.

    Equal values are counted first; ranges of the distinct ones are dealt over tasks, and only their counts meet.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    d = checkpoint(d.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    d = d.withColumn("__to", F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v")))
    sizes = before_in_range(d, F.col("__n"), *keys).withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("__part", "__p")
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    d = d.join(sizes, on).withColumn("__to", F.col("__to") + F.col("__before"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__to") - F.col("__n") <= place) & (place < F.col("__to")), F.col("__v").cast("double")))

    rank = {k: p * (F.col("__total") - 1) for k, p in places.items()}
    low, high = ({k: at(f(x)) for k, x in rank.items()} for f in (F.floor, F.ceil))
    part = {k: F.max(x - F.floor(x)) for k, x in rank.items()}
    return d.groupBy(*keys).agg(*[F.when(low[k] == high[k], low[k]).otherwise((1 - part[k]) * low[k] + part[k] * high[k]).alias(k) for k in places])


def latency_summary(samples: DataFrame, key: str, value: str, batch: str) -> DataFrame:
    """Mean, deviation and exact percentiles of latency in ms, per item, and items a second."""
    out = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"), F.stddev_samp(value).alias("std_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        (F.avg(value) / F.max(batch)).alias("per_item_ms"), (1000 * F.max(batch) / F.avg(value)).alias("items_per_s"),
    )
    q = exact_percentiles(samples, value, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, key).withColumnRenamed(key, "__key")
    out = out.join(q, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, "n", "mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms", "per_item_ms", "items_per_s")


def capture_mean_probability(preds: DataFrame, capture: str = "capture_id") -> DataFrame:
    """capture, y_true and y_pred: the class with the highest mean probability; ties go to the lesser class."""
    p = preds.select(capture, "y_true", F.posexplode("probs").alias("class", "p"))
    m = p.groupBy(capture, "class").agg(F.avg("p").alias("p"), F.max("y_true").alias("y_true"))
    return m.groupBy(capture).agg(F.max("y_true").alias("y_true"), F.max_by("class", F.struct(F.round("p", 12), -F.col("class"))).alias("y_pred"))


def capture_vote(preds: DataFrame, capture: str = "capture_id") -> DataFrame:
    """capture, y_true and y_pred: the class that most flows have; ties go to the lesser class."""
    m = preds.groupBy(capture, "y_pred").agg(F.count(F.lit(1)).alias("n"), F.max("y_true").alias("y_true"))
    return m.groupBy(capture).agg(F.max("y_true").alias("y_true"), F.max_by("y_pred", F.struct(F.col("n"), -F.col("y_pred"))).alias("y_pred"))


def status_summary(ledger: DataFrame) -> DataFrame:
    """status, runs and how many of them have no readable accuracy."""
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.count_if(scalar.parse_percent(F.col("val_acc")).isNull()).alias("unreadable"))


def seed_statistics(ledger: DataFrame, key: list[str], value: str) -> DataFrame:
    return ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def best_window_per_model(ledger: DataFrame, value: str) -> DataFrame:
    """The window with the best value of each model; ties go to the smaller window."""
    return ledger.groupBy("model").agg(F.max_by("window", F.struct(F.col(value), -F.col("window"))).alias("window"), F.max(value).alias(value))


def anomaly_threshold(energy: DataFrame, value: str, ratio: float) -> DataFrame:
    """One row, threshold: the exact percentile 100 - ratio."""
    return exact_percentiles(energy, value, {"threshold": (100 - ratio) / 100})


def point_adjust(scored: DataFrame, series: str, order: str) -> DataFrame:
    """scored (gt, pred as 0 or 1) with adjusted: all of a truth segment from its first place but place 0 of the series, if
    any point of it is predicted. Place 0 keeps its own prediction."""
    w = Window.partitionBy(series).orderBy(order)
    change = F.coalesce((F.col("gt") != F.lag("gt").over(w)).cast("int"), F.lit(0))
    d = scored.withColumns({"__change": change, "__place": F.row_number().over(w)})
    d = d.withColumn("__run", F.sum("__change").over(w))
    hit = F.max("pred").over(Window.partitionBy(series, "__run"))
    full = (F.col("gt") == 1) & (F.col("__place") > 1)
    return d.withColumn("adjusted", F.when(full, hit).otherwise(F.col("pred"))).drop("__change", "__place", "__run")


def reconstruction_energy(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.groupBy(*key).agg(F.avg((F.col("x") - F.col("x_hat")) ** 2).alias("energy"))


def anomaly_report(scored: DataFrame, series: str, order: str, value: str, ratio: float) -> DataFrame:
    """Threshold, then point adjustment, then accuracy, precision, recall and F1 of the anomalous class."""
    t = anomaly_threshold(scored, value, ratio)
    d = scored.join(F.broadcast(t)).withColumn("pred", (F.col(value) > F.col("threshold")).cast("int"))  # one row
    d = point_adjust(d, series, order)
    tp, fp, fn = (F.count_if((F.col("adjusted") == a) & (F.col("gt") == b)) for a, b in ((1, 1), (1, 0), (0, 1)))
    c = d.agg(F.max("threshold").alias("threshold"), F.avg((F.col("adjusted") == F.col("gt")).cast("int")).alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = scalar.safe_div(F.col("tp"), F.col("tp") + F.col("fp")), scalar.safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("threshold", "accuracy", p.alias("precision"), r.alias("recall"), scalar.safe_div(2 * p * r, p + r).alias("f1"))
