"""Metrics of scored rows. Ranking metrics aggregate by score first, so their windows run over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranged import quantiles, running

#: The smallest step of a double at 1: probabilities are kept so far from 0 and 1.
EPSILON = 2.220446049250313e-16
Y, SCORE = "y_true", "y_score"


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def basics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n_rows, positives, positive_rate, mean_score, brier, log_loss."""
    y, p = F.col(Y).cast("double"), F.col(SCORE)
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y == 1).alias("positives"),
        F.avg(y).alias("positive_rate"),
        F.avg(p).alias("mean_score"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(q)) - (1 - y) * F.ln(1 - q)).alias("log_loss"),
    )


def at_thresholds(df: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Per threshold (score >= threshold is positive): counts, accuracy, balanced accuracy, precision, recall, F1."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    hit, y = F.col(SCORE) >= F.col("threshold"), F.col(Y) == 1
    counts = df.select(*by, Y, SCORE, t).groupBy(*by, "threshold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n, precision, recall = tp + fp + tn + fn, _share(tp, tp + fp), _share(tp, tp + fn)
    # balanced: the mean over the classes that there are
    balanced = F.when(tp + fn == 0, _share(tn, tn + fp)).when(tn + fp == 0, recall).otherwise((recall + _share(tn, tn + fp)) / 2)
    return counts.select(*by, "threshold", tp, fp, tn, fn, _share(tp + tn, n).alias("accuracy"), balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), _share(tp + fp, n).alias("predicted_positive_rate"))


def _by_score(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by, SCORE).agg(F.count_if(F.col(Y) == 1).alias("p"), F.count_if(F.col(Y) != 1).alias("n"))


def ranking(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """roc_auc (ties count half) and average_precision (by steps), null where a class is missing. Counts of distinct scores are added
    up by ranges of the score, so any number of them will do."""
    ran = running(_by_score(df, by), SCORE, ("p", "n"), by, descending=True)
    named = {"upto_p": "cp", "upto_n": "cn", "all_p": "all_p", "all_n": "all_n"}
    return _ranked(ran.select(*by, "p", "n", *[F.col(a).alias(b) for a, b in named.items()]), by)


def _ranked(ran: DataFrame, by: tuple[str, ...]) -> DataFrame:
    below = F.col("all_n") - F.col("cn")
    area = F.sum(F.col("p") * (below + F.col("n") / 2))
    steps = F.sum(F.col("p") * F.try_divide(F.col("cp").cast("double"), F.col("cp") + F.col("cn")))
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    return ran.groupBy(*by).agg(
        F.when(both, F.try_divide(area, F.max("all_p").cast("double") * F.max("all_n"))).alias("roc_auc"),
        F.when(both, F.try_divide(steps, F.max("all_p"))).alias("average_precision"),
    )


def at_top(df: DataFrame, fractions: list[float], tie: tuple[str, ...] = ("symbol", "timestamp"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fraction, k, precision, recall) among the k = max(1, ceil(n * fraction)) best scores of each group; ties by key. Recall is null
    without positives. Fractions outside (0, 1] raise.

    The cut is found on counts by score, added up by ranges, then ties at the cut are ranked: no sort of the whole table."""
    if bad := [f for f in fractions if not 0 < f <= 1]:
        raise ValueError(f"fractions must be above 0 and at most 1: {bad}")
    ran = running(_by_score(df, by).withColumn("both", F.col("p") + F.col("n")), SCORE, ("both", "p"), by, descending=True)
    total = ran.groupBy(*by).agg(F.max("all_both").alias("rows"), F.max("all_p").alias("positives"))
    asked = total.select(*by, "rows", "positives", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    asked = asked.where("rows > 0").withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("rows") * F.col("fraction"))).cast("long"))
    placed = ran.withColumn("before", F.col("upto_both") - F.col("both"))
    # without groups the other side has a row per fraction
    met = (placed.join(asked.drop("rows"), list(by)) if by else placed.crossJoin(F.broadcast(asked.drop("rows")))).where("before < k")
    whole = met.where("upto_both <= k").groupBy(*by, "fraction").agg(F.sum("p").alias("hits"))
    cut = met.where("upto_both > k").select(*[F.col(b).alias(f"_{b}") for b in by], "fraction", F.col(SCORE).alias("_c"), (F.col("k") - F.col("before")).alias("room"))
    same = F.col(SCORE) == F.col("_c")
    for b in by:
        same = same & (F.col(b) == F.col(f"_{b}"))
    tied = df.join(cut if by else F.broadcast(cut), same).withColumn("_t", F.row_number().over(Window.partitionBy(*by, "fraction").orderBy(*tie)))
    more = tied.where("_t <= room").groupBy(*by, "fraction").agg(F.count_if(F.col(Y) == 1).alias("more"))
    out = asked.join(whole, [*by, "fraction"], "left").join(more, [*by, "fraction"], "left")
    hits = F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0))
    return out.select(*by, "fraction", "k", (hits / F.col("k")).alias("precision"), F.try_divide(hits, F.col("positives")).alias("recall"))


def grid(df: DataFrame, by: tuple[str, ...] = ("model_name", "split"), thresholds: tuple[float, ...] = (0.5,), fractions: tuple[float, ...] = (0.05, 0.1), tie: tuple[str, ...] = ("symbol", "timestamp")) -> list[dict]:
    """compute() of a binary task for every group of a table of scores: by, then the metrics as a nested mapping, in order of the groups.
    Four aggregations keyed by group, however many groups there are; a row for each of them comes back."""
    if df.isEmpty():
        raise ValueError("no rows to measure")
    key = lambda r: tuple(r[b] for b in by)
    rest = lambda r, *names: {k: v for k, v in r.asDict().items() if k not in (*by, *names)}
    out = {key(r): dict(zip(by, key(r), strict=True)) | rest(r) for r in basics(df, by).collect()}
    for r in ranking(df, by).collect():
        out[key(r)] |= rest(r)
    for name, part, rows in (("threshold_metrics", "threshold", at_thresholds(df, list(thresholds), by)), ("top_fraction_metrics", "fraction", at_top(df, list(fractions), tie, by))):
        for group in out.values():
            group[name] = {}
        for r in rows.orderBy(part).collect():
            out[key(r)][name][str(r[part])] = rest(r, part)
    return [out[k] for k in sorted(out)]


def confusion(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(label, support, predicted_rows, precision, recall, f1) for every label that occurs on either side."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_rows"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted_rows"), F.lit(0).cast("long").alias("hits")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted_rows").alias("predicted_rows"), F.sum("hits").alias("hits"))
    p, r = _share(F.col("hits"), F.col("predicted_rows")), _share(F.col("hits"), F.col("support"))
    return sums.select("label", "support", "predicted_rows", "hits", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def multiclass(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Accuracy, balanced accuracy, and macro and weighted precision, recall and F1."""
    n = F.sum("support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), n)
    return per_class(df, actual, predicted).agg(
        n.alias("n_rows"),
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def most_likely(proba: str) -> Column:
    """The class of the largest probability in a map; of equals the smallest."""
    ranked = F.transform(F.map_entries(proba), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("c")))
    return F.array_min(ranked)["c"]


def multiclass_log_loss(df: DataFrame, proba: str = "y_proba", actual: str = "y_true") -> DataFrame:
    """Mean of -ln p of the actual class; y_proba is a map from class to probability."""
    p = F.least(F.greatest(F.coalesce(F.element_at(F.col(proba), F.col(actual)), F.lit(0.0)), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg(F.avg(-F.ln(p)).alias("log_loss"))


def one_vs_rest_auc(df: DataFrame, proba: str = "y_proba", actual: str = "y_true") -> DataFrame:
    """Mean over classes of the area under each class's ROC against the others."""
    long = df.select(F.col(actual).alias("_a"), F.explode(proba).alias("label", SCORE)).withColumn(Y, (F.col("_a") == F.col("label")).cast("int"))
    return ranking(long, ("label",)).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def regression(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """MAE, MSE, RMSE, median absolute error, R2, explained variance and MAPE (null where an actual value is 0)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    mse = F.avg(e * e)
    errors = df.select(F.abs(e).alias("e"))
    middle = df.sparkSession.range(1).join(F.broadcast(quantiles(errors, "e", [0.5])), F.lit(True), "left").select(F.col("value").alias("median_ae"))  # one row each
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.when(F.count_if(y == 0) == 0, F.avg(F.try_divide(F.abs(e), F.abs(y)))).alias("mape"),
    ).crossJoin(F.broadcast(middle))


def compute(df: DataFrame, task: str, thresholds: tuple[float, ...] = (0.5,), fractions: tuple[float, ...] = (0.05, 0.1), tie: tuple[str, ...] = ("symbol", "timestamp")) -> dict:
    """Metrics of a whole table as a nested mapping, by kind of task; undefined ones are None. Binary scores come from y_score, else from
    the probability of class 1, else from the prediction. y_proba is a map from class to probability; without y_pred its largest
    (the smaller class of equals) is the prediction of several classes. An empty table raises."""
    if df.isEmpty():
        raise ValueError("no rows to measure")
    if task == "binary":
        if SCORE not in df.columns:
            other = F.try_element_at(F.col("y_proba"), F.lit(1)) if "y_proba" in df.columns else F.col("y_pred")
            df = df.withColumn(SCORE, other.cast("double"))
        out = basics(df).first().asDict() | ranking(df).first().asDict()
        out["threshold_metrics"] = {str(r.threshold): {k: v for k, v in r.asDict().items() if k != "threshold"} for r in at_thresholds(df, list(thresholds)).collect()}
        out["top_fraction_metrics"] = {str(r.fraction): {"k": r.k, "precision": r.precision, "recall": r.recall} for r in at_top(df, list(fractions), tie).collect()}
        return out
    if task == "multiclass":
        if "y_pred" not in df.columns:
            df = df.withColumn("y_pred", most_likely("y_proba"))
        out = multiclass(df).first().asDict()
        out["per_class"] = {str(r.label): r.asDict() for r in per_class(df).collect()}
        out["confusion_matrix"] = {f"{r.actual}->{r.predicted}": r.n for r in confusion(df).collect()}
        several = "y_proba" in df.columns and df.select("y_true").distinct().limit(2).count() > 1
        out["log_loss"] = multiclass_log_loss(df).first()[0] if several else None
        out["roc_auc_ovr"] = one_vs_rest_auc(df).first()[0] if several else None
        return out
    if task == "regression":
        return regression(df).first().asDict()
    raise ValueError(f"unknown task {task!r}")


def flatten(metrics: dict, prefix: str = "") -> dict:
    """Nested keys joined by dots; lists as JSON."""
    import json

    out: dict = {}
    for k, v in metrics.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = json.dumps(v) if isinstance(v, list | tuple) else v
    return out
