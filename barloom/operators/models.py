"""Classifiers by pyspark.ml: registry, training, prediction, artifacts and calibration."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import boosting, metrics
from barloom.operators.features import build, feature_columns
from barloom.sources.staging import run_folder, staged
from barloom.sources.tables import get_text, names_of, plain, put_text, report

UNBUILT = ("pytorch", "jax", "lightgbm", "xgboost")


@dataclass(frozen=True)
class Dataset:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    features: list[str]
    target: str


def dataset(df: DataFrame, features: list[str], target: str, split: str = "split", names: tuple[str, str, str] = ("train", "validation", "test")) -> Dataset:
    """Three parts of a table. Nulls in features or target anywhere, and empty parts, raise."""
    columns = [*features, target]
    checks = df.agg(F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1), *[F.count_if(F.col(split) == n) for n in names]).first()
    if checks[0]:
        raise ValueError(f"{checks[0]} rows have a null feature or target")
    if empty := [n for n, k in zip(names, checks[1:], strict=True) if not k]:
        raise ValueError(f"empty splits: {empty}")
    return Dataset(*(df.where(F.col(split) == n) for n in names), features, target)


def _with_classes(df: DataFrame, proba: Column, positive: int) -> DataFrame:
    """y_proba (class to probability), y_score (that of the positive class) and y_pred (the most likely class; of two, the positive
    one from 0.5 on)."""
    made = df.withColumn("y_proba", proba)
    made = made.withColumn("y_score", F.coalesce(F.try_element_at("y_proba", F.lit(positive)), F.lit(0.0)))
    other = F.filter(F.map_keys("y_proba"), lambda c: c != positive)
    two = (F.size("y_proba") <= 2) & (F.size(other) <= 1)
    either = F.when(F.col("y_score") >= 0.5, F.lit(positive)).otherwise(F.coalesce(F.get(other, F.lit(0)), F.lit(0)))
    return made.withColumn("y_pred", F.when(two, either).otherwise(metrics.most_likely("y_proba")).cast("int"))


class MajorityModel:
    """Always the most frequent class (the smaller of equals), or the only one that there was; its probability is 1."""

    def __init__(self, label: int):
        self.label = label

    def transform(self, df: DataFrame, positive: int = 1) -> DataFrame:
        classes = sorted({0, positive, self.label})
        proba = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(1.0 if c == self.label else 0.0))])
        return _with_classes(df, proba, positive).withColumn("y_pred", F.lit(self.label))

    def save(self, spark: SparkSession, path: str) -> None:
        put_text(spark, f"{path}/majority.json", json.dumps({"label": self.label}))


class VectorModel:
    """A fitted pipeline; place k of its probabilities is class k."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame, positive: int = 1) -> DataFrame:
        chances = self.model.transform(df).withColumn("_chances", vector_to_array("probability"))
        proba = F.map_from_arrays(F.sequence(F.lit(0), F.size("_chances") - 1), F.col("_chances"))
        return _with_classes(chances, proba, positive).drop("_raw", "_scaled", "_features", "rawPrediction", "probability", "prediction", "_chances")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path)


class BoostedModel:
    """Trees grown best leaf first over binned features."""

    def __init__(self, model: boosting.BoostedTrees):
        self.model = model

    def transform(self, df: DataFrame, positive: int = 1) -> DataFrame:
        made = self.model.scored(df, "_one")
        return _with_classes(made, F.create_map(F.lit(0), 1 - F.col("_one"), F.lit(1), F.col("_one")), positive).drop("_one")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(spark, path)


class ValueModel:
    """A fitted regression."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame, positive: int = 1) -> DataFrame:
        return self.model.transform(df).withColumn("y_pred", F.col("prediction").cast("double")).drop("_raw", "_scaled", "_features", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path)


def predict_for_task(model, df: DataFrame, task: str, positive: int = 1) -> DataFrame:
    """df with the columns of its kind of task: binary y_pred, y_score, y_proba; multiclass y_pred, y_proba; regression y_pred."""
    if task not in ("binary", "multiclass", "regression"):
        raise ValueError(f"unknown task {task!r}")
    made = model.transform(df, positive)
    if task == "regression":
        return made.withColumn("y_pred", F.col("y_pred").cast("double")).drop("y_score", "y_proba")
    if "y_proba" not in made.columns:
        raise TypeError("the model gives no probabilities")
    return made if task == "binary" else made.withColumn("y_pred", metrics.most_likely("y_proba")).drop("y_score")


def prediction_frame(predicted: DataFrame, target: str, task: str, classes: tuple[int, ...] = ()) -> DataFrame:
    """symbol, timestamp, split, y_true, and by task: y_score and y_pred_at_0_5; y_pred and proba_class_<c> for each class; y_pred and
    residual."""
    key = ["symbol", "timestamp", "split", F.col(target).alias("y_true")]
    if task == "binary":
        return predicted.select(*key, "y_score", F.col("y_pred").alias("y_pred_at_0_5"))
    if task == "multiclass":
        return predicted.select(*key, "y_pred", *[F.try_element_at("y_proba", F.lit(c)).alias(f"proba_class_{c}") for c in classes])
    if task == "regression":
        return predicted.select(*key, "y_pred", (F.col(target) - F.col("y_pred")).alias("residual"))
    raise ValueError(f"unknown task {task!r}")


def _balanced(df: DataFrame, target: str) -> tuple[DataFrame, float]:
    """Weights n / (classes * n of the class), and their sum. A row per class comes to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    n = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(target) == k, n / (len(counts) * c)) for k, c in counts.items()])
    return df.withColumn("_weight", weight), float(n)


def fit(config: dict, data: Dataset):
    """A model from {"backend", "estimator", "scale", "params"}."""
    backend, kind, params = config.get("backend", "spark"), config["estimator"], dict(config.get("params", {}))
    if backend in UNBUILT:
        raise NotImplementedError(f"backend {backend}")
    if backend != "spark":
        raise ValueError(f"unknown backend {backend!r}")
    if kind == "majority":
        top = data.train.groupBy(data.target).count().orderBy(F.desc("count"), data.target).first()
        return MajorityModel(int(top[0]))
    if kind == "boosted" and data.train.select(data.target).distinct().limit(2).count() == 2:
        rules = boosting.Rules(params.get("max_leaf_nodes", 31), params.get("max_depth"), params.get("min_samples_leaf", 20), params.get("l2", 0.0))
        return BoostedModel(boosting.boost(data.train, data.features, data.target, params.get("max_iter", 200), params.get("learning_rate", 0.05), params.get("max_bins", 255), rules))
    stages: list = [VectorAssembler(inputCols=data.features, outputCol="_raw" if config.get("scale") else "_features", handleInvalid="error")]
    if config.get("scale"):
        # the scaler divides by the sample deviation; the population one is smaller by the root of (n - 1) / n
        n = data.train.count()
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        stages.append(ElementwiseProduct(inputCol="_scaled", outputCol="_features", scalingVec=Vectors.dense([(n / max(n - 1, 1)) ** 0.5] * len(data.features))))
    train = data.train.withColumn(data.target, F.col(data.target).cast("double"))
    if kind == "linear":
        stages.append(LinearRegression(featuresCol="_features", labelCol=data.target, regParam=params.get("alpha", 0.0), maxIter=params.get("max_iter", 100)))
        return ValueModel(Pipeline(stages=stages).fit(train))
    classes = [r[0] for r in data.train.select(data.target).distinct().limit(2).collect()]
    if len(classes) == 1:
        return MajorityModel(int(classes[0]))
    if kind == "logistic":
        weighted, total = _balanced(train, data.target)
        penalty = 1 / (params.get("C", 1.0) * total)
        stages.append(LogisticRegression(featuresCol="_features", labelCol=data.target, weightCol="_weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=params.get("max_iter", 1000)))
        train = weighted
    elif kind == "gbt":
        stages.append(GBTClassifier(featuresCol="_features", labelCol=data.target, maxIter=params.get("max_iter", 200), stepSize=params.get("learning_rate", 0.05), maxDepth=params.get("max_depth", 5), maxBins=255, seed=params.get("seed", 42)))
    else:
        raise ValueError(f"unknown estimator {kind!r}")
    made = Pipeline(stages=stages).fit(train)
    if kind == "logistic":
        # a fresh model keeps its training summary, and that the session, which tasks can't take once it has observed a write
        path = f"{run_folder(train.sparkSession)}/model-{uuid.uuid4().hex}"
        made.write().save(path)
        made = PipelineModel.load(path)
    return VectorModel(made)


def load(spark: SparkSession, path: str, kind: str = "spark"):
    """A saved model; other formats than those of save() raise."""
    if kind != "spark":
        raise NotImplementedError(f"artifact format {kind!r}")
    if trees := boosting.BoostedTrees.load(spark, path):
        return BoostedModel(trees)
    if label := get_text(spark, f"{path}/majority.json"):
        return MajorityModel(json.loads(label)["label"])
    if not names_of(spark, f"{path}/metadata"):
        raise FileNotFoundError(path)
    model = PipelineModel.load(path)
    return (VectorModel if any(s.hasParam("probabilityCol") for s in model.stages) else ValueModel)(model)


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Names of saved models, sorted."""
    return sorted(p.rsplit("/", 2)[-2] for p in names_of(spark, f"{folder}/*/metadata.json"))


def feature_schema(spark: SparkSession, model_dir: str, fallback: str | None = None) -> dict:
    """The feature list that was saved with a model, else that of the fallback file; without either it raises."""
    for path in (f"{model_dir}/feature_schema.json", fallback):
        if path and (text := get_text(spark, path)) is not None:
            return json.loads(text)
    raise FileNotFoundError(f"no feature schema in {model_dir}, and no fallback")


def train_all(configs: dict[str, dict], data: Dataset, folder: str, version: str = "1") -> dict[str, dict]:
    """Fits, scores on validation and saves each model with its metadata, feature list and metrics, and training_summary.json, on the
    file system of folder."""
    out, spark = {}, data.train.sparkSession
    for name, config in configs.items():
        model, home = fit(config, data), f"{folder}/{name}"
        model.save(spark, f"{home}/model")
        scored = model.transform(data.validation).withColumn("y_true", F.col(data.target))
        out[name] = metrics.basics(scored).first().asDict() | metrics.ranking(scored).first().asDict() | metrics.at_thresholds(scored, [0.5]).first().asDict()
        put_text(spark, f"{home}/metadata.json", json.dumps({"name": name, "version": version, **config, "model_path": f"{home}/model", "artifact_format": "spark"}))
        put_text(spark, f"{home}/feature_schema.json", json.dumps({"feature_columns": data.features, "num_features": len(data.features)}))
        put_text(spark, f"{home}/metrics.json", json.dumps(out[name]))
    sizes = {f"num_{part}_rows": rows.count() for part, rows in (("train", data.train), ("validation", data.validation), ("test", data.test))}
    summary = {"model_version": version, "task_type": "binary", "target_column": data.target, "num_features": len(data.features), **sizes, "models": out}
    put_text(spark, f"{folder}/training_summary.json", json.dumps(plain(summary), indent=2, default=str))
    return out


def scored_grid(folder: str, data: Dataset) -> DataFrame:
    """Predictions of every saved model on validation and test in one plan: model_name and the columns of prediction_frame()."""
    spark, out = data.train.sparkSession, None
    held = data.validation.withColumn("split", F.lit("validation")).unionByName(data.test.withColumn("split", F.lit("test")))
    for name in discover(spark, folder):
        made = prediction_frame(load(spark, f"{folder}/{name}/model").transform(held), data.target, "binary").withColumn("model_name", F.lit(name))
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise FileNotFoundError(f"no saved models in {folder}")
    return out


def evaluate(folder: str, data: Dataset, thresholds: tuple[float, ...] = (0.5,), fractions: tuple[float, ...] = (0.05, 0.1), out: str | None = None) -> list[dict]:
    """Flat metrics of every saved model on validation and test, as many jobs as for one. With `out`, a folder on any file system, the
    predictions (by model and split), evaluation_summary.json, metrics_table.csv and evaluation_report.md are written there."""
    spark = data.train.sparkSession
    scores = scored_grid(folder, data)
    if out:
        scores.write.mode("overwrite").partitionBy("model_name", "split").parquet(f"{out}/predictions")
        scores = spark.read.schema(scores.schema).parquet(f"{out}/predictions")
    else:
        scores = staged(scores, "predictions")
    results = metrics.grid(scores, ("model_name", "split"), thresholds, fractions)
    order = {"validation": 0, "test": 1}
    results.sort(key=lambda r: (r["model_name"], order[r["split"]]))
    rows = [metrics.flatten(r) for r in results]
    if out:
        summary = {"task_type": "binary", "target_column": data.target, "features": data.features, "num_models": len({r["model_name"] for r in results}), "num_results": len(results), "results": results}
        put_text(spark, f"{out}/evaluation_summary.json", json.dumps(plain(summary), indent=2, default=str))
        table = spark.createDataFrame([tuple(None if v is None else str(v) for v in r.values()) for r in rows], ", ".join(f"`{c}` string" for c in rows[0]))  # a row for each model and split
        put_text(spark, f"{out}/metrics_table.csv", "\n".join([",".join(rows[0]), *[",".join("" if v is None else str(v) for v in r.values()) for r in rows], ""]))
        put_text(spark, f"{out}/evaluation_report.md", report("Evaluation", {"Metrics": table, "Features": {f: "" for f in data.features}}))
    return rows


def batch_predict(bars: DataFrame, model, features: list[str], windows: list[int], threshold: float = 0.5, policy: str = "full_window", name: str = "model", version: str = "1") -> DataFrame:
    """Features of bars, without rows that miss one, scored: key, close, model, prediction, y_score."""
    made = model.transform(build(bars, windows, policy).na.drop(subset=features))
    return made.select("symbol", "timestamp", "close", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), (F.col("y_score") >= threshold).cast("int").alias("prediction"), "y_score")


def latest_rows(requests: DataFrame, windows: list[int], policy: str = "full_window") -> DataFrame:
    """Requests are bars with a request_id: per request the features of its last bar, with n_bars and warnings. Many requests are
    scored in one job."""
    keyed = requests.withColumns({"_symbol": F.col("symbol"), "symbol": F.concat_ws("\0", F.col("request_id").cast("string"), "symbol")})
    made = build(keyed, windows, policy)
    columns = feature_columns(made, frozenset({"request_id"}))
    last = made.groupBy("request_id", F.col("_symbol").alias("asked")).agg(F.count(F.lit(1)).alias("n_bars"), F.max_by(F.struct("timestamp", "close", *columns), "timestamp").alias("r"))
    need = max(windows) + 1
    warn = F.when(F.col("n_bars") < need, F.array(F.format_string(f"%d bars, {need} are needed", "n_bars"))).otherwise(F.array().cast("array<string>"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in columns]))
    return last.select("request_id", F.col("asked").alias("symbol"), "n_bars", warn.alias("warnings"), F.slice(missing, 1, 20).alias("missing_features"), "r.*")


def request_errors(requests: DataFrame) -> DataFrame:
    """(request_id, error_count): nulls in prices or volume, prices at or below 0, negative volumes and repeated times."""
    core = ("open", "high", "low", "close", "volume")
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in (*core, "timestamp")], *[F.coalesce((F.col(c) <= 0).cast("int"), F.lit(0)) for c in core[:4]], F.coalesce((F.col("volume") < 0).cast("int"), F.lit(0)))
    return requests.groupBy("request_id").agg((F.sum(bad) + F.count("timestamp") - F.count_distinct("timestamp")).alias("error_count"))


def predict_requests(requests: DataFrame, model, features: list[str], windows: list[int], threshold: float = 0.5, policy: str = "full_window") -> DataFrame:
    """Per request: prediction, probabilities by class and warnings. Requests with errors or missing features raise, all or nothing."""
    if not request_errors(requests).where("error_count > 0").isEmpty():
        raise ValueError("requests have invalid bars")
    rows = latest_rows(requests, windows, policy)
    if bad := rows.where(F.size(F.array_intersect("missing_features", F.array(*[F.lit(f) for f in features]))) > 0).select("missing_features").first():
        raise ValueError(f"features of the last bar are missing: {bad[0]}")
    score = F.col("y_score")
    scored = model.transform(rows)
    chance = F.create_map(F.lit("0"), 1 - score, F.lit("1"), score)
    return scored.select("request_id", "symbol", "timestamp", (score >= threshold).cast("int").alias("prediction"), score, chance.alias("probabilities"), "warnings")


def calibrate(scored: DataFrame, target: str = "y_true", method: str = "isotonic"):
    """A map of scores, fitted on held-out rows: a function from a scored table to one with y_calibrated. isotonic: rows are pooled within
    ranges of the score, then the pools. sigmoid: a logistic curve of the score, see sigmoid()."""
    if method == "sigmoid":
        a, b = sigmoid(scored, target)
        return lambda df: df.withColumn("y_calibrated", 1 / (1 + F.exp(F.lit(a) * F.col("y_score") + F.lit(b))))
    if method != "isotonic":
        raise ValueError(f"unknown method {method!r}")
    made = IsotonicRegression(featuresCol="y_score", labelCol=target, predictionCol="y_calibrated").fit(scored)
    return made.transform


def sigmoid(scored: DataFrame, target: str = "y_true", most: int = 100, tolerance: float = 1e-10) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(a * score + b)) with the least log loss, by Newton's method: each step is one aggregation of five sums. The
    targets are not 0 and 1 but 1 / (n0 + 2) and (n1 + 1) / (n1 + 2) for n0 and n1 rows of the classes, so that a table which a score
    parts has a solution. Rows with a null score or target don't count; without rows it raises."""
    rows = staged(scored.select(F.col("y_score").cast("double").alias("f"), F.col(target).cast("double").alias("y")).where("f IS NOT NULL AND y IS NOT NULL"), "scores")
    n, n1 = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        raise ValueError("no rows to calibrate with")
    t = F.when(F.col("y") > 0, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n - n1 + 2)))
    a, b = 0.0, math.log((n - n1 + 1) / (n1 + 1))

    def sums(a: float, b: float):
        z = F.lit(a) * F.col("f") + F.lit(b)
        p = 1 / (1 + F.exp(z))
        loss = t * z + F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)
        # of the loss: its value, both slopes, and the second derivatives
        d, w = t - p, p * (1 - p)
        return rows.agg(F.sum(loss), F.sum(d * F.col("f")), F.sum(d), F.sum(w * F.col("f") * F.col("f")), F.sum(w * F.col("f")), F.sum(w)).first()

    now = sums(a, b)
    for _ in range(most):
        value, ga, gb, haa, hab, hbb = now
        if max(abs(ga), abs(gb)) <= tolerance * n:
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step = 1.0
        while (then := sums(a + step * da, b + step * db))[0] > value + 1e-4 * step * (ga * da + gb * db) and step > 1e-10:
            step /= 2
        a, b, now = a + step * da, b + step * db, then
    return a, b
