"""Exact small cases and invariants of the operators that SQL over the sample tables doesn't reach."""

import io
import math
import random
import re
import struct
import subprocess
import sys
import zipfile
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from barloom.functions import frames, ranged
from barloom.functions.columns import trailing
from barloom.operators import bars as B
from barloom.operators import drift as D
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import chunks
from barloom.operators import metrics as E
from barloom.operators import models as M
from barloom.operators import quality as Q
from barloom.operators import splits as S
from barloom.operators import timeline as T
from barloom.plans import catalog
from barloom.sources import klines as K
from barloom.sources import tables as R
from barloom.sources.staging import shared_folder
from barloom.streaming import bars as stream

SCALE = "abs(sin(id * 0.7)) * 10 + 50"


def bars(spark, n: int, symbols: int = 1):
    rows = spark.range(n).crossJoin(spark.range(symbols).withColumnRenamed("id", "s"))
    return rows.selectExpr(
        "concat('S', s) AS symbol", "cast(timestamp_seconds(id * 300) AS timestamp_ntz) AS timestamp", f"{SCALE} + s AS open", f"{SCALE} + s + 2 AS high",
        f"{SCALE} + s - 2 AS low", f"{SCALE} + s + cos(id) AS close", "100.0 + (id % 7) AS volume",
    )


def test_split_sizes(spark):
    counted = S.assign(bars(spark, 8628), 0.7, 0.15, 0.15, 12).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in counted} == dict(zip(S.SPLITS, (6027, 12, 1282, 12, 1295), strict=True))
    with pytest.raises(ValueError):
        S.assign(bars(spark, 9), 0.7, 0.2, 0.2, 1)


@pytest.mark.parametrize(("gap", "passes"), [(12, True), (0, False)])
def test_purge(spark, gap, passes):
    checks = S.purge_checks(S.assign(bars(spark, 400), 0.7, 0.15, 0.15, gap), 12, 300)
    if passes:
        S.raise_unless_passed(checks)
    else:
        with pytest.raises((ValueError, RuntimeError, AssertionError)):
            S.raise_unless_passed(checks)


def test_chunks_change_nothing(spark):
    source = bars(spark, 300, 2)
    plain, cut = X.build(source, [3, 12]), X.build_chunked(source, [3, 12], 50)
    names = plain.columns
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in plain.dtypes]
    assert sorted(map(str, cut.select(names).select(rounded).collect())) == sorted(map(str, plain.select(rounded).collect()))


def test_future_sum(spark):
    rows = bars(spark, 5).withColumn("x", F.row_number().over(S.by_time()).cast("double"))
    assert [r.s for r in L.future_sum(rows, "x", 2, "s").orderBy("timestamp").collect()] == [5.0, 7.0, 9.0, None, None]


def scores(spark, pairs):
    rows = spark.createDataFrame([("a", k, int(y), float(s)) for k, (y, s) in enumerate(pairs)], "symbol string, at int, y_true int, y_score double")
    return rows.withColumn("timestamp", F.timestamp_seconds("at").cast("timestamp_ntz"))


def test_ranking_metrics(spark):
    perfect = scores(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.2), (0, 0.1)])
    top = E.at_top(perfect, [0.4]).first()
    assert top.k == 2 and top.precision == 1.0 and top.recall == pytest.approx(2 / 3)
    assert E.ranking(perfect).first().roc_auc == 1.0
    tied = scores(spark, [(k % 3 == 0, (k * 7 % 10) / 10) for k in range(60)])
    whole = E.ranking(tied).first()
    by = {r.k: r.roc_auc for r in E.ranking(tied.withColumn("k", F.lit(1)).unionByName(perfect.withColumn("k", F.lit(2))), ("k",)).collect()}
    assert by == {1: pytest.approx(whole.roc_auc), 2: 1.0}
    wide = scores(spark, [(k % 3 == 0, -1e6 + k * 7919 % 613) for k in range(613)])  # distinct scores outside [0, 1]
    assert E.ranking(wide).first().roc_auc == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="y_score", labelCol="y_true", numBins=0).evaluate(wide))
    other = BinaryClassificationEvaluator(rawPredictionCol="y_score", labelCol="y_true", numBins=0).evaluate(tied)
    assert whole.roc_auc == pytest.approx(other)


def test_top_k_ties_at_the_cut(spark):
    tied = scores(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)])
    top = E.at_top(tied, [0.5]).first()
    assert top.k == 2 and top.precision == 0.5 and top.recall == 1.0


def test_drift(spark):
    rows = spark.range(500).selectExpr("cast(id AS double) AS x", "1.0D AS flat")
    same = {r.feature: r for r in D.feature_drift(rows, rows, ["x", "flat"]).collect()}
    assert same["x"].psi < 1e-8 and same["flat"].psi == 0
    moved = D.feature_drift(rows, rows.withColumn("x", F.col("x") + 200), ["x"]).first()
    assert moved.psi > 0.1
    empty = D.feature_drift(rows, rows.limit(0), ["x"]).first()
    assert empty.psi is None


def archive(rows) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data.csv", "\n".join(",".join(map(str, r)) for r in rows))
    return out.getvalue()


def kline(ms: int, close: float = 2.0) -> list:
    return [ms, 1, 3, 1, close, 10, ms + 1, 5, 4, 1, 1, 0]


def test_archives(spark, tmp_path):
    hour = 3_600_000
    (tmp_path / "X-1h-2024-01.zip").write_bytes(archive([K.RAW, kline(1_704_067_200_000), kline(1_704_067_200_000 + hour), kline(1_704_067_200_000, 9.0)]))
    (tmp_path / "X-1h-2024-02.zip").write_bytes(b"not an archive: a month that isn't asked for isn't opened")
    (tmp_path / "Y-1h-2024-01.zip").write_bytes(archive([kline(1_704_067_200_000, 7.0)]))
    (tmp_path / "X-5m-2024-01.zip").write_bytes(archive([kline(1_704_067_200_000, 8.0)]))
    found = K.ingest(spark, "X", "1h", "2024-01-01", "2024-02-01", str(tmp_path)).orderBy("timestamp").collect()
    assert {r.symbol for r in found} == {"X"}
    assert [r.close for r in K.ingest(spark, "Y", "1h", "2024-01-01", "2024-02-01", str(tmp_path)).collect()] == [7.0]
    with pytest.raises(ValueError, match="2024-03"):
        K.ingest(spark, "X", "1h", "2024-01-01", "2024-03-02", str(tmp_path))
    assert [(str(r.timestamp), r.close, r.num_trades) for r in found] == [("2024-01-01 00:00:00", 2.0, 4), ("2024-01-01 01:00:00", 2.0, 4)]
    with pytest.raises(ValueError):
        K.unzip_rows(archive([[1, 2]]))
    assert K.months("2024-12-15", "2025-01-01") == [(2024, 12)]
    assert K.archive_url("https://host/", "X", "5m", 2024, 1) == "https://host/data/spot/monthly/klines/X/5m/X-5m-2024-01.zip"


def test_whole_ingestion(spark, tmp_path):
    hour, start = 3_600_000, 1_704_067_200_000
    (tmp_path / "X-1h-2024-01.zip").write_bytes(archive([K.RAW, kline(start + hour), kline(start), kline(start, 9.0)]))
    config = {"symbol": "X", "interval": "1h", "start_utc": "2024-01-01", "end_utc": "2024-02-01", "raw_dir": f"{tmp_path}/raw", "processed_dir": f"{tmp_path}/done", "archives": str(tmp_path)}
    got = K.run_ingestion(spark, config)
    assert (got["data_source"], got["num_rows"], got["start_timestamp"]) == ("archives", 2, "2024-01-01 00:00:00")
    assert R.read(spark, got["raw_path"], header=True).count() == 3
    again = R.read(spark, got["processed_path"])
    assert again.columns == got["columns"] and again.count() == 2
    K.ingestion_checks(again.withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp"))), "at")
    with pytest.raises(ValueError, match="order"):
        K.ingestion_checks(again.withColumn("at", -F.unix_micros(F.col("timestamp").cast("timestamp"))), "at")
    for broken in (again.limit(0), again.drop("close"), again.unionByName(again), again.withColumn("open", F.lit(0.0)), again.withColumn("volume", F.lit(-1.0)), again.withColumn("low", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            K.ingestion_checks(broken)
    # without archives, months come from pages, a task each; a bar where a month ends comes once
    fetch = lambda at, stop, limit: [kline(t) for t in range(at, min(stop, at + 200 * hour) + 1, hour)][:limit]
    paged = K.run_ingestion(spark, config | {"archives": f"{tmp_path}/none", "start_utc": "2024-01-31", "end_utc": "2024-02-02"}, fetch)
    assert (paged["data_source"], paged["num_rows"]) == ("pages", 49)
    with pytest.raises(ValueError):
        K.run_ingestion(spark, config | {"archives": None, "use_pages": False}, fetch)


def test_raw_symbols_and_order(spark):
    raw = K.raw_table(spark, [kline(1_704_067_200_000), kline(1_704_067_200_000, 5.0)])
    own = raw.withColumn("symbol", F.when(F.col("_ingest_order") == 0, "OWN"))
    assert sorted((r.symbol, r.close) for r in K.canonical(own, "X").collect()) == [("OWN", 2.0), ("X", 5.0)]
    assert K.canonical(raw, "X").columns == ["symbol", "timestamp", "open", "high", "low", "close", "volume", "quote_volume", "num_trades"]
    with pytest.raises(ValueError):
        K.canonical(raw.drop("_ingest_order"), "X")
    half = K.raw_table(spark, [kline(1_704_067_200_000), kline(1_704_067_200_000_000)])  # the median is between: microseconds
    assert str(K.canonical(half, "X").orderBy("timestamp").collect()[1].timestamp) == "2024-01-01 00:00:00"


def test_units_of_time(spark):
    raw = K.raw_table(spark, [kline(1_704_067_200_000), kline(1_704_067_200_000_000 + 60_000_000)])
    times = [str(r.timestamp) for r in K.canonical(raw, "X", per_row_unit=True).orderBy("timestamp").collect()]
    assert times == ["2024-01-01 00:00:00", "2024-01-01 00:01:00"]


def test_pages():
    step = 3_600_000
    fetch = lambda at, stop, limit: [kline(t) for t in range(at, min(stop, at + 2 * step), step)]
    assert len(list(K.pages(fetch, "1h", "2024-01-01", "2024-01-01T05:00:00"))) == 5
    with pytest.raises(RuntimeError):
        list(K.pages(lambda *_: [kline(0)], "1h", "2024-01-01", "2024-01-02"))


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    for kind in ("parquet", "csv"):
        R.write(rows, f"{tmp_path}/t.{kind}")
        assert [tuple(r) for r in R.read(spark, f"{tmp_path}/t.{kind}").collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        R.write(rows, f"{tmp_path}/t.txt")
    with pytest.raises(FileNotFoundError):
        R.read(spark, f"{tmp_path}/none.csv")
    assert R.read_or_empty(spark, "").isEmpty()


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "value", "event_id")
    source.repartition(3).write.parquet(f"{tmp_path}/events")
    live = stream.bars(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/events"), "event_type", "ts", "value", "event_id")
    run = live.writeStream.outputMode("complete").format("memory").queryName("streamed_bars").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    rounded = lambda df: sorted((r.symbol, str(r.timestamp), round(r.open, 6), round(r.close, 6), round(r.volume, 6), r.num_trades) for r in df.collect())
    assert rounded(spark.table("streamed_bars")) == rounded(B.from_events(source, "event_type", "ts", "value", "event_id"))


def test_models_round_trip(spark, tmp_path):
    rows = spark.range(240).selectExpr("cast(id % 17 AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 17 > 8 AS int) AS y", "CASE WHEN id < 160 THEN 'train' WHEN id < 200 THEN 'validation' ELSE 'test' END AS split")
    data = M.dataset(rows, ["a", "b"], "y")
    found = M.train_all({"most": {"estimator": "majority"}, "line": {"estimator": "logistic", "scale": True, "params": {"max_iter": 20}}}, data, str(tmp_path))
    assert found["line"]["roc_auc"] > 0.99 and M.discover(spark, str(tmp_path)) == ["line", "most"]
    again = M.load(spark, f"{tmp_path}/line/model").transform(data.test)
    assert M.feature_schema(spark, f"{tmp_path}/line")["feature_columns"] == ["a", "b"]
    assert M.feature_schema(spark, f"{tmp_path}/none", f"{tmp_path}/line/feature_schema.json")["num_features"] == 2
    with pytest.raises(FileNotFoundError):
        M.feature_schema(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        M.load(spark, f"{tmp_path}/none")
    flat = M.evaluate(str(tmp_path), M.Dataset(data.train, *(x.withColumns({"symbol": F.lit("s"), "timestamp": F.col("a")}) for x in (data.validation, data.test)), ["a", "b"], "y"))
    assert [(r["model_name"], r["split"]) for r in flat] == [("line", "validation"), ("line", "test"), ("most", "validation"), ("most", "test")] and all("threshold_metrics.0.5.f1" in r for r in flat)
    assert again.where("y_pred = y").count() >= 0.95 * data.test.count()
    with pytest.raises(NotImplementedError):
        M.fit({"backend": "xgboost", "estimator": "x"}, data)
    with pytest.raises(ValueError):
        M.dataset(rows.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), ["a", "b"], "y")


def test_join_of_predictions(spark):
    left = bars(spark, 3)
    right = left.limit(2).select("symbol", "timestamp", F.lit(0.5).alias("y_score"), F.lit(1.0).alias("close"))
    joined = T.join_predictions(left, right)
    assert joined.columns == [*left.columns, "y_score"] and joined.where("y_score IS NOT NULL").count() == 2 and joined.count() == 3
    for a, b in ((left, right.unionByName(right)), (left.unionByName(left), right)):
        with pytest.raises(PySparkException):
            T.join_predictions(a, b).collect()
    assert T.join_predictions(left, right.unionByName(right), one_to_one=False).count() == 5
    assert T.join_predictions(left, None) is left


def test_quantiles_by_ranges(spark):
    rows = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('s', id % 5) END AS k", "CASE WHEN id % 4 = 0 THEN 1.5D WHEN id % 17 = 0 THEN NULL ELSE sin(id) * 100 END AS v")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {r.k: r.q for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    for small in (0, 10**6):
        got = {r.k: r.q for r in ranged.quantile_arrays(rows, "v", qs, ("k",), small).collect()}
        assert got.keys() == want.keys() and all(a == pytest.approx(b) for k in got for a, b in zip(got[k], want[k], strict=True))
        assert ranged.quantiles(rows.where("v > 1000"), "v", qs, small=small).collect() == []
    counted = rows.where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for down in (True, False):
        a, b = (sorted(map(str, ranged.running(counted, "v", ("n",), ("k",), down, small).select("k", "v", "n", "upto_n", "all_n").collect())) for small in (0, 10**6))
        assert a == b
    assert L.threshold(rows.where("v > 1000").withColumnRenamed("v", "future_rv_1"), 1, 0.5, F.lit(True)).first().threshold is None


def test_places_and_chunks(spark):
    rows = bars(spark, 700, 2).withColumn("odd", F.when(F.unix_micros(F.col("timestamp").cast("timestamp")) % 900_000_000 == 0, F.col("close")))
    got = {(r.symbol, r.timestamp): (r._row, r._n) for r in chunks.placed(rows, F.col("odd").isNotNull()).collect()}
    for s in ("S0", "S1"):
        mine = sorted((r for r in rows.where(F.col("symbol") == s).collect()), key=lambda r: r.timestamp)
        before = 0
        for r in mine:
            assert got[s, r.timestamp] == (before, sum(x.odd is not None for x in mine))
            before += r.odd is not None
    for n in (1, 7, 700, 5000):
        a, b = L.future_values(rows, 3), L.future_values_chunked(rows, 3, n)
        named = lambda df: sorted((r.symbol, r.timestamp, *(None if x is None else round(x, 9) for x in (r.future_return_3, r.future_rv_3))) for r in df.collect())  # noqa: E731, B023
        assert named(a) == named(b)
    with pytest.raises(ValueError):
        chunks.in_chunks(rows, 1, 1, 0, lambda x: x)


def test_inputs_are_checked(spark):
    good = L.build(bars(spark, 60), 3, 0.7, 0.8)
    made = S.build(good.where("y_high_vol_3 IS NOT NULL"), 3, 0.7, 0.15, 0.15, 2, 0.8)
    assert "y_high_vol_3_split_safe" in made.columns and made.count() == 57
    for broken in (bars(spark, 3).withColumn("close", F.lit(0.0)), bars(spark, 3).withColumn("timestamp", F.lit("never")), bars(spark, 3).drop("close")):
        with pytest.raises(ValueError):
            L.prepared(broken)
    for broken in (good.limit(0), good.drop("y_high_vol_3"), good.withColumn("timestamp", F.lit("never"))):
        with pytest.raises(ValueError):
            S.prepared(broken, 3)
    with pytest.raises(ValueError):
        L.threshold_mask(good, 3, 1.0, "again")
    for mask in (L.threshold_mask, L.threshold_mask_placed):
        with pytest.raises(PySparkException, match="too few"):
            mask(L.future_values(bars(spark, 5), 3), 3, 0.3).collect()


def test_validation_of_a_table_that_breaks_every_rule(spark):
    bad = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 1.0, 3.0, 0.5, 2.0, 1.0, 0), ("a", "2024-01-01 00:00:00", 1.0, 3.0, 0.5, 2.0, 1.0, 1), ("a", "2024-01-01 03:00:00", -1.0, 0.1, 9.0, 20.0, -5.0, 2), ("a", "2024-01-01 01:00:00", 1.0, 3.0, 0.5, None, 1.0, 3)],
        "symbol string, timestamp string, open double, high double, low double, close double, volume double, _ingest_order long",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = {r.check_name: r["count"] for r in Q.validate(bad, 3600).collect()}
    assert got == {
        "required_columns_exist": 0, "optional_columns_present": 2, "extra_columns_detected": 0, "core_null_values": 1, "total_null_values_counted": 1, "timestamps_parse_as_utc": 0,
        "timestamps_unique_within_symbol": 2, "timestamps_sorted_within_symbol": 1, "expected_interval_consistent": 1, "missing_intervals_counted": 1, "no_duplicate_rows": 2, "ohlc_prices_positive": 1,
        "volume_non_negative": 1, "high_not_below_open": 0, "high_not_below_close": 1, "low_not_above_open": 1, "low_not_above_close": 0, "high_not_below_low": 1, "extreme_returns_flagged": 0,
    }
    assert Q.exit_code(Q.validate(bad, 3600)) == 1
    fine = bars(spark, 20).withColumn("_ingest_order", F.unix_micros(F.col("timestamp").cast("timestamp"))).withColumns({"quote_volume": F.lit(1.0), "num_trades": F.lit(1), "close": F.col("open")})
    assert (Q.exit_code(Q.validate(fine, 300, 9.0)), Q.exit_code(Q.validate(fine, 300, 1e-9)), Q.exit_code(Q.validate(fine, 300, 1e-9), True)) == (0, 0, 1)
    assert Q.globally_sorted(fine.limit(0)).first()[0] is True
    late = {r.check_name: r["count"] for r in Q.validate(fine.withColumn("timestamp", F.when(F.col("volume") > 100, F.col("timestamp"))), 300).collect()}
    assert late["timestamps_parse_as_utc"] > 0 and "missing_intervals_counted" not in late
    some = {r.check_name: r["count"] for r in Q.validate(fine.drop("close", "symbol"), 300).collect()}
    assert some["symbol_column_exists"] == 1 and some["ohlcv_columns_exist"] == 1


def test_models_by_task(spark):
    rows = spark.range(90).selectExpr("'s' AS symbol", "timestamp_seconds(id) AS timestamp", "'test' AS split", "cast(id % 9 AS double) AS a", "cast(id % 9 DIV 3 AS int) AS y", "id % 9 * 2.0D + 1 AS z")
    several = M.fit({"estimator": "logistic", "scale": True, "params": {"max_iter": 60}}, M.Dataset(rows, rows, rows, ["a"], "y"))
    made = M.predict_for_task(several, rows, "multiclass")
    assert made.where("y_pred = y").count() >= 80
    frame = M.prediction_frame(made, "y", "multiclass", (0, 1, 2))
    assert frame.columns == ["symbol", "timestamp", "split", "y_true", "y_pred", "proba_class_0", "proba_class_1", "proba_class_2"]
    assert all(abs(r.proba_class_0 + r.proba_class_1 + r.proba_class_2 - 1) < 1e-9 for r in frame.collect())
    found = E.compute(made.withColumn("y_true", F.col("y")), "multiclass")
    assert found["roc_auc_ovr"] > 0.9 and found["log_loss"] < 1 and sum(found["confusion_matrix"].values()) == 90
    assert E.compute(made.drop("y_pred").withColumn("y_true", F.col("y")), "multiclass")["accuracy"] == found["accuracy"]
    line = M.fit({"estimator": "linear"}, M.Dataset(rows, rows, rows, ["a"], "z"))
    residuals = M.prediction_frame(M.predict_for_task(line, rows, "regression"), "z", "regression")
    assert residuals.columns[-1] == "residual" and all(abs(r.residual) < 1e-6 for r in residuals.collect())
    with pytest.raises(TypeError):
        M.predict_for_task(line, rows, "binary")
    one = rows.where("y = 0")
    only = M.fit({"estimator": "logistic"}, M.Dataset(one, one, one, ["a"], "y"))
    assert {(r.y_pred, r.y_score) for r in M.predict_for_task(only, rows, "binary").collect()} == {(0, 0.0)}
    assert M.prediction_frame(M.predict_for_task(only, rows, "binary"), "y", "binary").columns[-2:] == ["y_score", "y_pred_at_0_5"]
    # the second of two classes may be named: its score is that class's probability
    two = M.fit({"estimator": "logistic"}, M.Dataset(*[rows.where("y < 2")] * 3, ["a"], "y"))
    a, b = (sorted(r.y_score for r in two.transform(rows, p).collect()) for p in (0, 1))
    assert a[0] == pytest.approx(1 - b[-1])
    with pytest.raises(ValueError):
        E.compute(made.limit(0), "multiclass")


def test_scaling_by_the_population_deviation(spark):
    rows = spark.createDataFrame([(float(x), x % 2) for x in range(5)], "a double, y int")
    model = M.fit({"estimator": "linear", "scale": True}, M.Dataset(rows, rows, rows, ["a"], "y"))
    scaled = [r._features[0] for r in model.model.transform(rows).collect()]
    assert scaled == pytest.approx([(x - 2) / 2**0.5 for x in range(5)])


def test_serving(spark):
    history = bars(spark, 40)
    rows = X.build(history, [3]).na.drop().withColumn("y", (F.col("close") > F.col("open")).cast("int"))
    names = ["rolling_return_mean_3", "candle_body_pct"]
    model = M.fit({"estimator": "logistic"}, M.Dataset(rows, rows, rows, names, "y"))
    asked = history.withColumn("request_id", F.lit(1)).unionByName(bars(spark, 3).withColumn("request_id", F.lit(2)))
    latest = {r.request_id: r for r in M.latest_rows(asked, [3]).collect()}
    assert latest[1].n_bars == 40 and latest[1].warnings == [] and latest[2].n_bars == 3 and len(latest[2].warnings) == 1 and names[0] in latest[2].missing_features
    one = M.predict_requests(asked.where("request_id = 1"), model, names, [3]).first()
    assert sum(one.probabilities.values()) == pytest.approx(1) and one.prediction == int(one.y_score >= 0.5)
    with pytest.raises(ValueError, match="missing"):
        M.predict_requests(asked, model, names, [3])
    with pytest.raises(ValueError, match="invalid"):
        M.predict_requests(asked.withColumn("low", F.lit(-1.0)), model, names, [3])
    calibrated = M.calibrate(model.transform(rows).withColumn("y_true", F.col("y")))(model.transform(rows)).orderBy("y_score").collect()
    assert all(a.y_calibrated <= b.y_calibrated for a, b in zip(calibrated, calibrated[1:], strict=False))


def test_freshness(spark):
    rows = bars(spark, 5).where("timestamp <> TIMESTAMP_NTZ '1970-01-01 00:10:00'")
    fresh = D.freshness(rows.unionByName(bars(spark, 3).withColumn("symbol", F.lit("T"))), 300)
    assert sorted((r.symbol, r.missing_count, r.is_fresh) for r in fresh.collect()) == [("S0", 1, True), ("T", 0, True)]
    assert tuple(D.freshness_overall(fresh).first()) == (True, 1)
    live = D.freshness(rows.drop("symbol"), 300, "live", 10, "1970-01-01 01:00:00")
    assert [(r.symbol, r.delay_minutes, r.is_fresh) for r in live.collect()] == [("ALL", 40.0, False)] and D.freshness_overall(live).first().passed is False
    with pytest.raises(PySparkException):
        D.freshness(rows.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), 300).collect()


def test_artifacts_and_reports(spark, tmp_path):
    split = bars(spark, 4).withColumn("split", F.lit("test"))
    R.write(split, f"{tmp_path}/split.parquet")
    R.write(split.select("symbol", "timestamp", F.lit(0.25).alias("y_score")), f"{tmp_path}/predictions.csv")
    R.put_text(spark, f"{tmp_path}/summary.json", '{"freshness": {"passed": true, "total_missing_interval_count": 3}, "prediction_drift": {"severity": "alert", "psi": 0.5}}')
    paths = {"split_data_path": f"{tmp_path}/split.parquet", "prediction_path": f"{tmp_path}/predictions.csv", "monitoring_summary_path": f"{tmp_path}/summary.json", "feature_schema_path": f"{tmp_path}/none.json"}
    found = T.load_artifacts(spark, paths)
    assert found["timeline_df"].where("y_score = 0.25").count() == 4 and found["feature_schema"] == {} and found["metrics_df"].isEmpty()
    assert {r.artifact: r.there for r in found["artifact_status"].collect()} == {"split_data_path": True, "prediction_path": True, "monitoring_summary_path": True, "feature_schema_path": False}
    assert [tuple(r) for r in T.monitoring_rows(spark, found["monitoring_summary"]).collect()] == [("data_freshness", "passed", "missing_intervals=3"), ("prediction_drift", "alert", "psi=0.5")]
    assert T.monitoring_rows(spark, {}).isEmpty()
    text = R.report("Run", {"Rows": split, "Facts": {"n": 4, "nan": float("nan")}, "Note": "fine"}, most=2)
    assert text.startswith("# Run") and "Only the first 2 rows" in text and "- n: 4" in text and "## Note\n\nfine" in text
    assert [r.threshold for r in T.series(split, ["close"], 0.5).collect()] == [0.5] * 4
    assert [r.v for r in T.metric_bars(spark.createDataFrame([("m", "test", "0.5"), ("m", "x", "?")], "model_name string, split string, v string"), "v").collect()] == [0.5]


def test_times_of_tables(spark, tmp_path):
    R.write(spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("a", "soon")], "symbol string, timestamp string"), f"{tmp_path}/t.parquet")
    assert [str(r.timestamp) for r in R.read_split(spark, f"{tmp_path}/t.parquet").collect()] == ["2024-01-01 00:00:00", "None"]
    with pytest.raises(PySparkException, match="not a time"):
        R.read_candles(spark, f"{tmp_path}/t.parquet").collect()
    (tmp_path / "c.yaml").write_text("a: 1")
    (tmp_path / "l.json").write_text("[1]")
    assert R.read_config(f"{tmp_path}/c.yaml") == {"a": 1} and R.read_json(f"{tmp_path}/none", {}) == {} and R.read_text(None, "x") == "x"
    with pytest.raises(ValueError):
        R.read_config(f"{tmp_path}/l.json")
    R.write_json(f"{tmp_path}/o/p.json", {"x": float("inf"), "t": (1, float("nan"))})
    assert R.read_json(f"{tmp_path}/o/p.json") == {"x": None, "t": [1, None]}
    assert R.processed_path("X", "5m", "2024-01-01T00", "2024-02-01", "d") == "d/X_5m_2024-01-01_2024-02-01_processed.parquet"
    assert [r._ingest_order for r in R.with_arrival(spark.range(3).coalesce(1)).collect()] == [0, 1, 2]


def test_features_look_back_only(spark):
    """The check must fail where a feature looks ahead."""
    source = bars(spark, 40)
    assert X.past_only_check(source, [3]).first().max_abs_diff == 0
    ahead = lambda df, windows, policy: X.build(df, windows, policy).withColumn("rolling_return_mean_3", F.lead("close").over(S.by_time()))
    assert X.past_only_check(source, [3], made=ahead).first().max_abs_diff > 0
    assert X.resolve_columns(X.build(source, [3])) == X.feature_columns(X.build(source, [3]))
    for schema in ({"feature_columns": ["future_rv_3"]}, {"feature_columns": ["nowhere"]}):
        with pytest.raises(ValueError):
            X.resolve_columns(X.build(source, [3]), schema)
    with pytest.raises(ValueError):
        X.model_table(X.build(source, [288]), ["rolling_return_mean_288"])


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": "s://all/"}, sparkContext=context)) == "s://all"


def test_without_the_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['barloom.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)


def test_bits_keep_the_order_of_doubles(spark):
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0, 1.9999999999999998, 3.0, 1e-5, 1e300, 1.7976931348623157e308, float("inf")]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, s) for k in range(-1070, 1023, 13) for s in (0.0, math.inf)]
    values += [-v for v in values] + [float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = df.select("k", "v", ranged.bits_of(F.col("v")).alias("b")).withColumn("back", ranged.double_of(F.col("b"))).collect()
    for r in got:
        v = values[r.k]
        if math.isnan(v):
            assert math.isnan(r.back) and r.b == max(x.b for x in got)
        else:
            assert r.back == v and abs(r.b) == int.from_bytes(struct.pack(">d", abs(v)), "big") and (r.b < 0) == (v < 0)


def test_quantiles_by_radix_equal_percentile(spark):
    odd = "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D WHEN 3 THEN 7.25D WHEN 4 THEN -1e-310D WHEN 5 THEN double('inf') WHEN 6 THEN -1e300D ELSE (rand(3) - 0.5) * pow(10, id % 40 - 20) END"
    rows = ranged.staged(spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 5) END AS k", f"{odd} AS v"), "test")
    qs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    for by in ((), ("k",)):
        want = {tuple(r[b] for b in by): r.q for r in rows.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
        for chosen in (0, 10_000):
            ranged.CHOSEN, held = chosen, ranged.CHOSEN
            got = {tuple(r[b] for b in by): r.q for r in ranged.quantile_arrays(rows, "v", qs, by, 0).collect()}
            ranged.CHOSEN = held
            assert got.keys() == want.keys()
            for k in got:
                assert got[k] == pytest.approx(want[k], rel=1e-14, abs=0), k
    assert ranged.quantiles(rows.where("false"), "v", qs, small=0).collect() == []


def test_only_histograms_are_shuffled(spark, monkeypatch):
    sizes = []
    write = ranged.staged
    monkeypatch.setattr(ranged, "staged", lambda df, name: (made := write(df, name), sizes.append((name, made.count())))[0])
    rows = spark.range(60_000).selectExpr("sin(id) AS v")  # all distinct, mostly of few exponents
    got = ranged.quantiles(rows, "v", [0.5], small=0).first().value
    assert got == pytest.approx(rows.agg(F.percentile("v", F.lit(0.5))).first()[0])
    digits = [n for name, n in sizes if name == "digits"]
    assert len(digits) == 4 and digits[0] < 2000 and all(n <= 1 << 16 for n in digits)


def test_linear_frames_equal_moving_ones(spark):
    rows = bars(spark, 90, 3).withColumn("x", F.expr("CASE WHEN hash(timestamp) % 4 = 0 THEN NULL ELSE close + hash(timestamp) % 7 END"))
    w = X.by_time()
    for n in (1, 2, 5, 30, 200):
        kinds = [(f"{how}_{least}", how, least) for how in ("mean", "std", "max", "min", "sum", "energy") for least in sorted({1, n})]
        made = frames.with_trailing(rows, {name: (F.col("x"), how, n, least) for name, how, least in kinds})
        assert made.columns == [*rows.columns, *[name for name, _, _ in kinds]]
        both = made.withColumns({f"w_{name}": trailing(F.col("x"), n, how, w, least) for name, how, least in kinds}).collect()
        for r in both:
            for name, _, _ in kinds:
                assert (r[name] is None) == (r[f"w_{name}"] is None) and (r[name] is None or r[name] == pytest.approx(r[f"w_{name}"], abs=1e-9)), (n, name)
    plan = frames.with_trailing(rows, {"m": (F.col("x"), "max", 50, 1)})._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"specifiedwindowframe\(RowFrame, ([^,]*),", plan)) <= {"unboundedpreceding$()", "-49"} and plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        frames.with_trailing(rows, {"m": (F.col("x"), "max", 0, 1)})
    with pytest.raises(ValueError):
        frames.with_trailing(rows, {"m": (F.col("x"), "median", 3, 1)})


def test_gaps_by_chunks_of_the_grid(spark):
    rows = []
    rng = random.Random(3)
    for symbol, n in (("long", 4000), ("short", 5), ("one", 1), (None, 40)):
        for k in range(n):
            if rng.random() < 0.8 or k in (0, n - 1):
                rows.append((symbol, 300 * k + (7 if rng.random() < 0.05 and k else 0)))
    rows += rows[:20] + [("hole", 0), ("hole", 300 * 100_000), ("none", None), ("off", 0), ("off", 950)]
    df = spark.createDataFrame(rows, "symbol string, s long").select("symbol", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"))
    want = set()
    for symbol in {s for s, _ in rows}:
        mine = {t for s, t in rows if s == symbol and t is not None}
        if mine:
            want |= {(symbol, t) for t in range(min(mine), max(mine) + 1, 300)} - {(symbol, t) for t in mine}
    for chunk in (1, 7, 4096):
        holes = Q.gaps(df, 300, chunk)
        got = [(r.symbol, int((r.missing_timestamp - datetime(1970, 1, 1)).total_seconds())) for r in Q.listed(holes, "timestamp_ntz", chunk=chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert holes.agg(F.sum("n")).first()[0] == len(want)
    few = {r.symbol: (r.m, [x.timestamp() for x in r.missing_preview]) for r in Q.first_missing(Q.gaps(df, 300), "timestamp", 4).collect()}
    for symbol, (m, shown) in few.items():
        mine = sorted(t for s, t in want if s == symbol)
        assert m == len(mine) and shown == mine[:4]


def test_buckets_join_without_an_exchange(spark):
    left = bars(spark, 1500, 3).select("symbol", "timestamp", "close")
    right = left.where("hash(timestamp) % 3 = 0").select("symbol", "timestamp", F.lit(0.5).alias("y_score"), F.lit(1.0).alias("close"))
    odd = left.limit(2).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    T.write_buckets(left.unionByName(odd.limit(1)), "t_left", 4)
    T.write_buckets(right, "t_right", 4)
    joined = T.join_buckets(spark, "t_left", "t_right")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = T.join_predictions(left.unionByName(odd.limit(1)), right)
    assert joined.columns == want.columns and sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
    T.write_buckets(right.unionByName(right.limit(1)), "t_twice", 4)
    for a, b in (("t_left", "t_twice"), ("t_twice", "t_left")):
        with pytest.raises(PySparkException):
            T.join_buckets(spark, a, b).collect()
    for name in ("t_left", "t_right", "t_twice"):
        spark.sql(f"DROP TABLE {name}")


def test_metrics_of_a_grid(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('m', id % 3) AS model_name", "CASE WHEN id % 2 = 0 THEN 'test' ELSE 'validation' END AS split", "'s' AS symbol", "id AS timestamp", "cast(hash(id) % 3 = 0 AS int) AS y_true", "abs(hash(id, 1) % 40) / 40.0D AS y_score")
    got = E.grid(rows, thresholds=(0.3, 0.5), fractions=(0.1, 1.0))
    assert [(r["model_name"], r["split"]) for r in got] == [(f"m{k}", s) for k in range(3) for s in ("test", "validation")]
    for r in got:
        want = E.compute(rows.where((F.col("model_name") == r["model_name"]) & (F.col("split") == r["split"])), "binary", (0.3, 0.5), (0.1, 1.0))
        for a, b in ((E.flatten(r), E.flatten(want)),):
            assert {k: pytest.approx(v) for k, v in b.items()} == {k: v for k, v in a.items() if k not in ("model_name", "split")}
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            E.at_top(rows, [0.5, bad])


def test_evaluation_is_written(spark, tmp_path):
    rows = spark.range(240).selectExpr("cast(id % 17 AS double) AS a", "'s' AS symbol", "timestamp_seconds(id) AS timestamp", "cast(id % 17 > 8 AS int) AS y", "CASE WHEN id < 160 THEN 'train' WHEN id < 200 THEN 'validation' ELSE 'test' END AS split")
    data = M.dataset(rows, ["a"], "y")
    M.train_all({"most": {"estimator": "majority"}, "line": {"estimator": "logistic", "params": {"max_iter": 20}}}, data, f"{tmp_path}/models", "7")
    summary = R.read_json(f"{tmp_path}/models/training_summary.json")
    assert summary["model_version"] == "7" and (summary["num_train_rows"], summary["num_validation_rows"], summary["num_test_rows"]) == (160, 40, 40) and set(summary["models"]) == {"line", "most"}
    flat = M.evaluate(f"{tmp_path}/models", data, out=f"file:{tmp_path}/out")
    plain = M.evaluate(f"{tmp_path}/models", data)
    assert [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for r in plain] == flat
    written = R.read_json(f"{tmp_path}/out/evaluation_summary.json")
    assert written["num_models"] == 2 and written["num_results"] == 4 and written["results"][0]["top_fraction_metrics"]["0.1"]["k"] == 4
    table = spark.read.option("header", True).csv(f"{tmp_path}/out/metrics_table.csv")
    assert table.count() == 4 and "threshold_metrics.0.5.f1" in table.columns
    kept = spark.read.parquet(f"{tmp_path}/out/predictions")
    assert kept.where("model_name = 'line' AND split = 'test'").count() == 40 and {"y_true", "y_score", "y_pred_at_0_5"} <= set(kept.columns)
    assert "line" in R.read_text(f"{tmp_path}/out/evaluation_report.md")
    with pytest.raises(FileNotFoundError):
        M.evaluate(f"{tmp_path}/nothing", data)


def test_sigmoid_calibration(spark):
    rng = random.Random(1)
    held = [(s := rng.random(), int(rng.random() < 1 / (1 + math.exp(-6 * s + 2)))) for _ in range(800)]
    df = spark.createDataFrame([*held, (None, 1), (0.5, None)], "y_score double, y_true int")
    a, b = M.sigmoid(df)
    n1 = sum(y for _, y in held)
    low, high = 1 / (len(held) - n1 + 2), (n1 + 1) / (n1 + 2)

    def loss(a, b):
        total = 0.0
        for s, y in held:
            t, p = (high if y else low), 1 / (1 + math.exp(a * s + b))
            total -= t * math.log(p) + (1 - t) * math.log(1 - p)
        return total

    best = loss(a, b)
    assert -8 < a < -4 and all(loss(a + da, b + db) > best for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))
    parted = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.9, 1), (1.0, 1)], "y_score double, y_true int")
    made = M.calibrate(parted, method="sigmoid")(parted).orderBy("y_score").collect()
    assert all(x.y_calibrated < y.y_calibrated for x, y in zip(made, made[1:], strict=False)) and 0 < made[0].y_calibrated < 0.5 < made[-1].y_calibrated < 1
    with pytest.raises(ValueError):
        M.calibrate(df, method="other")
    with pytest.raises(ValueError):
        M.sigmoid(df.where("false"))


def test_builders_by_chunks(spark):
    rows = bars(spark, 400, 2)
    plain, chunked = (sorted(map(str, L.build(rows, 5, 0.7, 0.8, n).collect())) for n in (None, 60))
    assert plain == chunked
    made = L.build(rows, 5, 0.7, 0.8).where("y_high_vol_5 IS NOT NULL")
    assert sorted(map(str, S.build(made, 5, 0.7, 0.15, 0.15, 3, 0.8).collect())) == sorted(map(str, S.build(made, 5, 0.7, 0.15, 0.15, 3, 0.8, placed=True).collect()))
    odd = rows.where("hash(timestamp) % 9 <> 0").unionByName(rows.limit(5)).withColumn("close", F.expr("CASE WHEN hash(timestamp) % 7 = 0 THEN close * 2 ELSE close END"))
    a, b = (sorted(map(str, Q.validate(odd, 300, 0.1, n).collect())) for n in (None, 50))
    assert a == b


def test_side_files_on_any_file_system(spark, tmp_path):
    R.write_json(f"file:{tmp_path}/deep/er/x.json", {"a": 1})
    assert R.read_json(f"file:{tmp_path}/deep/er/x.json") == {"a": 1} == R.read_config(f"file:{tmp_path}/deep/er/x.json")
    assert R.read_text(f"file:{tmp_path}/none", "n") == "n"
    with pytest.raises(FileNotFoundError):
        R.read_config(f"file:{tmp_path}/none.json")


def test_drift_from_sketches(spark):
    made = "cast(date_add(DATE '2024-01-01', cast(id % 20 AS int)) AS timestamp_ntz) AS timestamp"
    rows = ranged.staged(spark.range(40_000).selectExpr(made, "rand(1) + (id % 20) / 40.0D AS x", "cast(id % 4 AS double) AS few", "CASE WHEN id % 20 < 10 THEN 1.0D END AS early"), "days")
    features = ["x", "few", "early"]
    early, late = rows.where("timestamp < '2024-01-11'"), rows.where("timestamp >= '2024-01-11'")
    exact = {r.feature: r.psi for r in D.stability(D.long_form(early, features, "reference").unionByName(D.long_form(late, features, "current")), 10).collect()}
    for k in (500, 8000):
        stored = ranged.staged(D.day_sketches(rows, features, k), "sketches")
        assert stored.count() == 50 and stored.agg(F.sum("n")).first()[0] == 100_000
        got = {r.feature: r.psi for r in D.sketched_stability(D.of_period(stored, None, "2024-01-10"), D.of_period(stored, "2024-01-11")).collect()}
        # each share may be off by the error: as much as that changes (b - a) ln(b / a) of ten bins
        off = D.rank_error(k, True)
        assert got["x"] == pytest.approx(exact["x"], abs=10 * off * (abs(math.log(1e-6)) if k < 1000 else 8)) and got["few"] == pytest.approx(exact["few"], abs=0.05) and got["early"] is None and exact.get("early") is None
    stored = D.day_sketches(rows.where("timestamp <= '2024-01-02'"), ["few"], 8000)  # few enough values to hold them all
    one, two = D.of_period(stored, "2024-01-01", "2024-01-01"), D.of_period(stored, "2024-01-02", "2024-01-02")
    assert D.sketched_stability(one, one).first().psi == 0
    # all of the first day is 0, all of the second 1: no inner edge, so one bin
    assert D.sketched_stability(one, two).first().psi == 0
    assert D.sketched_stability(D.of_period(stored, "2030-01-01"), one).first().psi is None


def test_sensitivity_query_asks_for_its_own_quantiles(spark):
    got = catalog.QUERIES["quantile_sensitivity"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.quantile for r in got) == [0.7, 0.8, 0.9, 0.95]


def test_bits_of_rows_are_made_once(spark, monkeypatch):
    plans, write = {}, ranged.staged
    monkeypatch.setattr(ranged, "staged", lambda df, name: (plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString().upper()), write(df, name))[1])
    rows = spark.range(5000).selectExpr("id % 3 AS k", "sin(id) * pow(10, id % 9) AS v")
    got = {(r.k, r.q): r.value for r in ranged.quantiles(rows, "v", [0.1, 0.5], ("k",), small=0).collect()}
    want = {r.k: r.q for r in rows.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    assert got == {(k, q): pytest.approx(v) for k, two in want.items() for q, v in zip((0.1, 0.5), two, strict=True)}
    # one logarithm a row, and none in the four passes over the bits
    assert sum(p.count("LOG2(") for p in plans.get("bits", [])) == 1 and not any("LOG2(" in p for p in plans["digits"])


def test_regression_makes_the_bits_of_errors_once(spark, monkeypatch):
    plans, write = [], ranged.staged
    monkeypatch.setattr(ranged, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().upper()), write(df, name))[1])
    monkeypatch.setattr(E, "quantiles", lambda df, column, qs: ranged.quantiles(df, column, qs, small=0))
    rows = spark.range(4001).selectExpr("sin(id) + 2 AS y_true", "2.0D AS y_pred")
    got = E.regression(rows).first()
    assert got.median_ae == pytest.approx(rows.agg(F.expr("percentile(abs(y_true - y_pred), 0.5)")).first()[0]) and got.n_rows == 4001
    assert sum(p.count("LOG2(") for p in plans) == 1


def test_equal_values_have_no_spread_in_long_frames(spark):
    rows = spark.range(40).selectExpr("concat('s', id % 2) AS symbol", "timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id AS int)) AS timestamp", "CASE WHEN id % 2 = 0 THEN 0.1D ELSE 29.27D END AS v")
    got = frames.with_trailing(rows, {"s": (F.col("v"), "std", 4, 1)}).collect()
    assert sorted(str(r.s) for r in got) == ["0.0"] * 38 + ["None"] * 2
