"""Scores of trained models at each bar, by the newest version of a table of models; momentum speaks where there is none."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W

Predict = Callable[[np.ndarray], np.ndarray]


def loaded(kind: str, payload: bytes) -> Predict:
    """linear: JSON with weights and bias; onnx: a graph whose first input takes rows of features as floats."""
    if kind == "linear":
        model = json.loads(payload)
        weights, bias = np.array(model["weights"], float), float(model["bias"])
        return lambda x: x @ weights + bias
    if kind == "onnx":
        import onnxruntime

        session = onnxruntime.InferenceSession(bytes(payload), providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: np.asarray(session.run(None, {name: x.astype(np.float32)})[0], float).reshape(len(x), -1)[:, -1]
    raise ValueError(f"no models of kind {kind}")


def newest(models: DataFrame) -> DataFrame:
    """(model, kind, payload): the newest version of each of models(model, version, kind, payload)."""
    best = F.max_by(F.struct("kind", "payload"), "version")
    return models.where("payload is not null").groupBy("model").agg(best.alias("b")).select("model", "b.kind", "b.payload")


def momentum_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """bars with ret, the close's change (0 at first), and mom, the close less its exponential mean."""
    ret = F.coalesce(F.try_divide(F.col("c"), F.lag("c").over(W.ordered())) - 1, F.lit(0.0))
    x = W.with_emas(bars, {"ema": n}, "first")
    return x.withColumn("ret", ret).withColumn("mom", F.col("c") - F.col("ema")).drop("ema")


def with_scores(rows: DataFrame, models: DataFrame, model: Column, features: list[str], most_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """rows with score: what the newest version of the model that ``model`` names makes of the features; null where there is no
    such model, a feature is missing or the model fails.

    Models of up to most_bytes in all are broadcast, each loaded once a task. Larger ones are joined by name, rows of one name
    being dealt over ``salts`` groups.
    """
    named, latest = rows.withColumn("_m", model), newest(models)
    size = latest.agg(F.sum(F.length("payload"))).first()[0] or 0

    def scored(predict: Predict | None, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        ok = np.isfinite(x).all(axis=1)
        if predict is not None and ok.any():
            try:
                out[ok] = predict(x[ok])
            except Exception:  # noqa: BLE001  a model that fails has nothing to say
                out[ok] = np.nan
        return out

    if size <= most_bytes:
        sent = named.sparkSession.sparkContext.broadcast({r["model"]: (r["kind"], bytes(r["payload"])) for r in latest.toLocalIterator()})
        held: dict[str, Predict] = {}

        @F.pandas_udf("double")
        def score(name, *columns):
            x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
            out = np.full(len(x), np.nan)
            for m in name.dropna().unique():
                if m in sent.value:
                    if m not in held:
                        held[m] = loaded(*sent.value[m])
                    at = (name == m).to_numpy(bool)
                    out[at] = scored(held[m], x[at])
            return pd.Series(out)

        out = named.withColumn("score", score("_m", *[F.col(c).cast("double") for c in features]))
        return out.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).drop("_m")

    schema = named.drop("_m").schema
    every = latest.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("model", "_m")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double"

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.stack([np.array(left.column(c).to_pylist(), float) for c in features], axis=1) if len(left) else np.zeros((0, len(features)))
        predict = loaded(right.column("kind")[0].as_py(), right.column("payload")[0].as_py()) if len(right) and len(left) else None
        return left.select(schema.names).append_column("score", pa.array(scored(predict, x), from_pandas=True))

    dealt = named.withColumn("_s", F.pmod(F.xxhash64(*features), F.lit(salts)).cast("int"))
    return dealt.groupBy("_m", "_s").cogroup(every.groupBy("_m", "_s")).applyInArrow(group, ddl)


def model_signals(bars: DataFrame, models: DataFrame, model: Column, n: int = 20) -> DataFrame:
    """(symbol, t, score, action, reason) of bars: by the sign of the score of (ret, mom), or of the momentum where the bar's
    model does not exist. A score that is 0 or missing is FLAT."""
    known = newest(models).select(F.col("model").alias("_known"))
    rows = with_scores(momentum_features(bars, n).withColumn("_name", model), models, F.col("_name"), ["ret", "mom"])
    rows = rows.join(known, F.col("_name") == F.col("_known"), "left")
    by = F.when(F.col("_known").isNotNull(), F.coalesce("score", F.lit(0.0))).otherwise(F.col("mom"))
    word = F.when(F.col("_known").isNotNull(), "ml_").otherwise("ml_fallback_")
    return rows.select("symbol", "t", "score", F.when(by > 0, "BUY").when(by < 0, "SELL").otherwise("FLAT").alias("action"), F.when(by > 0, F.concat(word, F.lit("up"))).when(by < 0, F.concat(word, F.lit("down"))).alias("reason"))
