"""Ridge regression from one pass of sufficient statistics, its selection, evaluation and explanation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.ml.features import Design, learn_design
from arzyab.operators.ranks import running_total
from arzyab.operators.rollup import union_all
from arzyab.sources.files import read_json, write_json


@dataclass
class Ridge:
    design: Design
    alpha: float
    coefficients: np.ndarray

    def predict(self, pdf: pd.DataFrame) -> np.ndarray:
        return self.design.matrix(pdf) @ self.coefficients

    def save(self, path: str) -> str:
        """The fitted model as one small JSON document."""
        return write_json(path, {"numeric": self.design.numeric, "binary": self.design.binary, "categorical": self.design.categorical, "alpha": self.alpha, "coefficients": list(map(float, self.coefficients))})

    @staticmethod
    def load(path: str) -> Ridge:
        d = read_json(path)
        pairs = lambda t: {k: tuple(v) for k, v in t.items()}
        return Ridge(Design(pairs(d["numeric"]), pairs(d["binary"]), d["categorical"]), d["alpha"], np.array(d["coefficients"]))

    def effects(self) -> list[tuple[str, float]]:
        return list(zip(self.design.names, map(float, self.coefficients)))


def _moments(df: DataFrame, design: Design, target: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all rows: each task adds up its own and hands over one p x (p + 1) matrix; the sum is by cell."""
    p = len(design.names)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p + 1))
        for pdf in batches:
            x = design.matrix(pdf)
            total += np.hstack([x.T @ x, (x.T @ pdf[target].to_numpy(float))[:, None]])
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"i": at, "v": flat[at]})

    flat = np.zeros(p * (p + 1))
    rows = df.where(F.col(target).isNotNull()).select(*design.columns, F.col(target).cast("double").alias(target))
    for i, v in rows.mapInPandas(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[i] = v
    m = flat.reshape(p, p + 1)
    return m[:, :p], m[:, p]


def solve(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Closed form; the intercept is not penalised."""
    penalty = np.full(len(xx), alpha)
    penalty[0] = 1e-9
    return np.linalg.solve(xx + np.diag(penalty), xy)


def fit_ridge(df: DataFrame, design: Design, target: str, alpha: float) -> Ridge:
    return Ridge(design, alpha, solve(*_moments(df, design, target), alpha))


def with_prediction(df: DataFrame, model: Ridge, name: str = "prediction") -> DataFrame:
    columns = model.design.columns

    def one(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(batch))

    one.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(one, "double")(F.struct(*[F.col(c) for c in columns])))


def metrics(predicted: DataFrame, target: str, by: list[str] | None = None, prediction: str = "prediction") -> DataFrame:
    """n, rmse and r2 of the log target, and absolute percent errors of exp: median, p75, p90, shares within 20, 30 and 50 %."""
    y, p = F.col(target), F.col(prediction)
    rows = predicted.where(y.isNotNull()).withColumns({"e_": y - p, "ape_": F.abs(F.exp(p - y) - 1) * 100})
    within = [F.avg((F.col("ape_") <= k).cast("int")).alias(f"within_{k}") for k in (20, 30, 50)]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e_") * F.col("e_"))).alias("rmse_log"), F.try_divide(F.sum(F.col("e_") * F.col("e_")), F.var_pop(y) * F.count(F.lit(1))).alias("u_"), F.percentile("ape_", 0.5).alias("median_ape"), F.percentile("ape_", 0.75).alias("p75_ape"), F.percentile("ape_", 0.9).alias("p90_ape"), *within).withColumn("r2_log", 1 - F.col("u_")).drop("u_")


def select_alpha(train: DataFrame, valid: DataFrame, design: Design, target: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> tuple[float, list[tuple[float, float]]]:
    """The penalty with the least error on the validation rows: X'X is taken once, and all candidates are scored in one pass."""
    xx, xy = _moments(train, design, target)
    models = [solve(xx, xy, a) for a in alphas]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sse, n = np.zeros(len(models)), 0
        for pdf in batches:
            x, y = design.matrix(pdf), pdf[target].to_numpy(float)
            sse += [((x @ c - y) ** 2).sum() for c in models]
            n += len(y)
        yield pd.DataFrame({"i": range(len(models)), "sse": sse, "n": n})

    rows = valid.where(F.col(target).isNotNull()).select(*design.columns, F.col(target).cast("double").alias(target)).mapInPandas(score, "i int, sse double, n long").groupBy("i").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).orderBy("i").collect()
    rmse = [(alphas[r.i], (r.sse / max(r.n, 1)) ** 0.5) for r in rows]
    return min(rmse, key=lambda x: x[1])[0], rmse


def contrast(df: DataFrame, model: Ridge, feature: str, low, high) -> DataFrame:
    """One row: mean of exp(prediction with the feature at high - at low) - 1, in percent, over all rows."""
    kind = df.schema[feature].dataType
    a = with_prediction(with_prediction(df.withColumn(feature, F.lit(low).cast(kind)), model, "low_").withColumn(feature, F.lit(high).cast(kind)), model, "high_")
    return a.agg(F.lit(feature).alias("feature"), F.avg((F.exp(F.col("high_") - F.col("low_")) - 1) * 100).alias("effect_pct"), F.count(F.lit(1)).alias("n"))


def permutation_importance(df: DataFrame, model: Ridge, target: str, blocks: dict[str, list[str]], id_columns: list[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, mean increase of the error when a block of columns is shuffled jointly.

    Shuffling is a join of the rows, numbered by one hash order, with themselves numbered by another; numbering is a range-partitioned
    prefix count, so nothing passes through one task. The orders come from hashes of ``id_columns``, which tell the rows apart, so results
    are the same between runs.
    """
    base = df.where(F.col(target).isNotNull()).select(*model.design.columns, target, F.xxhash64(*id_columns).alias("id_"))
    base = written(base)

    def numbered(salt: int) -> DataFrame:
        keyed = base.select("id_", F.xxhash64("id_", F.lit(seed), F.lit(salt)).alias("h_"), F.lit(1).alias("one_"))
        return running_total(keyed, [F.col("h_"), F.col("id_")], "one_", "n_").select("id_", "n_")

    y = F.col(target)
    error = lambda x: x.agg(F.sqrt(F.avg((y - F.col("prediction")) * (y - F.col("prediction")))).alias("e")).first().e or 0.0
    plain = error(with_prediction(base, model))
    rows = []
    for name, columns in blocks.items():
        gains = []
        for k in range(repeats):
            a, b = numbered(2 * k).withColumnRenamed("id_", "to_"), numbered(2 * k + 1).withColumnRenamed("id_", "from_")
            links = a.join(b, "n_").select("to_", "from_")
            moved = base.select(F.col("id_").alias("from_"), *[F.col(c).alias(f"{c}__m") for c in columns]).join(links, "from_")
            mixed = base.join(moved, base.id_ == moved.to_).select(*[(F.col(f"{c}__m").alias(c) if c in columns else base[c]) for c in [*model.design.columns, target]])
            gains.append(error(with_prediction(mixed, model)) - plain)
        rows.append((name, float(np.mean(gains)), float(np.std(gains)), repeats))
    return df.sparkSession.createDataFrame(rows, "feature string, rmse_increase double, spread double, repeats int")


def cross_fitted(df: DataFrame, numeric: list[str], binary: list[str], categorical: list[str], target: str, stratum: str, id_column: str, folds: int = 5, alpha: float = 1.0, least_frequency: int = 50) -> DataFrame:
    """``df`` with fold, prediction and residual: each row predicted by a model that was trained on the other folds. Folds are a hash of
    the id, which deals each stratum out evenly in expectation and needs no sort."""
    marked = df.withColumn("fold", F.pmod(F.xxhash64(F.col(stratum), F.col(id_column)), F.lit(folds)).cast("int"))
    parts = []
    for k in range(folds):
        rest = marked.where(F.col("fold") != k)
        model = fit_ridge(rest, learn_design(rest, numeric, binary, categorical, least_frequency), target, alpha)
        parts.append(with_prediction(marked.where(F.col("fold") == k), model))
    return union_all(parts).withColumn("residual", F.col(target) - F.col("prediction"))


def tree_benchmark(train: DataFrame, test: DataFrame, numeric: list[str], target: str, depth: int = 6, trees: int = 20, leaf: int = 10, seed: int = 42) -> DataFrame:
    """model, rmse_log, r2_log of a decision tree and a random forest on the same numeric columns (NULLs to the training median)."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    cast = lambda x: x.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in numeric], F.col(target).cast("double").alias("label"))
    imputer = Imputer(strategy="median", inputCols=numeric, outputCols=numeric).fit(cast(train))
    assemble = VectorAssembler(inputCols=numeric, outputCol="features")
    a, b = (assemble.transform(imputer.transform(cast(x))) for x in (train, test))
    rows = []
    for name, est in (("decision_tree", DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, seed=seed)), ("random_forest", RandomForestRegressor(maxDepth=depth, minInstancesPerNode=leaf, numTrees=trees, seed=seed))):
        m = metrics(est.fit(a).transform(b), "label").first()
        rows.append((name, m.n, m.rmse_log, m.r2_log))
    return train.sparkSession.createDataFrame(rows, "model string, n long, rmse_log double, r2_log double")
