"""Tests and intervals from grouped moments and rank sums. Each test shuffles one row per group or distinct value.

Only the tails of t and chi-square need Python, on one summary row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arzyab.operators.ranks import running_total


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    return 1.0 if x >= 1 else front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def chi2_tail(x: float, k: float) -> float:
    """Upper tail of chi-square with k degrees of freedom."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def with_p(df: DataFrame, kind: str, statistic: str, df_column: str | None = None) -> DataFrame:
    """Summary rows with their p-value; kind is normal, t or chi2."""
    tail = {"normal": lambda s, _: normal_tail(s), "t": t_tail, "chi2": chi2_tail}[kind]

    def p(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else tail(float(a), float(b)) for a, b in zip(s, d)], dtype="float64")

    return df.withColumn("p_value", F.pandas_udf(p, "double")(F.col(statistic).cast("double"), (F.col(df_column) if df_column else F.lit(0.0)).cast("double")))


def welch(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: counts, difference of means (a - b), standard error, t, degrees of freedom and normal 95 % interval."""
    at = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    m = df.agg(*[f(at(g)).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = F.sqrt(va + vb)
    d = F.col("mean_a") - F.col("mean_b")
    return m.select("n_a", "n_b", d.alias("difference"), se.alias("se"), F.try_divide(d, se).alias("t"), F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)).alias("df"), (d - 1.96 * se).alias("low"), (d + 1.96 * se).alias("high"))


def _value_ranks(df: DataFrame, value: str, counts: list[Column]) -> DataFrame:
    """v, n, the given counts, and the average rank of each distinct value."""
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), *counts)
    return running_total(by, "v", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: n_a, n_b, U of a, and z with ties corrected (no continuity correction)."""
    rows = df.where(F.col(group).isin(a, b))
    r = _value_ranks(rows, value, [F.count_if(F.col(group) == a).alias("k_a")])
    s = r.agg(F.sum("n").cast("double").alias("n"), F.sum("k_a").cast("double").alias("n_a"), F.sum(F.col("rank") * F.col("k_a")).alias("r_a"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n, na = F.col("n"), F.col("n_a")
    nb = n - na
    u = F.col("r_a") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), u.alias("u"), F.try_divide(u - na * nb / 2, sd).alias("z"))


def kruskal(df: DataFrame, group: str, value: str, least_rows: int = 20) -> DataFrame:
    """One row: groups and rows used (groups with enough rows), H with ties corrected, degrees of freedom."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_rows).select("g")
    rows = rows.join(large, "g", "left_semi")
    ranks = _value_ranks(rows, "v", [])
    per = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k")).join(ranks.select("v", "rank"), "v").groupBy("g").agg(F.sum("k").alias("k"), F.sum(F.col("rank") * F.col("k")).alias("r"))
    s = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("k").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("q"))
    t = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return s.crossJoin(t).select("groups", n.cast("long").alias("n"), h.alias("h"), (F.col("groups") - 1).alias("df"))  # one row each


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs and the correlation of average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    one = lambda c, r: running_total(rows.groupBy(c).agg(F.sum("k").alias("n")), c, "n").select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(r))
    j = rows.join(one("x", "rx"), "x").join(one("y", "ry"), "y")
    k = F.col("k").cast("double")
    s = j.agg(F.sum(k).alias("n"), *[F.sum(k * e).alias(a) for a, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("xx", F.col("rx") * F.col("rx")), ("yy", F.col("ry") * F.col("ry")), ("xy", F.col("rx") * F.col("ry")))])
    n = F.col("n")
    return s.select(n.cast("long").alias("n"), F.try_divide(n * F.col("xy") - F.col("sx") * F.col("sy"), F.sqrt((n * F.col("xx") - F.col("sx") * F.col("sx")) * (n * F.col("yy") - F.col("sy") * F.col("sy")))).alias("rho"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """``df`` with q_value: p * m / place, made monotone from the largest p downwards, at most 1. NULL p: NULL q.

    A family is a set of tests, small by nature; families are windows of their own.
    """
    keys = [*(family or []), F.col(p).isNull()]
    up = Window.partitionBy(*keys).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*keys))
    raw = df.withColumn("raw_", F.col(p) * m / F.row_number().over(up))
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q_value", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("raw_").over(down)))).drop("raw_")


def bootstrap_mean(df: DataFrame, group: str, value: str, id_column: str, runs: int = 250, seed: int = 42, least_rows: int = 5) -> DataFrame:
    """group, n, mean and 95 % bounds of Poisson-bootstrap means.

    A row's weight in each run comes from a hash of its id, its value and the run, so results are the same between runs and however the
    rows are partitioned. The weights of a batch are drawn at once, and a batch hands on sums by group and run only. NULL groups are a
    group; NULL values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(value).cast("double").alias("v"), F.xxhash64(id_column, value, F.lit(seed)).alias("h"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    salts = np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, names = pd.factorize(pdf["group"], use_na_sentinel=False)
            sums = np.zeros((2, len(names), runs))
            for at in range(0, len(pdf), 2048):
                part = slice(at, at + 2048)
                x = pdf["h"].to_numpy(np.int64)[part].view(np.uint64)[:, None] ^ salts
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                weight = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53, side="right").astype(float)
                for g in np.unique(codes[part]):
                    on = codes[part] == g
                    sums[0, g] += pdf["v"].to_numpy(float)[part][on] @ weight[on]
                    sums[1, g] += weight[on].sum(axis=0)
            yield pd.DataFrame({"group": np.repeat(np.array([None if pd.isna(n) else n for n in names], dtype=object), runs), "run": np.tile(np.arange(runs), len(names)), "a": sums[0].ravel(), "b": sums[1].ravel()})

    runs_of = rows.mapInPandas(partial, "group string, run int, a double, b double").groupBy("group", "run").agg(F.try_divide(F.sum("a"), F.sum("b")).alias("m"))
    bounds = runs_of.groupBy("group").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).where(F.col("n") >= least_rows).join(bounds.withColumnRenamed("group", "of_"), F.col("group").eqNullSafe(F.col("of_"))).drop("of_")


def strata_effect(df: DataFrame, strata: list[str], group: str, a: str, b: str, value: str, least_rows: int = 5) -> DataFrame:
    """One row: strata compared, effect exp(weighted mean difference) - 1; strata need all keys and enough rows of both groups; the
    weight is the smaller count."""
    complete = df
    for s in strata:
        complete = complete.where(F.col(s).isNotNull())
    at = lambda g: F.when(F.col(group) == g, F.col(value))
    by = complete.groupBy(*strata).agg(F.count(at(a)).alias("n_a"), F.count(at(b)).alias("n_b"), F.avg(at(a)).alias("m_a"), F.avg(at(b)).alias("m_b")).where((F.col("n_a") >= least_rows) & (F.col("n_b") >= least_rows))
    w = F.least("n_a", "n_b").cast("double")
    return by.agg(F.count(F.lit(1)).alias("strata"), F.sum(w).alias("weight"), (F.exp(F.sum(w * (F.col("m_a") - F.col("m_b"))) / F.sum(w)) - 1).alias("effect"))
