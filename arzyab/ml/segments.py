"""Clustering with gates: candidates, internal indices, stability, and the choice among them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled_matrix(df: DataFrame, columns: list[str], least_coverage: float = 0.5) -> tuple[DataFrame, list[str]]:
    """``df`` with robustly scaled copies z_<column> (NULL to the median, centred, divided by the IQR) of columns given often enough."""
    aggs = [a for c in columns for a in (F.count(c).alias(f"n_{c}"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}"))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    used = [c for c in columns if row.n and row[f"n_{c}"] / row.n >= least_coverage]
    scaled = {f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(row[f"q_{c}"][1])) - row[f"q_{c}"][1]) / ((row[f"q_{c}"][2] - row[f"q_{c}"][0]) or 1.0) for c in used}
    return df.withColumns(scaled), [f"z_{c}" for c in used]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean Euclidean silhouette of a sample."""
    sq = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0))
    groups = np.unique(label)
    sums = np.stack([d[:, label == g].sum(axis=1) for g in groups], axis=1)
    size = np.array([(label == g).sum() for g in groups])
    own = np.searchsorted(groups, label)
    r = np.arange(len(x))
    a = sums[r, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[r, own] = np.inf
    b = other.min(axis=1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def indices(labelled: DataFrame, columns: list[str], label: str = "cluster") -> tuple[float, float, float]:
    """(Calinski-Harabasz, Davies-Bouldin, smallest share) over all rows from grouped sums."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns]]
    rows = labelled.groupBy(label).agg(*aggs).collect()
    n = np.array([r.n for r in rows], dtype=float)
    s = np.array([[r[f"s_{c}"] for c in columns] for r in rows])
    q = np.array([[r[f"q_{c}"] for c in columns] for r in rows])
    centre = s / n[:, None]
    within = (q - s * centre).sum(axis=1)
    between = (n[:, None] * (centre - s.sum(axis=0) / n.sum()) ** 2).sum()
    k = len(rows)
    ch = (between / max(k - 1, 1)) / max(within.sum() / max(n.sum() - k, 1), 1e-12)
    # mean distance to the centre needs the rows again
    at = {r[label]: i for i, r in enumerate(rows)}
    dist = F.sqrt(sum((F.pow(F.col(c) - F.element_at(F.create_map(*[F.lit(v) for g, i in at.items() for v in (g, float(centre[i, j]))]), F.col(label)), 2) for j, c in enumerate(columns)), F.lit(0.0)))
    spread = {r[label]: r.d for r in labelled.groupBy(label).agg(F.avg(dist).alias("d")).collect()}
    sd = np.array([spread[r[label]] for r in rows])
    gap = np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + np.diag(np.full(k, np.inf))
    db = float(((sd[:, None] + sd) / gap).max(axis=1).mean()) if k > 1 else float("inf")
    return float(ch), db, float(n.min() / n.sum())


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """Adjusted Rand index from the contingency counts."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).collect()
    pairs = lambda v: float(sum(x * (x - 1) / 2 for x in v))
    ra, rb = {}, {}
    for r in cells:
        ra[r[a]] = ra.get(r[a], 0) + r.n
        rb[r[b]] = rb.get(r[b], 0) + r.n
    n = sum(ra.values())
    expected = pairs(ra.values()) * pairs(rb.values()) / max(n * (n - 1) / 2, 1)
    most = (pairs(ra.values()) + pairs(rb.values())) / 2
    return 1.0 if most == expected else (pairs([r.n for r in cells]) - expected) / (most - expected)


def candidates(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 4, 5), seed: int = 42, sample: int = 3000) -> DataFrame:
    """k, silhouette (of a sample, a documented bound), Calinski-Harabasz, Davies-Bouldin, smallest share, stability (mean adjusted Rand
    index of refits with other seeds against the first), passed (all gates)."""
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    rows = []
    for k in ks:
        fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol=f"c{i}", maxIter=20).fit(x) for i in range(3)]
        out = x
        for f in fits:
            out = f.transform(out)
        part = out.orderBy(F.xxhash64(*columns)).limit(sample).select(*columns, "c0").toPandas()
        sil = silhouette(part[columns].to_numpy(float), part["c0"].to_numpy()) if len(part) > k else 0.0
        ch, db, least = indices(out.withColumnRenamed("c0", "cluster"), columns)
        ari = float(np.mean([adjusted_rand(out, "c0", f"c{i}") for i in (1, 2)]))
        rows.append((k, sil, ch, db, least, ari, bool(sil >= 0.15 and ch >= 100 and db <= 2.5 and least >= 0.03 and ari >= 0.70)))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, least_share double, stability double, passed boolean")


def choose(table: DataFrame) -> int | None:
    """The passing candidate with the best silhouette, then stability; None: use the rule typology."""
    best = table.where("passed").orderBy(F.desc("silhouette"), F.desc("stability"), "k").first()
    return best.k if best else None
