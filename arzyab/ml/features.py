"""Design matrices: what a table teaches about imputing, scaling and encoding, and the matrix of a batch of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "__missing__"


@dataclass
class Design:
    """numeric: name -> (median, mean, deviation); binary: name -> (mode, mean, deviation); categorical: name -> levels kept."""

    numeric: dict[str, tuple[float, float, float]]
    binary: dict[str, tuple[float, float, float]]
    categorical: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        out = ["(intercept)"]
        for n in [*self.numeric, *self.binary]:
            out += [n, f"{n}:missing"]
        return out + [f"{n}={v}" for n, vs in self.categorical.items() for v in vs]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """Rows x names; unseen and rare levels are all zeros."""
        x = np.zeros((len(pdf), len(self.names)))
        x[:, 0] = 1
        j = 1
        for table in (self.numeric, self.binary):
            for n, (fill, mean, sd) in table.items():
                v = pd.to_numeric(pdf[n], errors="coerce").to_numpy(float, na_value=np.nan) if pdf[n].dtype != bool else pdf[n].to_numpy(float)
                gone = np.isnan(v)
                x[:, j] = (np.where(gone, fill, v) - mean) / sd
                x[:, j + 1] = gone
                j += 2
        for n, levels in self.categorical.items():
            at = pdf[n].astype(object).where(pdf[n].notna() & (pdf[n] != ""), MISSING).map({v: k for k, v in enumerate(levels)})
            rows = np.flatnonzero(at.notna())
            x[rows, j + at.iloc[rows].to_numpy(int)] = 1
            j += len(levels)
        return x


def learn_design(df: DataFrame, numeric: list[str], binary: list[str], categorical: list[str], least_frequency: int = 50) -> Design:
    """One aggregate for all medians, modes and moments; one grouped count for the levels (kept: those frequent enough)."""
    v = lambda n: F.col(n).cast("double")
    aggs = [f for n in numeric for f in (F.percentile(v(n), 0.5).alias(f"m_{n}"), F.avg(v(n)).alias(f"a_{n}"), F.stddev_pop(v(n)).alias(f"s_{n}"))]
    aggs += [f for n in binary for f in (F.avg(v(n)).alias(f"a_{n}"), F.stddev_pop(v(n)).alias(f"s_{n}"))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first().asDict()
    sd = lambda n: row[f"s_{n}"] or 1.0
    levels: dict[str, list[str]] = {n: [] for n in categorical}
    if categorical:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit(MISSING)).alias("level")) for n in categorical])).alias("x")).select("x.*")
        for r in pairs.groupBy("name", "level").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_frequency).orderBy("name", "level").collect():
            levels[r.name].append(r.level)
    return Design(
        {n: (row[f"m_{n}"] or 0.0, row[f"a_{n}"] or 0.0, sd(n)) for n in numeric},
        {n: (float((row[f"a_{n}"] or 0.0) >= 0.5), row[f"a_{n}"] or 0.0, sd(n)) for n in binary},
        levels,
    )
