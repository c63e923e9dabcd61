"""Reference values by falling back from narrow to wide keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.operators.percentiles import group_percentiles


def fallback_reference(df: DataFrame, value: str, chains: list[list[str]], least_rows: int, name: str) -> DataFrame:
    """``df`` with the median of ``value`` in the narrowest key group of the chain with enough rows, and which level gave it.

    NULL keys match each other. The last chain may be empty: the whole table. Reference tables have one row per group with enough
    support; AQE broadcasts them where small.
    """
    found = []
    levels = []
    out = df
    for i, keys in enumerate(chains):
        ref = group_percentiles(df.select(*[F.col(k).alias(f"key{j}_") for j, k in enumerate(keys)], F.col(value).alias("value_")), [f"key{j}_" for j in range(len(keys))], "value_", {f"m{i}_": 0.5}, least_rows=least_rows).drop("n")
        if keys:
            on = F.lit(True)
            for j, k in enumerate(keys):
                on &= out[k].eqNullSafe(ref[f"key{j}_"])
            out = out.join(ref, on, "left").drop(*[f"key{j}_" for j in range(len(keys))])
        else:
            out = out.crossJoin(F.broadcast(ref.agg(F.first(f"m{i}_").alias(f"m{i}_"))))  # one row
        found.append(F.col(f"m{i}_"))
        levels.append(F.when(F.col(f"m{i}_").isNotNull(), F.lit("+".join(keys) or "all")))
    return out.select(*df.columns, F.coalesce(*found).alias(name), F.coalesce(*levels).alias(f"{name}_level"))
