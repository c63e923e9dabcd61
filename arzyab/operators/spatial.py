"""Points in polygons, coordinate audits and repeatable stratified samples."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polygons_of(geometry: dict) -> list[np.ndarray]:
    """Each polygon of a GeoJSON geometry or FeatureCollection as an edge table x1, y1, x2, y2 over all its rings."""
    if geometry.get("type") == "FeatureCollection":
        return [p for f in geometry["features"] for p in polygons_of(f["geometry"])]
    if geometry.get("type") == "Feature":
        return polygons_of(geometry["geometry"])
    shapes = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(geometry.get("type"), lambda c: [])(geometry.get("coordinates") or [])
    out = []
    for rings in shapes:
        edges = []
        for ring in rings:
            xy = np.asarray(ring, dtype=float)[:, :2]
            if len(xy) >= 3:
                edges.append(np.hstack([xy, np.roll(xy, -1, axis=0)]))
        if edges:
            out.append(np.vstack(edges))
    return out


def inside(x: np.ndarray, y: np.ndarray, edges: np.ndarray, block: int = 4096) -> np.ndarray:
    """Even-odd rule over all rings at once, so a hole's edges undo its outer ring's. NaN is outside."""
    x1, y1, x2, y2 = edges.T
    slope = (x2 - x1) / np.where(y2 == y1, 1.0, y2 - y1)
    out = np.zeros(len(x), dtype=bool)
    for a in range(0, len(x), block):
        px, py = x[a : a + block, None], y[a : a + block, None]
        out[a : a + block] = (((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * slope)).sum(axis=1) % 2 == 1
    return out


def within(df: DataFrame, x: str, y: str, geometry: dict, name: str) -> DataFrame:
    """``df`` with a flag: the point lies in any polygon; NULL coordinates give NULL. The polygons are a parameter of fixed size; a
    bounding box test in the JVM keeps points that are surely outside from being tested edge by edge."""
    polygons = polygons_of(geometry)
    if not polygons:
        return df.withColumn(name, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(False)))
    every = np.vstack(polygons)
    box = F.col(x).between(float(every[:, [0, 2]].min()), float(every[:, [0, 2]].max())) & F.col(y).between(float(every[:, [1, 3]].min()), float(every[:, [1, 3]].max()))

    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        px, py = a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)
        known = np.flatnonzero(~np.isnan(px) & ~np.isnan(py))
        hit = np.zeros(len(px), dtype=bool)
        for p in polygons:
            hit[known] |= inside(px[known], py[known], p)
        return pd.Series(hit)

    hit = F.pandas_udf(test, "boolean")(F.when(box, F.col(x).cast("double")), F.when(box, F.col(y).cast("double")))
    return df.withColumn(name, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), hit & box))


def stratified_sample(df: DataFrame, stratum: str, key: list[str], most: int, boost: dict[str, int] | None = None) -> DataFrame:
    """Up to ``most`` rows of each stratum (``boost``: other numbers for named ones), those with the smallest SHA-256 of the key."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256), *key)
    limit = F.lit(most)
    for s, n in (boost or {}).items():
        limit = F.when(F.col(stratum) == s, F.lit(n)).otherwise(limit)
    return df.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= limit).drop("place_")


def coordinate_reuse(df: DataFrame, lat: str, lon: str, digits: int = 6) -> DataFrame:
    """uses, pairs, rows: how many coordinate pairs occur how often."""
    pairs = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.round(lat, digits), F.round(lon, digits)).agg(F.count(F.lit(1)).alias("uses"))
    return pairs.groupBy("uses").agg(F.count(F.lit(1)).alias("pairs"), F.sum("uses").alias("rows"))


def place_tokens(c: Column) -> Column:
    """Tokens of a place name for matching: lower case, plain letters, without common nouns."""
    plain = F.regexp_replace(F.lower(F.translate(c, "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")), "[^a-z0-9]+", " ")
    return F.array_except(F.array_remove(F.split(F.trim(plain), " "), ""), F.array(*[F.lit(w) for w in ("city", "county", "district", "province", "of", "the", "shahrestan", "ostan", "bakhsh")]))


def names_agree(a: Column, b: Column) -> Column:
    """Whether all tokens of one name are among the other's; NULL or empty names never agree."""
    x, y = place_tokens(a), place_tokens(b)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)), F.lit(False))


def replay_summary(replies: DataFrame, country: float = 0.98, request: float = 0.95, locality: float = 0.85) -> DataFrame:
    """One row of a saved reverse-geocode sample: rates, the core gate (requests and country) and the locality diagnostic."""
    ok = F.col("request_status") == "ok"
    rates = replies.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("int")).alias("request_rate"), F.avg(F.when(ok, F.col("country_match").cast("int"))).alias("country_rate"), F.avg(F.when(ok, F.col("locality_match").cast("int"))).alias("locality_rate"))
    core = (F.col("request_rate") >= request) & (F.col("country_rate") >= country)
    return rates.withColumn("core_gate", F.when(core, "PASS").otherwise("FAIL")).withColumn("status", F.when(~core, "FAIL").when(F.col("locality_rate") >= locality, "PASS").otherwise("REVIEW"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
