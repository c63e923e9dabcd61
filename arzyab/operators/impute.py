"""Filling missing values by expectation-maximisation on a mixture of Gaussian and categorical fields (problem 4).

Model: a hidden class z with weight; given z, numeric fields are independent Gaussians and categorical fields independent
multinomials (smoothed). A place implies its city, so its multinomial is one within each city. Rows with gaps take part through the
fields they have. The E step runs on the executors and hands over sufficient statistics only (classes x levels numbers per task, summed
by a grouped aggregate); the M step works on these sums. Rounds go on until the log-likelihood stands still. Numeric gaps get the
conditional expectation, categorical gaps the conditional mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.functions.text import fold, given
from arzyab.operators.missing import FIELDS, applies, listed, usable


@dataclass
class Mixture:
    """Parameters. numeric: names; mean, var: classes x numeric; levels: per field, level -> code; logp: per field, classes x levels."""

    numeric: list[str]
    levels: dict[str, dict[str, int]]
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    logp: dict[str, np.ndarray]
    loglik: list[float] = field(default_factory=list)

    def posterior(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
        """Class probabilities of each row, from the fields that are there (NaN and code -1: not there), and the log-likelihood."""
        out = np.tile(np.log(self.weight)[:, None], len(next(iter(x.values()))))  # classes x rows
        for j, name in enumerate(self.numeric):
            there = ~np.isnan(x[name])
            term = np.where(there, x[name], 0.0) - self.mean[:, j, None]
            term *= term
            term *= -0.5 / self.var[:, j, None]
            term -= 0.5 * np.log(2 * np.pi * self.var[:, j, None])
            term *= there
            out += term
        for name, table in self.logp.items():
            out += np.concatenate([table, np.zeros((len(table), 1))], axis=1)[:, x[name]]  # -1: the last column
        top = out.max(axis=0)
        out -= top
        p = np.exp(out, out=out)
        total = p.sum(axis=0)
        p /= total
        return p.T, float((np.log(total) + top).sum())


def _columns(pdf: pd.DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, np.ndarray]:
    return {n: pdf[n].to_numpy(dtype=float, na_value=np.nan) for n in numeric} | {n: pdf[n].to_numpy(dtype=np.int64) for n in categorical}


def fit_mixture(coded: DataFrame, numeric: list[str], levels: dict[str, dict[str, int]], classes: int = 8, rounds: int | None = None, tolerance: float = 1e-4, smoothing: float = 0.5, within: dict[str, np.ndarray] | None = None) -> Mixture:
    """EM over all rows of ``coded`` (id ``row``, numeric columns with NULL, categorical codes with -1 for NULL).

    Rounds end where the log-likelihood changes by at most the share ``tolerance``, or after ``rounds`` where that is given. Each
    round is one pass with a narrow result. The numbers sent to the driver depend on the classes and levels alone. An empty table
    gives a flat model. within: of a field's levels, the number of the level of another field that each implies; its probabilities
    then sum to one within each of these.
    """
    names = list(levels)
    sizes = [len(levels[n]) or 1 for n in names]
    offsets = np.cumsum([0, 1, *[3] * len(numeric), *sizes])  # per class: weight; n, sum, sum of squares; level counts
    width = int(offsets[-1])

    first = coded.agg(*[f(n).alias(f"{k}_{n}") for n in numeric for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}

    def start(row: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
        """A first class of each row: a cell of a grid over the numeric fields; where one is missing, its part is by the id's hash."""
        cell = np.zeros(len(row), dtype=np.int64)
        side = max(2, round(classes ** (1 / max(len(numeric), 1))))
        hashed = ((row * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
        for j, n in enumerate(numeric):
            z = (x[n] - (first[f"m_{n}"] or 0.0)) / (first[f"s_{n}"] or 1.0)
            known = ~np.isnan(z)
            part = np.where(known, np.clip((np.nan_to_num(z) + 1.5) / 3 * side, 0, side - 1).astype(np.int64), (hashed >> (8 * j)) % side)
            cell = cell * side + part
        return (cell if numeric else hashed) % classes

    def sums(model: Mixture | None) -> tuple[np.ndarray, float]:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, loglik = np.zeros((classes, width)), 0.0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _columns(pdf, numeric, names)
                if model is None:  # a start along the numeric fields, by row and not by partition
                    r = np.full((len(pdf), classes), 0.2 / classes)
                    r[np.arange(len(pdf)), start(pdf["row"].to_numpy(np.uint64), x)] += 0.8
                else:
                    r, part = model.posterior(x)
                    loglik += part
                total[:, 0] += r.sum(axis=0)
                for j, n in enumerate(numeric):
                    there = ~np.isnan(x[n])
                    v = np.where(there, x[n], 0.0)
                    total[:, 1 + 3 * j : 4 + 3 * j] += r.T @ np.stack([there, v, v * v], axis=1)
                for j, n in enumerate(names):
                    at = int(offsets[1 + len(numeric) + j])
                    code = x[n] + 1  # 0: not there
                    for k in range(classes):
                        total[k, at : at + sizes[j]] += np.bincount(code, weights=r[:, k], minlength=sizes[j] + 1)[1:]
            flat = np.append(total.ravel(), loglik)
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"i": at.astype(np.int64), "v": flat[at]})

        flat = np.zeros(classes * width + 1)
        for i, v in coded.mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[i] = v
        return flat[:-1].reshape(classes, width), float(flat[-1])

    def maximised(total: np.ndarray, history: list[float]) -> Mixture:
        weight = (total[:, 0] + 1) / (total[:, 0] + 1).sum()
        mean, var = np.zeros((classes, len(numeric))), np.ones((classes, len(numeric)))
        for j in range(len(numeric)):
            n, s, q = total[:, 1 + 3 * j : 4 + 3 * j].T
            all_mean = s.sum() / max(n.sum(), 1e-9)
            all_var = max(q.sum() / max(n.sum(), 1e-9) - all_mean**2, 1e-6)
            mean[:, j] = (s + all_mean) / (n + 1)
            var[:, j] = np.maximum((q + all_var + all_mean**2) / (n + 1) - mean[:, j] ** 2, 1e-4 * all_var + 1e-9)
        logp = {}
        for j, n in enumerate(names):
            at = int(offsets[1 + len(numeric) + j])
            c = total[:, at : at + sizes[j]]
            group = (within or {}).get(n, np.zeros(sizes[j], dtype=np.int64))
            size = smoothing * np.bincount(group)[group]
            prior = (c.sum(axis=0) + 1) / np.bincount(group, c.sum(axis=0) + 1)[group]
            held = np.stack([np.bincount(group, row)[group] for row in c])
            logp[n] = np.log((c + size * prior) / (held + size))
        return Mixture(numeric, levels, weight, mean, var, logp, history)

    history: list[float] = []
    model = maximised(sums(None)[0], history)
    while rounds is None or len(history) < rounds:
        total, loglik = sums(model)
        if not np.isfinite(loglik):
            raise ValueError("the log-likelihood is not finite: numeric fields must be finite or NULL")
        history.append(loglik)
        model = maximised(total, history)
        if len(history) > 2 and abs(history[-1] - history[-2]) <= tolerance * abs(history[-2]):
            break
    return model


NUMERIC, CATEGORICAL = ["year", "area"], ["rooms", "level", "kind", "city", "place"]


def _finite(name: str) -> Column:
    v = F.col(name).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _prepared(listings: DataFrame) -> DataFrame:
    year = usable("construction_year")
    size = _finite("building_size")
    return listings.select(
        F.col("source_row_id").alias("row"),
        F.regexp_extract(year, r"(\d{4})", 1).try_cast("double").alias("year"),
        F.when(size > 0, F.ln(size)).alias("area"),
        usable("rooms_count").alias("rooms"),
        F.regexp_replace(usable("floor"), r"^طبقه ", "").alias("level"),
        fold(F.col("cat3_slug")).alias("kind"),
        given(F.col("city_slug")).alias("city"),
        F.concat(given(F.col("city_slug")), F.lit("|"), usable("neighborhood_slug")).alias("place"),
        _finite("location_latitude").alias("lat"),
        _finite("location_longitude").alias("lon"),
        *[(applies(f) & usable(f).isNull()).alias(f"{f}_filled") for f in FIELDS],
        *[F.coalesce(usable(f), F.lit(None)).alias(f) for f in FIELDS],
    )


def _place_positions(rows: DataFrame, places: dict[str, int]) -> np.ndarray:
    """places x 4: mean and variance of latitude and longitude, the Gaussian part that depends on the place.

    Sparse places are drawn towards the spread of all; a place without positions gets the whole table's Gaussian.
    """
    known = rows.where("place IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    moments = known.groupBy("place").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("m", F.avg), ("v", F.var_pop))], F.count(F.lit(1)).alias("n")).collect()
    out = np.tile(np.array([0.0, 1e6, 0.0, 1e6]), (len(places), 1))
    if moments:
        n = np.array([r.n for r in moments], dtype=float)
        for j, c in ((0, "lat"), (2, "lon")):
            m, v = (np.array([r[f"{k}_{c}"] for r in moments]) for k in "mv")
            mean = (n * m).sum() / n.sum()
            within = max((n * v).sum() / n.sum(), 1e-8)
            out[:, j], out[:, j + 1] = mean, max((n * (v + (m - mean) ** 2)).sum() / n.sum(), 1e-8)
            at = [places[r.place] for r in moments]
            out[at, j], out[at, j + 1] = m, (n * v + 5 * within) / (n + 5)
    return out


def fill_missing(listings: DataFrame, classes: int = 25, rounds: int | None = None) -> DataFrame:
    """Each listing with its four fields filled and a mark per field saying whether it was filled.

    Columns: source_row_id, then for each field its value (string) and ``<field>_filled`` (boolean). A usable value is kept in
    its folded form (one kind of digits); a gap that belongs to the kind of property stays NULL and is not marked. The
    neighborhood is chosen among those of the row's city. Where no row of the model can say anything (no usable value in the
    whole table, a city without any neighborhood) the value stays NULL though marked. Rows with equal ids are filled alike.
    An empty table gives no rows.
    """
    rows = written(_prepared(listings))
    # Levels of the categorical fields: as many as there are rooms, floors, kinds and places, not rows.
    seen = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in CATEGORICAL])).alias("x")).select("x.*").where("value IS NOT NULL").distinct().collect()
    levels = {n: {v: i for i, v in enumerate(sorted(r.value for r in seen if r.name == n))} for n in CATEGORICAL}

    def codes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**{n: pdf[n].map(levels[n]).fillna(-1).astype(np.int64) for n in CATEGORICAL})

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield codes(pdf)[["row", *NUMERIC, *CATEGORICAL]]

    schema = "row long, year double, area double, " + ", ".join(f"{n} int" for n in CATEGORICAL)
    city_of = np.array([levels["city"].get(p.split("|", 1)[0], len(levels["city"])) for p in levels["place"]] or [0], dtype=np.int64)
    model = fit_mixture(written(rows.select("row", *NUMERIC, *CATEGORICAL).mapInPandas(coded, schema)), NUMERIC, levels, classes, rounds, within={"place": city_of})
    cities = {c: np.array([i for p, i in levels["place"].items() if p.startswith(f"{c}|")], dtype=int) for c in levels["city"]}
    names = {n: np.array(list(levels[n]), dtype=object) for n in ("rooms", "level", "place")}
    positions = _place_positions(rows, levels["place"])

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["row", *[c for f in FIELDS for c in (f, f"{f}_filled")]]].rename(columns={"row": "source_row_id"})
            gaps = pdf[[f"{f}_filled" for f in FIELDS]].any(axis=1).to_numpy()
            if gaps.any():
                part = codes(pdf[gaps])
                r, _ = model.posterior(_columns(part, NUMERIC, CATEGORICAL))
                at = np.flatnonzero(gaps)
                for f, n in (("rooms_count", "rooms"), ("floor", "level")):
                    lacks = part[f"{f}_filled"].to_numpy(bool)
                    if lacks.any() and len(names[n]):
                        out.iloc[at[lacks], out.columns.get_loc(f)] = names[n][(r[lacks] @ np.exp(model.logp[n])).argmax(axis=1)]
                lacks = part["construction_year_filled"].to_numpy(bool)
                if lacks.any() and len(levels["kind"]):
                    out.iloc[at[lacks], out.columns.get_loc("construction_year")] = [str(round(v)) for v in r[lacks] @ model.mean[:, 0]]
                lacks = np.flatnonzero(part["neighborhood_slug_filled"].to_numpy(bool))
                if len(lacks):
                    p = np.exp(model.logp["place"])
                    for city, rows_of in part["city"].iloc[lacks].groupby(part["city"].iloc[lacks]).indices.items():
                        own = cities.get(list(levels["city"])[city], np.array([], dtype=int))
                        if len(own):
                            who = lacks[rows_of]
                            score = np.log(r[who] @ p[:, own])
                            for j, c in ((0, "lat"), (2, "lon")):
                                v = part[c].to_numpy(float, na_value=np.nan)[who][:, None]
                                mean, var = positions[own, j], positions[own, j + 1]
                                score += np.where(np.isnan(v), 0.0, -0.5 * (np.log(var) + (v - mean) ** 2 / var))
                            best = own[score.argmax(axis=1)]
                            out.iloc[at[lacks[rows_of]], out.columns.get_loc("neighborhood_slug")] = [names["place"][b].split("|", 1)[1] for b in best]
            yield out

    schema = "source_row_id long, " + ", ".join(f"{f} string, {f}_filled boolean" for f in FIELDS)
    return rows.mapInPandas(filled, schema)


def filled_fields(listings: DataFrame) -> DataFrame:
    """One row (source_row_id, field_name) for each field that ``fill_missing`` marks as filled, also where no value could be found.

    Rows with equal ids repeat. An empty table gives no rows.
    """
    return listed(fill_missing(listings), {f: F.col(f"{f}_filled") for f in FIELDS})
