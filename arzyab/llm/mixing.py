"""Mixing sources to target shares by Poisson replication (problem 9).

Each text draws a number u from a hash of itself and a seed; the inverse of a Poisson distribution, cut off at the source's
greatest number of repeats, turns u into how often the text is used. The rate of each source is set so that the tokens it really
gives meet its share: as u is fixed, they rise with the rate, so the rate is found by bisection on a table of tokens by source and
range of u, which is bounded by sources x ranges. The copies are exploded and shuffled globally by a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.llm.tokens import VOCABULARY, with_token_counts

RANGES = 4096


def poisson_steps(rate: float, most: int) -> list[float]:
    """P(N <= 0), ..., P(N <= most - 1): a text with number u is used as often as steps lie at or below u."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(most):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def _rate(tokens: np.ndarray, most: int, wanted: float) -> float:
    """The rate at which the tokens of each range of u, times the repeats of its middle, come closest to ``wanted``."""
    u = (np.arange(RANGES) + 0.5) / RANGES

    def given(rate: float) -> float:
        return float(sum(tokens[u >= s].sum() for s in poisson_steps(rate, most)))

    low, high = 0.0, 50.0 + 4 * most
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle) < wanted else (low, middle)
    return low if wanted - given(low) < given(high) - wanted else high


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """position key, doc_id, copy, source, tokens: the mixed collection in shuffled order (sorted by ``shuffle_key``).

    targets: source, target_share, max_repeats (a fixed small table). Repeated texts count as one text, that of the smallest
    doc_id, so no text is used more than max_repeats times under whatever id. NULL and empty texts and sources without a target
    have no place in the mix. total_tokens: size of the mix; without it, the size of the corpus, lowered to what every source
    can give of its share. A share misses its target by half of the longest text's tokens at most, over the size of the mix. An empty table gives no rows.
    """
    known = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "source", "text", F.sha2("text", 256).alias("digest"))
    # Tokens are counted where the texts lie; only numbers are shuffled to find repeated texts.
    first = with_token_counts(known, "text", vocabulary).groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("digest", "x.*")
    u = F.shiftrightunsigned(F.xxhash64("digest", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sized = written(first.select("doc_id", "source", "tokens", u.alias("u")))
    goals = {r.source: r for r in targets.collect()}
    table: dict[str, np.ndarray] = {s: np.zeros(RANGES) for s in goals}
    for source, at, tokens in sized.groupBy("source", F.floor(F.col("u") * RANGES).alias("at")).agg(F.sum("tokens")).where(F.col("source").isin(*goals)).collect():
        table[source][at] = tokens
    sums = {s: t.sum() for s, t in table.items()}
    if total_tokens is None:
        most = [sums[s] * g.max_repeats / g.target_share for s, g in goals.items() if g.target_share > 0 and sums[s] > 0]
        total_tokens = int(min([sum(sums.values()), *most])) if most else 0
    steps = {s: poisson_steps(_rate(table[s], g.max_repeats, g.target_share * total_tokens), g.max_repeats) for s, g in goals.items() if g.target_share > 0}
    uses = F.lit(0)
    for s, at in steps.items():
        uses = F.when(F.col("source") == s, sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in at), F.lit(0))).otherwise(uses)
    copies = sized.withColumn("uses", uses).where("uses > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    return copies.select(F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("shuffle_key"), "doc_id", "copy", "source", "tokens").orderBy("shuffle_key", "doc_id", "copy")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share of tokens, tokens, texts, most_repeats; a source that gives nothing has zeros."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"), F.max("copy").alias("most_repeats"))
    total = mixed.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.join(by, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("texts"), "max_repeats", zero("most_repeats"))
