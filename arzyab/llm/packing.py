"""Filling containers of fixed capacity (problem 8) by vector best-fit.

Every container has three capacities: tokens, number of documents, and attention cost (the sum of squared piece lengths). Items
go in by falling size; among the open containers that hold an item under every constraint, the one with the best score takes it:
the smallest norm of what would be left, or the largest dot product of the item and the residual, each dimension weighted by how
scarce it is. Items are spread over shards of bounded size by a hash, so no task grows with the data or with a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import written
from arzyab.llm.tokens import VOCABULARY, with_token_counts


def best_fit(sizes: np.ndarray, tokens: int, documents: int, attention: float, rule: str = "norm") -> np.ndarray:
    """The container number (from 0) of each item; items must fit an empty container. Ties go to the oldest container."""
    demand = np.stack([sizes / tokens, np.full(len(sizes), 1 / documents), sizes.astype(float) ** 2 / attention], axis=1)
    weight = demand.sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    out = np.zeros(len(sizes), dtype=np.int64)
    room = np.empty((64, 3))
    number = np.empty(64, dtype=np.int64)  # of each open container
    count = made = 0
    least = demand.min(axis=0) if len(sizes) else None
    for i in np.argsort(-sizes, kind="stable"):
        need = demand[i]
        fits = np.flatnonzero((room[:count] >= need - 1e-9).all(axis=1))
        if len(fits):
            left = room[fits] - need
            score = -((left * left) @ weight) if rule == "norm" else (room[fits] * need) @ weight
            k = int(fits[score.argmax()])
        else:
            if count == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            k, room[count], number[count] = count, 1.0, made
            count, made = count + 1, made + 1
        room[k] -= need
        out[i] = number[k]
        if (room[k] < least - 1e-9).any():  # full: no item fits any more; the order of the others stays
            room[k : count - 1], number[k : count - 1] = room[k + 1 : count].copy(), number[k + 1 : count].copy()
            count -= 1
    return out


def pack(documents: DataFrame, capacities: DataFrame, rule: str = "norm", max_documents_share: float = 1 / 8, attention_share: float = 1.0, shard_items: int = 8192, reopened: int = 4, vocabulary: str = VOCABULARY) -> DataFrame:
    """capacity_id, container_id, doc_id, piece, first_token, tokens: every text in containers of every capacity.

    A text longer than the capacity is split into pieces of the capacity and a rest; no other text is split. NULL and empty
    texts have 0 tokens and are placed like others. A container of capacity c takes at most ceil(c * max_documents_share)
    pieces and an attention cost (sum of squared tokens) of attention_share * c^2; a piece that costs more by itself gets a container of
    its own. Items are packed in shards of about ``shard_items``; the ``reopened`` emptiest containers of each shard are emptied again and
    packed together with those of up to 63 other shards, as these are what a shard leaves half full. Rows with equal ids are placed each
    by itself. Container ids are unique within a capacity and equal between runs. Empty tables give no rows.
    """
    counted = with_token_counts(documents.select("doc_id", "text"), "text", vocabulary).select("doc_id", "tokens")
    # Texts are counted once; from here on there are only numbers. Repeated ids are told apart by number.
    copies = counted.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    sized = written(copies.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")))
    c = F.col("capacity_tokens")
    # capacities is a fixed table of a few rows
    each = sized.crossJoin(F.broadcast(capacities.select("capacity_id", "capacity_tokens"))).select(
        "capacity_id", "capacity_tokens", "doc_id", "copy", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / c) - 1, F.lit(0)).cast("long"))).alias("piece")
    )
    pieces = each.select("capacity_id", "capacity_tokens", "doc_id", "copy", "piece", (F.col("piece") * c).alias("first_token"), F.least(F.col("all") - F.col("piece") * c, c.cast("long")).alias("tokens"))
    # A full piece fills a container of its own, as does one beyond the attention bound, so only the others are packed.
    alone = (F.col("tokens") == c) | (F.col("tokens").cast("double") * F.col("tokens") > F.lit(attention_share) * c * c)
    full = pieces.where(alone).select("capacity_id", F.concat_ws("-", F.lit("alone"), "doc_id", "copy", "piece").alias("container_id"), "doc_id", "piece", "first_token", "tokens")
    shards = max(1, -(-sized.count() // shard_items))  # a text leaves at most one rest per capacity

    def packed(group: str, sign: str):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            cap = int(pdf["capacity_tokens"].iloc[0])
            pdf = pdf.sort_values(["tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
            bins = best_fit(pdf["tokens"].to_numpy(np.int64), cap, int(np.ceil(cap * max_documents_share)), attention_share * cap * cap, rule)
            fill = np.bincount(bins, pdf["tokens"])
            emptiest = np.zeros(len(fill), dtype=bool)
            emptiest[np.argsort(fill, kind="stable")[:reopened]] = True
            return pdf[["capacity_id", "capacity_tokens", "doc_id", "copy", "piece", "first_token", "tokens", "shard"]].assign(container_id=[f"{sign}{s}-{b}" for s, b in zip(pdf[group], bins)], open=emptiest[bins])

        return one

    names = "capacity_id int, capacity_tokens int, doc_id long, copy long, piece long, first_token long, tokens long, shard long, container_id string, open boolean"
    out = ["capacity_id", "container_id", "doc_id", "piece", "first_token", "tokens"]
    rest = pieces.where(~alone).withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).cast("long"))
    once = rest.groupBy("capacity_id", "shard").applyInPandas(packed("shard", ""), names)
    if shards == 1:
        return once.select(*out).unionByName(full)
    once = written(once)
    again = once.where("open").withColumn("club", F.floor(F.col("shard") / 64).cast("long")).groupBy("capacity_id", "club").applyInPandas(packed("club", "again-"), names)
    return once.where(~F.col("open")).select(*out).unionByName(again.select(*out)).unionByName(full)


def constraint_report(containers: DataFrame, capacities: DataFrame, max_documents_share: float = 1 / 8, attention_share: float = 1.0) -> DataFrame:
    """capacity_id, containers, fill, and how many containers stand at each bound: document_bound (the greatest number of pieces),
    attention_bound (at least 95 % of the attention cost allowed), token_bound (at least 95 % of the tokens)."""
    per = containers.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("cost"))
    c = F.col("capacity_tokens")
    return per.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), "capacity_id").groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("containers"), (F.sum("tokens") / F.sum(c)).alias("fill"), F.count_if(F.col("pieces") >= F.ceil(c * max_documents_share)).alias("document_bound"),
        F.count_if(F.col("cost") >= 0.95 * attention_share * c * c).alias("attention_bound"), F.count_if(F.col("tokens") >= 0.95 * c).alias("token_bound"),
    )


def fill_report(containers: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_id, containers, tokens, fill (share of room used) and containers_at_least (no packing needs fewer)."""
    used = containers.groupBy("capacity_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    c = F.col("capacity_tokens")
    return used.join(F.broadcast(capacities), "capacity_id").select("capacity_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * c)).alias("fill"), F.ceil(F.col("tokens") / c).alias("containers_at_least"))
