"""Near-duplicate records with small edits (problem 7): banded MinHash candidates, odd sketches, exact verification.

1. Every ad becomes a set of word hashes. Equal sets with equal size and price are one class; links are found between classes.
2. MinHash samples of a set give band keys; a band key also holds a coarse bucket of the building size, and ads close to a bucket's
   edge are put into both. Band rows are partitioned and sorted by key, and each task streams its sorted rows and pairs up equal
   keys, at once dropping pairs whose sizes or prices are too far apart. Runs are held in blocks, so a hot key needs no more memory
   than a block times its row count in codes.
3. All samples of a set are folded into an odd sketch, a bitmap of parities. The population count of two sketches' XOR estimates
   their similarity far more precisely than the bands, which drops nearly all chance pairs.
4. Survivors are verified exactly on their word sets, and classes are expanded to their members.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.functions.session import checkpoint_dir, written
from arzyab.functions.text import fold
from arzyab.llm.normalize import consistent_text
from arzyab.operators.units import with_stated_toman

DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹", "0123456789")
PUNCTUATION = "".join(c for c in map(chr, range(0x3100)) if unicodedata.category(c)[0] in "PS")
SKETCH_BITS, ODD_WORDS = 512, 8
EDGE = 0.6  # width of a size bucket, in ln
MISSING = 0  # code of a price that isn't given


def word_set(text: str, seen: dict[str, int]) -> np.ndarray:
    """Sorted hashes of the distinct words of a text in consistent form: U+200C dropped, digits alike, case ignored. Punctuation at a
    word's ends is no part of it, and what is only punctuation is no word.

    seen: word as written -> hash, 0 for no word; it is emptied when it outgrows its bound.
    """
    words = text.split()
    hashes = set(map(seen.get, words))
    if None in hashes:
        if len(seen) > 500_000:
            seen.clear()
        for w in words:
            if w not in seen:
                bare = w.strip(PUNCTUATION).replace("\u200c", "").translate(DIGITS).lower()
                seen[w] = xxhash.xxh32_intdigest(bare) or 1 if bare else 0
        hashes = set(map(seen.get, words))
    hashes.discard(0)
    a = np.fromiter(hashes, dtype=np.uint32, count=len(hashes))
    a.sort()
    return a


def minhash(flat: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """sets x samples: the least value of each set's hashes under each of ``samples`` odd multipliers. Sets aren't empty."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(1 << 31, 1 << 32, samples, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(starts), samples), dtype=np.uint32)
    mixed = np.empty_like(flat)
    for j in range(samples):
        np.bitwise_xor(flat, shifts[j], out=mixed)
        np.multiply(mixed, factors[j], out=mixed)
        out[:, j] = np.minimum.reduceat(mixed, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """sets x 8 int64: parity of how many (sample number, value) pairs fall on each of 512 bits."""
    n, k = samples.shape
    mixed = samples.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    bit = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 9)
    at = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    parity = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(parity, axis=1).view(np.int64).reshape(n, ODD_WORDS)


def sketch_similarity(differing: int, samples: int) -> float:
    """The estimate of Jaccard similarity from the number of differing bits."""
    return 1 + SKETCH_BITS / (4 * samples) * math.log(max(1 - 2 * differing / SKETCH_BITS, 1e-9))


def differing_bits(similarity: float, samples: int) -> float:
    """The number of differing bits expected at a similarity."""
    return SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / SKETCH_BITS))


def _described_sets(pdf: pd.DataFrame, least_words: int, seen: dict[str, int]) -> tuple[list[int], list[np.ndarray]]:
    """Places and word sets of the rows whose description has enough words."""
    keep, sets = [], []
    for i, (t, d) in enumerate(zip(pdf["title"], pdf["description"])):
        d = consistent_text(d)
        if len(d.split()) >= least_words:
            words = word_set(f"{consistent_text(t) or ''} {d}", seen)
            if len(words):
                keep.append(i)
                sets.append(words)
    return keep, sets


def described(listings: DataFrame, bands: int, rows: int, least_words: int) -> DataFrame:
    """Ads that can have partners: row_id, class_id (of equal word set, size and price), size, price, bands (binary: a 32-bit
    value per band), s0..s7 (odd sketch)."""
    samples = bands * rows

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            keep, sets = _described_sets(pdf, least_words, seen)
            for at in range(0, len(keep), 512):
                part = sets[at : at + 512]
                out = pdf.iloc[keep[at : at + 512]][["row_id", "size", "price"]].reset_index(drop=True)
                starts = np.concatenate([[0], np.cumsum([len(s) for s in part[:-1]])]).astype(np.int64)
                sig = minhash(np.concatenate(part), starts, samples)
                odd = odd_sketches(sig)
                keys = [xxhash.xxh3_64_intdigest(w.tobytes() + np.array([s, p]).tobytes()) for w, s, p in zip(part, out["size"], out["price"].fillna(-1.0))]
                out["class_id"] = np.array(keys, dtype=np.uint64).view(np.int64)
                mixed = np.zeros((len(out), bands), dtype=np.uint64)
                for r in range(rows):
                    mixed = (mixed ^ sig[:, r::rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(32)
                out["bands"] = [k.tobytes() for k in (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
                for w in range(ODD_WORDS):
                    out[f"s{w}"] = odd[:, w]
                yield out

    known = listings.where("description IS NOT NULL").select(F.col("source_row_id").alias("row_id"), "title", "description", "price_value", fold(F.col("building_size")).alias("size"))
    known = with_stated_toman(known.select("row_id", "title", "description", "price_value", F.col("size").try_cast("double").alias("size")).where("size > 0"), "price_value", "price")
    known = known.select("row_id", "title", "description", "size", F.nullif(F.col("price"), F.lit(0)).cast("double").alias("price"))
    return known.mapInPandas(describe, "row_id long, size double, price double, class_id long, bands binary, " + ", ".join(f"s{w} long" for w in range(ODD_WORDS)))


def _codes(size: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Size and price in one int: ln in steps of 0.005 and 0.01; price 0 where not given."""
    s = np.clip(np.round(np.log(size) / 0.005) + 8192, 0, 16383).astype(np.int64)
    p = np.where(np.isnan(price), MISSING, np.clip(np.round(np.log(np.where(price > 0, price, 1.0)) / 0.01) + 1, 1, 16383)).astype(np.int64)
    return (s << 14 | p).astype(np.int32)


def candidate_pairs(ads: DataFrame, bands: int, size_within: float, price_within: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a band key and may agree in size and price.

    Equal classes are merged within each batch before the shuffle and within each key after it, so a class with a third of all rows
    weighs one row per batch and key.
    """
    reach, price_reach = -math.log(1 - size_within), -math.log(1 - price_within)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.drop_duplicates("class_id")
            sig = np.frombuffer(b"".join(pdf["bands"]), dtype=np.uint32).reshape(len(pdf), bands).astype(np.uint64)
            size, price = pdf["size"].to_numpy(float), pdf["price"].to_numpy(float, na_value=np.nan)
            code, ids = _codes(size, price), pdf["class_id"].to_numpy(np.int64)
            place = np.log(size) / EDGE
            home = np.floor(place).astype(np.int64)
            both = np.flatnonzero((home + 1 - place) * EDGE <= reach + 1e-9)  # near the upper edge: also in the next bucket
            who = np.concatenate([np.arange(len(pdf)), both])
            bucket = np.concatenate([home, home[both] + 1]).astype(np.uint64)
            key = sig[who] * np.uint64(0x9E3779B97F4A7C15) + (bucket[:, None] * np.uint64(bands) + np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(31)
            yield pd.DataFrame({"key": (key * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64).ravel(), "class_id": np.repeat(ids[who], bands), "code": np.repeat(code[who], bands)})

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last run of a batch is carried over to the next."""
        s_reach, p_reach = int(reach / 0.005) + 2, int(price_reach / 0.01) + 2
        rest: list[list[np.ndarray]] = []  # parts of a run that may go on

        def near(ia: np.ndarray, ib: np.ndarray, ids: np.ndarray, code: np.ndarray) -> pd.DataFrame:
            s, p = code >> 14, code & 16383
            ok = (ids[ia] != ids[ib]) & (np.abs(s[ia] - s[ib]) <= s_reach) & ((p[ia] == MISSING) | (p[ib] == MISSING) | (np.abs(p[ia] - p[ib]) <= p_reach))
            x, y = ids[ia[ok]], ids[ib[ok]]
            return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        def runs(key: np.ndarray, ids: np.ndarray, code: np.ndarray) -> Iterator[pd.DataFrame]:
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
            key, ids, code = key[fresh], ids[fresh], code[fresh]
            n = len(key)
            end = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n)
            size = np.diff(np.concatenate([[0], end]))
            last = np.repeat(end, size)  # where each row's run ends
            partners = last - np.arange(n) - 1
            at = 0
            upto = np.cumsum(partners)
            while at < n:  # blocks of about 2^20 pairs; one row's partners at least
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), side="right")))
                count = partners[at:stop]
                if count.sum():
                    ia = np.repeat(np.arange(at, stop), count)
                    ib = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + ia + 1
                    yield near(ia, ib, ids, code).drop_duplicates()
                at = stop

        for pdf in batches:
            if not len(pdf):
                continue
            now = [pdf["key"].to_numpy(), pdf["class_id"].to_numpy(), pdf["code"].to_numpy()]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if rest and (cut or rest[0][0][0] != now[0][0]):  # the run that was open ends in this batch, or ended before it
                yield from runs(*[np.concatenate(x) for x in zip(*rest, [x[:cut] for x in now])])
                rest = []
            elif cut:
                yield from runs(*[x[:cut] for x in now])
            rest.append([x[cut:] for x in now])
        if rest:
            yield from runs(*[np.concatenate(x) for x in zip(*rest)])

    rows = ads.select("class_id", "size", "price", "bands").mapInPandas(banded, "key long, class_id long, code int")
    return rows.repartition("key").sortWithinPartitions("key", "class_id").mapInPandas(paired, "a long, b long").distinct()


def similar_pairs(listings: DataFrame, similarity: float = 0.7, size_within: float = 0.05, price_within: float = 0.2, least_words: int = 35, bands: int = 48, rows: int = 7, slack: float = 0.165, broadcast_rows: int = 150_000) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes a < b, members row_id -> class_id). A class holds the ads of equal word set, size and price.

    bands and rows set which pairs become candidates: at similarity 0.7 all but 2 %, at 0.75 all but 0.1 %, at 0.8 all but 0.002 %;
    more bands find more, more rows a band keep chance pairs few as the collection grows. slack is how far below the threshold a
    sketch's estimate may lie (four standard errors of 0.041). Ads without description, size or enough words have no partner. A price of 0 is
    none. Empty tables give no rows. broadcast_rows: up to so many ads of surviving pairs their ids are broadcast to pick their texts;
    beyond it the pick is a shuffled join (150,000 rows take about 64 MB as a hash table).
    """
    ads = written(described(listings, bands, rows, least_words))
    odd = [f"s{w}" for w in range(ODD_WORDS)]
    classes = ads.select("class_id", "size", "price", *odd).dropDuplicates(["class_id"])
    side = lambda n: classes.select(F.col("class_id").alias(n), F.col("size").alias(f"size_{n}"), F.col("price").alias(f"price_{n}"), *[F.col(s).alias(f"{s}_{n}") for s in odd])
    pairs = candidate_pairs(ads, bands, size_within, price_within).join(side("a"), "a").join(side("b"), "b")
    away = sum((F.expr(f"bit_count({s}_a ^ {s}_b)") for s in odd), F.lit(0))
    apart = lambda x: F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) / F.greatest(f"{x}_a", f"{x}_b")
    likely = written(pairs.where((away <= F.lit(differing_bits(similarity - slack, bands * rows))) & (apart("size") <= size_within) & F.coalesce(apart("price") <= price_within, F.lit(True))).select("a", "b"))
    involved = likely.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    few = involved.count() <= broadcast_rows
    hint = F.broadcast if few else (lambda x: x)
    shown = ads.select("row_id", "class_id").join(hint(involved), "class_id", "left_semi").groupBy("class_id").agg(F.min("row_id").alias("row_id"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            keep, sets = _described_sets(pdf, least_words, seen)
            yield pdf.iloc[keep][["class_id"]].assign(words=[s.tobytes() for s in sets])

    texts = listings.select(F.col("source_row_id").alias("row_id"), "title", "description").join(hint(shown), "row_id")
    words = written(texts.where("description IS NOT NULL").select("class_id", "title", "description").mapInPandas(read, "class_id long, words binary"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["words_a"], pdf["words_b"]):
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pdf.loc[keep, ["a", "b"]]

    both = likely.join(words.select(F.col("class_id").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("class_id").alias("b"), F.col("words").alias("words_b")), "b")
    return both.mapInPandas(verified, "a long, b long"), ads.select("row_id", "class_id")


def pairs_found(listings: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: every pair of ads that problem 7 calls near-duplicates, exact copies too."""
    pairs, members = similar_pairs(listings)
    of = lambda n: members.select(F.col("class_id").alias(n), F.col("row_id").alias(f"row_{n}"))
    across = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b"))
    copies = members.join(members.groupBy("class_id").count().where("count > 1").select("class_id"), "class_id", "left_semi")
    within = copies.select("class_id", F.col("row_id").alias("row_id_a")).join(copies.select("class_id", F.col("row_id").alias("row_id_b")), "class_id").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
    return across.unionByName(within)


def components(edges: DataFrame) -> DataFrame:
    """(node, group): connected components by alternating large-star and small-star steps; group is the least node.

    edges: a, b. Each round is a grouped minimum and a join, checkpointed to the shared folder; it ends when nothing changes, after about log(nodes)^2 rounds at most.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    while True:
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = sides.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: from each node to the least of its smaller neighbours
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct().checkpoint()
        same = small.count() == now.count() and small.exceptAll(now).isEmpty()
        now = small
        if same:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("group")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("group")).distinct())


def offer_groups(listings: DataFrame) -> DataFrame:
    """source_row_id, class_id (least id of its exact copies), group_id (least id of its offer), links: one row per ad that can
    have partners; links counts the classes linked to its own."""
    pairs, members = similar_pairs(listings)
    pairs = written(pairs)
    groups = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("class_id").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = classes.join(groups.select(F.col("node").alias("class_id"), "group"), "class_id", "left").join(links, "class_id", "left").withColumn("group", F.coalesce("group", "class_id"))
    least = named.groupBy("group").agg(F.min("least").alias("group_id"))
    named = named.join(least, "group").select("class_id", "least", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(named, "class_id").select(F.col("row_id").alias("source_row_id"), F.col("least").alias("class_id"), "group_id", "links")
