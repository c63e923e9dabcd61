import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arzyab.llm import mixing, packing
from arzyab.llm.tokens import VOCABULARY, encoder, with_token_counts


def optimal_bins(sizes, capacity):
    """Fewest bins, by trying."""
    for k in range(1, len(sizes) + 1):
        for places in itertools.product(range(k), repeat=len(sizes)):
            if all(sum(s for s, p in zip(sizes, places) if p == b) <= capacity for b in range(k)):
                return k


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 400, 700)
    bins = packing.best_fit(sizes, 512, 6, 165_000.0, rule)
    for b in range(bins.max() + 1):
        own = sizes[bins == b]
        assert own.sum() <= 512 and len(own) <= 6 and (own**2).sum() <= 165_000
    for seed in range(4):
        small = np.random.default_rng(seed).integers(1, 100, 6)
        assert packing.best_fit(small, 100, 99, 1e9, rule).max() + 1 <= optimal_bins(small, 100) + 1


def test_texts_are_split_only_beyond_the_capacity(spark):
    texts = ["house " * n for n in (1, 5, 20, 63, 64, 65, 200, 3)] + [None, "", "خانه " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS piece")
    caps = spark.createDataFrame([(1, 64), (2, 256)], "capacity_id int, capacity_tokens int")
    got = packing.pack(docs, caps).collect()
    size = {i: len(encoder(VOCABULARY).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.capacity_id, r.doc_id].append(r)
        by_bin[r.capacity_id, r.container_id].append(r.tokens)
    for c, cap in ((1, 64), (2, 256)):
        for i, n in size.items():
            rows = sorted(by_doc[c, i], key=lambda r: r.piece)
            assert sum(r.tokens for r in rows) == n and [r.first_token for r in rows] == [k * cap for k in range(len(rows))]
            assert len(rows) == max(1, -(-n // cap))
        assert all(sum(v) <= cap for (k, _), v in by_bin.items() if k == c)
    report = {r.capacity_id: r for r in packing.fill_report(packing.pack(docs, caps), caps).collect()}
    assert report[1].tokens == sum(size.values()) and 0 < report[1].fill <= 1 and report[1].containers >= report[1].containers_at_least
    assert packing.pack(docs.limit(0), caps).count() == 0


def test_repeated_ids_stay_whole(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d " * 700), (2, "d " * 700)], "doc_id long, text string")
    caps = spark.createDataFrame([(1, 64)], "capacity_id int, capacity_tokens int")
    got = packing.pack(docs, caps)
    want = with_token_counts(docs, "text").agg(F.sum("tokens")).first()[0]
    assert got.agg(F.sum("tokens")).first()[0] == want
    assert got.groupBy("container_id").agg(F.sum("tokens").alias("t")).where("t > 64").count() == 0


def test_poisson_steps():
    assert mixing.poisson_steps(1.0, 3) == pytest.approx([np.exp(-1), 2 * np.exp(-1), 2.5 * np.exp(-1)])


def test_shares_caps_and_repeats(spark):
    docs = [(i, f"text {i} " + "word " * (20 + i % 50), "big" if i < 2000 else "mid" if i < 2600 else "tiny" if i < 2800 else "unknown") for i in range(2900)]
    docs += [(5000 + i, docs[0][1], "tiny") for i in range(50)] + [(6000, None, "big"), (6001, "", "big"), (6002, "x y", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS copy", "0 AS u")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, total_tokens=60_000)
    report = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert report[s].actual_share == pytest.approx(share, abs=0.02)
    assert report["absent"].tokens == 0
    rows = mixed.collect()
    used = Counter(dict((i, t) for i, t, _ in docs)[r.doc_id] for r in rows)
    most = {"big": 1, "mid": 2, "tiny": 4}
    source = {t: s for _, t, s in reversed(docs)}
    assert all(n <= most[source[t]] for t, n in used.items()) and set(r.source for r in rows) <= set(most)
    assert [r.doc_id for r in rows] == [r.doc_id for r in mixing.mix(df, targets, total_tokens=60_000).collect()]  # repeatable
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_the_mix_is_all_that_the_scarcest_source_allows(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 5, "scarce" if i < 10 else "rich") for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("scarce", 0.5, 2), ("rich", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.share_report(mixing.mix(docs, targets), targets).collect()}
    assert got["scarce"].texts == 10 and got["scarce"].most_repeats == 2 and abs(got["scarce"].actual_share - 0.5) < 0.03


def test_attention_bound_does_not_depend_on_other_pieces(spark):
    """A piece beyond the bound is alone; it doesn't raise the bound of the rest."""
    docs = spark.createDataFrame([(i, "a " * 60) for i in range(8)] + [(100, "a " * 100)], "doc_id long, text string")
    caps = spark.createDataFrame([(1, 128)], "capacity_id int, capacity_tokens int")
    got = packing.pack(docs, caps, attention_share=0.4, max_documents_share=1.0).collect()
    cost: dict = {}
    for r in got:
        cost.setdefault(r.container_id, []).append(r.tokens)
    assert len(got) == 9
    for sizes in cost.values():
        assert len(sizes) == 1 or sum(t * t for t in sizes) <= 0.4 * 128 * 128


def test_shards_are_merged_where_they_are_left_open(spark):
    docs = spark.createDataFrame([(i, "a " * (3 + i % 40)) for i in range(300)], "doc_id long, text string")
    caps = spark.createDataFrame([(1, 512)], "capacity_id int, capacity_tokens int")
    report = lambda **k: packing.fill_report(packing.pack(docs, caps, **k), caps).first()
    many, apart, one = report(shard_items=20), report(shard_items=20, reopened=0), report()
    assert many.tokens == apart.tokens == one.tokens and one.containers <= many.containers < apart.containers
    assert packing.pack(docs, caps, shard_items=20).select("doc_id").distinct().count() == 300
    ids = lambda: sorted((r.container_id, r.doc_id) for r in packing.pack(docs, caps, shard_items=20).collect())
    assert ids() == ids()
