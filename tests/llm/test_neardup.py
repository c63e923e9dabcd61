import itertools
import random

import numpy as np

from arzyab.llm import neardup as N
from arzyab.llm.normalize import consistent_text
from arzyab.operators import units


def brute(spark, df):
    """All pairs of eligible ads, compared word by word."""
    prices = {r.source_row_id: r.toman for r in units.marked_amounts(df).where("field_name = 'price_value' AND toman > 0").collect()}
    ads = []
    for r in df.collect():
        d = consistent_text(r.description) or ""
        try:
            size = float(r.building_size)
        except (TypeError, ValueError):
            continue
        if len(d.split()) >= 35 and size > 0:
            words = f"{consistent_text(r.title) or ''} {d}".replace("\u200c", "").translate(N.DIGITS).lower().split()
            ads.append((r.source_row_id, set(words), size, prices.get(r.source_row_id)))
    out = []
    for a, b in itertools.combinations(sorted(ads), 2):
        close = abs(a[2] - b[2]) <= 0.05 * max(a[2], b[2]) and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 0.2 * max(a[3], b[3]))
        if close and len(a[1] & b[1]) >= 0.7 * len(a[1] | b[1]):
            out.append((a[0], b[0]))
    return out


def test_pairs_equal_brute_force(spark, listings):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for g in range(25):
        base = rng.sample(vocabulary, 60)
        for k in range(rng.choice([1, 2, 3, 12 if g == 0 else 4])):
            words = [w for w in base if rng.random() > 0.08] + rng.sample(vocabulary, rng.randint(0, 6))
            rng.shuffle(words)
            n += 1
            rows.append({"source_row_id": n * 7, "title": f"Ad {g}", "description": " ".join(words if k else base), "building_size": str(100 + g % 3 + (k % 4) * 3), "price_value": rng.choice([None, "0", str(10**9), str(11 * 10**8), str(13 * 10**8)])})
    for i in (3, 3, 8):  # exact copies under other ids
        n += 1
        rows.append(rows[i] | {"source_row_id": n * 7})
    rows += [{"source_row_id": 5000, "description": None, "building_size": "9"}, {"source_row_id": 5001, "description": "", "building_size": "9"}, {"source_row_id": 5002, "description": "short text", "building_size": "9"}, {"source_row_id": 5003, "description": " ".join(vocabulary[:60])}]
    rows += [{"source_row_id": 6000 + i, "title": None, "description": " ".join(vocabulary), "building_size": "50"} for i in range(2)]  # long texts
    df = listings(rows, ["row_id", "size", "words"])
    want = brute(spark, df)
    got = [tuple(r) for r in N.pairs_found(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(want)
    assert len(want) > 40 and len(set(want) - set(got)) <= 0.02 * len(want)
    groups = {r.source_row_id: r for r in N.offer_groups(df).collect()}
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id
    assert N.pairs_found(df.limit(0)).count() == 0 and N.offer_groups(df.limit(0)).count() == 0


def test_a_third_of_all_rows_in_one_group_of_copies(spark, listings):
    rng = random.Random(1)
    text = " ".join(rng.sample([f"w{i}" for i in range(900)], 50))
    rows = [{"source_row_id": i, "description": text, "building_size": "80"} for i in range(60)]
    rows += [{"source_row_id": 100 + i, "description": " ".join(rng.sample([f"x{j}" for j in range(5000)], 50)), "building_size": "80"} for i in range(120)]
    got = {tuple(r) for r in N.pairs_found(listings(rows)).collect()}
    assert got == set(itertools.combinations(range(60), 2))


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.7, 0.9):
        errors = []
        for _ in range(20):
            union = rng.choice(1 << 32, 400, replace=False).astype(np.uint32)
            common = int(400 * j)
            a = np.sort(union[: common + (400 - common) // 2])
            b = np.sort(np.concatenate([union[:common], union[common + (400 - common) // 2 :]]))
            sig = N.minhash(np.concatenate([a, b]), np.array([0, len(a)]), 280)
            odd = N.odd_sketches(sig)
            away = sum(bin(int(x) & (2**64 - 1)).count("1") for x in odd[0] ^ odd[1])
            errors.append(N.sketch_similarity(away, 280) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
        assert N.sketch_similarity(round(N.differing_bits(j, 280)), 280) == __import__("pytest").approx(j, abs=0.01)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.group for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 100} == {0} and {v for k, v in got.items() if k >= 200} == {200}
