"""Training of the tagger for personal information.

    python -m arzyab.llm.pii_train LISTINGS.parquet pii_model.npz [most_texts [START.npz]]

A bounded sample of descriptions (``most_texts``, smallest hash of the id) is labelled by patterns with their context, and composed
items and look-alikes (``pii_compose``) are inserted between their sentences, so that the model learns forms, names and contexts which
the sample lacks. The gate is fitted first; the tagger learns from what the gate lets through. A held-out tenth of the texts is scored by
spans: against the patterns, and with composed items of names, carriers and forms kept out of training.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from arzyab.llm import pii
from arzyab.llm.gate import Gate, fit_gate
from arzyab.llm.pii_compose import Composer, inserted
from arzyab.llm.tagger import Tagger, fit

FA = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیء"
FAMILY = rf"[{FA}]+(?:خواه|پور|منش|زاده|نژاد|نیا|فر)(?![{FA}])"
TITLE = r"(?:سرکار خانم|جناب اقای|اقای|خانم|جناب|مهندس|دکتر)"
# What stands before the name of an agency or place.
PLACE = r"(?:املاک|مشاور|بنگاه|دفتر|شرکت|برج|مجتمع|پارک|کتابخانه|پاساژ|پروژه|شهرک|باغ|گروه) "
PATTERNS = (
    ("email", re.compile(r"(?<![a-z0-9._+\-])([a-z0-9._+\-]+ ?(?:@|\(at\)|\[at\]) ?[a-z0-9\-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[a-z0-9\-]+)+)")),
    ("phone", re.compile(r"(?<![0-9/\-])((?:\+ ?98|0 ?0 ?9 ?8|\(0|0)(?:[ .\-()]{0,2}[0-9]){8,12})(?![0-9])")),
    ("identity_number", re.compile(r"(?<![0-9\-])([0-9]{3}[ \-]?[0-9]{6}[ \-]?[0-9])(?![0-9])")),
    ("identity_number", re.compile(r"(?:پاسپورت|گذرنامه|passport(?: no)?\.?)[ :]*([a-z] ?[0-9]{8})(?![0-9])")),
    ("street_address", re.compile(r"((?:خیابان|بلوار|کوی|میدان|کوچه|بزرگراه|بن ?بست) (?:(?!پارکینگ|خیابان ارام)[^\n./\-]){0,70}?(?:پلاک|شماره) [0-9]+(?:[ ,]+(?:واحد|زنگ|طبقه|ط) [0-9]+)?)")),
    ("street_address", re.compile(rf"(?<![{FA}])((?:خ|ک|م)\.? [{FA} ]{{2,40}}? (?:پ|ش|پلاک)\.? ?[0-9]+(?: (?:ط|و|واحد)\.? ?[0-9]+)?)")),
    ("street_address", re.compile(r"((?:no\.? ?)?[0-9]+,? [a-z]+ (?:street|alley|avenue|boulevard|lane|road|square)(?:, unit [0-9]+)?)")),
    ("person_name", re.compile(rf"{TITLE} ((?:[{FA}]+ )?{FAMILY})")),
    ("person_name", re.compile(rf"(?:(?:^|[ \n])با|نزد|مالک:) (?!{PLACE})([{FA}]+ {FAMILY})")),
    ("person_name", re.compile(r"(?:\b(?:mr|mrs|ms|dr)\.? |owner )([a-z]+ [a-z]+)")),
)
NOT_BEFORE = re.compile(r"(?:اگهی|سند|پرونده ثبتی|پرونده)[ :]*$")


def label(plain: str) -> np.ndarray:
    """The tags of a folded text by patterns; the first pattern that takes a character keeps it."""
    tags = np.zeros(len(plain), dtype=np.int8)
    for kind, pattern in PATTERNS:
        n = pii.TYPES.index(kind)
        for m in pattern.finditer(plain):
            a, b = m.span(1)
            if tags[a:b].any() or kind == "identity_number" and (NOT_BEFORE.search(plain[:a]) or m[1][0].isdigit() and not pii.national_code(re.sub(r"\D", "", m[1]))):
                continue
            if kind == "person_name" and m[1].startswith("ناظر"):
                continue
            tags[a], tags[a + 1 : b] = 2 * n + 1, 2 * n + 2
    return tags


def sample(text: str, composer: Composer, share: float = 0.9) -> tuple[str, np.ndarray]:
    """A text and its tags, mostly with composed items and look-alikes put between its sentences."""
    plain = pii.plain_text(pii.encode(text)[0])
    tags = label(plain)
    if share < 1 and composer.chance(0.1):  # phrases alone
        plain, tags = "", tags[:0]
    if not plain or composer.chance(share):
        plain, tags = inserted(plain, tags, [composer.phrase() for _ in range(int(composer.rng.integers(1, 6)))], composer.rng)
    return plain, tags


def numbered(tags: np.ndarray) -> np.ndarray:
    """The number of the item that each character belongs to, 0 for none."""
    return np.where(tags > 0, np.cumsum(tags % 2 == 1), 0)


def examples(samples: list[tuple[np.ndarray, np.ndarray]], gate: Gate, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What the gate lets through, with other digits in some items, and whole texts here and there."""
    xs, ys = [], []
    digits = np.array([pii.ALPHABET.index(c) + 1 for c in "0123456789"])
    for ids, tags in samples:
        pieces = [(0, len(ids))] if rng.random() < 0.03 or len(ids) < 150 else pii.regions_of(gate.fires(ids), len(ids), pii.CONTEXT + int(rng.integers(-12, 8)))
        for a, b in pieces:
            while a < b and tags[a] and tags[a] % 2 == 0:  # don't start inside an item
                a += 1
            x, y = ids[a:b].copy(), tags[a:b]
            if len(x) < 4 or not y.any() and rng.random() < 0.25:
                continue
            vary = (y > 0) & np.isin(x, digits) & (rng.random(len(x)) < 0.3)
            for s in np.flatnonzero(y == 3):  # a phone's first digits stay
                vary[s : s + 7] = False
            x[vary] = rng.choice(digits, vary.sum())
            xs.append(x.astype(np.int64))
            ys.append(y.astype(np.int64))
    return xs, ys


def score(model: pii.Model, texts: list[str], composer: Composer | None = None) -> dict[str, dict[str, float]]:
    """Per type: items, found (share overlapped by a found item of the type), exact (same ends), gated (share that the gate lets
    through), right (share of found items that overlap one of the type). Texts with composed items if a composer is given, else
    against the labelling patterns."""
    out = {k: dict(items=0, found=0, exact=0, gated=0, got=0, right=0) for k in pii.TYPES}
    made = [sample(t, composer, 1.0) if composer else (lambda p: (p, label(p)))(pii.plain_text(pii.encode(t)[0])) for t in texts]
    # read as they stand: the labels' places must stay those of the text
    kept = [(p, t) for p, t in made if len(pii.encode(p)[0]) == len(p)]
    for (plain, tags), found in zip(kept, pii.find_items([p for p, _ in kept], model)):
        want = pii.spans(plain, tags)
        passed = np.zeros(len(plain) + 1, dtype=bool)
        for a, b in pii.regions_of(model.gate.fires(pii.encode(plain)[0]), len(plain), 0):
            passed[a:b] = True
        for a, b, k in want:
            o = out[k]
            o["items"] += 1
            o["found"] += any(x < b and a < y and k == z for x, y, z in found)
            o["exact"] += (a, b, k) in found
            o["gated"] += passed[a:b].any()
        for x, y, k in found:
            out[k]["got"] += 1
            out[k]["right"] += any(x < b and a < y and k == z for a, b, z in want)
    return {k: {"items": o["items"], "got": o["got"], **{n: round(float(o[n] / max(o["items"], 1)), 4) for n in ("found", "exact", "gated")}, "right": round(float(o["right"] / max(o["got"], 1)), 4)} for k, o in out.items()}


def train(texts: list[str], hidden: int = 24, epochs: int = 11, rounds: int = 2, seed: int = 5, processes: int = 1, start: pii.Model | None = None, log=print) -> pii.Model:
    """Rounds of fitting, each on newly composed samples of the same texts; after the first (or from ``start``) at a lower rate."""
    held, kept = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    model = start
    for n in range(rounds):
        composer = Composer(seed + 100 * n + (len(texts) if start else 0))
        made = [sample(t, composer, 0.9 if model is None else 0.6) for t in kept]
        samples = [(ids, tags) for ids, tags in ((pii.encode(p)[0], t) for p, t in made) if len(ids) == len(tags)]
        gate = model.gate if model else fit_gate([i for i, _ in samples], [numbered(t) for _, t in samples], log=log)
        xs, ys = examples(samples, gate, composer.rng)
        if log:
            log(f"{len(xs)} windows, {sum(map(len, xs))} characters of {sum(len(i) for i, _ in samples)}")
        tagger = fit(model.tagger if model else Tagger.fresh(pii.CHARACTERS, hidden, pii.TAGS), xs, ys, epochs=epochs if model is None else -(-epochs // 2), rate=0.012 if model is None else 0.005, processes=processes, log=log)
        model = pii.Model(gate, tagger)
    if log:
        log(f"patterns: {score(model, held)}")
        log(f"other names in known phrases: {score(model, held, Composer(seed + 1, held=True, known_carriers=True))}")
        log(f"other names and phrases: {score(model, held, Composer(seed + 2, held=True))}")
    return model


if __name__ == "__main__":
    import os

    import pyarrow.parquet as pq

    rows = pq.read_table(sys.argv[1], columns=["source_row_id", "description"]).to_pandas().dropna()
    most = int(sys.argv[3]) if len(sys.argv) > 3 else 9_000
    rows = rows.assign(k=(rows["source_row_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).sort_values("k").head(most)
    before = pii.Model.from_bytes(open(sys.argv[4], "rb").read()) if len(sys.argv) > 4 else None
    trained = train(list(rows["description"]), rounds=1 if before else 2, processes=os.cpu_count() or 1, start=before)
    with open(sys.argv[2], "wb") as f:
        f.write(trained.to_bytes())
