"""A learned gate before the training of an expensive sequence model: a linear model over hashed runs of four characters.

Every run of four characters has a weight, learned by logistic regression over stretches that overlap an item or don't; a stretch of
``REACH`` runs fires where their weights add up to more than a bound. Runs that training never met weigh towards an item, so new words
are read rather than passed over. The bound is set from the share of items that must fire.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BUCKET_BITS, REACH = 16, 12


def buckets(ids: np.ndarray) -> np.ndarray:
    """The bucket of the run of four characters that starts at each place but the last three."""
    a = ids.astype(np.uint32)
    key = a[:-3] + a[1:-2] * np.uint32(131) + a[2:-1] * np.uint32(17_161) + a[3:] * np.uint32(2_248_091)
    return (key * np.uint32(2_654_435_761)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Gate:
    """weights: one of int8 per bucket; bound: the sum over REACH runs from which a stretch fires."""

    weights: np.ndarray
    bound: int

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The sum of each stretch, by its first character; at least one stretch, which short texts don't fill."""
        if len(ids) < 4:
            return np.zeros(0, dtype=np.int32)
        total = np.concatenate([[0], np.cumsum(self.weights[buckets(ids)], dtype=np.int32)])
        reach = min(REACH, len(total) - 1)
        return total[reach:] - total[:-reach]

    def fires(self, ids: np.ndarray) -> np.ndarray:
        """First characters of the stretches that fire. Texts of fewer than four characters hold no item."""
        return np.flatnonzero(self.scores(ids) >= self.bound)

    def fires_of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """``fires`` of many texts at once."""
        flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8)
        if len(flat) < REACH + 3:
            return [self.fires(t) for t in texts]
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(self.weights[buckets(flat)], dtype=np.int64)])
        at = np.flatnonzero(total[REACH:] - total[:-REACH] >= self.bound)
        of = np.searchsorted(ends, at, side="right")
        inside = at + REACH + 3 <= ends[of]  # not across two texts
        at, of = at[inside], of[inside]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        return [self.fires(t) if len(t) < REACH + 3 else at[cuts[n] : cuts[n + 1]] - (ends[n] - sizes[n]) for n, t in enumerate(texts)]


def fit_gate(texts: list[np.ndarray], inside: list[np.ndarray], unseen: float = 1.0, rounds: int = 6, recall: float = 0.9998, most_bound: int = 0, seed: int = 3, log=None) -> Gate:
    """texts: character ids; inside: number of the item that each character belongs to, 0 for none.

    recall: the share of the items given that must hold a stretch that fires. most_bound: the bound is no higher, as items of other parts
    score lower than those that were learned from.
    """
    rng = np.random.default_rng(seed)
    starts, labels, flat, base = [], [], [], 0
    for ids, item in zip(texts, inside):
        n = len(ids) - 3
        if n < REACH:
            continue
        flat.append(buckets(ids))
        count = np.concatenate([[0], np.cumsum(item > 0)])
        held = count[REACH + 3 :] - count[: -REACH - 3]  # characters of items in each stretch
        places = np.arange(n - REACH + 1)
        yes, no = places[held[: len(places)] >= 8], places[held[: len(places)] == 0]
        no = no[rng.random(len(no)) < 0.15]
        starts += [yes + base, no + base]
        labels += [np.ones(len(yes), np.float32), np.zeros(len(no), np.float32)]
        base += n
    flat, starts, labels = np.concatenate(flat), np.concatenate(starts), np.concatenate(labels)
    weights, grown = np.zeros(1 << BUCKET_BITS), np.full(1 << BUCKET_BITS, 1e-3)
    bias = -2.0
    for _ in range(rounds):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), 4096):
            pick = order[at : at + 4096]
            runs = flat[starts[pick][:, None] + np.arange(REACH)]
            z = weights[runs].sum(axis=1) + bias
            off = 1 / (1 + np.exp(-z)) - labels[pick]
            grad = np.bincount(runs.ravel(), np.repeat(off, REACH), 1 << BUCKET_BITS) + 1e-3 * weights
            grown += grad * grad
            weights -= 0.3 * grad / np.sqrt(grown)
            bias -= 0.002 * off.mean()
    met = np.bincount(flat, minlength=1 << BUCKET_BITS) > 0
    weights = np.where(met, weights, unseen)
    scale = 127 / max(np.abs(weights).max(), 1e-9)
    gate = Gate(np.clip(np.round(weights * scale), -127, 127).astype(np.int8), 0)
    best: list[int] = []  # of each item, the highest sum of a stretch that overlaps it
    for ids, item in zip(texts, inside):
        if not item.any():
            continue
        s = gate.scores(ids)
        for k in np.unique(item[item > 0]):
            at = np.flatnonzero(item == k)
            near = s[max(0, at[0] - REACH) : at[-1] + 1]
            best.append(int(near.max()) if len(near) else -(10**6))
    gate.bound = min(int(np.quantile(best, 1 - recall, method="lower")) if best else 0, most_bound)
    if log:
        log(f"gate: {len(starts)} stretches, {len(best)} items, bound {gate.bound}, {np.mean(np.concatenate([gate.scores(t) for t in texts[:2000]]) >= gate.bound):.3f} of stretches fire")
    return gate
