"""Personal information inside free text (problem 3).

Texts are turned to character ids (alike characters to one id, invisible ones left out, with a map back). A character-level BiLSTM-CRF
(``tagger``) reads every character: common texts whole, longer ones in overlapping windows, where each character's tag comes from the
window in which it stands farthest from an edge. Runs of one type become spans; identity numbers pass an exact check of their check
digit or form. Spans are replaced by typed placeholders, the rest of the text stays as it was. A learned linear gate (``gate``) only
picks what the tagger is trained on (``pii_train``).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arzyab.functions.text import fold_tables
from arzyab.llm.gate import REACH, Gate
from arzyab.llm.tagger import Tagger

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
# Tag 0: outside; 2n+1: first character of type n; 2n+2: a further one.
TAGS = 1 + 2 * len(TYPES)
ALPHABET = " \n0123456789abcdefghijklmnopqrstuvwxyzابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیء.,:;-_/()[]{}<>@+|*#&%!?؟؛«»\"'"
OTHER = len(ALPHABET) + 1
CHARACTERS = OTHER + 1
WINDOW, STRIDE = 960, 864
PART = 5000  # descriptions sorted by length together: the more, the less padding
CONTEXT = 40  # characters on both sides of what fires, in training
STRETCH = REACH + 3
LEAD = np.array([ALPHABET.index(c) + 1 for c in ". "], dtype=np.uint8)


@cache
def id_table() -> np.ndarray:
    """Code point (of the first plane) -> character id; 0 for characters to leave out."""
    a, b = fold_tables()
    folds = dict(zip(a, b))
    gone = set(a[len(b) :])
    ids = {c: i + 1 for i, c in enumerate(ALPHABET)}
    table = np.full(65536, OTHER, dtype=np.uint8)
    for code in range(65536):
        ch = chr(code)
        if ch in gone:
            table[code] = 0
            continue
        plain = folds.get(ch, ch).lower()
        table[code] = ids.get(plain, ids[" "] if ch.isspace() else OTHER) if len(plain) == 1 else OTHER
    return table


@cache
def _plain() -> np.ndarray:
    return np.array([0, *map(ord, ALPHABET), ord("~")], dtype=np.uint32)


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, position of each in the text); characters without an id of their own are kept as "other"."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = id_table()[np.minimum(codes, 65535)]
    at = np.flatnonzero(ids)
    return ids[at], at


def plain_text(ids: np.ndarray) -> str:
    """The folded text of ids, one character each."""
    return _plain()[ids].tobytes().decode("utf-32-le")


def regions_of(fires: np.ndarray, length: int, context: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that fire, with ``context`` characters on both sides, joined where they meet."""
    if not len(fires):
        return []
    a, b = np.maximum(fires - context, 0), np.minimum(fires + STRETCH + context, length)
    new = np.flatnonzero(a[1:] > b[:-1]) + 1
    return list(zip(a[np.concatenate([[0], new])].tolist(), b[np.concatenate([new - 1, [len(b) - 1]])].tolist()))


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows over all characters of a stretch."""
    last = max(0, -(-(end - start - WINDOW) // STRIDE))
    return [(start + k * STRIDE, min(end, start + k * STRIDE + WINDOW)) for k in range(last + 1)]


@dataclass
class Model:
    """The tagger, which reads personal information, and the gate, which picks what it is trained on."""

    gate: Gate
    tagger: Tagger

    def to_bytes(self) -> bytes:
        b = io.BytesIO()
        np.savez_compressed(b, gate=self.gate.weights, bound=np.array(self.gate.bound), **self.tagger.arrays())
        return b.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        return Model(Gate(z["gate"], int(z["bound"])), Tagger.from_arrays(z))


@cache
def default_model() -> Model:
    """The weights that ``pii_train`` made from a bounded sample of listings."""
    return Model.from_bytes(resources.files("arzyab.llm").joinpath("pii_model.npz").read_bytes())


def tag_windows(model: Tagger, texts: list[np.ndarray], windows: list[tuple[int, int, int]], batch: int = 256) -> dict[int, np.ndarray]:
    """Text number -> tags of all its characters, reconciled over overlapping windows (text number, start, end)."""
    tags: dict[int, np.ndarray] = {}
    edge: dict[int, np.ndarray] = {}
    order = sorted(range(len(windows)), key=lambda i: windows[i][2] - windows[i][1])
    for at in range(0, len(order), batch):
        group = order[at : at + batch]
        width = max(windows[i][2] - windows[i][1] for i in group)
        ids = np.zeros((len(group), width), dtype=np.uint8)
        for r, i in enumerate(group):
            n, a, b = windows[i]
            ids[r, : b - a] = texts[n][a:b]
        best = model.decode(ids)
        for r, i in enumerate(group):
            n, a, b = windows[i]
            if b - a == len(texts[n]):
                tags[n] = best[r, : b - a]
                continue
            if n not in tags:
                tags[n] = np.zeros(len(texts[n]), dtype=np.int8)
                edge[n] = np.full(len(texts[n]), -1, dtype=np.int32)
            far = np.minimum(np.arange(a, b) - a + (10**6 if a == 0 else 0), b - 1 - np.arange(a, b) + (10**6 if b == len(texts[n]) else 0))
            better = far > edge[n][a:b]
            tags[n][a:b][better] = best[r, : b - a][better]
            edge[n][a:b][better] = far[better]
    return tags


def national_code(digits: str) -> bool:
    """Whether ten digits carry the right check digit of an Iranian national code."""
    if len(digits) != 10 or not digits.isdigit() or len(set(digits)) == 1:
        return False
    r = sum(int(d) * (10 - i) for i, d in enumerate(digits[:9])) % 11
    return int(digits[9]) == (r if r < 2 else 11 - r)


def _plausible(kind: str, piece: str) -> bool:
    digits = re.sub(r"\D", "", piece)
    if kind == "identity_number":
        return national_code(digits) or re.fullmatch(r"[a-z] ?[0-9]{7,9}", piece.strip()) is not None
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "email":
        return "@" in piece or "at" in piece
    if kind == "street_address":
        return bool(digits)
    return len(piece.strip()) >= 3


def spans(plain: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the tagged items; spaces and separators at their ends are left out."""
    out: list[tuple[int, int, str]] = []
    n = len(tags)
    on = np.flatnonzero(tags)
    i = 0
    while i < len(on):
        a = int(on[i])
        kind = (tags[a] - 1) // 2
        b = a + 1
        while b < n and tags[b] == 2 * kind + 2:
            b += 1
        i = int(np.searchsorted(on, b))
        while b > a and plain[b - 1] in " \n.,:;-/|":
            b -= 1
        while a < b and plain[a] in " \n,:;-/|":
            a += 1
        if b > a and _plausible(TYPES[kind], plain[a:b]):
            out.append((a, b, TYPES[kind]))
    return out


def find_items(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the items of each text, in positions of the text itself."""
    ids, places, windows = [], [], []
    for n, t in enumerate(texts):
        i, at = encode(t or "")
        # A text begins as if after a sentence, which training saw far more often than a bare beginning.
        ids.append(np.concatenate([LEAD, i]) if len(i) else i)
        places.append(np.concatenate([[0, 0], at]) if len(i) else at)
        windows += [(n, a, b) for a, b in windows_of(0, len(ids[n])) if b]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for n, tags in tag_windows(model.tagger, ids, windows).items():
        if tags.any():
            out[n] = [(int(places[n][a]), int(places[n][b - 1]) + 1, k) for a, b, k in spans(plain_text(ids[n]), tags)]
    return out


def pii_types(listings: DataFrame, model: Model | None = None) -> DataFrame:
    """(source_row_id, pii_type): the types of which a description holds at least one item. No shuffle.

    NULL and empty descriptions hold none; whole texts of any length are read; an empty table gives no rows.
    """
    model = model or default_model()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), PART):
                part = pdf.iloc[a : a + PART]
                rows = [(i, k) for i, found in zip(part["source_row_id"], find_items(list(part["description"]), model)) for k in sorted({x[2] for x in found})]
                yield pd.DataFrame(rows, columns=["source_row_id", "pii_type"])

    return listings.where("description IS NOT NULL").select("source_row_id", "description").mapInPandas(scan, "source_row_id long, pii_type string")


def masked(text: str, items: list[tuple[int, int, str]]) -> str:
    for a, b, kind in reversed(items):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


def mask_descriptions(listings: DataFrame, model: Model | None = None) -> DataFrame:
    """source_row_id, description with typed placeholders, items (number replaced); NULL stays NULL with 0 items. No shuffle."""
    model = model or default_model()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), PART):
                part = pdf.iloc[a : a + PART]
                texts = list(part["description"])
                found = find_items(texts, model)
                yield pd.DataFrame({"source_row_id": part["source_row_id"], "description": [None if t is None else masked(t, f) for t, f in zip(texts, found)], "items": [len(f) for f in found]})

    return listings.select("source_row_id", F.col("description")).mapInPandas(scan, "source_row_id long, description string, items int")
