"""Languages of documents and of their segments (problem 10): word-first backoff.

A sentence's known words score by their log frequency in each language. An unseen word falls back to its character n-grams, from
five letters down to one: the longest length of which at least half the grams are known decides. What stands in quotes or brackets
is left out, and a sentence with too little evidence takes the language of the one before it.

Training starts from the right examples of every language and grows by sentences of a bounded sample of documents on whose
language the model and, if it names one, the document's label agree.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of language labels, by ISO 639-1 code.
LABELS = {
    "fa": "fa per fas persian farsi فارسی", "en": "en eng english", "ar": "ar ara arabic العربية عربي عربی", "tr": "tr tur turkish türkçe turkce",
    "de": "de ger deu german deutsch", "fr": "fr fre fra french français francais", "ru": "ru rus russian русский", "ur": "ur urd urdu اردو",
    "es": "es spa spanish español", "it": "it ita italian italiano", "az": "az aze azerbaijani", "ku": "ku kur kurdish", "ps": "ps pus pashto", "hi": "hi hin hindi", "zh": "zh chi zho chinese", "nl": "nl dut nld dutch", "pt": "pt por portuguese",
}
CODES = {word: code for code, words in LABELS.items() for word in words.split()}

SENTENCE = re.compile(r"[^.!?؟۔。\n]*(?:[.!?؟۔。]+(?!\s|$)[^.!?؟۔。\n]*)*[.!?؟۔。]*\s*")
ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|«[^«»]*»|“[^“”„]*[“”]|„[^„“”]*[“”]|\"[^\"]*\"|‹[^‹›]*›")
WORD = re.compile("[^\\W\\d_]+(?:[\u200c'’][^\\W\\d_]+)*")
ORDERS = (5, 4, 3, 2, 1)


def label_code(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names in any spelling, None if it names none."""
    word = (label or "").strip().lower()
    return CODES.get(word) or CODES.get(re.split(r"[-_ ]", word)[0])


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence with its trailing space; together they are the whole text."""
    for m in SENTENCE.finditer(text):
        if m.end() > m.start():
            yield m.span()


def words_of(sentence: str) -> list[str]:
    return WORD.findall(ASIDE.sub(" ", sentence).lower())


class Backoff:
    """Word and n-gram tables: word -> row of ``known`` (log frequency per language); grams per order -> row of ``grams``."""

    def __init__(self, counts: dict[str, Counter], smoothing: float = 0.05, least: int = 1):
        self.languages = sorted(counts)
        n = len(self.languages)
        words = {w for c in counts.values() for w, k in c.items() if k >= least}
        self.known = {w: i for i, w in enumerate(sorted(words))}
        table = np.zeros((len(words), n), dtype=np.float64)
        tables: dict[int, dict[str, np.ndarray]] = {o: defaultdict(lambda: np.zeros(n)) for o in ORDERS}
        for j, lang in enumerate(self.languages):
            for w, k in counts[lang].items():
                if w in self.known:
                    table[self.known[w], j] = k
                # types rather than tokens: a name that repeats must not shape the n-grams
                for o in ORDERS:
                    marked = f" {w} "
                    for i in range(len(marked) - o + 1):
                        tables[o][marked[i : i + o]][j] += 1 + np.log(k)
        total = np.maximum(table.sum(axis=0), 1)
        self.vectors = np.log((table + smoothing) / (total + smoothing * max(len(words), 1)))
        self.grams: dict[int, dict[str, np.ndarray]] = {}
        for o, t in tables.items():
            sums = np.maximum(sum(t.values()) if t else np.ones(n), 1)
            self.grams[o] = {g: np.log((v + smoothing) / (sums + smoothing * len(t))).astype(np.float32) for g, v in t.items()}

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that no language has: half the weight of a known one, by its longest known n-grams."""
        marked = f" {word} "
        for o in ORDERS:
            if len(marked) < o:
                continue
            all_grams = [marked[i : i + o] for i in range(len(marked) - o + 1)]
            rows = [self.grams[o][g] for g in all_grams if g in self.grams[o]]
            if 2 * len(rows) >= len(all_grams):
                mean = np.mean(rows, axis=0)
                return 0.5 * (mean - mean.max()) * min(3.0, len(rows) / 2)
        return np.zeros(len(self.languages))


class Scorer:
    """Scores batches of sentences; remembers the vectors of words it has met, up to a bound."""

    def __init__(self, model: Backoff, memory: int = 300_000):
        self.model, self.memory = model, memory
        self.fresh()

    def fresh(self) -> None:
        centred = self.model.vectors - self.model.vectors.max(axis=1, keepdims=True)
        self.row = dict(self.model.known)
        self.rows = np.concatenate([centred, np.zeros((max(4096, len(centred) // 2), centred.shape[1]))])

    def vector(self, word: str) -> int:
        at = len(self.row)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.model.unseen(word)
        self.row[word] = at
        return at

    def scores(self, batch: list[list[str]]) -> np.ndarray:
        """sentences x languages: summed log scores."""
        if len(self.row) > self.memory + len(self.model.known):
            self.fresh()
        get, make = self.row.get, self.vector
        flat = []
        for ws in batch:
            for w in ws:
                i = get(w)
                flat.append(make(w) if i is None else i)
        sizes = np.array([len(ws) for ws in batch])
        out = np.zeros((len(batch), len(self.model.languages)))
        full = sizes > 0
        if full.any():
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = np.add.reduceat(self.rows[np.array(flat)], starts, axis=0)
        return out


def _posterior(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(samples: DataFrame, documents: DataFrame, most_documents: int = 1200, most_sentences: int = 120, rounds: int = 2, sure: float = 0.98) -> Backoff:
    """The model from the right examples and a bounded sample: of at most ``most_documents`` documents, those with the smallest hash of
    their id, ``most_sentences`` sentences each at most, those with the smallest hash. Only the ids are sorted; sentences are cut where
    the texts lie, and the driver gets no whole text."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in samples.where("text IS NOT NULL AND lang_code IS NOT NULL").select("lang_code", "text").collect():
        counts[r.lang_code].update(words_of(r.text))
    if not counts:
        raise ValueError("no right examples to start from")
    model = Backoff(counts)
    chosen = documents.where("text IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, text in zip(pdf["lang"], pdf["text"]):
                found = (text[a:b] for a, b in sentences(text) if b - a <= 2000)
                least = heapq.nsmallest(most_sentences, ((zlib.crc32(x.encode("utf-8", "surrogatepass")), x) for x in found))
                yield pd.DataFrame({"label": [label] * len(least), "sentence": [x for _, x in least]})

    texts = documents.where("text IS NOT NULL").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("lang", "text")
    parts = [(label_code(r.label), words_of(r.sentence)) for r in texts.mapInPandas(cut, "label string, sentence string").collect()]
    parts = [(label, ws) for label, ws in parts if len(ws) >= 3]
    for _ in range(rounds if parts else 0):
        p = _posterior(Scorer(model).scores([ws for _, ws in parts]))
        grown: dict[str, Counter] = defaultdict(Counter, {k: Counter(c) for k, c in counts.items()})
        for (label, ws), row in zip(parts, p):
            best = model.languages[int(row.argmax())]
            if row.max() >= (0.6 if label == best else sure):
                grown[best].update(ws)
        model = Backoff(grown)
    return model


def segment(text: str, scorer: Scorer, least_words: int = 3, sure: float = 0.9) -> list[tuple[int, int, str | None, float]]:
    """(start, end, code, confidence) of the longest runs of sentences in one language; code None for text without evidence.

    Confidence is the word-weighted mean of the sentences' posteriors. A sentence of fewer words or a lower posterior takes the
    language of the sentence before it, or after it at the start.
    """
    spans = list(sentences(text))
    batch = [words_of(text[a:b]) for a, b in spans]
    if not batch:
        return []
    p = _posterior(scorer.scores(batch))
    best, top = p.argmax(axis=1), p.max(axis=1)
    clear = [len(ws) >= least_words and t >= sure for ws, t in zip(batch, top)]
    if not any(clear):  # one decision over everything
        all_p = _posterior(scorer.scores([[w for ws in batch for w in ws]]))[0]
        n = sum(map(len, batch))
        code = scorer.model.languages[int(all_p.argmax())] if n else None
        return [(0, len(text), code, float(all_p.max()) if n else 0.0)]
    codes, last = [], None
    for b, ok in zip(best, clear):
        last = int(b) if ok else last
        codes.append(last)
    first = next(c for c in codes if c is not None)
    codes = [first if c is None else c for c in codes]
    out: list[list] = []
    for (a, b), c, row, ws in zip(spans, codes, p, batch):
        if out and out[-1][2] == c:
            out[-1][1] = b
            out[-1][3] += row[c] * len(ws)
            out[-1][4] += len(ws)
        else:
            out.append([a, b, c, row[c] * len(ws), len(ws)])
    return [(a, b, scorer.model.languages[c], float(s / max(n, 1))) for a, b, c, s, n in out]


def language_segments(documents: DataFrame, model: Backoff) -> DataFrame:
    """doc_id, segment, start, end (offsets in code points), lang_code, confidence: whole texts, in order, without gaps.

    NULL and empty texts have no segment. Text without words gets one segment with NULL code and confidence 0. Rows with equal
    ids are segmented each by itself. An empty table gives no rows.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            rows = [(i, k, *s) for i, t in zip(pdf["doc_id"], pdf["text"]) for k, s in enumerate(segment(t, scorer))]
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "start", "end", "lang_code", "confidence"])

    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(segments, "doc_id long, segment int, start long, end long, lang_code string, confidence double")


def document_languages(documents: DataFrame, model: Backoff) -> DataFrame:
    """doc_id, lang_code (of most text), confidence (its share of the text times its certainty), languages (sorted codes), labelled
    (code named by the label, NULL if none) and label_right (the label names the only language of the text).

    NULL, empty and wordless texts get NULL code, confidence 0 and no languages. No shuffle.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            rows = []
            for i, t, label in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                size: dict[str, float] = defaultdict(float)
                sure: dict[str, float] = defaultdict(float)
                for a, b, code, conf in segment(t, scorer) if t else []:
                    if code:
                        size[code] += b - a
                        sure[code] += (b - a) * conf
                named = label_code(label)
                main = max(size, key=lambda c: (size[c], c)) if size else None
                rows.append((i, main, sure[main] / sum(size.values()) if main else 0.0, sorted(size), named, bool(main) and [named] == sorted(size)))
            yield pd.DataFrame(rows, columns=["doc_id", "lang_code", "confidence", "languages", "labelled", "label_right"])

    return documents.select("doc_id", "text", "lang").mapInPandas(decide, "doc_id long, lang_code string, confidence double, languages array<string>, labelled string, label_right boolean")


def languages_to_report(documents: DataFrame, model: Backoff) -> DataFrame:
    """(doc_id, lang_code): every language of documents without a right label or with more than one language."""
    return document_languages(documents, model).where(~F.col("label_right")).select("doc_id", F.explode("languages").alias("lang_code"))
