"""Operator 1, language identification with spans.

Words are maximal runs of letters. Scripts seen in training narrow the
languages a word can have; its score for each is the sum of log probabilities
of its character trigrams, hashed into a fixed number of buckets. A Viterbi
pass over the words of a text, with a penalty for every switch, labels spans;
the language with most letters is the text's.

Training counts trigrams of all labelled rows inside the tasks, so the model
that reaches the driver and the tasks has ``buckets x languages`` numbers,
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import code_points, map_rows, mix64

UNDETERMINED = "und"
#: First code points of the ranges by which scripts are told
#: apart (Unicode blocks); a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFF66, "Katakana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_RANGE_SCRIPT = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])

BUCKETS = 1 << 15


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass(frozen=True)
class Model:
    """``logs[bucket, language]`` and which scripts each language uses."""

    languages: tuple[str, ...]
    logs: np.ndarray
    scripts: np.ndarray


def _lower(text: str) -> str:
    """Lower case that keeps the number of code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the bucket of the trigram around each; what is
    not a letter counts as one separator."""
    letter = _letters()[points]
    c = np.where(letter, points, 32).astype(np.uint64)
    padded = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    at = np.flatnonzero(letter)
    h = padded[at] | padded[at + 1] << np.uint64(21) | padded[at + 2] << np.uint64(42)
    return at, (mix64(h) >> np.uint64(64 - 15)).astype(np.int64)


def _script(points: np.ndarray) -> np.ndarray:
    return _RANGE_SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5, least_share: float = 0.005) -> Model:
    """Trigram counts of all rows with a text and a language.

    A language uses a script that holds ``least_share`` of its letters. Rows
    with a null text or language teach nothing.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(_lower(t))
            for name, texts in by_lang.items():
                total = grams.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for part in _parts(texts):
                    points = code_points("\n".join(part))
                    at, buckets = _grams(points)
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(_script(points[at]), minlength=len(SCRIPT_NAMES))
        for name, total in grams.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                             names=["l", "b", "n"])

    counts = map_rows(rows, count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("l").agg(F.collect_list(F.struct("b", "n")).alias("c")).orderBy("l").collect()
    languages = tuple(r["l"] for r in packed)
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    for j, r in enumerate(packed):
        for b, n in r["c"]:
            table[b, j] = n
    grams = table[:BUCKETS] + smoothing
    logs = np.log(grams / grams.sum(axis=0))
    used = table[BUCKETS:]
    return Model(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), used >= least_share * np.maximum(used.sum(axis=0), 1))


def _parts(texts: list[str], size: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` code points, so that the arrays of a
    run stay small; a longer text is a run of its own."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t) + 1
    if part:
        yield part


def _word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words of all texts: text number, start and end in it, and scores."""
    numbers, starts, ends, scores = [], [], [], []
    first = 0
    impossible = np.float32(-50)
    any_script = model.scripts.any(axis=1)
    for part in _parts(texts):
        points = code_points("\n".join(part))
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        at, buckets = _grams(points)
        if len(at):
            new = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            word_start, word_end = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1] + 1
            number = np.searchsorted(offsets, word_start, side="right") - 1
            score = np.add.reduceat(model.logs[buckets], new, axis=0)
            script = _script(points[word_start])
            allowed = model.scripts[script]
            score = np.where(allowed, score, np.where(any_script[script][:, None], impossible, np.float32(0)))
            numbers.append(number + first)
            starts.append(word_start - offsets[number])
            ends.append(word_end - offsets[number])
            scores.append(score)
        first += len(part)
    if not numbers:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(model.languages)), np.float32)
    return tuple(map(np.concatenate, (numbers, starts, ends, scores)))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, clip: float = 12.0) -> np.ndarray:
    """Best labels of several word sequences that lie one after another.

    ``counts`` are their lengths. All sequences advance together, one word a
    step, longest first, so a step is one small array operation. Scores count
    relative to the best of the word and at most ``clip`` below it.
    """
    scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -np.float32(clip))
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    back = np.zeros(scores.shape, np.int16)
    lanes = np.arange(scores.shape[1], dtype=np.int16)
    state = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        rows = begin[:k] + t
        v = state[:k]
        if t:
            top = v.argmax(axis=1).astype(np.int16)
            other = v[np.arange(k), top] - np.float32(penalty)
            switch = other[:, None] > v
            back[rows] = np.where(switch, top[:, None], lanes)
            v = np.maximum(v, other[:, None])
        state[:k] = v + scores[rows]
    labels = np.zeros(len(scores), np.int16)
    last = state.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        labels[rows] = last[:k]
        last[:k] = back[rows, last[:k]]
    return labels


def label_texts(model: Model, texts: list[str | None], penalty: float) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Language, its share of the letters, and spans of each text."""
    out: list[tuple[str, float, list]] = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not model.languages:
        return out
    number, start, end, scores = _word_scores(model, [_lower(t or "") for t in texts])
    if not len(number):
        return out
    counts = np.bincount(number, minlength=len(texts))
    labels = viterbi(scores, counts, penalty)
    letters = (end - start).astype(np.int64)
    weight = np.zeros((len(texts), len(model.languages)), np.int64)
    np.add.at(weight, (number, labels), letters)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 0) | (np.diff(labels) != 0)]))
    close = np.concatenate([cut[1:], [len(number)]]) - 1
    spans: dict[int, list] = {}
    for i, a, b, label in zip(number[cut].tolist(), start[cut].tolist(), end[close].tolist(), labels[cut].tolist(), strict=True):
        spans.setdefault(i, []).append((model.languages[label], a, b))
    total, best = weight.sum(axis=1), weight.argmax(axis=1)
    for i in spans:
        out[i] = (model.languages[best[i]], float(weight[i, best[i]] / total[i]), spans[i])
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = 20.0) -> DataFrame:
    """``key, lang_pred, score, spans`` of every row.

    ``score`` is the share of letters in spans of the predicted language;
    ``spans`` holds language, first code point and end. A text that is null or
    without letters is ``und`` with score 0, as is every text if nothing was
    learned. Ties go to the first language in order. Only key and text are
    read; repeated rows are repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = label_texts(shared.value, b.column(1).to_pylist(), penalty)
            spans = pa.array([[{"lang": x, "start": s, "end": e} for x, s, e in r[2]] for r in found],
                             pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64()), spans],
                                             names=[key, "lang_pred", "score", "spans"])

    return map_rows(docs.select(F.col(key), F.col(text).alias("_text")), work,
                    f"`{key}` {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from: a quarter, by CRC of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))
