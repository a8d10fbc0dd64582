"""Operator 12, a quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, and up to four
neighbouring word shapes (classes of characters, and whether the word before
is repeated), hashed into a fixed number of buckets. Each indicator is scaled
by the log ratio of its shares in the two classes, counted over all rows to
learn from; rows are scaled to unit length; a linear hinge-loss model is
fitted by dual coordinate descent on a bounded sample of them; a logistic
curve over rows that neither step saw turns margins into scores.

Counts are summed inside the tasks; what reaches the driver and all tasks is a
number per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows, mix64
from vitalspan.session import materialize

BITS = 18
#: Words a worker remembers before it starts anew.
KNOWN = 500_000
#: Words whose n-grams are hashed together.
PART_WORDS = 1 << 18
#: Bits of the bitmap that keeps texts without labels from being shuffled.
SIEVE_BITS = 26
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: UTF-8 bytes to their character class: capitals, letters (all bytes beyond
#: ASCII are), digits; blanks and marks stand for themselves.
CLASS_BYTES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def word_shape(classes: bytes) -> bytes:
    """Character classes in order, runs as one: ``Aa`` for "Spark", ``a**``
    for "this***" (a run of marks stands as two)."""
    return _RUNS.sub(lambda m: m[1] if m[1] in b"Aa0" else m[1] * 2, classes)[:24]


class _Hashes(dict):
    """Hash of a word, and of its shape, made when first met."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


_words = _Hashes(_hash)
_shapes = _Hashes(lambda classes: _hash(b"\0" + word_shape(classes)))


def _parts(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``PART_WORDS`` words; a longer one is a run of
    its own."""
    part: list[bytes] = []
    held = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if part and held + len(data) > 6 * PART_WORDS:
            yield part
            part, held = [], 0
        part.append(data)
        held += len(data)
    if part:
        yield part


def indicators(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one text after another, and where each
    text's begin (one more place than texts)."""
    buckets, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for part in _parts(texts):
        words = [t.split() for t in part]  # bytes split at space and 9 to 13 only
        row = np.repeat(np.arange(len(part), dtype=np.uint64), [len(w) for w in words])
        flat = list(chain.from_iterable(words))
        word = np.fromiter(map(_words.__getitem__, flat), np.uint64, len(flat))
        flat = b"\n".join(part).translate(CLASS_BYTES).split()
        shape = np.fromiter(map(_shapes.__getitem__, flat), np.uint64, len(flat))
        if len(flat) > 1:
            again = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            shape[1:][again] = np.uint64(1)
        grams = [(row, word)]
        for source, orders in ((word, (2,)), (shape, (1, 2, 3, 4))):
            rolled = source
            for order in range(1, max(orders) + 1):
                if order > 1:
                    rolled = rolled[:-1] * _GOLD + source[order - 1:] if len(rolled) else rolled
                same = row[order - 1:] == row[:len(row) - order + 1] if len(row) >= order else np.zeros(0, bool)
                if order in orders:
                    grams.append((row[:len(rolled)][same], mix64(rolled[same] + np.uint64(order))))
        cells = np.concatenate([(r << np.uint64(bits)) | (h >> np.uint64(64 - bits)) for r, h in grams])
        cells.sort()
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
        buckets.append((cells & np.uint64((1 << bits) - 1)).astype(np.uint32))
        sizes.append(np.bincount((cells >> np.uint64(bits)).astype(np.int64), minlength=len(part)))
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of a bucket's shares in both classes. A class is smoothed in
    proportion to its size, so a bucket nobody has weighs nothing."""
    total = n_positive + n_negative
    p, q = smoothing * n_positive / total, smoothing * n_negative / total
    return (np.log((positive + p) / (n_positive + p)) - np.log((negative + q) / (n_negative + q))).astype(np.float32)


def dual_coordinate_descent(values: np.ndarray, columns: np.ndarray, starts: np.ndarray, sign: np.ndarray, size: int,
                            cost: float, epochs: int = 60, tolerance: float = 0.02, seed: int = 7) -> np.ndarray:
    """Weights of ``min |w|^2 / 2 + cost * sum of hinge losses`` over sparse
    rows, the last weight being that of a constant 1.

    Rows are met in a new random order each epoch; each takes the exact step
    of its dual variable within 0 and ``cost``. Ends when the projected
    gradients of an epoch spread less than ``tolerance``, else after
    ``epochs``.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    n = len(sign)
    alpha = np.zeros(n)
    rows = [(columns[a:b], values[a:b].astype(np.float64)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    curve = [float(v @ v) + 1.0 for _, v in rows]
    for _ in range(epochs):
        low, high = 0.0, 0.0
        for i in rng.permutation(n).tolist():
            c, v = rows[i]
            y = sign[i]
            gradient = y * (float(w[c] @ v) + w[-1]) - 1.0
            old = alpha[i]
            projected = min(gradient, 0.0) if old <= 0 else max(gradient, 0.0) if old >= cost else gradient
            low, high = min(low, projected), max(high, projected)
            if projected:
                alpha[i] = min(max(old - gradient / curve[i], 0.0), cost)
                step = (alpha[i] - old) * y
                w[c] += step * v
                w[-1] += step
        if high - low < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve with a slope of at
    least 0, labels pulled towards one half by one row of each class."""
    n1 = float(label.sum())
    n0 = len(label) - n1
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 0.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float(np.sum(np.logaddexp(0, z) - goal * z))

    now = loss(slope, offset)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-12)
        g = np.array([d @ margin, d.sum()])
        m = np.array([[h @ margin**2 + 1e-9, h @ margin], [h @ margin, h.sum() + 1e-9]])
        move = np.linalg.solve(m, g)
        scale = 1.0
        while scale > 1e-6 and loss(slope - scale * move[0], offset - scale * move[1]) > now:
            scale /= 2
        after = loss(slope - scale * move[0], offset - scale * move[1])
        if not now - after > 1e-9:
            break
        slope, offset, now = slope - scale * move[0], offset - scale * move[1], after
    return max(slope, 0.0), offset


@dataclass(frozen=True)
class Model:
    """Per bucket the ratio, and the ratio times its weight; then the constant
    and the curve. ``ratio`` is empty if there was nothing to tell apart."""

    ratio: np.ndarray
    weight: np.ndarray
    constant: float
    slope: float
    offset: float
    bits: int = BITS

    def margins(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.ratio):
            return np.zeros(len(texts))
        buckets, starts = indicators(texts, self.bits)
        return _margins(self.ratio, self.weight, self.constant, buckets, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))


def _margins(ratio: np.ndarray, weight: np.ndarray, constant: float, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    dot = np.bincount(row, weight[buckets], len(starts) - 1)
    square = np.bincount(row, ratio[buckets].astype(np.float64) ** 2, len(starts) - 1)
    return dot / np.sqrt(np.maximum(square, 1e-12)) + constant


def _fold(key: Column, text: Column) -> Column:
    """An even number in 0..1 for each row, by a digest of key and text."""
    return F.pmod(F.xxhash64(F.lit("fold"), key.cast("string"), text), F.lit(1 << 30)) / float(1 << 30)


def _sieve(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose key may be among the known ones, by one bitmap of
    ``2^SIEVE_BITS`` digests. It only saves shuffling the texts of others;
    the join that follows decides."""
    def digest(df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << SIEVE_BITS))
        return df.withColumn("_b", F.shiftright(h, 15)).withColumn("_p", h.bitwiseAND(32767))

    # at most 2^(SIEVE_BITS - 15) rows of 4 kB: broadcast has a fixed bound
    bitmap = digest(known).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    byte = F.conv(F.hex(F.substring("_m", (F.shiftright("_p", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_v, cast(_p & 7 AS int)) & 1") == 1
    return digest(rows).join(F.broadcast(bitmap), "_b").withColumn("_v", byte).where(hit).select(*rows.columns)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, calibration_share: float = 0.15, cost: float = 1.0,
          key: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS) -> Model:
    """Learns label 1 against label 0 from all ``docs`` that have a label.

    Class counts cover every labelled row. The support vectors are fitted to
    about ``sample_rows`` rows, never more, drawn by digest; the curve to at
    most a third as many of the ``calibration_share`` that nothing else
    learned from.
    Both are bounds on rows; a row has at most ``2^bits`` numbers. Rows of
    ``labels`` with a null label or other values teach nothing, nor do keys
    with both labels; several equal labels count as one. Null texts learn as
    empty ones, repeated rows as often as they stand, null keys never. With
    fewer than two classes the score is the same for all: the smoothed share
    of label 1, one half without labels.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
             .agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("_y")).where("y = _y").select("k", "y"))
    known = materialize(known, "labels")
    rows = _sieve(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), known).join(known, "k")
    rows = rows.select("y", "t", _fold(F.col("k"), F.col("t")).alias("f"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, starts = indicators(b.column(1).to_pylist(), bits)
            cells = [buckets[s:e].astype("<u4").tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), b.column(2)], names=["y", "x", "f"])

    rows = materialize(map_rows(rows, featurize, "y int, x binary, f double"), "grams")
    learned = rows.where(F.col("f") >= calibration_share)
    sizes = {r["y"]: r["n"] for r in learned.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))), bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[y, np.frombuffer(x, "<u4")] += 1  # distinct within a row
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[1, seen]), pa.array(total[0, seen])], names=["b", "p", "q"])

    counts = map_rows(learned.select("y", "x"), count, "b int, p long, q long").groupBy("b").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    at = counts.column("b").to_numpy()
    positive, negative = np.zeros(1 << bits), np.zeros(1 << bits)
    positive[at], negative[at] = counts.column("p").to_numpy(), counts.column("q").to_numpy()
    ratio = log_count_ratios(positive, negative, n1, n0)
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    # a tenth of slack, so that the limit hardly ever has to cut
    share = min(1.0, 0.9 * sample_rows / (n1 + n0))
    drawn = learned.where(F.col("f") < calibration_share + (1 - calibration_share) * share).limit(sample_rows).withColumn("fit", F.lit(True))
    few = sample_rows // 3
    held = rows.where(F.col("f") < min(calibration_share, 0.9 * few / (n1 + n0) * (1 - calibration_share))).limit(few).withColumn("fit", F.lit(False))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        cells: dict[bool, list[np.ndarray]] = {True: [], False: []}
        marks: dict[bool, list[int]] = {True: [], False: []}
        for b in batches:
            for y, x, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cells[f].append(np.frombuffer(x, "<u4"))
                marks[f].append(y)
        starts = {f: np.concatenate([[0], np.cumsum([len(c) for c in cells[f]])]).astype(np.int64) for f in cells}
        flat = {f: np.concatenate([*cells[f], np.zeros(0, np.uint32)]).astype(np.int64) for f in cells}
        values = ratio[flat[True]]
        length = np.sqrt(np.maximum(np.add.reduceat(np.append(values.astype(np.float64) ** 2, 0), starts[True][:-1]), 1e-12)) if len(values) else np.ones(len(marks[True]))
        length = np.where(np.diff(starts[True]) > 0, length, 1.0)
        values = values / np.repeat(length, np.diff(starts[True])).astype(np.float32)
        y = np.array(marks[True])
        w = dual_coordinate_descent(values, flat[True], starts[True], np.where(y == 1, 1.0, -1.0).tolist(), len(ratio), cost)
        weight = (w[:-1] * ratio).astype(np.float32)
        curve_label = np.array(marks[False], np.float64)
        curve_margin = _margins(ratio, weight, w[-1], flat[False], starts[False]) if len(curve_label) else np.zeros(0)
        slope, offset = logistic_curve(curve_margin, curve_label) if 0 < curve_label.sum() < len(curve_label) else (2.0, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([weight.astype("<f4").tobytes()], pa.binary()), pa.array([w[-1]]), pa.array([slope]), pa.array([offset])],
                                         names=["weight", "constant", "slope", "offset"])

    sample = drawn.select("y", "x", "fit").unionByName(held.select("y", "x", "fit")).repartition(1)
    best = map_rows(sample, fit, "weight binary, constant double, slope double, offset double").first()
    return Model(ratio, np.frombuffer(best["weight"], "<f4"), best["constant"], best["slope"], best["offset"], bits)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every row by its whole text.

    A null text is an empty one; it and other texts without words get the
    score of the constant. Repeated rows are repeated, an empty table gives
    none. Only key and text are read, so other columns cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], names=["k", "score"])

    found = map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), work, f"k {kind}, score double")
    return found.select(F.col("k").alias(key), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
