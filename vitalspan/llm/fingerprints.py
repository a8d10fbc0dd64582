"""Operator 8, document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of every prefix under two prime moduli.
Differences of two entries answer the equality of any two spans, so a binary
search finds the longest common extension from any two positions. The
fingerprint keeps the array at a grid of prefix lengths, the same for suffixes,
and the whole hash; two fingerprints are compared by the same binary search
over their common grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import code_points, map_rows, share_code

#: Two primes below 2**31, so that products fit in 64 bits, and bases for them.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709127)
#: Grid points of a fingerprint, at most, and its finest step in code points.
GRID, FINEST = 64, 1

_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)``, kept and doubled as longer texts come."""
    have = _POWERS.get((base, prime), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * (int(have[-1]) * base % prime) % prime])
    if len(have) <= 1 << 22:
        _POWERS[base, prime] = have
    return have[:n]


class PrefixHash:
    """Prefix hashes of one text: ``sums[k][i]`` is the hash of the first
    ``i`` code points under prime ``k``."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        values = points.astype(np.int64) + 1
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            out = np.zeros(self.n + 1, np.int64)
            if self.n:
                # each term is below 2**31, so the running sum cannot overflow
                np.cumsum(values * _powers(base, prime, self.n) % prime, out=out[1:])
            out %= prime
            self.sums.append(out)

    def span(self, start: int, end: int) -> int:
        """A 62-bit hash of a span; equal spans hash alike wherever they stand."""
        out = 0
        for sums, base, prime in zip(self.sums, BASES, PRIMES, strict=True):
            h = (int(sums[end]) - int(sums[start])) * pow(base, -start, prime) % prime
            out = out << 31 | h
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """The longest length over which both texts agree from two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low

    def fingerprint(self) -> str:
        """``length:whole:step:prefixes:suffixes`` in hex; a function of the
        text alone, empty lists for an empty text."""
        n, step = self.n, FINEST
        while n // step > GRID:
            step *= 2
        lengths = np.arange(step, n + 1, step)
        (s1, s2), (p1, p2), (b1, b2) = self.sums, PRIMES, BASES
        pre = s1[lengths] ^ (s2[lengths] << 1)
        starts = n - lengths
        back = []
        for s, p, b in ((s1, p1, b1), (s2, p2, b2)):
            inverse = pow(b, -1, p)
            first = pow(inverse, n - step, p) if len(lengths) else 1
            shift = np.empty(len(lengths), np.int64)
            forward = pow(b, step, p)
            for i in range(len(lengths)):
                shift[i] = first
                first = first * forward % p
            back.append((s[n] - s[starts]) % p * shift % p)
        suf = back[0] ^ (back[1] << 1)
        mask = 0xFFFFFFFF
        return f"{n:x}:{self.span(0, n):016x}:{step:x}:{_hex(pre & mask)}:{_hex(suf & mask)}"


def _hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def _parse(fingerprint: str) -> tuple[int, str, int, np.ndarray, np.ndarray]:
    n, whole, step, pre, suf = fingerprint.split(":")
    return int(n, 16), whole, int(step, 16), np.frombuffer(bytes.fromhex(pre), ">u4"), np.frombuffer(bytes.fromhex(suf), ">u4")


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading grid points agree, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """Common prefix and suffix as a share of the longer text, from two
    fingerprints; 1 for equal texts, at the resolution of the coarser grid
    otherwise."""
    if a == b:
        return 1.0
    na, _, sa, pa_, qa = _parse(a)
    nb, _, sb, pb, qb = _parse(b)
    step = max(sa, sb)
    ra, rb = step // sa, step // sb
    both = _agreeing(pa_[ra - 1::ra], pb[rb - 1::rb]) + _agreeing(qa[ra - 1::ra], qb[rb - 1::rb])
    return min(both * step, na, nb) / max(na, nb, 1)


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter of the code points replaced by the first as many (or
    all) of the following text."""
    quarter = len(points) // 4
    return np.concatenate([points[: len(points) - quarter], following[:quarter]])


def _follow(rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Each row of a range with the next; a range ends with its borrowed row."""
    before = None
    for row in rows:
        if before is not None and before[0] == row[0] and not before[1]:
            yield before, row
        before = row


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, common_edited`` of every row.

    Null texts count as empty. Rows are ordered by key, equal keys by text and
    null keys first; the row after the last is the first, a single row follows
    itself. Repeated rows are kept. Other columns are not read.

    Texts are shuffled once, into ranges of keys. Each range borrows the first
    row of the next, so no range waits for another; bounds and firsts are one
    number per range.
    """
    spark = docs.sparkSession
    share_code(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * tasks
    bounds = np.unique(np.array(rows.approxQuantile("k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) or [], np.float64))

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.float64), side="left").astype(np.int32))

    place_udf = F.pandas_udf(place, "int")
    filled = F.coalesce("k", F.lit(-(2**63)))  # null keys come first
    firsts = {r["g"]: r["k"] for r in rows.select(place_udf(filled).alias("g"), filled.alias("k")).groupBy("g").agg(F.min("k").alias("k")).collect()}
    held = sorted(firsts)
    before = {g: held[i - 1] for i, g in enumerate(held)}

    def destinations(keys: pd.Series) -> pd.Series:
        return pd.Series([[g * 2, before[g] * 2 + 1] if k == firsts[g] else [g * 2] for k, g in zip(keys.tolist(), place(keys).tolist(), strict=True)])

    spread = rows.withColumn("d", F.explode(F.pandas_udf(destinations, "array<int>")(filled)))
    spread = spread.select(F.floor(F.col("d") / 2).cast("int").alias("g"), (F.col("d") % 2).alias("borrowed"), "k", "t")
    ordered = spread.repartition(tasks, "g").sortWithinPartitions("g", "borrowed", F.col("k").asc_nulls_first(), "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

        out: list[tuple] = []
        held_row = held_hash = None
        for row, following in _follow(stream()):
            if held_row is row:
                mine = held_hash
            else:
                mine = _Hashed(row[3])
            nxt = _Hashed(following[3])
            held_row, held_hash = following, nxt
            changed = edited(mine.points, nxt.points)
            other = PrefixHash(changed)
            fp = other.fingerprint()
            out.append((row[2], len(mine.points), hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(),
                        mine.fp, fp, likeness(mine.fp, fp), likeness(mine.fp, nxt.fp), mine.hash.common_extension(0, other, 0)))
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return map_rows(ordered, work, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double, common_edited long").withColumnRenamed("k", key)


class _Hashed:
    def __init__(self, text: str):
        self.points = code_points(text)
        self.hash = PrefixHash(self.points)
        self.fp = self.hash.fingerprint()


_TYPES = (("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _TYPES, strict=True)], names=[n for n, _ in _TYPES])
