"""Operator 5, substring dedup by repeated-phrase automata.

A window of so many words that also starts elsewhere is a recurring passage;
every word it covers goes. Documents are dealt into blocks of a bounded size.

1. *Phrases.* Of the short phrases in each window the one with the least hash
   stands for it, so equal windows share a phrase and a document has few. A
   phrase seen twice anywhere makes its windows candidates.
2. *Confirmed passages.* Candidate windows are counted over all blocks; those
   that start twice are confirmed and sent to the blocks that hold them.
3. *Automata.* Each block compiles its confirmed passages into an Aho-Corasick
   automaton over word numbers and streams all its documents that hold such a
   window through it. The automata are sharded by document block: each holds
   no more than its block does, and together they grow with the corpus, not
   with its square.

A phrase or passage reaches the counts once per block, with 1 or 2, so one
that a third of all documents share is never gathered row by row. Rows are
dealt by key and text, so rows of one key spread; equal rows that would fill a
good part of a block stand in it once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows, mix64, share_code
from vitalspan.llm.shingles import word_hashes, words_of
from vitalspan.session import materialize

WINDOW, PHRASE = 35, 8
#: Bytes of text in a block, on average.
BLOCK_BYTES = 6 << 20
#: Equal rows of more than this part of a block are counted, not dealt.
EQUAL_PART = 16


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    m = len(hashes) - k + 1
    out = np.zeros(m, np.uint64)
    factor = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        for i in range(k):
            out += hashes[i:i + m] * np.uint64(factor)
            factor = factor * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return mix64(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def phrases_of(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """All phrase hashes of a text, and for each window the least in it."""
    phrases = _rolled(hashes, phrase)
    return phrases, _sliding_min(phrases, window - phrase + 1)


def _times(phrases: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases that stand for a window, and how often each occurs."""
    chosen = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])])
    values, n = np.unique(phrases, return_counts=True)
    return chosen, n[np.searchsorted(values, chosen)]


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, blocks, times = [], [], []
        for block, text, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = words_of(text, False)
            if len(words) >= WINDOW:
                values, n = _times(*phrases_of(mix64(word_hashes(words))))
                found.append(values)
                times.append(n * min(copies, 2))
                blocks.append(np.full(len(values), block, np.int32))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(blocks)),
                                              pa.array(np.minimum(np.concatenate(times), 2).astype(np.int32))], names=["h", "block", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way to the blocks; shuffle files hold them in
    less than two thirds of the room that plain rows need."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        texts = [squeeze(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary()), b.column(3)], names=["block", "k", "z", "copies"])


def _texts(docs: pa.Table) -> Iterator[str]:
    loose = zstandard.ZstdDecompressor().decompress
    for z in docs.column("z").to_pylist():
        yield loose(z).decode("utf-8", "surrogatepass") if z else ""


def _recurring(rows: DataFrame) -> DataFrame:
    """``block, h`` of hashes with two or more places in all blocks; rows are
    one per hash and block."""
    total = F.sum("n").over(W.partitionBy("h"))
    return rows.withColumn("_total", total).where("_total >= 2").select("block", "h")


def _empty(names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([], t) for t in types], names=names)


def _candidate_windows(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """Distinct windows of a block whose phrase recurs."""
    wanted = np.sort(phrases.column("h").to_numpy().view(np.uint64))
    parts = []
    if len(wanted):
        for text, copies in zip(_texts(docs), docs.column("copies").to_pylist(), strict=True):
            words = words_of(text, False)
            if len(words) >= WINDOW:
                h = mix64(word_hashes(words))
                hit = _member(phrases_of(h)[1], wanted)
                if hit.any():
                    parts += [_rolled(h, WINDOW)[hit]] * min(copies, 2)
    if not parts:
        return _empty(["h", "block", "n"], [pa.int64(), pa.int32(), pa.int32()])
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    block = docs.column("block")[0].as_py()
    return pa.table([pa.array(values.view(np.int64)), pa.array(np.full(len(values), block, np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))],
                    names=["h", "block", "n"])


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _runs(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _passages(ids: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Stretches of confirmed windows, cut into pieces of fewer than two
    windows, each window whole in some piece."""
    for start, end in _runs(hit):
        stop = end - 1 + WINDOW
        for a in range(start, end, WINDOW):
            yield tuple(ids[a:min(a + 2 * WINDOW - 1, stop)].tolist())


def covered_words(documents: list[list[bytes]], confirmed: np.ndarray) -> list[np.ndarray]:
    """For the documents of a block, which words a confirmed window covers.

    ``confirmed`` are the sorted hashes of confirmed windows. The passages
    that hold them are compiled into one automaton over word numbers, which
    then reads every document that holds a confirmed window; no passage can be
    in any other.
    """
    lengths = [len(words) for words in documents]
    hashes = mix64(word_hashes([w for words in documents for w in words]))
    numbers = np.unique(hashes, return_inverse=True)[1]
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    starts = np.cumsum([0, *lengths])
    holders = []
    for i, (start, n) in enumerate(zip(starts.tolist(), lengths, strict=False)):
        if n >= WINDOW and len(confirmed):
            hit = _member(_rolled(hashes[start:start + n], WINDOW), confirmed)
            if hit.any():
                holders.append(i)
                for passage in _passages(numbers[start:start + n], hit):
                    machine.add_word(passage, len(passage))
    out = [np.zeros(n, bool) for n in lengths]
    if len(machine):
        machine.make_automaton()
        for i in holders:
            start, n = int(starts[i]), lengths[i]
            spans = np.array(list(machine.iter(tuple(numbers[start:start + n].tolist()))))
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, spans[:, 0] + 1 - spans[:, 1], 1)
            np.add.at(edges, spans[:, 0] + 1, -1)
            out[i] = np.cumsum(edges[:-1]) > 0
    return out


def _remove(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
    wanted = np.sort(confirmed.column("h").to_numpy().view(np.uint64))
    documents = [words_of(t, False) for t in _texts(docs)]
    removed, kept, digests = [], [], []
    for words, gone in zip(documents, covered_words(documents, wanted), strict=True):
        left = b" ".join(compress(words, (~gone).tolist()))
        removed.append(int(gone.sum()))
        kept.append(left.decode("utf-8", "surrogatepass"))
        digests.append(hashlib.sha256(left).hexdigest())
    return pa.table([docs.column("k"), pa.array([len(w) for w in documents], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                     pa.array(digests, pa.string()), docs.column("copies")], names=["k", "n_words", "n_removed", "kept", "kept_sha256", "copies"])


def _dealt(rows: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """``k, t, copies, block``: rows by a hash of key and text. Equal rows that
    together are large are one row, summed up before they are sent."""
    rows = rows.withColumn("h", F.xxhash64("k", "t"))
    equal = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size"))
    large = materialize(equal.where((F.col("n") > 1) & (F.col("size") * EQUAL_PART > block_bytes)).select("h"), "equal")
    one = F.lit(1).cast("long").alias("copies")
    if large.isEmpty():
        return rows.select("k", "t", one, F.pmod("h", F.lit(blocks)).cast("int").alias("block"))
    summed = rows.join(large, "h", "left_semi").groupBy("h", "k", "t").agg(F.count("*").alias("copies"))
    rows = rows.join(large, "h", "left_anti").select("h", "k", "t", one).unionByName(summed)
    return rows.select("k", "t", "copies", F.pmod("h", F.lit(blocks)).cast("int").alias("block"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, n_words, n_removed, kept, kept_sha256`` of every row: words that
    no recurring window of 35 words covers, joined by one space.

    Words are compared as they are; windows are judged on the input. Null
    texts have no words. Repeated rows repeat each other's windows, so both
    lose them. Windows of fewer words than the limit do not exist. Other
    columns are not read. Window hashes have 64 bits.
    """
    share_code(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, round(size / block_bytes))
    rows = _dealt(rows, blocks, block_bytes)
    phrases = map_rows(rows.select("block", "t", "copies"), _phrase_rows, "h long, block int, n int")
    phrases = phrases.groupBy("h", "block").agg(F.sum("n").alias("n"))
    # a phrase of a block reaches its documents as one row
    wanted = materialize(_recurring(phrases), "phrases")
    docs_of = map_rows(rows.select("block", "k", "t", "copies"), _packed, "block int, k long, z binary, copies long").groupBy("block")
    windows = docs_of.cogroup(wanted.groupBy("block")).applyInArrow(_candidate_windows, "h long, block int, n int")
    confirmed = materialize(_recurring(windows), "passages")
    out = docs_of.cogroup(confirmed.groupBy("block")).applyInArrow(
        _remove, "k long, n_words long, n_removed long, kept string, kept_sha256 string, copies long")
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("k").alias(key), "n_words", "n_removed", "kept", "kept_sha256")
