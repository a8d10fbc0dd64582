"""Operator 13, ranked lexical search of many items at once.

Items share terms, so their scores share partial sums. Terms of an item stand
in a fixed order; pairs of neighbours that several items have become a node of
their own, round by round, until no pair occurs twice. The nodes form a
directed graph from single terms to shared term sets, and every item is a
short list of nodes. For each block of documents the accumulators of all nodes
are computed once, level by level, and items add up theirs.

Documents are read twice: once for their term counts, which are written, and
from those for the scores. Only each task's best documents are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows
from vitalspan.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that ends a term: ASCII but for digits and letters.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: UTF-8 bytes of a text to bytes of its terms: breaks become spaces, A-Z
#: lower case; longer characters have no byte below 128.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Item terms that one pass over the documents answers; more items take more
#: passes, so what is broadcast does not grow with them.
BLOCK_TERMS = 1 << 18
#: Numbers in the accumulators of one block of documents.
CELLS = 1 << 21


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


@dataclass(frozen=True)
class SharingPlan:
    """Nodes 0..terms-1 are terms; ``levels`` hold the two parts of the nodes
    that follow, ``nodes`` and ``starts`` the nodes of each item."""

    terms: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return self.terms + sum(len(a) for a, _ in self.levels)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """``items x documents`` from ``terms x documents`` (every item has at
        least one term)."""
        held = np.empty((self.size, weights.shape[1]), np.int64)
        held[:self.terms] = weights
        at = self.terms
        for a, b in self.levels:
            np.add(held[a], held[b], out=held[at:at + len(a)])
            at += len(a)
        return np.add.reduceat(held[self.nodes], self.starts, axis=0)


def share_terms(items: list[list[int]], terms: int) -> SharingPlan:
    """Mines term sets that items share.

    Terms of an item are ordered by the number of items that have them, so
    shared terms are neighbours. A round counts the pairs of neighbours of all
    items; each pair that occurs twice or more, and is at both its terms'
    commonest, becomes a node. A round costs what the lists hold, and at least
    one pair is replaced, so lists only get shorter.
    """
    count = np.bincount(np.concatenate([np.asarray(i, np.int64) for i in items]) if items else np.zeros(0, np.int64), minlength=terms)
    rank = np.lexsort((np.arange(terms), -count))
    place = np.empty(terms, np.int64)
    place[rank] = np.arange(terms)
    flat = np.concatenate([np.array(sorted(set(i), key=place.__getitem__), np.int64) for i in items]) if items else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(items)), [len(set(i)) for i in items])
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    size = terms
    while len(flat) > 1:
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        left, right = flat[inside], flat[inside + 1]
        pairs, which, times = np.unique(left * size + right, return_inverse=True, return_counts=True)
        a, b = pairs // size, pairs % size
        best = np.zeros(size, np.int64)
        np.maximum.at(best, a, times)
        np.maximum.at(best, b, times)
        # of equally common pairs of a term the first counts
        first = np.full(size, len(pairs), np.int64)
        for side in (a, b):
            top = np.flatnonzero(times == best[side])
            np.minimum.at(first, side[top], top)
        at = np.arange(len(pairs))
        chosen = (times > 1) & (first[a] == at) & (first[b] == at)
        if not chosen.any():
            break
        number = np.cumsum(chosen) - 1 + size
        levels.append((a[chosen], b[chosen]))
        # no term is in two chosen pairs, so chosen places do not overlap
        hit = inside[chosen[which]]
        flat[hit] = number[which[chosen[which]]]
        keep = np.ones(len(flat), bool)
        keep[hit + 1] = False
        flat, owner = flat[keep], owner[keep]
        size += int(chosen.sum())
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return SharingPlan(terms, levels, flat, starts)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct ``item, term`` pairs."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    found = F.explode(F.regexp_extract_all(low, F.lit(f"([^{BREAKS}]+)"), F.lit(1)))
    return items.select(F.col(item).alias("item"), found.alias("term")).distinct()


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``k, n, terms, counts``: all terms of a document, and those of the
    items with their occurrences. Documents without terms go."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            keys, totals, found, counts = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(t)
                if not words:
                    continue
                ids = np.array([i for i in map(known.get, words) if i is not None], np.int32)
                at, times = np.unique(ids, return_counts=True)
                keys.append(k)
                totals.append(len(words))
                found.append(at)
                counts.append(times)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64()))],
                names=["k", "n", "terms", "counts"])

    return map_rows(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), work, "k long, n long, terms array<int>, counts array<long>")


def _best(counted: DataFrame, plan: SharingPlan, weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """``i, k, score``: each task's ``top`` documents of every item."""
    shared = counted.sparkSession.sparkContext.broadcast((plan, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        items = len(plan.starts)
        step = max(1, CELLS // (plan.size + items))
        best = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))  # item, key is not null, key, score
        least = np.ones(items, np.int64)
        for b in batches:
            keys, n = b.column(0), b.column(1).to_numpy()
            valid, keys = keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
            lists, counts = b.column(2), b.column(3)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term, tf = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), np.diff(offsets))
            m = 50 + (50 * n * documents) // total
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            for start in range(0, len(n), step):
                end = min(start + step, len(n))
                part = slice(offsets[start], offsets[end])
                held = np.zeros((plan.terms, end - start), np.int64)
                held[term[part], row[part] - start] = value[part]
                scores = plan.scores(held)
                i, d = np.nonzero(scores >= least[:, None])
                if not len(i):
                    continue
                new = (i, valid[start + d], keys[start + d], scores[i, d])
                item, known, key, score = (np.concatenate(x) for x in zip(best, new, strict=True))
                order = np.lexsort((key, known, -score, item))
                item = item[order]
                first = np.searchsorted(item, np.arange(items))
                kept = np.arange(len(item)) - first[item] < top
                best = (item[kept], known[order][kept], key[order][kept], score[order][kept])
                full = np.bincount(best[0], minlength=items) >= top
                ends = np.cumsum(np.bincount(best[0], minlength=items)) - 1
                least[full] = best[3][ends[full]]  # equal scores still compete by key
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0], pa.int32()), pa.array(best[2], pa.int64(), mask=~best[1]), pa.array(best[3], pa.int64())], names=["i", "k", "score"])

    return map_rows(counted.select("k", "n", "terms", "counts"), work, "i int, k long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: the ``top`` best documents of every item.

    A term weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))``; a document's
    score sums, over the item's distinct terms, the weight times
    ``(10^9 tf) div (1000 tf + 20 m)`` with ``m = 50 + (50 n N) div L``, all
    in 64-bit integers. Ranks count from 1; equal scores rank by ascending
    key, null keys first. Every row of ``docs`` is a document, repeated rows
    too. Rows of ``items`` with one id are one item with the terms of all of
    them. Null or empty texts have no terms: such a document is never found,
    such an item finds nothing, as does every item in an empty table. A
    term of nearly all documents can weigh 0; who scores 0 is not found. Keys
    are whole numbers. Only key and text columns are read, so others cannot clash.

    Items are answered in blocks of about ``BLOCK_TERMS`` terms, each by its
    own pass over all documents; one item's distinct terms must fit in memory.
    """
    spark = docs.sparkSession
    kind = items.select(item).schema[0].dataType
    pairs = materialize(item_terms(items, item, item_text), "items")
    blocks = -(-pairs.count() // BLOCK_TERMS)
    found = []
    for block in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").toArrow()
        if not some.num_rows:
            continue
        terms = some.column("term").to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
        names = some.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        lists: list[list[int]] = [[] for _ in range(len(names.dictionary))]
        for i, t in zip(names.indices.to_pylist(), terms, strict=True):
            lists[i].append(vocabulary[t])
        plan = share_terms(lists, len(vocabulary))
        counted = materialize(_counted(docs, {t.encode(): i for t, i in vocabulary.items()}, key, text), "counted")
        size = counted.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not size["N"]:
            continue
        df = np.zeros(len(vocabulary), np.float64)
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df[held.column("t").to_numpy()] = held.column("count").to_numpy()
        weights = np.floor(1000 * np.log((2 * size["N"] + 2) / (2 * df + 1))).astype(np.int64)
        ranked = F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), F.asc("k")))
        best = _best(counted, plan, weights, size["N"], size["L"], top).withColumn("rank", ranked).where(F.col("rank") <= top)
        table = spark.createDataFrame(pa.table({"i": pa.array(range(len(lists)), pa.int32()), "item": names.dictionary}))
        found.append(best.join(table, "i").select(F.col("item").cast(kind).alias(item), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score"))
    if not found:
        return spark.createDataFrame([], f"`{item}` {kind.simpleString()}, rank int, `{key}` long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
