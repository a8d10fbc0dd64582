"""Operator 4, best-fit packing by patterns.

Token pieces are packed into sequences of fixed capacity from their length
histogram alone. Patterns of up to three length classes that fill a sequence
are enumerated; non-negative least squares fits how often each is used to the
histogram; the counts are rounded down. What remains is packed by best fit on
the exact histogram. The plan has at most a few rows per length, whatever the
number of documents; every piece finds its place by joining its rank within
its length to the plan's ranges.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows
from vitalspan.session import materialize

#: Length classes of the patterns; parts of a pattern are at least a quarter of
#: a sequence, shorter pieces fill the room that is left.
CLASSES, LEAST = 512, 4
#: Share of the fitted counts that is taken; the rest keeps lengths of all
#: kinds for the best fit.
SHARE = 0.6
#: Chunks and words whose tokens a worker remembers before it starts anew.
KNOWN = 500_000
#: Shares of a length among which ranks are dealt, at least, and pieces for
#: each further one: full pieces all have one length.
SALTS, SHARE_PIECES = 32, 1 << 20


#: Characters of a batch whose chunks are looked up together.
PART_CHARS = 1 << 22
#: What a chunk is made of for its words to be found without the tokenizer's
#: normalizer: printable ASCII and composed Latin letters that keep their
#: number in lower case.
_SIMPLE = regex.compile(r"[!-~\u00C0-\u012F\u0131-\u024F]+")
#: How the byte-level alphabet writes a byte that is not printable.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class ChunkTokenizer:
    """Token ids of texts, remembered per chunk between spaces.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its chunks one after another. New chunks of simple
    characters are cut into words by the tokenizer's own pattern, and words
    are remembered in the same place: a pattern that looks at nothing around a
    word cuts the word alone into itself. All other chunks, and all of a
    tokenizer that cuts words in another way, pass through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.pattern = self._word_pattern()
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, marks)) or r"(?!)", regex.I)

    def _word_pattern(self) -> regex.Pattern | None:
        parts = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        cut = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"] or parts["model"]["type"] != "BPE":
            return None
        if not cut[0]["invert"] or cut[0]["behavior"] != "Removed" or cut[1]["use_regex"] or cut[1]["add_prefix_space"] or "Regex" not in cut[0]["pattern"]:
            return None
        if regex.search(r"\(\?|\\b|[\^$](?![^\[]*\])", cut[0]["pattern"]["Regex"], regex.I):
            return None
        return regex.compile(cut[0]["pattern"]["Regex"])

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = self.known[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return ids

    def _learn(self, chunks: list[str]) -> None:
        whole = []
        known = self.known
        for c in chunks:
            if self.pattern and _SIMPLE.fullmatch(c) and not self.special.search(c):
                found = self.pattern.findall(c.lower())
                known[c] = b"".join([known.get(w) or self._word(w) for w in found])
            else:
                whole.append(c)
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for i in range(0, len(whole), 5000):
            some = whole[i:i + 5000]
            for c, e in zip(some, encode(some, add_special_tokens=False), strict=True):
                self.known[c] = array("I", e.ids).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin
        (one more place than texts); nulls have none."""
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        chunks = pc.split_pattern(spaced, " ")
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN:
            self.known = {}
        self._learn([c for c in names if c not in self.known])
        parts = [self.known[c] for c in names]
        first = np.cumsum([0, *map(len, parts)]) // 4
        blob = np.frombuffer(b"".join(parts), "<u4")
        which = coded.indices.to_numpy()
        size = np.diff(first)[which]
        ends = np.cumsum(size)
        out = blob[np.repeat(first[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        places = np.concatenate([[0], ends])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        # Arrow's pool keeps what it freed, as much as half of what is remembered
        del spaced, chunks, coded, which
        pa.default_memory_pool().release_unused()
        return out, places


@cache
def _chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32``: a document's ids with the end
    id, cut only where it is longer than a sequence. Null texts count as
    empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cut = _chunk_tokenizer(tokenizer)
        end = np.array([end_id], "<u4")
        for b in batches:
            out: list[tuple] = []
            keys, texts = b.column(0).to_pylist(), b.column(1)
            filled = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            starts = [*np.flatnonzero(np.diff(filled // PART_CHARS, prepend=-1)).tolist(), len(texts)]
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                ids, at = cut.ids(texts.slice(start, stop - start))
                for k, first, last in zip(keys[start:stop], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    row = np.concatenate([ids[first:last], end])
                    for i, place in enumerate(range(0, len(row), capacity)):
                        part = row[place:place + capacity]
                        out.append((k, i, place, len(part), zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5,
                                             names=["id", "piece", "start", "length", "ids_crc32"])

    return map_rows(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), work,
                    "id long, piece long, start long, length long, ids_crc32 long")


def patterns(classes: int = CLASSES) -> np.ndarray:
    """All ways to fill ``classes`` units with one to three parts, as rows of
    part sizes in falling order, padded with zeros."""
    rows = [(classes, 0, 0)]
    rows += [(a, classes - a, 0) for a in range((classes + 1) // 2, classes)]
    for a in range(-(-classes // 3), classes - 1):
        for b in range(-(-(classes - a) // 2), min(a, classes - a - 1) + 1):
            rows.append((a, b, classes - a - b))
    return np.array(rows, np.int32)


def nonnegative_fit(parts: np.ndarray, target: np.ndarray, steps: int = 800) -> np.ndarray:
    """Non-negative least squares of pattern counts to a class histogram, by
    active sets: the pattern with the steepest gradient enters, patterns that
    turn negative leave, and the entered ones are solved exactly."""
    size = len(target)

    def column(p: int) -> np.ndarray:
        out = np.zeros(size)
        np.add.at(out, parts[p][parts[p] > 0] - 1, 1.0)
        return out

    x = np.zeros(len(parts))
    active: list[int] = []
    matrix = np.zeros((size, 0))
    padded = np.zeros(size + 1)
    scale = max(float(target.max(initial=0.0)), 1.0)
    for _ in range(steps):
        residual = target - (matrix @ x[active] if active else 0)
        padded[1:] = residual
        gradient = padded[parts].sum(axis=1)
        if active:
            gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-7 * scale:
            break
        active.append(best)
        matrix = np.column_stack([matrix, column(best)])
        while True:
            gram = matrix.T @ matrix + 1e-9 * np.eye(len(active))
            solved = np.linalg.solve(gram, matrix.T @ target)
            if (solved > 0).all():
                x[active] = solved
                break
            old = x[active]
            low = solved <= 0
            step = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-300))
            moved = old + step * (solved - old)
            keep = moved > 1e-9
            x[active] = np.where(keep, moved, 0)
            active = [a for a, k in zip(active, keep, strict=True) if k]
            matrix = matrix[:, keep]
            if not active:
                break
    return x


class Plan:
    """Ranges of ranks per length, each mapped to consecutive sequences:
    ``(length, first rank, last rank + 1, first sequence, slot)``."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {n: c for n, c in histogram.items() if c}
        self.used: dict[int, int] = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.capacity = capacity
        #: open sequences by room: (first sequence, count, slots used)
        self.open: dict[int, list[tuple[int, int, int]]] = {}

    def take(self, length: int, count: int, sequence: int, slot: int) -> None:
        start = self.used[length]
        self.rows.append((length, start, start + count, sequence, slot))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fill_patterns(self, classes: int) -> None:
        """Fits patterns of length classes to the histogram and takes whole
        repeats of them; a class hands out its longest pieces first."""
        in_class: dict[int, list[int]] = {}
        for n in sorted(self.left, reverse=True):
            in_class.setdefault(-(-n * classes // self.capacity), []).append(n)
        target = np.zeros(classes)
        for c, lengths in in_class.items():
            target[c - 1] = sum(self.left[n] for n in lengths)
        parts = patterns(classes)
        parts = parts[np.array([all(not p or (p * LEAST >= classes and target[p - 1]) for p in row) for row in parts.tolist()], bool)]
        if not len(parts):
            return
        counts = np.floor(SHARE * nonnegative_fit(parts, target) + 1e-6).astype(np.int64)
        have = target.astype(np.int64)
        for p in np.argsort(-counts, kind="stable"):
            wanted = [int(c) for c in parts[p] if c]
            times = min([int(counts[p]), *(int(have[c - 1]) // wanted.count(c) for c in wanted)])
            if times <= 0:
                continue
            lengths = np.zeros((1, 2), np.int64)  # where in the repeats the length of the sequence changes, and by what
            for slot, c in enumerate(wanted):
                have[c - 1] -= times
                done, last = 0, 0
                while done < times:
                    n = next(n for n in in_class[c] if n in self.left)
                    some = min(times - done, self.left[n])
                    self.take(n, some, self.sequences + done, slot)
                    lengths = np.vstack([lengths, [done, n - last]])
                    done, last = done + some, n
            self._open_rest(lengths, times, len(wanted))
            self.sequences += times

    def _open_rest(self, changes: np.ndarray, times: int, slots: int) -> None:
        """Keeps the room that pieces shorter than their class have left."""
        changes = changes[np.argsort(changes[:, 0], kind="stable")]
        rooms = self.capacity - np.cumsum(changes[:, 1])
        ends = np.append(changes[1:, 0], times)
        for start, end, room in zip(changes[:, 0].tolist(), ends.tolist(), rooms.tolist(), strict=True):
            if end > start and room:
                self.open.setdefault(room, []).append((self.sequences + start, end - start, slots))

    def best_fit(self) -> None:
        """Packs what is left, longest first, each into the open sequences
        with the least room that holds it."""
        groups = self.open
        for n in sorted(self.left, reverse=True):
            while n in self.left:
                room = min((r for r in groups if r >= n), default=None)
                if room is None:
                    count = self.left[n]
                    self.take(n, count, self.sequences, 0)
                    groups.setdefault(self.capacity - n, []).append((self.sequences, count, 1))
                    self.sequences += count
                    continue
                first, count, slots = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                some = min(count, self.left[n])
                self.take(n, some, first, slots)
                if some < count:
                    groups.setdefault(room, []).append((first + some, count - some, slots))
                if room > n:
                    groups.setdefault(room - n, []).append((first, some, slots + 1))


def plan_sequences(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """Patterns first, best fit for the rest."""
    fitted = Plan(histogram, capacity)
    fitted.fill_patterns(min(classes, capacity))
    fitted.best_fit()
    return fitted


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every
    piece.

    Ids are the tokenizer's own: a text that spells out one of its special
    tokens gets that token's id. A null or empty text is its end id alone. Rows with equal keys are packed
    as separate pieces. Other columns are not read. An empty table gives none.
    Texts are tokenized once; only piece records are shuffled. The histogram
    (one row per length up to ``capacity``) and the plan pass through the
    driver, nothing that grows with the documents does.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces")
    # ranks within a length: within one of its shares, after the shares before
    salts = max(SALTS, -(-pieces.count() // SHARE_PIECES))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    shares = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = materialize(shares.withColumn("before", before), "shares")
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_sequences(histogram, capacity)
    table = spark.createDataFrame(plan.rows or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, slot int")
    table = materialize(table, "plan")
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_rank", rank).join(shares.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("_rank") + F.col("before")).drop("_rank", "before")
    placed = ranked.join(table, (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["length"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0))
    return placed.select(F.col("id").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))
