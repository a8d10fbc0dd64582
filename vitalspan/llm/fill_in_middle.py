"""Operator 11, fill-in-the-middle rewriting.

A text is cut at two units into prefix, middle and suffix, and written with
the middle last behind three sentinels, so that a left-to-right model learns
to fill gaps. A unit is a run of non-blanks with the blanks before it; blanks
at the end of a text are a unit of their own. One ``regex`` full match of
``(unit)*`` keeps every repetition of its group: their number is the count of
units, their ends are the places where a text can be cut.

Draws are digests of a seed and the row's key, taken by SQL functions, so a
lost task repeats them and no engine's random numbers matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows

#: Units of a whole text. The possessive signs keep a full match from
#: remembering places to come back to; there is only one way to cut.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """The three marks. No mark may begin as one of them ends, nor stand
    within another, so that cut texts beside marks never form a new one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all()
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must be three different, non-empty texts")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can overlap")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _draw(key: Column, seed: int, i: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def cut_text(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Units of a text and the two code points at which draws cut it."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, marks: Sentinels = Sentinels(),
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row.

    ``rate`` of 100 rows are rewritten, ``suffix_first`` of 100 of these with
    the suffix before the prefix. A null text is an empty one. An empty text,
    or one that holds a sentinel, stays plain: its output is the text, its two
    lengths are null. Rows with equal keys draw alike, whatever their texts; a
    null key draws like an empty one. Repeated rows are repeated, an empty
    table gives none. Only key and text are read, so other columns cannot
    clash. Texts of any length are cut whole; a task holds one batch.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chosen = (_draw(F.col("k"), seed, 2) % 100) < rate
    for mark in marks.all():
        chosen = chosen & ~F.contains(F.col("t"), F.lit(mark))
    form = (F.when((F.col("t") == "") | ~chosen, PLAIN)
            .when((_draw(F.col("k"), seed, 3) % 100) < suffix_first, SUFFIX_FIRST).otherwise(PREFIX_FIRST))
    rows = rows.select("k", "t", _draw(F.col("k"), seed, 0).alias("h1"), _draw(F.col("k"), seed, 1).alias("h2"), form.alias("form"))
    p, s, m = marks.all()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, prefixes, middles, outputs = [], [], [], []
            for t, h1, h2, f in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                n, low, high = cut_text(t, h1, h2)
                counts.append(n)
                prefixes.append(None if f == PLAIN else low)
                middles.append(None if f == PLAIN else high - low)
                before, between, after = t[:low], t[low:high], t[high:]
                outputs.append(t if f == PLAIN else f"{p}{before}{s}{after}{m}{between}" if f == PREFIX_FIRST else f"{s}{after}{p}{before}{m}{between}")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), b.column(4), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                names=["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = map_rows(rows, work, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("k", key)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text from a rewritten one and its form, by its sentinels alone."""
    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(marks.middle) + 1)

    prefix, suffix, middle = split(marks.prefix, marks.suffix)
    suffix2, prefix2, middle2 = split(marks.suffix, marks.prefix)
    return (F.when(form == PREFIX_FIRST, F.concat(prefix, middle, suffix))
            .when(form == SUFFIX_FIRST, F.concat(prefix2, middle2, suffix2)).otherwise(output))
