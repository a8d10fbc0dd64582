"""Operator 10, quality rules: a decision list learned by sequential covering.

Every text is reduced once, by SQL functions only, to a row of counts. From
the labelled rows a list of threshold conjunctions is learned: each rule is
grown by information gain on two thirds of the labels, pruned on the other
third, and its rows leave the table before the next rule is grown. Growth
reads nothing but grouped counts per feature and threshold, one small Spark
job a step. The list becomes one ordered ``CASE`` expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import BLANKS, count_of, free_name, text_of, trimmed, word_array
from vitalspan.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8

FEATURES = (
    "n_words", "mean_word_chars", "symbols_per_word", "marks_per_word", "dup_line_share", "repeat_share",
    "upper_share", "distinct_share", "mean_line_words",
)


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold``, or ``feature > threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its precision on the pruning labels."""

    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def window_hashes(words: Column, k: int) -> list[Callable[[Column], Column]]:
    """Steps from an array of words to a 64-bit hash of each ``k``-word window.

    Each takes the step before: first the words' own hashes, then those of
    twice as many words, at last of two runs that overlap to ``k`` words. Every
    word is read once. Windows that run over the end are cut off.
    """
    def paired(shift: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(h, F.slice(h, F.lit(1 + shift), F.size(h)), lambda a, b: F.xxhash64(a, b))

    steps, reach = [lambda _: F.transform(words, lambda w: F.xxhash64(w))], 1
    while reach * 2 <= k:
        steps.append(paired(reach))
        reach *= 2
    if reach < k:
        steps.append(paired(k - reach))
    none = F.array().cast("array<bigint>")
    return [*steps, lambda h: F.when(F.size(h) >= k, F.slice(h, F.lit(1), F.size(h) - (k - 1))).otherwise(none)]


def with_repeated_words(df: DataFrame, words: str, name: str, k: int = WINDOW) -> DataFrame:
    """Adds the number of words inside a ``k``-word window that the same array
    has twice or more.

    Window hashes are compared inside the row; their positions are only sorted
    where a text repeats a window at all. Each step is a column of its own, so
    that Spark evaluates it once.
    """
    h, p, at = (free_name([*df.columns, name], n) for n in ("_hashes", "_places", "_at"))
    columns = df.columns
    for step in window_hashes(F.col(words), k):
        df = df.withColumn(h, step(F.col(h)))
    places = F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))
    df = df.select(*columns, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(places)).alias(p))

    def twice(v: Column, i: Column) -> Column:
        return ((i > 0) & F.get(p, F.greatest(i - 1, F.lit(0)))["h"].eqNullSafe(v["h"])) | F.get(p, i + 1)["h"].eqNullSafe(v["h"])

    df = df.select(*columns, F.sort_array(F.transform(F.filter(p, twice), lambda v: v["i"])).alias(at))
    steps = F.transform(at, lambda v, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - v, F.lit(k))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return df.select(*columns, F.coalesce(covered, F.lit(0)).cast("long").alias(name))


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and ratios of every whole text; one row per input row.

    A null or empty text has all counts 0 and all ratios 0. Other columns are
    dropped, whatever their names. Windows are compared by 64-bit hashes.
    """
    base = docs.select(F.col(key), text_of(text).alias("_t"))
    base = base.withColumns({"_w": word_array(F.col("_t")),
                             "_lines": F.filter(F.split(F.col("_t"), "\n"), lambda x: trimmed(x) != "")})
    base = with_repeated_words(base, "_w", "_repeated")
    t, w = F.col("_t"), F.col("_w")
    counts = base.select(
        key, F.size(w).cast("long").alias("n_words"),
        F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        count_of(t, "!?").cast("long").alias("n_marks"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counts.withColumns({
        "mean_word_chars": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"),
        "distinct_share": share("n_distinct_words", "n_words"), "mean_line_words": share("n_words", "n_lines"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_statistics(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the labelled documents with ``bad`` (0 or 1) and ``fold``.

    Null labels are ignored; of repeated labels the majority counts, a tie as
    good.
    """
    one = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"))
           .agg(F.when(F.avg(label) < 0.5, 1).otherwise(0).alias("bad")))
    fold = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)).cast("int")
    return (stats.join(one, F.col(key) == F.col("_k")).select(key, *FEATURES, "bad", fold.alias("fold")))


def thresholds(rows: DataFrame, per_feature: int) -> dict[str, list[float]]:
    """Candidate cut points: quantiles of each feature (at most so many), of
    the rejected and of the kept rows alike, so that a rare class has its own."""
    levels = [i / (per_feature // 2 + 1) for i in range(1, per_feature // 2 + 1)]
    wanted = [F.percentile_approx(F.when(F.col("bad") == y, F.col(f)), levels, 2000).alias(f"{f}_{y}") for f in FEATURES for y in (0, 1)]
    got = rows.agg(*wanted).first()
    return {f: sorted({float(v) for y in (0, 1) for v in (got[f"{f}_{y}"] or [])}) for f in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """Rejected and kept rows by feature and interval between cut points."""
    def interval(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: F.col(f) > c))

    cells = F.array(*[F.struct(F.lit(f).alias("f"), interval(f).alias("b")) for f in FEATURES if cuts[f]])
    got = (rows.select("bad", F.explode(cells).alias("c")).groupBy("c.f", "c.b")
           .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got}


def _best_condition(counts, cuts, p0: int, n0: int) -> tuple[Condition, int, int] | None:
    """The condition with the highest FOIL gain; ties go to the first in
    feature and threshold order."""
    best, best_gain = None, 1e-9
    before = math.log2(p0 / (p0 + n0))
    for f in FEATURES:
        below_p = below_n = 0
        for b, cut in enumerate(cuts[f]):
            p, n = counts.get((f, b), (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best_gain:
                    best, best_gain = (Condition(f, above, cut), p, n), gain
    return best


def learn_rules(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, per_feature: int = 32,
                min_precision: float = 0.9, min_support: int = 3) -> list[Rule]:
    """Sequential covering over ``labelled_statistics`` rows.

    A rule is taken while it rejects at least ``min_support`` bad rows of the
    growing labels, and the rejected rows of the pruning labels are bad in at
    least ``min_precision`` of the cases. No labels: no rules.
    """
    rows = materialize(rows.select(*FEATURES, "bad", "fold"), "labelled")
    cuts = thresholds(rows, per_feature)
    if not any(cuts.values()):
        return []
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grown: list[Condition] = []
        here = left.where("fold <> 2")
        while len(grown) < max_conditions:
            counts = _counts(here, cuts)
            first = next(f for f in FEATURES if cuts[f])
            p0 = sum(p for (f, _), (p, _n) in counts.items() if f == first)
            n0 = sum(n for (f, _), (_p, n) in counts.items() if f == first)
            found = _best_condition(counts, cuts, p0, n0) if p0 and n0 else None
            if found is None:
                break
            grown.append(found[0])
            here = here.where(found[0].column())
            if found[2] == 0:
                break
        if not grown:
            break
        rule = _prune(left, grown, min_precision, min_support)
        if rule is None:
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def _prune(left: DataFrame, grown: list[Condition], min_precision: float, min_support: int) -> Rule | None:
    """The prefix of the conditions that does best on the pruning labels."""
    prefixes = [Rule(tuple(grown[:i]), 0.0) for i in range(1, len(grown) + 1)]
    sums = []
    for i, r in enumerate(prefixes):
        sums += [F.sum(F.when(r.column() & (F.col("fold") == 2), F.col("bad")).otherwise(0)).alias(f"p{i}"),
                 F.sum(F.when(r.column() & (F.col("fold") == 2), 1 - F.col("bad")).otherwise(0)).alias(f"n{i}"),
                 F.sum(F.when(r.column() & (F.col("fold") != 2), F.col("bad")).otherwise(0)).alias(f"g{i}")]
    got = left.agg(*sums).first()
    best = None
    for i, r in enumerate(prefixes):
        p, n, g = (got[f"{k}{i}"] or 0 for k in "png")
        precision = (p + 1) / (p + n + 2) if p + n < 10 else p / (p + n)
        worth = (p - n) / (p + n) if p + n else 0.0
        if g >= min_support and p and precision >= min_precision - (0.3 if p + n < 10 and n == 0 else 0) and (best is None or worth > best[0]):
            best = (worth, Rule(r.conditions, p / (p + n)))
    return best[1] if best else None


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that rejects a row, counted from 1; null if none does."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(None).cast("int") if out is None else out


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **learning) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``rule`` and ``kept``.

    ``kept`` is false if the base test fails or a learned rule rejects. Texts
    are read once: the counts are written, then learned from and judged.
    """
    stats = materialize(text_statistics(docs, key), "statistics")
    rules = learn_rules(labelled_statistics(stats, labels, key), **learning)
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
