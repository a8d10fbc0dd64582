"""Operator 9, mixing sources to target weights by entropy balancing.

Of all document rates that give each source its target of tokens, take those
closest in entropy to one copy each. The convex dual has one multiplier per
source and the rates are exponential in a document's size relative to its
source's mean: ``rate = min(3, exp(multiplier * size / mean))``. Rates only
depend on source and size, so Newton's sums run over the (source, size)
histogram, one grouped Spark job a step, with a bracket that Newton may not
leave. Rates are rounded to copies by a hash of the document, and one
threshold per source takes back what rounding left over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalspan.llm.common import text_of, word_array
from vitalspan.session import materialize

MOST = 3
CELLS = 4096
SHARES = 32


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, size``; a null text has size 0, a null source is a source."""
    return docs.select(F.col(key), F.col(source).alias("source"), F.size(word_array(text_of(text))).cast("long").alias("size"))


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Targets from ``source, source_size``: weights repeat over the sources in
    code-point order (null last), share all tokens, and stop at ``most`` times
    the source; the excess is shared again by weight.

    Capped sources are those with the least room per weight, so one pass in
    that order finds the level that the others share. Windows run over the
    table of sources, one row each.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    room = (F.col("source_size") * most / F.col("weight")).alias("room")
    everything = W.partitionBy()
    earlier = W.orderBy("_room", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_room", room)
    rows = rows.withColumns({
        "_left": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
        "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    })
    rows = rows.withColumn("_level", F.col("_left") / F.col("_weights"))
    rows = rows.withColumn("_share", F.min(F.when(F.col("_room") >= F.col("_level"), F.struct("_room", "source", "_level"))).over(everything))
    capped = F.col("_share").isNull() | (F.col("_room") < F.col("_share._level"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("_share._level"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def balance(histogram: DataFrame, targets: DataFrame, most: int = MOST, steps: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """``source, source_size, target, mean, multiplier`` (null: all rates are
    ``most``, or the source has no words).

    Every step sums gradient and curvature of the dual over the histogram and
    moves all multipliers at once; a step that leaves its bracket halves it.
    """
    top = math.log(most)
    shape = (histogram.where("size > 0").groupBy("source")
             .agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least")))
    state = targets.join(shape.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    # at the ends of the bracket every rate is at least, or at most, what the target needs on average
    scale = F.col("mean") / F.col("least")
    state = state.select("source", "source_size", "weight", "target", "mean", F.when(open_, F.lit(0.0)).alias("multiplier"),
                         F.when(open_, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * scale) - 1).alias("low"),
                         F.when(open_, top * scale + 1).alias("high"))
    state = materialize(state, "multipliers")
    for _ in range(steps):
        moment = F.col("size") / F.col("mean")
        power = F.least(F.col("multiplier") * moment, F.lit(top))
        rate = F.exp(power)
        each = F.col("n") * F.col("size") * rate
        sums = (histogram.where("size > 0").join(state.where("multiplier IS NOT NULL").withColumnRenamed("source", "_s"),
                                                 F.col("source").eqNullSafe(F.col("_s")))
                .groupBy("_s").agg((F.sum(each) - F.first("target")).alias("gradient"),
                                   F.sum(F.when(power < top, each * moment).otherwise(0.0)).alias("curvature")))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        low = F.when(F.col("gradient") < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("gradient") > 0, F.col("multiplier")).otherwise(F.col("high"))
        # no curvature is left once all documents are at the cap; the null takes the bisection
        newton = F.col("multiplier") - F.try_divide("gradient", "curvature")
        moved = moved.select("source", "source_size", "weight", "target", "mean", "multiplier", low.alias("low"), high.alias("high"),
                             newton.alias("_newton"), F.abs(F.col("gradient") / F.col("target")).alias("_off"))
        inside = (F.col("_newton") > F.col("low")) & (F.col("_newton") < F.col("high"))
        step = F.when(F.col("_off") <= tolerance, F.col("multiplier")).when(inside, F.col("_newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(moved.select("source", "source_size", "weight", "target", "mean", step.alias("multiplier"), "low", "high", "_off"),
                            "multipliers")
        worst = state.agg(F.max("_off")).first()[0]
        state = state.drop("_off")
        if worst is None or worst <= tolerance:
            break
    # sums of doubles may differ in their last digits between runs; the rates must not
    return state.select("source", "source_size", "weight", "target", "mean", F.round("multiplier", 6).alias("multiplier"))


def _per_source(rows: DataFrame, key: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their source. Either side is dealt by source
    and a share of the keys, so that a source with a third of all rows is not
    gathered in one place, by the join or by a sum that follows it."""
    dealt = table.withColumnRenamed("source", "_s").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int"))
    return rows.join(dealt, (F.col("_share") == F.col("_deal")) & F.col("source").eqNullSafe(F.col("_s")), how).drop("_s", "_deal", "_share")


def _unit(key: Column, seed: int) -> Column:
    """An even number in [0, 1) from a key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(2**53))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3),
                most: int = MOST, seed: int = 9) -> DataFrame:
    """``key, source, size, source_size, target, rate, copies, taken`` of every row.

    Null and empty texts have size 0, rate 1 and one copy that takes no word.
    A null source is a source of its own, last in order. Repeated rows are
    separate documents with the same draw. An empty table gives none. Texts
    are read once; other columns are not read. The threshold brings ``taken``
    of a source to within one 4,096th of its tokens, or one document, of the
    target; a last copy more or less brings it nearer still.
    """
    sizes = materialize(document_sizes(docs, key, text, source), "sizes")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = balance(histogram, source_targets(sources, cycle, most), most)
    rows = _per_source(sizes, key, solved)
    tilted = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(math.log(most))))
    rate = (F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNotNull(), F.least(tilted, F.lit(float(most))))
            .otherwise(F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))))
    rows = rows.withColumn("rate", rate).withColumn("_at", F.col("rate") + _unit(F.col(key), seed))
    rows = rows.withColumn("_copies", F.least(F.floor("_at"), F.lit(most)).cast("long"))
    # how near the sum is to the next copy: cells of equal width, for the threshold
    rows = rows.withColumn("_cell", F.when(F.col("rate") < most, F.least(F.floor((F.col("_at") - F.floor("_at")) * CELLS), F.lit(CELLS - 1))).cast("int"))
    rows = _per_source(rows, key, _shifts(rows), "left")
    up = (F.col("_shift") > 0) & (F.col("_cell") >= CELLS - F.col("_shift")) & (F.col("_copies") < most)
    down = (F.col("_shift") < 0) & (F.col("_cell") < -F.col("_shift")) & (F.col("_copies") > 0)
    copies = F.when(F.col("size") == 0, F.col("_copies")).when(up, F.col("_copies") + 1).when(down, F.col("_copies") - 1).otherwise(F.col("_copies"))
    rows = rows.select(key, "source", "size", "source_size", "target", "rate", copies.alias("copies"))
    rows = _per_source(rows, key, _last_copy(rows, key, most), "left")
    last = F.col("copies") + F.when(F.col(key) == F.col("_key"), F.col("_step")).otherwise(0)
    return rows.select(key, "source", "size", "source_size", "target", "rate", last.alias("copies"), (last * F.col("size")).alias("taken"))


def _last_copy(rows: DataFrame, key: str, most: int) -> DataFrame:
    """For each source, the one document whose copy more or less brings the
    sum nearest to the target, if that is nearer than it is."""
    short = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    off = F.abs(F.abs("short") - F.col("size"))
    able = (F.col("size") > 0) & F.when(F.col("short") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    able = able & (off < F.abs("short")) & ((F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    best = (_per_source(rows, key, short).where(able).groupBy("source")
            .agg(F.min(F.struct(off.alias("off"), F.col(key).alias("k"), F.signum("short").cast("int").alias("step"))).alias("b")))
    return best.select("source", F.col("b.k").alias("_key"), F.col("b.step").alias("_step"))


def _shifts(rows: DataFrame, most: int = MOST) -> DataFrame:
    """For each source, by how many cells its rounding threshold moves so that
    the words taken come nearest to the target."""
    cells = (rows.where(F.col("_cell").isNotNull() & (F.col("size") > 0)).groupBy("source", "_cell")
             .agg(F.sum(F.when(F.col("_copies") < most, F.col("size")).otherwise(0)).alias("up"),
                  F.sum(F.when(F.col("_copies") > 0, F.col("size")).otherwise(0)).alias("down")))
    short = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("_copies") * F.col("size"))).alias("short"))
    cells = cells.join(short.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    raised = F.sum("up").over(W.partitionBy("source").orderBy(F.col("_cell").desc()))
    lowered = F.sum("down").over(W.partitionBy("source").orderBy("_cell"))
    cells = cells.withColumns({"raised": raised, "lowered": lowered})
    moves = cells.select("source", "short", F.explode(F.array(
        F.struct((CELLS - F.col("_cell")).alias("shift"), F.col("raised").alias("gain")),
        F.struct((-F.col("_cell") - 1).alias("shift"), (-F.col("lowered")).alias("gain")))).alias("m"))
    best = F.min(F.struct(F.abs(F.col("short") - F.col("m.gain")).alias("off"), F.abs("m.shift").alias("far"), F.col("m.shift").alias("shift")))
    found = moves.groupBy("source").agg(best.alias("b"), F.first("short").alias("short"))
    return found.select("source", F.when(F.col("b.off") < F.abs("short"), F.col("b.shift")).otherwise(0).alias("_shift"))
