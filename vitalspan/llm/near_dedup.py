"""Operator 2, near-duplicate groups by SuperMinHash.

Every text becomes its set of hashed word shingles and a SuperMinHash
signature: each element offers a rank to the slots in its own permuted order,
with early stopping, so the slots are correlated and the estimate varies less
than with independent permutations. Texts with equal sets form classes, and
one representative of each goes on. Bands of the signature put
representatives into buckets; links are confirmed on full sets; union-find
gives the groups.

No pairs of a bucket are listed. Every bucket elects a pivot, its most central
member, and each representative is first confirmed against the pivot it shares
most buckets with. That leaves few components. What remains are pairs of one
pivot's group that lie in different components: the group's largest component
meets the other members only, and those meet each other too, in blocks of
bounded members and elements inside the tasks, which return a spanning forest
of the confirmed links.

A pair at the threshold shares no band with probability
``(1 - 0.75**4) ** 32``, five in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows
from vitalspan.llm.components import UnionFind, components
from vitalspan.llm.shingles import band_keys, shingle_set, signatures
from vitalspan.session import materialize

SLOTS, BAND = 128, 4
#: Members and set elements of a block, on average; two blocks meet in one comparison.
BLOCK, ELEMENTS = 512, 1 << 18
#: Columns of an incidence block.
COLUMNS = 4096


def shingle_features(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``id, n, s1, s2, bands``: set size, 128 bits that identify the set, and
    band keys (none for an empty set)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            keys = band_keys(signatures(sets, SLOTS), BAND)
            # the sum and a scrambled sum of set elements do not depend on their order
            with np.errstate(over="ignore"):
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([((s ^ (s >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) for s in sets], np.uint64)
            sizes = [len(s) for s in sets]
            bands = [k.tolist() if n else [] for k, n in zip(keys.view(np.int64), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "s1", "s2", "bands"])

    return map_rows(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), work, "id long, n long, s1 long, s2 long, bands array<long>")


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``id, shingles`` with the full set of hashed shingles."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return map_rows(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), work, "id long, shingles array<long>")


def _alike(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _blocks(members: Column, elements: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, elements / ELEMENTS)).cast("int")


def near_links(features: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """``a, b`` links between representatives whose components are those of
    all confirmed links."""
    reps = features.where("id = rep AND n > 0").dropDuplicates(["id"])
    rows = reps.select("id", "n", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(rows.join(counts, "bucket").select("bucket", "id", "n", "size"), "buckets")
    central = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    central = shared.select("bucket", "id", "n").join(central, "id")
    pivots = central.groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot"))
    member = shared.join(pivots, "bucket").groupBy("pivot", "id", "n").agg(F.count("*").alias("times"))
    member = materialize(member, "members")
    sets = materialize(shingle_sets(docs.join(member.select(F.col("id").alias("_id")).distinct(), docs[key] == F.col("_id"), "left_semi"), key, text, k)
                       .dropDuplicates(["id"]), "sets")
    # each representative against the pivot with which it shares most buckets
    sizes = reps.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"))
    other = member.where("id <> pivot").join(sizes, "pivot")
    other = other.where((100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")))
    first = other.groupBy("id").agg(F.max_by(F.struct("pivot", "n", "pivot_n"), F.struct("times", -F.col("pivot"))).alias("p")).select("id", "p.*")
    mine = sets.withColumnRenamed("shingles", "mine")
    theirs = sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("theirs"))
    common = F.size(F.array_intersect("mine", "theirs"))
    stars = first.join(mine, "id").join(theirs, "pivot").where(_alike(common, F.col("n"), F.col("pivot_n"), percent))
    stars = materialize(stars.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "stars")
    found = components(stars)
    # groups of a pivot that still hold several components
    placed = member.join(found, member["id"] == found["node"], "left").select("pivot", "id", "n", F.coalesce("component", "id").alias("comp"))
    parts = placed.groupBy("pivot", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    most = F.struct("members", -F.col("comp"))
    largest = [F.max_by(c, most).alias(f"main_{c}") for c in ("comp", "members", "elements")]
    open_ = (parts.groupBy("pivot").agg(F.count("*").alias("comps"), F.sum("members").alias("members"), F.sum("elements").alias("elements"), *largest)
             .where("comps > 1"))
    open_ = open_.select("pivot", "main_comp", _blocks(F.col("main_members"), F.col("main_elements")).alias("main"),
                         _blocks(F.col("members") - F.col("main_members"), F.col("elements") - F.col("main_elements")).alias("others"))
    rest = placed.join(materialize(open_, "groups"), "pivot")
    # blocks of the others come first; the largest component's blocks do not meet each other
    inner, deal = F.col("comp") == F.col("main_comp"), F.xxhash64("id")
    rest = rest.withColumn("own", F.when(inner, F.col("others") + F.pmod(deal, "main")).otherwise(F.pmod(deal, "others")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(inner, 0).otherwise(F.col("main")) - 1)))
    rest = rest.select("pivot", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "comp").join(sets, "id")
    rest = rest.select("pivot", "i", "j", "own", "id", "comp", "shingles").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            lists = batch.column(6)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (p, a, b, own, node, comp) in enumerate(zip(*columns, strict=True)):
                if (p, a, b) != group:
                    yield _links(held, group, percent)
                    held, group = [], (p, a, b)
                held.append((own, node, comp, values[offsets[i]:offsets[i + 1]].copy()))
        yield _links(held, group, percent)

    return stars.union(map_rows(rest, work, "a long, b long"))


def _links(rows: list[tuple], group: tuple | None, percent: int) -> pa.RecordBatch:
    """A spanning forest of the confirmed links between different components
    of one block pair; pairs within a block belong to its own comparison."""
    out: list[tuple[int, int]] = []
    n = len(rows)
    if n > 1:
        sizes = np.array([len(r[3]) for r in rows])
        common = _intersections([r[3] for r in rows])
        comp = np.array([r[2] for r in rows])
        own = np.array([r[0] for r in rows])
        near = 100 * common >= percent * (sizes[:, None] + sizes - common)
        near &= comp[:, None] != comp
        if group[1] != group[2]:
            near &= own[:, None] != own
        sets = UnionFind()
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            if sets.union(rows[i][2], rows[j][2]):
                out.append((rows[i][1], rows[j][1]))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by incidence blocks."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    element = np.cumsum(new) - 1
    often = np.bincount(element) > 1
    keep = often[element]
    owner, element = owner[keep], (np.cumsum(often) - 1)[element[keep]]
    common = np.zeros((n, n))
    total = int(often.sum())
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(element, [start, start + COLUMNS])
        block = np.zeros((n, min(COLUMNS, total - start)), np.float32)
        block[owner[a:b], element[a:b] - start] = 1
        common += block @ block.T
    return common.astype(np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``key, n_shingles, class_id, component_id, kept`` of every row.

    Texts are lower-cased A-Z and split at ASCII blanks. The set of a text
    holds its distinct ``k``-word shingles; with fewer words, the whole
    sequence. Null texts and texts without words have an empty set and link
    with nothing. ``class_id`` is the smallest key with an equal set,
    ``component_id`` the smallest reachable over links of at least ``percent``
    similarity, ``kept`` whether the row's key is that. Repeated rows are
    repeated and share a key, so they share the verdict. Rows with a null key
    link with nothing and are kept. Other columns are not read.
    """
    features = materialize(shingle_features(docs, key, text, k), "features")
    sets = ["n", "s1", "s2"]
    # written, so that the join deals its own sides and can split a large class
    classes = materialize(features.where("n > 0 AND id IS NOT NULL").groupBy(*sets).agg(F.min("id").alias("rep")), "representatives")
    features = materialize(features.join(classes, sets, "left").withColumn("rep", F.coalesce("rep", "id")), "classes")
    groups = components(near_links(features, docs, key, text, k, percent))
    out = features.join(groups, features["rep"] == groups["node"], "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(known, F.col("rep")).alias("class_id"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
