"""Operator 3, line dedup by a log-template tree.

A line's place in the tree is its number of tokens and its leading tokens; a
token with a digit is a variable field everywhere. Lines that enough documents
hold token for token recur as they are. The others are judged in groups, at
first the leaves: every position holds its most common token if at least half
of the group's lines and enough documents share it, and is a variable field
otherwise. Lines that agree with this template behind their leading tokens,
and not by fields alone, recur. The rest splits by the most common token that
each line holds and part of its group lacks, until no group is left that
enough documents reach. The first line of a template (by key and line) stays
where it is, all others are dropped.

Only SQL functions run. The tree is a key, its leaves are groups, and all
counts have partial sums, so a line that a third of the documents hold is
counted, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import text_of, word_array
from vitalspan.session import materialize

#: A variable field in a row of token hashes.
FIELD = 0


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(F.hash(w)))


def _row(words: Column, tokens: Column) -> Column:
    """Equal for lines of equal tokens; where all are fields, of equal words."""
    return F.when(F.exists(tokens, lambda t: t != FIELD), F.xxhash64(tokens)).otherwise(F.xxhash64(words))


def parsed_lines(docs: DataFrame, key: str, text: str, depth: int, least_tokens: int, least_docs: int) -> DataFrame:
    """``id, line, leaf, row, tokens`` of lines with enough tokens in leaves of
    enough documents; tokens are hashes, ``FIELD`` for one with a digit. ``row``
    is equal for lines of equal tokens; where all are fields, of equal words.
    Only leading tokens are hashed to find the leaves."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(text_of(text), "\n")).alias("line", "content"))
    # words come out of a generator, through which the filter is not pushed: each line is cut once
    words = lines.select("id", "line", "content", F.explode(F.array(word_array(F.col("content")))).alias("w")).where(F.size("w") >= least_tokens)
    rows = words.select("id", "line", "content", F.xxhash64(F.size("w"), _hashed(F.slice("w", 1, depth))).alias("leaf"))
    rows = rows.join(_reached(rows, least_docs, "leaf"), "leaf", "left_semi").withColumn("w", word_array(F.col("content")))
    rows = rows.select("id", "line", "leaf", "w", _hashed(F.col("w")).alias("tokens"))
    return materialize(rows.select("id", "line", "leaf", _row(F.col("w"), F.col("tokens")).alias("row"), "tokens"), "lines")


def _reached(rows: DataFrame, least_docs: int, by: str = "group") -> DataFrame:
    """Groups of at least so many documents, and their lines; written, so that
    a join with them deals its own sides and can split a group that many lines
    reach."""
    groups = rows.groupBy(by, "id").agg(F.count("*").alias("n")).groupBy(by).agg(F.count("*").alias("docs"), F.sum("n").alias("lines"))
    return materialize(groups.where(F.col("docs") >= least_docs).select(by, "lines"), "groups")


def _firsts(rows: DataFrame, least_docs: int, by: str = "group") -> DataFrame:
    """The first line of each group of at least so many documents."""
    groups = (rows.groupBy(by, "id").agg(F.min("line").alias("line"))
              .groupBy(by).agg(F.count("*").alias("docs"), F.min(F.struct("id", "line")).alias("first")))
    return materialize(groups.where(F.col("docs") >= least_docs).select(by, "first"), "firsts")


def _counts(rows: DataFrame) -> DataFrame:
    """``group, lines, at, token, n, docs``: lines and documents of a group
    that hold a token at a position."""
    tokens = rows.select("group", "lines", "id", F.posexplode("tokens").alias("at", "token"))
    return (tokens.groupBy("group", "lines", "at", "token", "id").agg(F.count("*").alias("n"))
            .groupBy("group", "lines", "at", "token").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))


def group_templates(rows: DataFrame, least_docs: int) -> DataFrame:
    """``group, template``: for each position the commonest token if half of
    the group's lines and enough documents have it (the smaller hash of
    equally common ones), else a variable field."""
    top = (_counts(rows).groupBy("group", "lines", "at")
           .agg(F.max(F.struct("n", (-F.col("token").cast("long")).alias("t"), "docs")).alias("m")))
    common = (2 * F.col("m.n") >= F.col("lines")) & (F.col("m.docs") >= least_docs)
    placed = top.select("group", "at", F.when(common, -F.col("m.t")).otherwise(FIELD).cast("int").alias("token"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "token")))
    return placed.groupBy("group").agg(F.transform(ordered, lambda x: x["token"]).alias("template"))


def _agrees(depth: int, agreement: float) -> Column:
    """Whether enough tokens behind the leading ones, which all lines of a leaf
    share, are those of the template, and one of them is no field."""
    behind = [F.slice(c, depth + 1, F.size("tokens")) for c in ("tokens", "template")]
    same = F.filter(F.zip_with(*behind, lambda a, b: F.when(a == b, a)), lambda t: t.isNotNull())
    return (F.size(same) >= agreement * F.size(behind[0])) & F.exists(same, lambda t: t != FIELD)


def _split(rest: DataFrame, least_docs: int) -> DataFrame:
    """The lines of a group that enough documents could still share, by the
    commonest token of each. A token of all the group's lines splits nothing,
    so every new group has fewer lines than the one it comes from."""
    keys = materialize(_counts(rest).where((F.col("token") != FIELD) & (F.col("docs") >= least_docs) & (F.col("n") < F.col("lines")))
                       .select("group", "at", "token", "n"), "keys")
    tokens = rest.select("group", "id", "line", "row", F.posexplode("tokens").alias("at", "token"))
    chosen = (tokens.join(keys, ["group", "at", "token"]).groupBy("group", "id", "line", "row")
              .agg(F.max(F.struct("n", (-F.col("at")).alias("before"), "token")).alias("k")))
    return (rest.join(chosen, ["group", "id", "line", "row"])
            .select("leaf", F.xxhash64("group", "k.before", "k.token").alias("group"), "id", "line", "row", "tokens"))


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 3, least_tokens: int = 5, least_docs: int = 5,
                    agreement: float = 0.6) -> DataFrame:
    """``id, line, row, leaf, template`` of every line to drop. ``row`` tells
    apart lines that rows of one key have at the same place."""
    later = "NOT (id <=> first.id AND line <=> first.line)"
    rows = parsed_lines(docs, key, text, depth, least_tokens, least_docs)
    rows = materialize(rows.join(_firsts(rows, least_docs, "row"), "row", "left"), "exact")
    dropped = rows.where("first IS NOT NULL").where(later).select("id", "line", "row", "leaf", F.col("tokens").alias("template"))
    rows = rows.where("first IS NULL").select("leaf", F.col("leaf").alias("group"), "id", "line", "row", "tokens").distinct()
    while True:
        rows = materialize(rows.join(_reached(rows, least_docs), "group"), "lines")
        if rows.isEmpty():
            return dropped
        judged = rows.join(materialize(group_templates(rows, least_docs), "templates"), "group")
        judged = materialize(judged.withColumn("fits", _agrees(depth, agreement)), "judged")
        judged = judged.join(_firsts(judged.where("fits"), least_docs), "group", "left").withColumn("gone", F.col("fits") & F.col("first").isNotNull())
        dropped = dropped.union(judged.where("gone").where(later).select("id", "line", "row", "leaf", "template"))
        rows = materialize(_split(judged.where("NOT gone").drop("template", "fits", "first", "gone"), least_docs), "rest")


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: str = "_lines", **tree) -> DataFrame:
    """The rows with all their columns, the text without recurring lines, and
    a struct ``counts`` (``n``, ``dropped``); no other name can clash."""
    gone = recurring_lines(docs.where(F.col(key).isNotNull()), key, text, **tree)
    gone = gone.groupBy("id").agg(F.collect_set(F.struct("line", "row")).alias("gone"))
    # one struct of all columns, so that their names cannot meet those used here
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    rows = rows.join(gone, F.col("own")[key] == F.col("id"), "left").withColumn("all", F.split(F.col("own")[text], "\n"))

    def same(x: Column) -> Column:
        words = word_array(F.coalesce(F.get("all", x["line"]), F.lit("")))
        return _row(words, _hashed(words)) == x["row"]

    here = F.transform(F.filter("gone", same), lambda x: x["line"])
    rows = rows.withColumn("here", F.coalesce(F.array_distinct(here), F.array().cast("array<int>")))
    n = F.when(F.col("all").isNull(), 0).otherwise(F.size("all"))
    rows = rows.withColumn("counted", F.struct(n.cast("long").alias("n"), F.size("here").cast("long").alias("dropped")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "here"), lambda i: F.get("all", i))
    new = F.when(F.col("counted.dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("own")[text])
    return rows.select(*[(new if c == text else F.col("own")[c]).alias(c) for c in docs.columns], F.col("counted").alias(counts))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **tree) -> DataFrame:
    """``key, n_lines, n_dropped, text`` of every row, without the lines that
    ``recurring_lines`` names.

    Lines are separated by line feeds and stay as they are. Lines with fewer
    than ``least_tokens`` words are never dropped. A null text stays null and
    has no lines. Rows with equal keys count as one document, but each loses
    only its own recurring lines; rows with a null key keep theirs. Other
    columns are not read.
    """
    rows = rewritten(docs.select(key, text), key, text, **tree)
    return rows.select(key, F.col("_lines.n").alias("n_lines"), F.col("_lines.dropped").alias("n_dropped"), text)
