"""Fill-in-the-middle, quality classifier and ranked search against brute
force: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vitalspan.llm import fill_in_middle, lexical_search, quality_classifier, queries

DOCS = "doc_id long, text string, n long, k long, t string, form string, output string, score double, i int, rank int, item string"


@pytest.fixture(scope="module")
def make(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, -1, -2, "x", "y", "z", 0.5, 1, 2, "w") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)] + ["The", "the", "THE", "x_y", "a-b", "12"]
    rows = [(i, "".join(rng.choice([" ", "\n", "  \t", " "]) + w for w in rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "tail \n "), (205, "a <P> b"), (206, "a <S"), (207, " ".join(rng.choices(vocabulary, k=30_000))),
             (208, rows[4][1]), (None, "the key is null, the"), (209, "<M>"), (210, "😀 the 😀")]
    return [*rows, rows[5], rows[5]]


# -- 11 fill in the middle


def brute_middle(key, text, p="<P>", s="<S>", m="<M>"):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not t or p in t or s in t or m in t or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(units), "spm", len(a), len(b), s + c + p + a + m + b
    return len(units), "psm", len(a), len(b), p + a + s + c + m + b


def test_middle_equals_brute_force_and_can_be_undone(make, corpus):
    rows = corpus + [(1000 + i, t) for i, (_, t) in enumerate(corpus)]
    found = fill_in_middle.fill_in_middle(make(rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found]
    assert Counter(got) == Counter((k, *brute_middle(k, t)) for k, t in rows)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    assert Counter((r["doc_id"], r["back"]) for r in found) == Counter((k, t or "") for k, t in rows)
    assert fill_in_middle.fill_in_middle(make([])).count() == 0


def test_units_of_long_texts_take_linear_time():
    for text in (" " * 2_000_000, "ab " * 700_000, " a" * 3 + "b" * 1_000_000 + "\n" * 1_000_000):
        n, low, high = fill_in_middle.cut_text(text, 1, 2)
        assert n == len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)) and low <= high


def test_middle_takes_other_marks_and_refuses_overlapping_ones(make):
    marks = fill_in_middle.Sentinels("[pre]", "[suf]", "[mid]")
    found = fill_in_middle.fill_in_middle(make([(i, f"a [p b {i} [su") for i in range(40)]), rate=100, suffix_first=50, marks=marks)
    rows = found.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in rows} == {"spm", "psm"} and all(r["back"] == f"a [p b {r['doc_id']} [su" for r in rows)
    for bad in (("", "b", "c"), ("a", "a", "c"), ("ab", "ba", "c"), ("<x>", "<x><y>", "z")):
        with pytest.raises(ValueError):
            fill_in_middle.Sentinels(*bad)


# -- 12 quality classifier


def brute_grams(text, bits=quality_classifier.BITS):
    """Buckets of a text, one n-gram at a time with whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    word = [quality_classifier._hash(w.encode()) for w in words]
    shape = [quality_classifier._hash(b"\0" + quality_classifier.word_shape(w.encode().translate(quality_classifier.CLASS_BYTES))) for w in words]
    shape = [1 if i and words[i] == words[i - 1] else s for i, s in enumerate(shape)]
    out = set(word)
    for source, orders in ((word, (2,)), (shape, (1, 2, 3, 4))):
        for order in orders:
            for i in range(len(source) - order + 1):
                h = source[i]
                for s in source[i + 1:i + order]:
                    h = (h * 0x9E3779B97F4A7C15 + s) & mask
                out.add(mix((h + order) & mask))
    return sorted({h >> 64 - bits for h in out})


def test_indicators_equal_one_by_one(corpus, monkeypatch):
    texts = [t for _, t in corpus if len(t or "") < 5000]
    for part in (1 << 18, 5):
        monkeypatch.setattr(quality_classifier, "PART_WORDS", part)
        buckets, starts = quality_classifier.indicators(texts)
        assert [buckets[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [brute_grams(t) for t in texts]
    assert quality_classifier.indicators([]) [0].tolist() == []
    assert quality_classifier.word_shape(b"Aaaaa***!") == b"Aa**!"


def test_count_ratios_are_neutral_where_nothing_is_known():
    ratio = quality_classifier.log_count_ratios(np.array([0.0, 90, 0]), np.array([0.0, 0, 10]), 90, 10)
    assert ratio[0] == pytest.approx(0, abs=1e-6) and ratio[1] > 0 > ratio[2]
    assert ratio[1] == pytest.approx(math.log((90.9 / 90.9) / (0.1 / 10.1)), abs=1e-5)


def test_dual_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1.0, -2, 0, 0.5, 0]) + 0.4 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = 0.7
    w = quality_classifier.dual_coordinate_descent(x.ravel(), np.tile(np.arange(5), 60), np.arange(0, 301, 5), y.tolist(), 5, cost, epochs=5000, tolerance=1e-8)
    with_constant = np.column_stack([x, np.ones(60)])
    primal = 0.5 * w @ w + cost * np.maximum(0, 1 - y * (with_constant @ w)).sum()
    for _ in range(300):  # no other weights are better
        other = w + rng.normal(size=6) * rng.choice([1e-3, 1e-2, 0.1])
        assert primal <= 0.5 * other @ other + cost * np.maximum(0, 1 - y * (with_constant @ other)).sum() + 1e-6


def test_logistic_curve_matches_known_shares():
    margin = np.repeat([-1.0, 1.0], 1000)
    label = np.concatenate([np.repeat([0.0, 1], [900, 100]), np.repeat([0.0, 1], [100, 900])])
    slope, offset = quality_classifier.logistic_curve(margin, label)
    assert slope == pytest.approx(math.log(9), abs=0.02) and abs(offset) < 0.02
    assert quality_classifier.logistic_curve(margin, 1 - label)[0] == 0


def test_classifier_edges(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make([(1, "good words here"), (2, "bad*** words!! here"), (3, "both"), (4, None), (4, None), (None, "no key"), (5, ""), (6, "x " * 50_000)])
    model = quality_classifier.train(docs, labels, calibration_share=0.0)
    rows = quality_classifier.score_documents(docs, model).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] > score[2] and score[4] == score[5]
    assert quality_classifier.score_documents(make([]), model).count() == 0
    only = quality_classifier.train(docs, labels.where("quality = 1"), calibration_share=0.0)
    assert {round(r["score"], 6) for r in quality_classifier.score_documents(docs, only).collect()} == {round(3 / 4, 6)}
    nothing = quality_classifier.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score_documents(docs, nothing).collect()} == {0.5}


def test_the_sieve_keeps_every_known_key(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("t"), F.lit(1).alias("_z"))
    known = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    for bits, most in ((26, 730), (16, 800)):
        monkeypatch.setattr(quality_classifier, "SIEVE_BITS", bits)
        left = quality_classifier._sieve(rows, known)
        assert left.columns == rows.columns and left.join(known, "k").count() == known.count() <= left.count() <= most
    assert quality_classifier._sieve(rows, known.where("false")).count() == 0


def test_classifier_on_held_out_documents(spark):
    folder = os.path.join(os.path.dirname(DATA), "sf0.01")
    folder = folder if os.path.isdir(folder) else DATA
    rows = queries.QUERIES["op12_quality_classifier"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in tested)
    assert right / len(tested) > 0.95
    assert np.mean([r["predicted"] for r in tested if truth[r["doc_id"]] == 1]) > 0.97


# -- 13 ranked search


def brute_search(docs, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, b) for k, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, have in wanted.items():
        scored = []
        for k, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in have if bag[t])
            if score > 0:
                scored.append((-score, k is not None, k or 0))
        out += [(i, r, k if known else None, -s) for r, (s, known, k) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("top,cells,block", [(50, 1 << 21, 1 << 18), (3, 400, 40)])
def test_search_equals_brute_force(spark, make, corpus, monkeypatch, top, cells, block):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    items = [(i, t) for i, t in corpus[10:40:3]] + [(7, "The THE the"), (7, "12 é"), (8, None), (9, "--"), (None, "the 12"), (11, "nowhere at-all zzz")]
    table = spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, rank int, term int")
    got = lexical_search.search(make(corpus), table, top).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == Counter(brute_search(corpus, items, top))


def test_search_of_nothing(spark, make):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    for docs, some in ((make([]), items), (make([(1, None), (2, "-")]), items), (make([(1, "the")]), items.where("false"))):
        found = lexical_search.search(docs, some)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_shared_sets_are_summed_once():
    rng = random.Random(8)
    common = rng.sample(range(200), 20)
    items = [sorted({*common, *rng.sample(range(200), 5)}) for _ in range(60)] + [[3], [3, 4]]
    plan = lexical_search.share_terms([list(i) for i in items], 200)
    weights = np.random.default_rng(1).integers(0, 1000, size=(200, 7))
    assert (plan.scores(weights) == np.array([weights[i].sum(axis=0) for i in items])).all()
    additions = sum(len(a) for a, _ in plan.levels) + len(plan.nodes) - len(items)
    assert additions < 0.5 * sum(len(i) - 1 for i in items)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_ranked_search"])
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
