import datetime as dt
import random
import time

from pyspark.sql import functions as F

from vitalspan.operators.eras import drug_era, sub_exposures
from vitalspan.operators.intervals import collapse_intervals, collapse_twice, interval_difference, interval_intersection, interval_union
from vitalspan.operators.ranges import band_join, interval_counts, overlap_join, window_counts, without_earlier
from vitalspan import session
from vitalspan.catalog.registry import Query
from vitalspan.session import configure
from vitalspan.sources.derived import derived_cdm

DAY0 = dt.date(2000, 1, 1)


def day(n):
    return str(DAY0 + dt.timedelta(days=n))


def dated(frame, rows):
    """(key, start, end) with day numbers."""
    f = frame([(k, day(s), day(e)) for k, s, e in rows], "k long, s string, e string")
    return f.select("k", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))


def spans(df):
    return sorted((r.k, (r.s - DAY0).days, (r.e - DAY0).days) for r in df.collect())


def brute_collapse(rows, gap):
    out = []
    for k in sorted({r[0] for r in rows}):
        current = None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k and e >= s):
            if current and s <= current[1] + gap:
                current[1] = max(current[1], e)
            else:
                current = [s, e]
                out.append((k, current))
    return sorted((k, c[0], c[1]) for k, c in out)


def test_touching_intervals_merge(frame):
    rows = dated(frame, [(1, 1, 5), (1, 5, 9), (2, 1, 5), (2, 36, 40), (3, 1, 5), (3, 35, 40)])
    assert spans(collapse_intervals(rows, ["k"], "s", "e")) == [(1, 1, 9), (2, 1, 5), (2, 36, 40), (3, 1, 5), (3, 35, 40)]
    assert spans(collapse_intervals(rows, ["k"], "s", "e", 30)) == [(1, 1, 9), (2, 1, 5), (2, 36, 40), (3, 1, 40)]


def test_nested_interval_counts(frame):
    rows = dated(frame, [(1, 1, 50), (1, 10, 20)])
    got = collapse_intervals(rows, ["k"], "s", "e", count="n").first()
    assert ((got.e - DAY0).days, got.n) == (50, 2)


def test_reversed_rows_are_dropped(frame):
    assert spans(collapse_intervals(dated(frame, [(1, 9, 3), (1, 4, 5)]), ["k"], "s", "e")) == [(1, 4, 5)]


def test_random_against_brute_force_with_one_hot_key(frame):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        k = 1 if rng.random() < 0.4 else rng.randint(2, 30)
        s = rng.randint(0, 700)
        rows.append((k, s, s + rng.randint(0, 12)))
    for gap in (0, 30):
        once = collapse_intervals(dated(frame, rows), ["k"], "s", "e", gap)
        assert spans(once) == brute_collapse(rows, gap)
        assert spans(collapse_intervals(once, ["k"], "s", "e", gap)) == spans(once)


def test_two_levels_in_one_sweep(frame):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3, 4]), s, s + rng.randint(-1, 9)) for s in (rng.randint(0, 900) for _ in range(300))]
    rows += rows[:40]
    got = collapse_twice(dated(frame, rows), ["k"], "s", "e", 30, "n", "days")
    subs = brute_collapse(rows, 0)
    want = sorted(
        (k, s, e, sum(1 for m, a, b in rows if m == k and s <= a <= b <= e), sum(b - a for m, a, b in subs if m == k and s <= a <= e))
        for k, s, e in brute_collapse(rows, 30))
    assert sorted((r.k, (r.s - DAY0).days, (r.e - DAY0).days, r.n, r.days) for r in got.collect()) == want


def test_islands_are_not_hashed_after_the_sweep(frame, capsys):
    rows = dated(frame, [(1, 1, 5), (1, 40, 44)])
    for found in (collapse_intervals(rows, ["k"], "s", "e", 30, count="n"), collapse_twice(rows, ["k"], "s", "e", 30, "n", "days")):
        found.explain()
        text = capsys.readouterr().out
        assert text.count("Aggregate(") == 2 and text.count("Sort [") == 1 and text.count("Exchange") == 2


def test_shuffled_partitions_are_merged_to_a_small_size(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    try:
        for size, expected in (("64MB", "16m"), ("8m", "8m")):
            spark.conf.set(key, size)
            configure(spark)
            assert spark.conf.get(key) == expected
    finally:
        spark.conf.set(key, was)


def test_shuffles_start_with_more_partitions_for_larger_tables(spark, tmp_path, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    path = str(tmp_path / "orders.parquet")
    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(path)
    monkeypatch.setattr(session, "INPUT_BYTES", 100)
    try:
        derived_cdm(spark, str(tmp_path)).orders
        assert int(spark.conf.get(key)) > 40
        monkeypatch.setattr(session, "INPUT_BYTES", 1 << 30)
        spark.conf.unset(key)
        derived_cdm(spark, str(tmp_path)).orders
        assert spark.conf.get(key, None) is None
    finally:
        spark.conf.unset(key)


def test_record_tables_are_read_in_small_splits(spark, tmp_path, monkeypatch):
    key, cut = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    was = spark.conf.get(key)
    spark.range(400_000).selectExpr("xxhash64(id) AS o_orderkey", "id AS o_custkey").coalesce(1).write.option(
        "parquet.block.size", 1 << 18).parquet(str(tmp_path / "orders.parquet"))
    orders = Query("orders", (("o_orderkey", "l"),), lambda cdm: cdm.orders, None)
    monkeypatch.setattr(session, "SPLIT_MB", 1)
    try:
        spark.conf.set(cut, "1")
        found = orders.run(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 3 and found.count() == 400_000
    finally:
        spark.conf.unset(cut)
        spark.conf.set(key, was)


def test_tables_are_broadcast_by_measured_rows_only(spark, tmp_path):
    spark.range(600_000).selectExpr("xxhash64(id) AS o_orderkey", "xxhash64(-id) AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))

    def plan(cdm):
        some = cdm.orders.select("o_orderkey")
        return cdm.orders.join(some, "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))

    found = Query("orders", (("o_orderkey", "l"),), plan, None).run(spark, str(tmp_path))
    assert len(found.collect()) == 600_000
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_written_stages_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before = held()
    found = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before
    assert found.count() == 7
    assert spark.conf.get(key, None) == was


def test_interval_algebra_by_days(frame):
    rng = random.Random(3)

    def sample(n):
        return [(rng.randint(1, 3), s, s + rng.randint(0, 6)) for s in (rng.randint(0, 80) for _ in range(n))]

    a, b = sample(25), sample(25)

    def days(rows):
        return {(k, d) for k, s, e in rows for d in range(s, e + 1)}

    for fn, op in ((interval_union, set.union), (interval_intersection, set.intersection), (interval_difference, set.difference)):
        got = spans(fn(dated(frame, a), dated(frame, b), ["k"], "s", "e"))
        assert days(got) == op(days(a), days(b))
        assert all(not (x[0] == y[0] and x[2] + 1 == y[1]) for x, y in zip(got, got[1:], strict=False))


def test_sub_exposures_counts_repeats(frame):
    rows = dated(frame, [(1, 0, 3), (1, 0, 5), (1, 20, 21)]).select(
        F.col("k").alias("person_id"), F.lit(7).cast("long").alias("drug_concept_id"), F.col("s").alias("start_date"), F.col("e").alias("end_date"))
    got = sorted((r.drug_exposure_count, r.days_exposed) for r in sub_exposures(rows).collect())
    assert got == [(1, 1), (2, 5)]


def test_band_and_overlap_joins_match_brute_force(frame):
    rng = random.Random(11)
    left = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 400)) for _ in range(60)]
    right = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 400), rng.randint(0, 90)) for _ in range(60)]
    l = frame([(i, k, day(d - 60), day(d)) for i, (k, d) in enumerate(left)], "i long, k long, lo string, hi string").select(
        "i", "k", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    r = frame([(j, k, day(s), day(s + n)) for j, (k, s, n) in enumerate(right)], "j long, k long, a string, b string").select(
        "j", "k", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    band = sorted((x.i, x.j) for x in band_join(l, r, ["k"], "lo", "hi", "a", 60).collect())
    assert band == sorted((i, j) for i, (k, d) in enumerate(left) for j, (m, s, _) in enumerate(right) if k == m and d - 60 <= s <= d)
    over = sorted((x.i, x.j) for x in overlap_join(l, r, ["k"], "lo", "hi", "a", "b", 61).collect())
    assert over == sorted(
        (i, j) for i, (k, d) in enumerate(left) for j, (m, s, n) in enumerate(right) if k == m and s <= d and s + n >= d - 60)


def test_window_counts_and_anti(frame):
    events = frame([(1, day(100)), (1, day(200)), (2, day(100))], "k long, at string").select("k", F.col("at").cast("date").alias("at"))
    records = frame([(1, day(d), v) for d, v in ((40, 1), (40, 9), (39, 9), (100, 5), (101, 5))], "k long, d string, v int").select(
        "k", F.col("d").cast("date").alias("d"), "v")
    got = {(r.k, (r.at - DAY0).days): (r.n, r.big) for r in window_counts(
        events, records, ["k"], "at", "d", -60, 0, {"n": F.lit(True), "big": F.col("v") > 4}).collect()}
    assert got == {(1, 100): (3, 2), (1, 200): (0, 0), (2, 100): (0, 0)}
    kept = without_earlier(events, records, ["k"], "d", F.date_sub("at", 60))
    assert sorted((r.k, (r.at - DAY0).days) for r in kept.collect()) == [(2, 100)]


def test_interval_counts_match_brute_force(frame):
    rng = random.Random(21)
    spans_ = [(rng.choice([1, 1, 2, 3]), s, s + rng.choice([0, 5, 400])) for s in (rng.randint(0, 300) for _ in range(60))]
    points = [(rng.choice([1, 1, 2, 4]), rng.randint(0, 500)) for _ in range(150)]
    w = dated(frame, spans_)
    p = frame([(k, day(d)) for k, d in points], "k long, d string").select("k", F.col("d").cast("date").alias("d"))
    got = {(r.k, (r.s - DAY0).days, (r.e - DAY0).days): (r.n, r["first"] and (r["first"] - DAY0).days)
           for r in interval_counts(w, p, ["k"], "s", "e", "d").collect()}
    for k, s, e in spans_:
        inside = sorted(d for m, d in points if m == k and s <= d <= e)
        assert got[(k, s, e)] == (len(inside), inside[0] if inside else None)


def test_long_intervals_meet_every_partner_once_and_are_not_spread(spark):
    rng = random.Random(11)
    day = dt.date(2000, 1, 1)

    def rows(n, base):
        out = []
        for i in range(n):
            a = day + dt.timedelta(rng.randrange(4000))
            out.append((base + i, i % 5, a, dt.date(2099, 12, 31) if i % 7 == 0 else a + dt.timedelta(rng.choice([0, 5, 60, 400, 3000]))))
        return out

    left, right = rows(120, 0), rows(150, 1000)
    l = spark.createDataFrame(left, "lid long, person_id long, lo date, hi date")
    r = spark.createDataFrame(right, "rid long, person_id long, s date, e date")
    got = sorted((x.lid, x.rid) for x in overlap_join(l, r, ["person_id"], "lo", "hi", "s", "e", 31).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and b[2] <= a[3] and b[3] >= a[2])


def test_window_counts_shuffle_events_as_they_are(frame):
    rng = random.Random(12)

    def some(n):
        return None if rng.random() < 0.05 else day(n)

    events = [(rng.choice([1, 2, 3, None]), some(rng.randint(0, 200)), some(0), some(rng.randint(150, 220))) for _ in range(60)]
    records = [(rng.choice([1, 2, None]), some(rng.randint(-20, 240)), rng.randint(1, 3)) for _ in range(300)]
    left = frame([*events, *events[:5]], "k long, at string, a string, z string").selectExpr("k", "date(at) AS at", "date(a) AS a", "date(z) AS z")
    right = frame(records, "k long, d string, c long").selectExpr("k", "date(d) AS d", "c")

    def expected(e, lo, hi, clipped):
        k, at, a, z = e
        if at is None or clipped and None in (a, z):
            return 0, 0
        first, last = (str(dt.date.fromisoformat(at) + dt.timedelta(days=n)) for n in (lo, hi))
        if clipped:
            first, last = max(first, a), min(last, z)
        found = [c for q, d, c in records if q is not None and q == k and d is not None and first <= d <= last]
        return len(found), found.count(2)

    for lo, hi in ((-30, 0), (-7, 7), (0, 0)):
        for bounds in (None, ("a", "z")):
            got = window_counts(left, right, ["k"], "at", "d", lo, hi, {"n": F.lit(True), "two": F.col("c") == 2}, bounds)
            want = [(*e, *expected(e, lo, hi, bounds)) for e in [*events, *events[:5]]]
            assert sorted(map(str, ((r.k, r.at and str(r.at), r.a and str(r.a), r.z and str(r.z), r.n, r.two) for r in got.collect()))) == sorted(map(str, want))
            assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_eras_are_swept_from_written_exposures(frame):
    exposure = frame([(1, 21, day(0), day(5), 5), (1, 21, day(20), day(25), 5), (2, 21, day(0), None, 3), (2, 99, day(0), None, 3)],
                     "person_id long, drug_concept_id long, s string, e string, days_supply long").selectExpr(
        "person_id", "drug_concept_id", "date(s) AS drug_exposure_start_date", "date(e) AS drug_exposure_end_date", "days_supply")
    concept = frame([(7, "RxNorm", "Ingredient")], "concept_id long, vocabulary_id string, concept_class_id string")
    links = frame([(7, 21)], "ancestor_concept_id long, descendant_concept_id long")
    eras = drug_era(exposure, concept, links)
    assert "Join" not in eras._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.person_id, r.drug_concept_id, str(r.drug_era_start_date), r.drug_exposure_count) for r in eras.collect()) == [
        (1, 7, day(0), 2), (2, 7, day(0), 1)]
