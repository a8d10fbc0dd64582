import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalspan.operators import ranks as R
from vitalspan.operators import summaries
from vitalspan.operators.ranks import hash_order
from vitalspan.operators.sampling import hashed_sample, portable_order, stable_sample
from vitalspan.operators.summaries import continuous_summary, discrete_percentiles, middle_value, nonmissing_summary


def sample(frame, n=400, seed=5):
    rng = random.Random(seed)
    return frame(
        [(i, 0 if rng.random() < 0.4 else rng.randint(1, 5), rng.choice([-2.5, -1.0, 0.0, 0.001, 0.5, 3.0, 1e6, rng.random()]), rng.randint(-3, 3))
         for i in range(n)], "id long, g long, v double, c long")


def same(a, b, cols):
    assert sorted(tuple(r[c] for c in cols) for r in a.collect()) == sorted(tuple(r[c] for c in cols) for r in b.collect())


def test_row_numbers_equal_window(frame):
    df = sample(frame)
    for order in (["v", "id"], ["c", "id"], ["id"]):
        plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
        same(R.row_numbers(df, ["g"], order), plain, ["id", "rn"])
    plain = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")).cast("long"))
    same(R.row_numbers(df, [], ["v", "id"]), plain, ["id", "rn"])


def test_running_totals_equal_window(frame):
    counts = sample(frame).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for desc in (False, True):
        order = F.col("v").desc() if desc else F.col("v")
        plain = counts.withColumn("cum_n", F.sum("n").over(Window.partitionBy("g").orderBy(order)))
        same(R.running_totals(counts, ["g"], "v", ["n"], desc), plain, ["g", "v", "cum_n"])


def test_order_bucket_is_monotone(frame):
    values = sorted([float("-inf"), float("inf"), -1e9, -1.0, -1e-12, 0.0, 1e-300, 1e-9, 0.1, 0.1000001, 1.0, 1.5, 2.0, 1e9])
    df = frame([(str(v),) for v in values], "v string").select(F.col("v").cast("double").alias("v"))
    df = df.unionByName(frame([(None,)], "v double")).unionByName(frame([("NaN",)], "v string").select(F.col("v").cast("double").alias("v")))
    got = [r.b for r in df.withColumn("b", R.order_bucket(df, "v")).orderBy("v").collect()]
    assert got == sorted(got) and len(got) == len(values) + 2


def test_text_ids_follow_value_order(frame):
    names = [f"Customer#{i % 70:04d}" for i in range(200)]
    ids = {r.name: r.nid for r in R.dense_ids(frame([(n,) for n in names], "name string"), "name", "nid").collect()}
    assert ids == {n: i + 1 for i, n in enumerate(sorted(set(names)))}


def test_first_per_key_and_runs(frame):
    df = sample(frame, 200)
    w = Window.partitionBy("g").orderBy("v", "id")
    plain = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    same(R.first_per_key(df, ["g"], ["v", "id"]), plain, ["g", "id", "v"])
    ordered = Window.partitionBy("g").orderBy("id")
    flag = F.when(F.col("c") == F.lag("c").over(ordered), 0).otherwise(1)
    plain = df.withColumn("f", flag).withColumn("run_id", F.sum("f").over(ordered).cast("long"))
    same(R.identify_runs(df, ["g"], ["id"], "c"), plain, ["id", "run_id"])
    plain = df.withColumn("m", F.max("v").over(ordered))
    same(R.running_max(df, ["g"], ["id"], "v", "m"), plain, ["id", "m"])


def test_fill_missing_both_ways(frame):
    df = sample(frame, 200).withColumn("x", F.when(F.col("c") == 0, F.col("v")))
    w = Window.partitionBy("g").orderBy("id")
    down = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))

    def key(d, c):
        return sorted((r.id, -99.0 if r[c] is None else r[c]) for r in d.collect())

    assert key(R.fill_missing(df, ["g"], ["id"], "x", "y"), "y") == key(df.withColumn("y", down), "y")
    assert key(R.fill_missing(df, ["g"], ["id"], "x", "y", True), "y") == key(df.withColumn("y", up), "y")


def test_zero_filled_percentiles(frame):
    values = frame([(1, v) for v in (2, 4, 4, 9)], "g long, value long")
    size = frame([(1, 10)], "g long, population_size long")
    r = continuous_summary(values, size, ["g"], ["g"]).first()
    assert (r.p10_value, r.p25_value, r.median_value, r.p75_value, r.p90_value) == (0, 0, 0, 4, 4)
    assert (r.min_value, r.max_value, r.average_value, r.count_value) == (0, 9, 1.9, 4)


def test_single_value_has_zero_deviation(frame):
    r = nonmissing_summary(frame([(1, 5.0)], "g long, value double"), ["g"]).first()
    assert (r.standard_deviation, r.median_value, r.min_value) == (0, 5, 5)


def test_percentiles_and_median(frame):
    df = frame([(1, float(v)) for v in (1, 2, 3, 4)], "g long, v double")
    r = discrete_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.51}).first()
    assert (r.a, r.b, r.c) == (1, 2, 3)
    assert middle_value(df, ["g"], "v", "m").first().m == 2.5


def test_samples_follow_the_plain_order(frame):
    df = sample(frame).withColumn("d", F.date_add(F.lit("2001-03-04").cast("date"), F.col("id").cast("int")))
    big = df.withColumn("id", F.col("id") + 10**14)
    for n in (0, 1, 37, 399, 400, 1000):
        want = {r.id for r in df.orderBy(portable_order("id", "d"), "id", "d").limit(n).collect()}
        assert {r.id for r in stable_sample(df, "id", "d", n).collect()} == want
        want = {r.id for r in df.orderBy(hash_order("id", seed=3), "id").limit(n).collect()}
        assert {r.id for r in hashed_sample(df, "id", n, 3).collect()} == want
        assert stable_sample(big, "id", "d", n).count() == min(n, 400)


def test_large_ids_spread_over_many_buckets(spark):
    for start in (0, 10**12, -10**12):
        ids = spark.range(start, start + 200_000)
        sizes = ids.groupBy(R.order_bucket(ids, "id")).count()
        assert sizes.agg(F.max("count")).first()[0] <= 4096
    ids = spark.range(0, 3000).select((F.col("id") * 10**13 - 10**16).alias("id"))
    got = [r.rn for r in R.row_numbers(ids, [], ["id"]).orderBy("id").collect()]
    assert got == list(range(1, 3001))
    down = R.running_totals(ids.withColumn("n", F.lit(1)), [], "id", ["n"], descending=True)
    assert [r.cum_n for r in down.orderBy(F.desc("id")).collect()] == list(range(1, 3001))


def test_samples_are_nested(frame):
    df = sample(frame).withColumn("d", F.date_add(F.lit("2001-03-04").cast("date"), F.col("id").cast("int")))
    for take in (lambda n: hashed_sample(df, "id", n, 3), lambda n: stable_sample(df, "id", "d", n)):
        small, large = ({r.id for r in take(n).collect()} for n in (20, 21))
        assert len(small) == 20 and len(large) == 21 and small < large


def test_medians_of_two_columns_take_one_pass(frame):
    rows = sample(frame, 300).selectExpr("id", "g", "IF(id % 7 = 0, NULL, v) AS v", "c", "1 + id % 3 AS n")
    rows = rows.unionByName(frame([(900, 9, None, 1, 2), (901, None, 1.0, 1, 2)], "id long, g long, v double, c long, n long"))
    spread = rows.collect()

    def middle(g, name):
        found = sorted(r[name] for r in spread if r.g == g and r[name] is not None for _ in range(r.n))
        return (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2

    expected = sorted((g, middle(g, "v"), middle(g, "c")) for g in range(6))
    for most in (1 << 20, 60, 0):
        before = summaries.GROUP_ROWS
        summaries.GROUP_ROWS = most
        try:
            got = summaries.middle_values(rows, ["g"], {"a": "v", "b": "c"}, "n")
        finally:
            summaries.GROUP_ROWS = before
        assert sorted(map(tuple, got.collect())) == expected
        if most == 1 << 20:
            assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert summaries.middle_values(rows, [], {"a": "c"}, "n").first().a == sorted(
        r.c for r in spread for _ in range(r.n))[sum(r.n for r in spread) // 2]


def test_first_row_sends_columns_of_the_order_once(frame):
    df = sample(frame, 200)
    found = R.first_per_key(df, ["g"], ["v", F.col("c") + 1, "id"])
    assert found.columns == ["g", "id", "v", "c"]
    w = Window.partitionBy("g").orderBy("v", "c", "id")
    same(found, df.withColumn("rn", F.row_number().over(w)).filter("rn = 1"), ["g", "id", "v", "c"])
    last = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id").desc())
    same(R.first_per_key(df, ["g"], ["v", "id"], descending=True), df.withColumn("rn", F.row_number().over(last)).filter("rn = 1"), ["g", "id", "v", "c"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_r0" in plan and "_r1" not in plan and "_row" not in plan
