"""Reshaping, JSON, digests, scalar functions and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.registry import query
from vitalspan.functions import dates as D
from vitalspan.functions import scalars as S
from vitalspan.operators import reshape as R
from vitalspan.session import scratch_path

_WIDE = ["l_quantity", "l_discount", "l_tax"]


@query("melt", "l_returnflag:s variable:s n:l total:f", " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, count(*) AS n, sum({c}) AS total FROM lineitem GROUP BY 1" for c in _WIDE))
def _(cdm):
    long = R.melt(cdm.lineitem.select("l_returnflag", *_WIDE), ["l_returnflag"], _WIDE)
    return long.groupBy("l_returnflag", "variable").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


_TYPES = ("error", "click", "view", "signup", "purchase")


@query("dcast", "user_id:l error:f click:f view:f signup:f purchase:f", "SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def _(cdm):
    return R.dcast(cdm.events.select("user_id", "event_type", "value"), ["user_id"], "event_type", _TYPES, F.sum("value"))


@query("colsplit", "n:l level:s name:s", "SELECT split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS name, count(*) AS n FROM orders GROUP BY 1, 2")
def _(cdm):
    return R.colsplit(cdm.orders.select("o_orderpriority"), "o_orderpriority", "-", ["level", "name"]).groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"))


@query("json_flatten", "event_id:l k:l inner_v:f inner_deep_t:s", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS inner_v, event_type AS inner_deep_t FROM events")
def _(cdm):
    nested = cdm.events.select(
        "event_id", F.from_json("props", "struct<k: long>").alias("p"),
        F.struct(F.col("value").alias("v"), F.struct(F.col("event_type").alias("t")).alias("deep")).alias("inner"))
    flat = R.flatten(nested, "_")
    return flat.withColumnRenamed("p_k", "k")


PAGES = ("click", "error", "purchase", "signup", "view")


@query(
    "json_pages", "page:l user_id:l " + " ".join(f"{p}s:l" for p in PAGES),
    " UNION ALL ".join(
        f"SELECT {i} AS page, user_id, " + ", ".join(f"{'count(*)' if p == kind else 'CAST(NULL AS BIGINT)'} AS {p}s" for p in PAGES) + f" FROM events WHERE event_type = '{kind}' GROUP BY user_id"
        for i, kind in enumerate(PAGES)),
)
def _(cdm):
    """Each kind of event is a page with a column of its own."""
    from vitalspan.operators.sets import bind_rows

    def page(i, kind):
        return cdm.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(
            F.count(F.lit(1)).alias(f"{kind}s")).withColumn("page", F.lit(i))

    return bind_rows([page(i, kind) for i, kind in enumerate(PAGES)])


@query("ndjson_in_out", "event_id:l user_id:l event_type:s value:f", "SELECT event_id, user_id, event_type, value FROM events")
def _(cdm):
    path = scratch_path(cdm.spark, "events-json")
    cdm.events.select("event_id", "user_id", "event_type", "value").write.option("compression", "gzip").json(path)
    return cdm.spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)


@query("json_parse", "event_id:l k:l", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(cdm):
    return cdm.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("json_emit", "user_id:l text:s", """SELECT user_id, '{"user":' || user_id || ',"events":' || count(*) || '}' AS text FROM events GROUP BY 1""")
def _(cdm):
    counts = cdm.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return counts.select("user_id", F.to_json(F.struct(F.col("user_id").alias("user"), "events")).alias("text"))


@query("json_valid", "valid:b rows:l", "SELECT event_id % 3 <> 0 AS valid, count(*) AS rows FROM events GROUP BY 1")
def _(cdm):
    # Every third text loses its closing brace.
    broken = cdm.events.select(F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("props"))
    return broken.groupBy(R.json_valid("props").alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


@query("json_array_rows", "o_custkey:l pos:l key:l price:f extra:s", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price, CAST(NULL AS VARCHAR) AS extra FROM orders")
def _(cdm):
    big = cdm.orders.select(
        "o_custkey", F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price")).alias("o"))
    # Arrays hold at most 50 objects, so a hot customer becomes many documents.
    chunks = R.chop(big.select("o_custkey", F.col("o.key").alias("key")), "o_custkey", "key", 50).select(
        "o_custkey", "chunk", F.explode("members").alias("key"))
    arrays = big.select("o_custkey", "o", F.col("o.key").alias("key")).join(chunks, ["o_custkey", "key"]).groupBy(
        "o_custkey", "chunk").agg(F.to_json(F.sort_array(F.collect_list("o"))).alias("doc"))
    rows = R.json_rows(arrays, "doc", "key: long, price: double, extra: string", ["o_custkey", "chunk"])
    return rows.withColumn("pos", F.col("pos") + 50 * F.col("chunk"))


@query("group_id", "c_custkey:l group_id:l", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS group_id FROM customer")
def _(cdm):
    return R.group_ids(cdm.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "group_rle", "user_id:l run_id:l event_type:s length:l",
    """SELECT user_id, run_id, any_value(event_type) AS event_type, count(*) AS length FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id
       FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY 1, 2""",
)
def _(cdm):
    return R.run_lengths(cdm.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("duplicate_id", "doc_id:l first_id:l", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def _(cdm):
    from vitalspan.operators.sets import duplicate_first_id
    digests = cdm.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return duplicate_first_id(digests, ["digest"], "doc_id")


@query("row_digest", "s_suppkey:l md5:s sha256:s", "SELECT s_suppkey, md5(s_suppkey || chr(31) || s_name) AS md5, sha256(s_suppkey || chr(31) || s_name) AS sha256 FROM supplier")
def _(cdm):
    d = R.digest_columns(["s_suppkey", "s_name"])
    return cdm.supplier.select("s_suppkey", d["md5"].alias("md5"), d["sha256"].alias("sha256"))


@query("vec_chop", "o_custkey:l chunk:l members:s", "SELECT o_custkey, (rn - 1) // 4 AS chunk, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1, 2")
def _(cdm):
    chunks = R.chop(cdm.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)
    return chunks.withColumn("members", F.array_join(F.transform("members", lambda v: v.cast("string")), ","))


@query("complete_rows", "measurement_concept_id:l n:l", "SELECT measurement_concept_id, count(*) AS n FROM measurement WHERE value_as_number IS NOT NULL AND range_high IS NOT NULL AND range_low IS NOT NULL GROUP BY 1")
def _(cdm):
    return cdm.measurement.dropna(subset=["value_as_number", "range_high", "range_low"]).groupBy("measurement_concept_id").agg(F.count(F.lit(1)).alias("n"))


@query("interleave", "position:l label:s", "SELECT n_nationkey * 2 AS position, n_name AS label FROM nation UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier")
def _(cdm):
    return R.interleave([
        cdm.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label")),
        cdm.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))], "id")


@query("rep", "s_suppkey:l copy:l", "SELECT s_suppkey, copy FROM supplier, range(1, 6) t(copy) WHERE copy <= 1 + s_suppkey % 5")
def _(cdm):
    return R.repeat_rows(cdm.supplier.select("s_suppkey"), 1 + F.col("s_suppkey") % 5)


# --- scalar function families ---------------------------------------------------
_D = "CAST(o_orderdate AS DATE)"


@query(
    "scalar_date", "o_orderkey:l plus_day:d plus_month:d plus_year:d month_end:d built:d y:l m:l d:l diff:l quarter:l week:l days_in_month:l leap:b decimal:f floor_month:d ceiling_month:d round_month:d inside:b",
    f"""SELECT o_orderkey, {_D} + 10 AS plus_day, CAST({_D} + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST({_D} + INTERVAL 12 MONTH AS DATE) AS plus_year, last_day({_D}) AS month_end,
      make_date(year({_D}), month({_D}), 1 + o_orderkey % 28) AS built, year({_D}) AS y, month({_D}) AS m, day({_D}) AS d, date_diff('day', DATE '1995-01-01', {_D}) AS diff, quarter({_D}) AS quarter, weekofyear({_D}) AS week,
      day(last_day({_D})) AS days_in_month, (year({_D}) % 4 = 0 AND year({_D}) % 100 <> 0) OR year({_D}) % 400 = 0 AS leap,
      year({_D}) + (dayofyear({_D}) - 1) / CASE WHEN (year({_D}) % 4 = 0 AND year({_D}) % 100 <> 0) OR year({_D}) % 400 = 0 THEN 366.0 ELSE 365.0 END AS decimal, CAST(date_trunc('month', {_D}) AS DATE) AS floor_month,
      CASE WHEN day({_D}) = 1 THEN {_D} ELSE last_day({_D}) + 1 END AS ceiling_month, CASE WHEN day({_D}) - 1 < day(last_day({_D})) - day({_D}) + 1 THEN CAST(date_trunc('month', {_D}) AS DATE) ELSE last_day({_D}) + 1 END AS round_month,
      {_D} BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AS inside FROM orders""",
)
def _(cdm):
    o = cdm.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.select(
        "o_orderkey", S.dateadd("day", 10, "day").alias("plus_day"), S.dateadd("month", 1, "day").alias("plus_month"),
        S.dateadd("year", 1, "day").alias("plus_year"), S.eomonth("day").alias("month_end"),
        S.datefromparts(F.year("day"), F.month("day"), 1 + F.col("o_orderkey") % 28).alias("built"),
        F.year("day").alias("y"), F.month("day").alias("m"), F.dayofmonth("day").alias("d"),
        D.days_between(F.lit("1995-01-01").cast("date"), "day").alias("diff"), F.quarter("day").alias("quarter"),
        F.weekofyear("day").alias("week"), D.days_in_month("day").alias("days_in_month"), D.is_leap_year("day").alias("leap"),
        D.decimal_year("day").alias("decimal"), F.trunc("day", "MM").alias("floor_month"), D.ceiling_month("day").alias("ceiling_month"),
        D.round_to_month("day").alias("round_month"),
        D.within("day", F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date")).alias("inside"))


@query(
    "scalar_math", "s_suppkey:l a:f b:f c:f e:f fl:l ce:l lo:f l10:f pw:f rt:f sq:f s:f co:f ta:f ac:f asn:f atn:f ro:f",
    """SELECT s_suppkey, abs(s_acctbal) AS a, s_acctbal / pi() AS b, exp(s_acctbal / 10000) AS c, exp(1.0) AS e, floor(s_acctbal) AS fl, ceil(s_acctbal) AS ce, ln(abs(s_acctbal) + 1) AS lo, log10(abs(s_acctbal) + 1) AS l10,
       power(s_acctbal / 1000, 3) AS pw, sqrt(abs(s_acctbal)) AS rt, s_acctbal * s_acctbal AS sq, sin(s_acctbal) AS s, cos(s_acctbal) AS co, tan(s_acctbal / 10000) AS ta, acos(s_acctbal / 20000) AS ac, asin(s_acctbal / 20000) AS asn, atan(s_acctbal) AS atn, round(s_acctbal, 1) AS ro FROM supplier""",
)
def _(cdm):
    x = F.col("s_acctbal")
    return cdm.supplier.select(
        "s_suppkey", F.abs(x).alias("a"), (x / F.pi()).alias("b"), F.exp(x / 10000).alias("c"), F.e().alias("e"), F.floor(x).alias("fl"),
        F.ceil(x).alias("ce"), F.log(F.abs(x) + 1).alias("lo"), F.log10(F.abs(x) + 1).alias("l10"), F.pow(x / 1000, F.lit(3.0)).alias("pw"),
        F.sqrt(F.abs(x)).alias("rt"), S.square(x).alias("sq"), F.sin(x).alias("s"), F.cos(x).alias("co"), F.tan(x / 10000).alias("ta"),
        F.acos(x / 20000).alias("ac"), F.asin(x / 20000).alias("asn"), F.atan(x).alias("atn"), F.round(x, 1).alias("ro"))


@query(
    "scalar_string", "c_custkey:l idx:l cat:s l:s r:s n:l lo:s up:s lt:s rt:s h:s h256:s",
    """SELECT c_custkey, strpos(c_name, '#') AS idx, c_name || '/' || c_mktsegment AS cat, left(c_name, 4) AS l, right(c_name, 3) AS r, length(c_name) AS n, lower(c_name) AS lo, upper(c_name) AS up,
       ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, md5(c_name) AS h, sha256(c_name) AS h256 FROM customer""",
)
def _(cdm):
    c = F.col("c_name")
    return cdm.customer.select(
        "c_custkey", S.charindex("#", "c_name").alias("idx"), F.concat(c, F.lit("/"), F.col("c_mktsegment")).alias("cat"),
        F.left(c, F.lit(4)).alias("l"), F.right(c, F.lit(3)).alias("r"), F.length(c).alias("n"), F.lower(c).alias("lo"),
        F.upper(c).alias("up"), F.ltrim(F.concat(F.lit("  "), c)).alias("lt"), F.rtrim(F.concat(c, F.lit("  "))).alias("rt"),
        F.md5(c).alias("h"), F.sha2(c, 256).alias("h256"))


@query(
    "scalar_null_cast", "event_id:l filled:f numeric:b as_int:l nullified:f first:f",
    """SELECT event_id, COALESCE(CASE WHEN event_type = 'view' THEN value END, 0) AS filled, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) IS NOT NULL AS numeric,
       CAST(floor(value) AS BIGINT) AS as_int, NULLIF(event_id % 5, 0) AS nullified, COALESCE(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN -value END, 1) AS first FROM events""",
)
def _(cdm):
    t, v = F.col("event_type"), F.col("value")
    e = cdm.events.withColumn("text", F.when(F.col("event_id") % 2 == 0, t).otherwise(v.cast("string")))
    return e.select(
        "event_id", F.coalesce(F.when(t == "view", v), F.lit(0.0)).alias("filled"), S.isnumeric("text").alias("numeric"),
        F.floor(v).alias("as_int"), F.nullif(F.col("event_id") % 5, F.lit(0)).alias("nullified"),
        F.coalesce(F.when(t == "click", v), F.when(t == "view", -v), F.lit(1.0)).alias("first"))


@query(
    "scalar_aggregate", "l_returnflag:s l_linestatus:s n:l avg_q:f sum_q:f min_q:f max_q:f sd_q:f var_q:f",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS avg_q, sum(l_quantity) AS sum_q, min(l_quantity) AS min_q, max(l_quantity) AS max_q, stddev_samp(l_quantity) AS sd_q, var_samp(l_quantity) AS var_q FROM lineitem GROUP BY 1, 2",
)
def _(cdm):
    q = F.col("l_quantity")
    return cdm.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg(q).alias("avg_q"), F.sum(q).alias("sum_q"), F.min(q).alias("min_q"),
        F.max(q).alias("max_q"), F.stddev_samp(q).alias("sd_q"), F.var_samp(q).alias("var_q"))


@query(
    "calendar_features", "event_id:l year:l month:l weekday:l hour:l month_sin:f month_cos:f hour_sin:f hour_cos:f local_hour:l",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, dayofweek(ts) AS weekday, hour(ts) AS hour, sin(month(ts) * 2 * pi() / 12) AS month_sin, cos(month(ts) * 2 * pi() / 12) AS month_cos,
       sin(hour(ts) * 2 * pi() / 24) AS hour_sin, cos(hour(ts) * 2 * pi() / 24) AS hour_cos, hour(ts + INTERVAL 9 HOUR) AS local_hour FROM events""",
)
def _(cdm):
    ts = F.col("ts").cast("timestamp")
    ms, mc = D.cyclic(F.month(ts), 12)
    hs, hc = D.cyclic(F.hour(ts), 24)
    return cdm.events.select(
        "event_id", F.year(ts).alias("year"), F.month(ts).alias("month"), (F.dayofweek(ts) - 1).alias("weekday"), F.hour(ts).alias("hour"),
        ms.alias("month_sin"), mc.alias("month_cos"), hs.alias("hour_sin"), hc.alias("hour_cos"),
        F.hour(S.with_tz(ts, "Asia/Seoul")).alias("local_hour"))


@query(
    "text_profile", "lang:s documents:l distinct_texts:l empty:l min_chars:l max_chars:l mean_chars:f lines:l digits:l urls:l",
    r"""SELECT lang, count(*) AS documents, count(DISTINCT text) AS distinct_texts, sum((length(trim(text)) = 0)::INT) AS empty, min(length(text)) AS min_chars, max(length(text)) AS max_chars, avg(length(text)) AS mean_chars,
        sum(length(text) - length(replace(text, chr(10), '')) + 1) AS lines, sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS digits, sum(len(regexp_extract_all(text, 'https?://'))) AS urls FROM documents GROUP BY 1""",
)
def _(cdm):
    t = F.col("text")
    d = cdm.documents.select("lang", F.sha2(t, 256).alias("h"), F.length(t).alias("n"), F.length(F.trim(t)).alias("trimmed"),
                             (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).alias("line"),
                             F.length(F.regexp_replace(t, "[^0-9]", "")).alias("digit"), F.regexp_count(t, F.lit("https?://")).alias("url"))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("h").alias("distinct_texts"), F.sum((F.col("trimmed") == 0).cast("int")).alias("empty"),
        F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.avg("n").alias("mean_chars"), F.sum("line").alias("lines"),
        F.sum("digit").alias("digits"), F.sum("url").alias("urls"))


@query("dedup_by_digest", "digest:s copies:l first_id:l", "SELECT sha256(text || chr(31) || lang) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text, lang HAVING count(*) > 1")
def _(cdm):
    return R.duplicate_rows(cdm.documents, ["text", "lang"], "doc_id")


@query("recast", "event_type:s mean_value:f mean_amount:f", "SELECT event_type, avg(value) AS mean_value, avg(value * 2) AS mean_amount FROM events GROUP BY 1")
def _(cdm):
    wide = cdm.events.select("event_type", F.col("value").alias("mean_value"), (F.col("value") * 2).alias("mean_amount"))
    return R.dcast(R.melt(wide, ["event_type"], ["mean_value", "mean_amount"]), ["event_type"], "variable", ["mean_value", "mean_amount"], F.avg("value"))
