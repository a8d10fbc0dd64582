"""Record tables derived from the star-schema Parquet tables.

Customers act as people, orders as visits and diagnoses, line items as drug
exposures, measurements and procedures. The small vocabulary is derived from
``part``, ``nation`` and ``region`` plus the code ranges below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.operators.eras import condition_eras, drug_era
from vitalspan.plans import params as P
from vitalspan.session import literal_frame, materialize, size_shuffles
from vitalspan.sources.cdm import Cdm

RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
RAW_TABLES = tuple(RAW_SCHEMAS)
VOCABULARY = ("concept", "concept_ancestor", "concept_relationship")

# Ingredient concept and name for each part brand number 1..25.
INGREDIENTS = (
    (1, 1367500, "losartan"), (2, 1150345, "meloxicam"), (3, 1308842, "valsartan"), (4, 1125315, "acetaminophen"),
    (5, 1115008, "naproxen"), (6, 19124477, "lithium"), (7, 1118084, "celecoxib"), (8, 1124300, "diclofenac"),
    (9, 1310149, "warfarin"), (10, 1342439, "trandolapril"), (11, 1334456, "ramipril"), (12, 1000012, "azilsartan"),
    (13, 1000013, "candesartan"), (14, 1000014, "eprosartan"), (15, 1000015, "fimasartan"),
    (16, 1000016, "irbesartan"), (17, 1000017, "olmesartan"), (18, 1000018, "telmisartan"),
    (19, 1000019, "amphotericin b"), (20, 1000020, "vancomycin"), (21, 1000021, "cisplatin"),
    (22, 1000022, "acyclovir"), (23, 1000023, "ibuprofen"), (24, 1000024, "ketoprofen"), (25, 1000025, "piroxicam"),
)
LABS = (P.AST, P.ALT, P.BILIRUBIN, P.ALP, P.CREATININE)
ATC_CODES = ("A", "B01", "C02A", "D03AA", "E04", "F05BA01")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def clinical_links() -> list[tuple[int, int]]:
    """(ancestor concept, condition number) pairs: every ancestor a shipped
    parameter set names covers two of the 25 conditions, by a fixed rule."""
    ancestors: list[int] = []
    for spec in (P.CHARLSON, P.CHADS2, P.CHADS2VASC):
        for row in spec:
            ancestors += list(row[3])
            if len(row) > 4:
                ancestors += list(row[4])
    ancestors += [P.TYPE_2_DIABETES, P.ATRIAL_FIBRILLATION, *P.STROKE_ANCESTORS, P.ANGIOEDEMA]
    seen = list(dict.fromkeys(ancestors))
    return [(a, (i * 7 + j * 3) % 25) for i, a in enumerate(seen) for j in (0, 1)]


def _person(cdm: Cdm) -> DataFrame:
    c, n = cdm.customer, cdm.nation
    key = F.col("c_custkey")
    ethnicity = F.lit(0)
    for i, s in enumerate(SEGMENTS):
        if s != "HOUSEHOLD":
            ethnicity = F.when(F.col("c_mktsegment") == s, i + 1).otherwise(ethnicity)
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("person_id"),
        F.when(key % 2 == 0, P.MALE).otherwise(P.FEMALE).cast("long").alias("gender_concept_id"),
        (1912 + key % 80).alias("year_of_birth"),
        (1 + key % 12).alias("month_of_birth"),
        (1 + key % 28).alias("day_of_birth"),
        (100 + F.col("n_regionkey")).cast("long").alias("race_concept_id"),
        ethnicity.cast("long").alias("ethnicity_concept_id"),
    )


def _observation_period(cdm: Cdm) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return cdm.orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min(d).alias("observation_period_start_date"),
        F.date_add(F.max(d), 90).alias("observation_period_end_date"),
    )


def _lines(cdm: Cdm, lines: DataFrame, *columns: Column) -> DataFrame:
    """Columns of line items with the person of their order. They are worked
    out before the join, which then shuffles less than what they are made of."""
    orders = cdm.orders.select("o_orderkey", F.col("o_custkey").alias("person_id"))
    made = lines.select(F.col("l_orderkey").alias("o_orderkey"), *columns)
    return made.join(orders, "o_orderkey")


def _drug_exposure(cdm: Cdm) -> DataFrame:
    ship = F.col("l_shipdate").cast("date")
    return _lines(
        cdm, cdm.lineitem,
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), F.lit(0))
        .otherwise(2000000 + F.col("l_partkey")).cast("long").alias("drug_concept_id"),
        ship.alias("drug_exposure_start_date"),
        F.when(F.col("l_linestatus") != "O", F.date_add(ship, 5 * F.col("l_linenumber"))).alias(
            "drug_exposure_end_date"
        ),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("long")).alias("days_supply"),
    ).select("person_id", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date", "days_supply")


def _visit_occurrence(cdm: Cdm) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    concept = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 9203).when(F.col("o_orderpriority") == "2-HIGH", 9201)
        .when(F.col("o_orderpriority") == "3-MEDIUM", 9202).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 262)
        .otherwise(581477)
    )
    return cdm.orders.select(
        F.col("o_orderkey").alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id"),
        concept.cast("long").alias("visit_concept_id"), d.alias("visit_start_date"),
        F.date_add(d, (F.col("o_orderkey") % 7).cast("int")).alias("visit_end_date"),
    )


def _condition_occurrence(cdm: Cdm) -> DataFrame:
    k = F.col("o_orderkey")
    letter = F.expr("substring('KNIB', cast(1 + o_orderkey % 4 as int), 1)")
    return cdm.orders.select(
        F.col("o_custkey").alias("person_id"),
        (4000000 + k % 25).alias("condition_concept_id"),
        (4100000 + k % 25).alias("condition_source_concept_id"),
        F.concat(letter, F.lpad((k % 100).cast("string"), 2, "0")).alias("condition_source_value"),
        F.col("o_orderdate").cast("date").alias("condition_start_date"),
        k.alias("visit_occurrence_id"),
    )


def _measurement(cdm: Cdm) -> DataFrame:
    lab = F.lit(LABS[-1])
    for i in range(4):
        lab = F.when(F.col("l_suppkey") % 5 == i, LABS[i]).otherwise(lab)
    value = F.when(F.col("l_suppkey") % 5 == 4, F.col("l_quantity") / 25).otherwise(F.col("l_quantity"))
    return _lines(
        cdm, cdm.lineitem,
        lab.cast("long").alias("measurement_concept_id"),
        F.col("l_shipdate").cast("date").alias("measurement_date"),
        F.when(F.col("l_partkey") % 97 != 0, value).alias("value_as_number"),
        (8700 + F.col("l_suppkey") % 3).alias("unit_concept_id"),
        F.when(F.col("l_linenumber") == 5, 2.0).otherwise(10.0).alias("range_low"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).when(F.col("l_linenumber") == 6, 0.0)
        .when(F.col("l_linenumber") == 5, 8.0).otherwise(30.0).alias("range_high"),
    ).select(
        "person_id", "measurement_concept_id", "measurement_date", "value_as_number", "unit_concept_id", "range_low",
        "range_high", F.col("o_orderkey").alias("visit_occurrence_id"))


def _procedure_occurrence(cdm: Cdm) -> DataFrame:
    return _lines(
        cdm, cdm.lineitem.filter(F.col("l_linestatus") == "F"),
        (8000000 + F.col("l_suppkey") % 40).alias("procedure_concept_id"),
        F.col("l_shipdate").cast("date").alias("procedure_date"),
    ).select("person_id", "procedure_concept_id", "procedure_date", F.col("o_orderkey").alias("visit_occurrence_id"))


def _death(cdm: Cdm) -> DataFrame:
    last = cdm.orders.groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("death_date"))
    poor = cdm.customer.filter(F.col("c_acctbal") < 0).select("c_custkey")
    return last.join(poor, last.o_custkey == poor.c_custkey).select(F.col("o_custkey").alias("person_id"), "death_date")


_CONCEPT = (
    "concept_id long, concept_name string, concept_code string, vocabulary_id string, concept_class_id string, "
    "domain_id string, standard_concept string, invalid_reason string"
)


def _concept(cdm: Cdm) -> DataFrame:
    spark = cdm.spark
    fixed = [(c, n, str(c), "RxNorm", "Ingredient", "Drug", "S", None) for _, c, n in INGREDIENTS]
    fixed += [
        (3000000 + i, f"class {code}", code, "ATC", "ATC", "Drug", "C", None) for i, code in enumerate(ATC_CODES)
    ]
    fixed += [(P.CLINICAL_FINDING, "Clinical finding", "404684003", "SNOMED", "Clinical Finding", "Condition", "S", None)]
    fixed += [(c, f"lab {i}", str(c), "LOINC", "Lab Test", "Measurement", "S", None) for i, c in enumerate(LABS)]
    fixed += [
        (c, n, str(c), "Visit", "Visit", "Visit", "S", None)
        for c, n in ((9201, "inpatient"), (9202, "outpatient"), (9203, "emergency"), (262, "er and inpatient"),
                     (581477, "office"))
    ]
    literal = literal_frame(spark, fixed, _CONCEPT)

    def rows(df, cid, name, code, vocab, cls, domain, standard):
        return df.select(
            cid.cast("long").alias("concept_id"), name.alias("concept_name"), code.cast("string").alias("concept_code"),
            F.lit(vocab).alias("vocabulary_id"), F.lit(cls).alias("concept_class_id"), F.lit(domain).alias("domain_id"),
            F.lit(standard).alias("standard_concept"), F.lit(None).cast("string").alias("invalid_reason"),
        )

    part = rows(cdm.part, 2000000 + F.col("p_partkey"), F.col("p_name"), F.col("p_partkey"), "RxNorm",
                "Clinical Drug", "Drug", "S")
    pruned = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("Disorder of "), F.col("n_name"))).otherwise(
        F.col("n_name"))
    nation = rows(cdm.nation, 4000000 + F.col("n_nationkey"), pruned, F.col("n_nationkey"), "SNOMED",
                  "Clinical Finding", "Condition", "S")
    region = rows(cdm.region, 5000000 + F.col("r_regionkey"), F.col("r_name"), F.col("r_regionkey"), "SNOMED",
                  "Clinical Finding", "Condition", "S")
    codes = _source_codes(cdm)
    codes = codes.select(
        F.col("code_id").alias("concept_id"), F.concat(F.lit("code "), F.col("code")).alias("concept_name"),
        F.col("code").alias("concept_code"), F.col("vocab").alias("vocabulary_id"),
        F.lit("Code").alias("concept_class_id"), F.lit("Condition").alias("domain_id"),
        F.lit(None).cast("string").alias("standard_concept"), F.lit(None).cast("string").alias("invalid_reason"),
    )
    out = literal
    for f in (part, nation, region, codes):
        out = out.unionByName(f)
    return out


def _source_codes(cdm: Cdm) -> DataFrame:
    """Source codes and the condition number (0..24) each one maps to; the
    targets come from ``nation``, so a code maps only to a known condition."""
    spark = cdm.spark
    n = F.col("id")
    icd10 = spark.range(0, 2600, 1, 1).select(
        (7000000 + n).alias("code_id"),
        F.concat(F.expr("char(cast(65 + id div 100 as int))"), F.lpad((n % 100).cast("string"), 2, "0")).alias("code"),
        F.lit("ICD10").alias("vocab"), (n % 25).alias("k"),
    )
    decimal = spark.range(0, 10000, 1, 1).select(
        (7100000 + n).alias("code_id"),
        F.concat(F.lpad(F.expr("id div 10").cast("string"), 3, "0"), F.lit("."), (n % 10).cast("string")).alias("code"),
        F.lit("ICD9CM").alias("vocab"), F.expr("(id div 10) % 25").alias("k"),
    )
    header = spark.range(0, 1000, 1, 1).select(
        (7200000 + n).alias("code_id"), F.lpad(n.cast("string"), 3, "0").alias("code"),
        F.lit("ICD9CM").alias("vocab"), (n % 25).alias("k"),
    )
    letters = spark.range(0, 200, 1, 1).select(
        (7300000 + n).alias("code_id"),
        F.concat(F.when(n < 100, "E").otherwise("V"), F.lpad((n % 100).cast("string"), 2, "0")).alias("code"),
        F.lit("ICD9CM").alias("vocab"), (n % 25).alias("k"),
    )
    return icd10.unionByName(decimal).unionByName(header).unionByName(letters)


def _concept_ancestor(cdm: Cdm) -> DataFrame:
    spark = cdm.spark
    brand = cdm.part.select(
        "p_partkey", "p_type", F.expr("cast(substring(p_brand, 7) as int)").alias("brand_no"))
    ingredient = literal_frame(spark, [(b, c) for b, c, _ in INGREDIENTS], "brand_no int, ingredient long")
    atc = literal_frame(spark, [(t, 3000000 + i) for i, t in enumerate(PART_TYPES)], "p_type string, atc long")
    part = brand.join(ingredient, "brand_no").join(atc, "p_type")

    def pairs(df, ancestor, descendant, level):
        return df.select(
            ancestor.cast("long").alias("ancestor_concept_id"), descendant.cast("long").alias("descendant_concept_id"),
            F.lit(level).cast("long").alias("min_levels_of_separation"),
        )

    product = 2000000 + F.col("p_partkey")
    condition, region = 4000000 + F.col("n_nationkey"), 5000000 + F.col("n_regionkey")
    root = F.lit(P.CLINICAL_FINDING)
    links = literal_frame(spark, clinical_links(), "ancestor long, n_nationkey int")
    links = links.join(cdm.nation, "n_nationkey")
    fixed = [(c, c, 0) for _, c, _ in INGREDIENTS] + [(3000000 + i, 3000000 + i, 0) for i in range(len(ATC_CODES))]
    fixed += [(v, v, 0) for v in (9201, 9202, 9203, 262, 581477)]
    out = literal_frame(spark, 
        fixed, "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation long")
    for f in (
        pairs(part, product, product, 0),
        pairs(part, F.col("ingredient"), product, 1),
        pairs(part, F.col("atc"), product, 2),
        pairs(part.select("atc", "ingredient").distinct(), F.col("atc"), F.col("ingredient"), 1),
        pairs(cdm.nation, condition, condition, 0),
        pairs(cdm.nation, region, condition, 1),
        pairs(cdm.nation, root, condition, 3),
        pairs(cdm.region, 5000000 + F.col("r_regionkey"), 5000000 + F.col("r_regionkey"), 0),
        pairs(cdm.region, root, 5000000 + F.col("r_regionkey"), 2),
        pairs(links, F.col("ancestor"), condition, 1),
    ):
        out = out.unionByName(f)
    return out


def _concept_relationship(cdm: Cdm) -> DataFrame:
    codes = _source_codes(cdm)
    return codes.join(cdm.nation, F.col("k") == F.col("n_nationkey")).select(
        F.col("code_id").alias("concept_id_1"), (4000000 + F.col("n_nationkey")).cast("long").alias("concept_id_2"),
        F.lit("Maps to").alias("relationship_id"), F.lit(None).cast("string").alias("invalid_reason"),
    )


def _cohort(cdm: Cdm) -> DataFrame:
    """1 first finished order, 2 first urgent order, 3 outcome days, 4 repeat entries."""
    o = cdm.orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").cast("date").alias("d"))

    def build(df, cid, days):
        return df.select(
            F.lit(cid).cast("long").alias("cohort_definition_id"), "subject_id", F.col("d").alias("cohort_start_date"),
            F.date_add("d", days).alias("cohort_end_date"))

    first = F.min("d").alias("d")
    return (
        build(o.filter(F.col("o_orderstatus") == "F").groupBy("subject_id").agg(first), 1, 90)
        .unionByName(build(o.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("subject_id").agg(first), 2, 30))
        .unionByName(build(o.filter(F.col("o_orderkey") % 5 == 3).select("subject_id", "d").distinct(), 3, 0))
        .unionByName(build(o.filter(F.col("o_orderkey") % 3 == 1).select("subject_id", "d").distinct(), 4, 60))
    )


def with_row_id(cohort: DataFrame) -> DataFrame:
    """A unique row id from subject, start (1900 to 2173) and definition (up to
    9,999), without a sort; larger subjects overflow with an error."""
    day = F.datediff("cohort_start_date", F.lit("1900-01-01").cast("date"))
    return cohort.withColumn("row_id", (F.col("subject_id") * 100000 + day) * 10000 + F.col("cohort_definition_id"))


def _stored(build, folder: str, name: str):
    """Vocabulary tables are written once per session and folder, so every
    plan scans them as tables of known size."""

    def read(cdm: Cdm) -> DataFrame:
        known = cdm.spark.__dict__.setdefault("_vitalspan_vocabulary", {})
        if (folder, name) not in known:
            known[(folder, name)] = materialize(build(cdm).hint("rebalance"), name)
        return known[(folder, name)]

    return read


def _raw(folder: str, table: str):
    def read(cdm: Cdm) -> DataFrame:
        path = f"{folder}/{table}.parquet"
        frame = cdm.spark.read.schema(RAW_SCHEMAS[table]).parquet(path)
        size_shuffles(cdm.spark, path)
        return frame

    return read


def derived_cdm(spark: SparkSession, folder: str) -> Cdm:
    builders = {t: _raw(folder, t) for t in RAW_TABLES}
    builders |= {
        "person": _person, "observation_period": _observation_period, "drug_exposure": _drug_exposure,
        "visit_occurrence": _visit_occurrence, "condition_occurrence": _condition_occurrence,
        "measurement": _measurement, "procedure_occurrence": _procedure_occurrence, "death": _death,
        "concept": _stored(_concept, folder, "concept"),
        "concept_ancestor": _stored(_concept_ancestor, folder, "concept_ancestor"),
        "concept_relationship": _stored(_concept_relationship, folder, "concept_relationship"),
        "cohort": _cohort,
        "drug_era": lambda c: drug_era(c.drug_exposure, c.concept, c.concept_ancestor),
        "condition_era": lambda c: condition_eras(c.condition_occurrence),
        "cohort_rows": lambda c: with_row_id(c.cohort),
    }
    return Cdm(spark, builders)
