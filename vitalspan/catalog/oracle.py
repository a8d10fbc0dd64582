"""Reference SQL: the derived record tables as common table expressions."""

from __future__ import annotations

import re

from vitalspan.plans import params as P
from vitalspan.sources.derived import ATC_CODES, INGREDIENTS, LABS, PART_TYPES, clinical_links


def values(rows, names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def islands(source: str, keys: str, start: str, end: str, gap: int, extra: str = "") -> str:
    """Merge intervals of ``source``; yields keys, s, e, n (rows) and extras."""
    return f"""SELECT {keys}, min({start}) AS s, max({end}) AS e, count(*) AS n {extra} FROM (
      SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT *, CASE WHEN {start} <= max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS brk FROM {source}))
      GROUP BY {keys}, grp"""


_LAB = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(LABS))

VIEWS = {
    "person": f"""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN {P.MALE} ELSE {P.FEMALE} END AS gender_concept_id,
      1912 + c_custkey % 80 AS year_of_birth, 1 + c_custkey % 12 AS month_of_birth, 1 + c_custkey % 28 AS day_of_birth,
      100 + n_regionkey AS race_concept_id,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 5 ELSE 0 END AS ethnicity_concept_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "observation_period": """SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) AS observation_period_start_date,
      CAST(max(o_orderdate) AS DATE) + 90 AS observation_period_end_date FROM orders GROUP BY 1""",
    "linez": "SELECT *, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "drug_exposure": """SELECT o_custkey AS person_id, CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 0 ELSE 2000000 + l_partkey END AS drug_concept_id,
      ship AS drug_exposure_start_date, CASE WHEN l_linestatus <> 'O' THEN ship + 5 * l_linenumber END AS drug_exposure_end_date,
      CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INTEGER) END AS days_supply FROM linez""",
    "visit_occurrence": """SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
      CASE o_orderpriority WHEN '1-URGENT' THEN 9203 WHEN '2-HIGH' THEN 9201 WHEN '3-MEDIUM' THEN 9202 WHEN '4-NOT SPECIFIED' THEN 262 ELSE 581477 END AS visit_concept_id,
      CAST(o_orderdate AS DATE) AS visit_start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS visit_end_date FROM orders""",
    "condition_occurrence": """SELECT o_custkey AS person_id, 4000000 + o_orderkey % 25 AS condition_concept_id, 4100000 + o_orderkey % 25 AS condition_source_concept_id,
      substr('KNIB', CAST(1 + o_orderkey % 4 AS INTEGER), 1) || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS condition_source_value,
      CAST(o_orderdate AS DATE) AS condition_start_date, o_orderkey AS visit_occurrence_id FROM orders""",
    "measurement": f"""SELECT o_custkey AS person_id, CAST(CASE l_suppkey % 5 {_LAB} END AS BIGINT) AS measurement_concept_id, ship AS measurement_date,
      CASE WHEN l_partkey % 97 <> 0 THEN CASE WHEN l_suppkey % 5 = 4 THEN l_quantity / 25 ELSE l_quantity END END AS value_as_number,
      8700 + l_suppkey % 3 AS unit_concept_id, CASE WHEN l_linenumber = 5 THEN 2.0::DOUBLE ELSE 10.0::DOUBLE END AS range_low,
      CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN 0.0::DOUBLE WHEN 5 THEN 8.0::DOUBLE ELSE 30.0::DOUBLE END AS range_high, l_orderkey AS visit_occurrence_id FROM linez""",
    "procedure_occurrence": """SELECT o_custkey AS person_id, 8000000 + l_suppkey % 40 AS procedure_concept_id, ship AS procedure_date,
      l_orderkey AS visit_occurrence_id FROM linez WHERE l_linestatus = 'F'""",
    "death": """SELECT o_custkey AS person_id, CAST(max(o_orderdate) AS DATE) AS death_date FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""",
    "source_codes": """SELECT 7000000 + i AS code_id, chr(CAST(65 + i // 100 AS INTEGER)) || lpad(CAST(i % 100 AS VARCHAR), 2, '0') AS code, 'ICD10' AS vocab, i % 25 AS k FROM range(2600) t(i)
      UNION ALL SELECT 7100000 + i, lpad(CAST(i // 10 AS VARCHAR), 3, '0') || '.' || CAST(i % 10 AS VARCHAR), 'ICD9CM', (i // 10) % 25 FROM range(10000) t(i)
      UNION ALL SELECT 7200000 + i, lpad(CAST(i AS VARCHAR), 3, '0'), 'ICD9CM', i % 25 FROM range(1000) t(i)
      UNION ALL SELECT 7300000 + i, CASE WHEN i < 100 THEN 'E' ELSE 'V' END || lpad(CAST(i % 100 AS VARCHAR), 2, '0'), 'ICD9CM', i % 25 FROM range(200) t(i)""",
    "concept": f"""SELECT concept_id, concept_name, concept_code, vocabulary_id, concept_class_id, domain_id, standard_concept, CAST(NULL AS VARCHAR) AS invalid_reason FROM (
      SELECT cid AS concept_id, nm AS concept_name, CAST(cid AS VARCHAR) AS concept_code, 'RxNorm' AS vocabulary_id, 'Ingredient' AS concept_class_id, 'Drug' AS domain_id, 'S' AS standard_concept
        FROM {values([(c, n) for _, c, n in INGREDIENTS], 'cid, nm')}
      UNION ALL SELECT cid, 'class ' || code, code, 'ATC', 'ATC', 'Drug', 'C' FROM {values([(3000000 + i, c) for i, c in enumerate(ATC_CODES)], 'cid, code')}
      UNION ALL SELECT {P.CLINICAL_FINDING}, 'Clinical finding', '404684003', 'SNOMED', 'Clinical Finding', 'Condition', 'S'
      UNION ALL SELECT cid, 'lab ' || i, CAST(cid AS VARCHAR), 'LOINC', 'Lab Test', 'Measurement', 'S' FROM {values([(c, i) for i, c in enumerate(LABS)], 'cid, i')}
      UNION ALL SELECT cid, nm, CAST(cid AS VARCHAR), 'Visit', 'Visit', 'Visit', 'S' FROM (VALUES (9201,'inpatient'),(9202,'outpatient'),(9203,'emergency'),(262,'er and inpatient'),(581477,'office')) AS v(cid, nm)
      UNION ALL SELECT 2000000 + p_partkey, p_name, CAST(p_partkey AS VARCHAR), 'RxNorm', 'Clinical Drug', 'Drug', 'S' FROM part
      UNION ALL SELECT 4000000 + n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'Disorder of ' || n_name ELSE n_name END, CAST(n_nationkey AS VARCHAR), 'SNOMED', 'Clinical Finding', 'Condition', 'S' FROM nation
      UNION ALL SELECT 5000000 + r_regionkey, r_name, CAST(r_regionkey AS VARCHAR), 'SNOMED', 'Clinical Finding', 'Condition', 'S' FROM region
      UNION ALL SELECT code_id, 'code ' || code, code, vocab, 'Code', 'Condition', NULL FROM source_codes)""",
    "part_map": f"""SELECT 2000000 + p_partkey AS product, ingredient, atc FROM part
      JOIN {values([(b, c) for b, c, _ in INGREDIENTS], 'b, ingredient')} ON b = CAST(substr(p_brand, 7) AS INTEGER)
      JOIN {values([(t, 3000000 + i) for i, t in enumerate(PART_TYPES)], 't, atc').replace('AS v(', 'AS w(')} ON t = p_type""",
    "concept_ancestor": f"""SELECT cid AS ancestor_concept_id, cid AS descendant_concept_id, 0 AS min_levels_of_separation
        FROM {values([(c,) for _, c, _ in INGREDIENTS] + [(3000000 + i,) for i in range(len(ATC_CODES))] + [(9201,), (9202,), (9203,), (262,), (581477,)], 'cid')}
      UNION ALL SELECT product, product, 0 FROM part_map UNION ALL SELECT ingredient, product, 1 FROM part_map
      UNION ALL SELECT atc, product, 2 FROM part_map UNION ALL SELECT DISTINCT atc, ingredient, 1 FROM part_map
      UNION ALL SELECT 4000000 + n_nationkey, 4000000 + n_nationkey, 0 FROM nation UNION ALL SELECT 5000000 + n_regionkey, 4000000 + n_nationkey, 1 FROM nation
      UNION ALL SELECT {P.CLINICAL_FINDING}, 4000000 + n_nationkey, 3 FROM nation UNION ALL SELECT 5000000 + r_regionkey, 5000000 + r_regionkey, 0 FROM region
      UNION ALL SELECT {P.CLINICAL_FINDING}, 5000000 + r_regionkey, 2 FROM region
      UNION ALL SELECT anc, 4000000 + k, 1 FROM {values(clinical_links(), 'anc, k')}""",
    "concept_relationship": """SELECT code_id AS concept_id_1, 4000000 + k AS concept_id_2, 'Maps to' AS relationship_id, CAST(NULL AS VARCHAR) AS invalid_reason FROM source_codes""",
    "cohort": """SELECT 1 AS cohort_definition_id, o_custkey AS subject_id, CAST(min(o_orderdate) AS DATE) AS cohort_start_date, CAST(min(o_orderdate) AS DATE) + 90 AS cohort_end_date FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
      UNION ALL SELECT 2, o_custkey, CAST(min(o_orderdate) AS DATE), CAST(min(o_orderdate) AS DATE) + 30 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey
      UNION ALL SELECT DISTINCT 3, o_custkey, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 5 = 3
      UNION ALL SELECT DISTINCT 4, o_custkey, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 60 FROM orders WHERE o_orderkey % 3 = 1""",
    "cohort_all_rows": """SELECT *, (subject_id * 100000 + date_diff('day', DATE '1900-01-01', cohort_start_date)) * 10000 + cohort_definition_id AS row_id FROM cohort""",
    "cohort_rows": "SELECT * FROM cohort_all_rows",
    "resolved": """SELECT person_id, c.concept_id AS ing, drug_exposure_start_date AS sd,
      COALESCE(drug_exposure_end_date, CASE WHEN days_supply > 0 THEN drug_exposure_start_date + days_supply END, drug_exposure_start_date + 1) AS ed
      FROM drug_exposure JOIN concept_ancestor a ON a.descendant_concept_id = drug_concept_id JOIN concept c ON c.concept_id = a.ancestor_concept_id
      WHERE c.vocabulary_id = 'RxNorm' AND c.concept_class_id = 'Ingredient' AND drug_concept_id <> 0 AND COALESCE(days_supply, 0) >= 0""",
    "sub_exposure": islands("resolved", "person_id, ing", "sd", "ed", 0),
    "drug_era": "SELECT person_id, ing AS drug_concept_id, s AS drug_era_start_date, e AS drug_era_end_date, k AS drug_exposure_count, date_diff('day', s, e) - x AS gap_days FROM ("
    + islands("(SELECT person_id, ing, s AS s0, e AS e0, n AS n0 FROM sub_exposure)", "person_id, ing", "s0", "e0", 30,
              ", sum(n0) AS k, sum(date_diff('day', s0, e0)) AS x") + ")",
    "condition_era": "SELECT person_id, condition_concept_id, s AS condition_era_start_date, e AS condition_era_end_date FROM ("
    + islands("condition_occurrence", "person_id, condition_concept_id", "condition_start_date", "condition_start_date", 30) + ")",
}

_TYPES = {"l": "BIGINT", "f": "DOUBLE", "d": "DATE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}


def _needed(sql: str, seen: list[str], views: dict[str, str]) -> None:
    for name in views:
        if re.search(rf"\b{name}\b", sql) and name not in seen:
            _needed(views[name], seen, views)
            seen.append(name)


def oracle(body: str, columns: list[tuple[str, str]], extra: dict[str, str] | None = None) -> str:
    """Complete statement: needed views, the body, typed and rounded columns."""
    views = VIEWS | (extra or {})
    seen: list[str] = []
    _needed(body, seen, views)
    picked = ", ".join(
        f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if t == "f" else f"CAST({c} AS {_TYPES[t]}) AS {c}"
        for c, t in columns
    )
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in seen)
    return (f"WITH {ctes}\n" if ctes else "") + f"SELECT {picked} FROM (\n{body}\n) q"
