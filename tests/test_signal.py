from vitalspan.plans import signal as G


class Tables:
    def __init__(self, **tables):
        self.__dict__.update(tables)


def test_eras_are_not_shuffled_by_drug_to_get_their_names(spark, frame):
    names = [(c, f"Drug {c}") for c in range(3000)] + [(1, "Drug 1")]
    eras = frame([(1, 1, "2000-05-01", "2000-05-20"), (1, 2, "2000-05-01", "2000-05-03"), (2, 2, "2001-05-01", "2001-05-20"),
                  (2, 5000, "2001-05-01", "2001-05-20"), (2, None, "2001-05-01", "2001-05-20")],
                 "person_id long, drug_concept_id long, drug_era_start_date string, drug_era_end_date string")
    t = Tables(
        person=frame([(p, 1980, 1, 1) for p in (1, 2)], "person_id long, year_of_birth long, month_of_birth long, day_of_birth long"),
        concept=spark.createDataFrame(names, "concept_id long, concept_name string"),
        drug_era=eras.withColumns({c: eras[c].cast("date") for c in ("drug_era_start_date", "drug_era_end_date")}))
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "4k")
        found = G.eligible_eras(t, G.LIVER)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.person_id, r.ingredient_name) for r in found.collect()) == [(1, "drug 1"), (1, "drug 1"), (2, "drug 2")]
    finally:
        spark.conf.set(key, was)
    assert "hashpartitioning(drug_concept_id" not in plan
