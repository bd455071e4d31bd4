from pyspark.sql import functions as F

from assaylake.sources import external as X

A = X.Database("a", {"record": ["id"], "entity_raw": ["gene name"], "context_raw": ["disease"], "method_raw": ["method"], "pmid_raw": ["pubmed id"], "direction_raw": ["trend"]}, ("unclear", "other"), [("predict", "model", "predicted"), ("blot", "assay", "experimental")])
B = X.Database("b", {"record": ["row"], "entity_raw": ["target"]}, ("screen", "experimental"), suffix="(?i)_x$")


def rows(spark):
    a = [
        ("1", "malat1.2", "Breast cancer", "Western blot", "PMID: 0012", "Up-regulated"), ("2", "HOTAIR", "breast and lung", "Predicted", "7.0", "decreased"), ("3", "twin", "lung", "blot", "", None),
        ("4", " ", None, None, "none", "upstream"), ("5", "XIST", "LUNG-cancer!", "blot", "99", ""), ("6", "XIST", "bone", "Blot; predicted", None, "x"),
    ]
    one = spark.createDataFrame(a, "ID string, `Gene-Name` string, Disease string, METHOD string, `PubMed ID` string, trend string")
    two = spark.createDataFrame([("1", "XIST_X"), ("2", "nothing_x"), ("3", "MALAT1")], "row string, Target string")
    return X.stacked([(one, A), (two, B)])


def found(spark):
    names = spark.createDataFrame([("MALAT1", 1), ("hotair", 2), ("TWIN", 3), ("TWIN", 4), ("xist", 5), ("XIST", 5), (None, 6)], "alias string, entity int")
    cohorts = spark.createDataFrame([("Breast_Cancer", "BR"), ("breast", "BR"), ("lung", "LU"), ("", "NO")], "alias string, cohort string")
    trained = spark.createDataFrame([(99,), (None,), (99,)], "pmid long")
    return X.mapped(rows(spark), names, cohorts, trained)


def test_one_schema_and_mapping(spark):
    got = {(r.database, r.record): r for r in found(spark).collect()}
    assert len(got) == 9
    at = lambda *c: {k: tuple(r[x] for x in c) for k, r in got.items()}
    assert at("entity", "entity_status") == {
        ("a", "1"): (1, "mapped"), ("a", "2"): (2, "mapped"), ("a", "3"): (None, "ambiguous"), ("a", "4"): (None, "unnamed"), ("a", "5"): (5, "mapped"), ("a", "6"): (5, "mapped"),
        ("b", "1"): (5, "mapped_short"), ("b", "2"): (None, "unmapped"), ("b", "3"): (1, "mapped"),
    }
    assert at("cohort", "context_status")["a", "1"] == ("BR", "exact") and at("cohort", "context_status")["a", "2"] == (None, "ambiguous")
    assert at("cohort", "context_status")["a", "5"] == ("LU", "exact") and at("context_status")["a", "6"] == ("unmapped",) and at("context_status")["b", "1"] == ("global",)
    assert {k: r.pmid for k, r in got.items() if r.pmid} == {("a", "1"): 12, ("a", "2"): 7, ("a", "5"): 99}
    assert {k: r.direction for k, r in got.items() if r.direction != "unknown"} == {("a", "1"): "up", ("a", "2"): "down", ("a", "4"): "up"}
    assert [got["a", str(i)].kind for i in range(1, 7)] == ["experimental", "predicted", "experimental", "other", "experimental", "predicted"]


def test_eligibility_needs_all(spark):
    got = found(spark).collect()
    assert {(r.database, r.record) for r in got if r.validation_eligible} == {("a", "1")}  # 5 is in training's publications
    assert not any(r.consistency_eligible for r in got) and {r.record for r in got if r.trained_pmid} == {"5"}
    assert {r.role for r in got if r.database == "b"} == {"validation"} and next(r for r in got if r.record == "4").role == "context"


def test_empty_databases(spark):
    none = X.stacked([(spark.createDataFrame([], "ID string"), A), (spark.createDataFrame([], "z int"), B)])
    assert none.count() == 0 and set(X.FIELDS) <= set(none.columns)


def test_rows_without_a_key_are_spread_over_tasks(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("record"), F.lit("x").alias("entity_raw"), F.when(F.col("id") < 5, F.col("id")).alias("pmid"))
    side = spark.createDataFrame([(0, True), (3, True), (9, True)], "pmid long, hit boolean")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = X._met(rows, side, "pmid")
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        assert got.count() == 4000 and {r.pmid for r in got.where("hit").collect()} == {0, 3}
        assert max(r["count"] for r in sizes) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
