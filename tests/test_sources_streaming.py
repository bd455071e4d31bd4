"""Files in and out, and the incremental jobs."""

import pytest
from pyspark.sql import functions as F

from assaylake.sources import readers as R
from assaylake.streaming import ledger as L


def test_gmt_round_trip(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S1\tfirst\tG2\tG1\tG9\n\nS2\tnone\n")
    rows = R.gmt(spark, str(tmp_path / "a.gmt"))
    assert sorted(map(tuple, rows.collect())) == [("S1", "first", "G1", 2), ("S1", "first", "G2", 1), ("S1", "first", "G9", 3)]
    R.write_gmt(rows, str(tmp_path / "out"), "set", "description", "member", "rank")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["S1\tfirst\tG2\tG1\tG9"]


def test_gtf_bed_fasta(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#!x\nchr1\tsrc\tgene\t11\t20\t.\t-\t.\tgene_id "E1"; gene_name "A";\nchr1\tsrc\tCDS\t11\t20\t.\t-\t.\tgene_id "E1";\n')
    g = R.gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert [(r.chrom, r.start, r.end, r.gene_id, r.transcript_id, r.gene_name) for r in g] == [("chr1", 10, 20, "E1", None, "A")]
    (tmp_path / "a.bed").write_text("# c\nchr1\t5\t9\tp1\n")
    assert tuple(R.bed(spark, str(tmp_path / "a.bed"), "name string").first()) == ("chr1", 5, 9, "p1")
    (tmp_path / "a.fa").write_text(">one x\nac\nGT\n>two\nTTT\n")
    assert sorted(map(tuple, R.fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one x", "ACGT"), ("two", "TTT")]


def test_delimited_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tv\n007\t1.5\n")
    assert tuple(R.delimited(spark, str(tmp_path / "a.tsv"), "id string, v double").first()) == ("007", 1.5)


def test_variants_are_accepted_or_quarantined(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("chrom\tstart\tend\tref\talt\tbarcode\n1\t5\t5\tA\tC\tTCGA-AA-0001-01A\n1\t0\t5\tA\tC\tTCGA-AA-0001-01A\n1\t7\t7\tA\tC\tTCGA-ZZ-0009-01A\n")
    ok, bad = R.maf(spark, str(tmp_path / "v.tsv"), spark.createDataFrame([("TCGA-AA-0001",)], "patient string"))
    assert ok.count() == 1 and sorted(r.reason for r in bad.collect()) == ["bad_interval", "unknown_patient"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "c string, v int")
    p = str(tmp_path / "p")
    R.write_partitioned(df, p, "c")
    R.write_partitioned(df.where("c = 'a'").limit(1), p, "c")
    assert spark.read.parquet(p).groupBy("c").count().orderBy("c").collect() == [("a", 1), ("b", 1)]
    R.write_ordered(df, str(tmp_path / "o"), ["v"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_segment_stream_works_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "patient string, chrom string, start long, end long, value double"
    entities = spark.createDataFrame([("E1", "1", 5), ("E2", "1", 50)], "entity string, chrom string, mid long")
    write = lambda p, v: spark.createDataFrame([(p, "1", 0, 10, v)], schema).coalesce(1).write.mode("append").parquet(src)
    write("p1", 0.5)
    L.segment_stream(spark, src, schema, entities, out, check).awaitTermination()
    write("p2", -0.9)
    for _ in range(2):
        L.segment_stream(spark, src, schema, entities, out, check).awaitTermination()
    got = {(r.patient, r.entity): (r.gain, r.loss, r.callable) for r in spark.read.parquet(out).collect()}
    assert got == {("p1", "E1"): (True, False, True), ("p1", "E2"): (False, False, False), ("p2", "E1"): (False, True, True), ("p2", "E2"): (False, False, False)}


def test_event_ledger_counts_an_event_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.createDataFrame([("e1", "k", "2024-01-01 00:00:00"), ("e2", "k", "2024-01-01 00:01:00")], "id string, k string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(src)
    run = lambda: L.event_ledger(spark, src, "id string, k string, at timestamp", "id", "at", "1 hour", ["k"], out, check).awaitTermination()
    run()
    rows.write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).groupBy("k").agg(F.sum("n").alias("n")).first().n == 2


def test_variant_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.tsv").write_text(f"chrom\tstart\tend\tref\talt\tbarcode\n1\t{i + 1}\t{i + 1}\tA\tC\tB{i}\n")
    L.variant_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.source_file for r in got) == ["0.tsv", "1.tsv"] and len({r.variant_id for r in got}) == 2


def test_entry_point_without_the_llm_folder():
    import __spark_entry__ as E

    assert "assoc_ranked_sets" in E.queries() and "assoc_ranked_sets" in E.oracle_sql()
    assert set(E.oracle_sql()) <= set(E.queries())
    with pytest.raises(ModuleNotFoundError):
        E._optional("no_such_module_here", ("something_else",))
    assert E._optional("no_such_module_here", ("no_such_module_here",)) is None
