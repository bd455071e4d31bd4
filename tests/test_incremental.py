import gzip
import random
import shutil

import pytest
from pyspark.sql import functions as F

from assaylake.operators.genome import segment_calls
from assaylake.operators.joins import as_of
from assaylake.sources import lines as S
from assaylake.streaming import ledger as L

def uncommitted(check):
    """As if the last batch had not been committed: it runs again."""
    last = sorted((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (check / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


SEGMENTS = "patient string, chrom string, start long, end long, value double"


def test_patients_split_over_batches_give_the_one_shot_table(spark, tmp_path):
    rng = random.Random(1)
    entities = spark.createDataFrame([(f"E{i}", str(i % 2), 7 * i) for i in range(12)], "entity string, chrom string, mid long")
    rows = [(f"p{p}", str(c), 20 * k, 20 * k + 20, rng.choice([-0.8, 0.0, 0.9])) for p in range(5) for c in range(2) for k in range(5) if rng.random() < 0.8]
    rng.shuffle(rows)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9] + rows[:1], SEGMENTS).coalesce(1).write.mode("append").parquet(src)
        if k % 2 == 0:
            L.segment_stream(spark, src, SEGMENTS, entities, out, check, files=1).awaitTermination()
    L.segment_stream(spark, src, SEGMENTS, entities, out, check).awaitTermination()
    every = spark.createDataFrame(rows, SEGMENTS)
    points = entities.crossJoin(every.select("patient").distinct())
    want = segment_calls(as_of(points, every, ["patient", "chrom"], "mid", "start", "end", ["value"]), ["patient", "entity"], "value", 0.3, -0.3)
    columns = sorted(want.columns)
    same = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert same(spark.read.parquet(out)) == same(want)
    shutil.rmtree(check)  # all batches once more
    L.segment_stream(spark, src, SEGMENTS, entities, out, check, files=2).awaitTermination()
    assert same(spark.read.parquet(out)) == same(want)


EVENTS = "id string, k string, at timestamp"


@pytest.mark.parametrize("files", [1, 3])
def test_late_repeated_and_replayed_events_give_the_one_shot_counts(spark, tmp_path, files):
    rng = random.Random(files)
    events = [(f"e{i}", f"k{i % 7}", f"2024-01-{1 + i % 20:02} 00:{i % 60:02}:00") for i in range(80)]
    dealt = events + rng.sample(events, 30)
    rng.shuffle(dealt)  # later files bring events of earlier days
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    frame = lambda rows: spark.createDataFrame(rows, "id string, k string, at string").withColumn("at", F.to_timestamp("at"))
    run = lambda: L.event_ledger(spark, src, EVENTS, "id", "at", "1 hour", ["k"], out, check, files=files).awaitTermination()
    for k in range(0, len(dealt), 40):
        frame(dealt[k : k + 40]).coalesce(1).write.mode("append").parquet(src)
        run()
    want = {(r.k, r.n, r.first, r.last) for r in frame(events).groupBy("k").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).collect()}
    got = lambda: [(r.k, r.n, r["first"], r["last"]) for r in spark.read.parquet(out).collect()]
    assert set(got()) == want and len(got()) == 7
    kept = spark.read.parquet(f"{out}-ledger")
    assert kept.count() == kept.select("id").distinct().count() == 80
    uncommitted(tmp_path / "check")
    run()
    assert set(got()) == want and spark.read.parquet(f"{out}-ledger").count() == 80


def test_lines_have_the_same_numbers_under_any_split(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(2)
    texts = {f"{i}.tsv": [f"line {i} {k} " + "x" * rng.randrange(200) for k in range(400)] for i in range(3)}
    for name, rows in texts.items():
        (folder / name).write_text("\n".join(rows) + "\n")
    (folder / "packed.tsv.gz").write_bytes(gzip.compress("\n".join(texts["0.tsv"]).encode()))
    texts["packed.tsv.gz"] = texts["0.tsv"]
    for split in (1500, 20_000, 1 << 27):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        try:
            got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in S.read_lines(spark, str(folder)).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == {(name, k + 1): v for name, rows in texts.items() for k, v in enumerate(rows)}


def test_variant_stream_keeps_lines_over_triggers_and_reruns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = set()
    for i in range(3):
        rows = [f"1\t{k}\t{k}\tA\tC\tB{i}" for k in range(1, 6)]
        want |= {(f"{i}.tsv", k + 1, k) for k in range(1, 6)}
        (tmp_path / "in" / f"{i}.tsv").write_text("\n".join(["chrom\tstart\tend\tref\talt\tbarcode", *rows]) + "\n")
    for each in (1, 2):
        out = str(tmp_path / f"out{each}")
        run = lambda: L.variant_stream(spark, str(tmp_path / "in"), out, str(tmp_path / f"check{each}"), each).awaitTermination()  # noqa: E731, B023
        run()
        uncommitted(tmp_path / f"check{each}")
        run()
        assert sorted((r.source_file, r.source_line, r.start) for r in spark.read.parquet(out).collect()) == sorted(want)
