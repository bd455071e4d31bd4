import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import genome as N


def test_probe_regions_equal_all_pairs(spark):
    rng = random.Random(2)
    probes = [(i, rng.choice("xy"), s := rng.randrange(900), s + 2) for i in range(150)]
    promoters = [(f"e{i % 9}", rng.choice("xy"), s := rng.randrange(900), s + 11) for i in range(40)] + [("flat", "x", 5, 5)]
    peaks = [(f"p{i}", rng.choice("xy"), s := rng.randrange(900), s + 40) for i in range(20)]
    links = [(f"e{rng.randrange(9)}", f"p{rng.randrange(20)}") for _ in range(30)]
    df = lambda r, n: spark.createDataFrame(r, f"{n}, chrom string, start int, end int")
    spots = {p: (c, s, e) for p, c, s, e in peaks}
    regions = [("promoter", e, c, s, t) for e, c, s, t in promoters if s < t] + [("distal", e, *spots[p]) for e, p in links]
    want = {(p, e, k) for p, c, s, t in probes for k, e, rc, rs, re in regions if c == rc and s < re and rs < t}
    args = df(probes + probes[:9], "probe int"), df(promoters, "entity string"), spark.createDataFrame(links, "entity string, peak string"), df(peaks + peaks[:2], "peak string")
    got = [tuple(r) for r in N.probe_regions(*args, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for *_, k in want} == {"promoter", "distal"}
    with pytest.raises(ValueError):
        N.probe_regions(args[0], args[1], args[2], args[3].where("peak <> 'p3'").where(F.col("peak") != links[0][1]), 16)


def test_probe_regions_shuffle_no_pairs(spark):
    """Regions of one entity that overlap, touch, hold one another or are equal, probes with several places, and nulls: every pair
    once, though no plan of probes with one place makes the pairs distinct."""
    rng = random.Random(5)
    df = lambda r, n: spark.createDataFrame(r, f"{n}, chrom string, start int, end int")
    span = lambda most: ((s := rng.randrange(300)), s + rng.randrange(most))
    probes = [(i, rng.choice("xy"), *span(4)) for i in range(90)] + [(900, "x", 5, None), (901, None, 5, 9)]
    promoters = [(rng.choice([None, "a", "b"]), rng.choice("xy"), *span(60)) for _ in range(60)]
    peaks = [(f"p{i}", rng.choice("xy"), *span(90)) for i in range(30)]
    links = [(rng.choice("ab"), f"p{rng.randrange(30)}") for _ in range(40)]
    spots = {p: r for p, *r in peaks}
    regions = [("promoter", *r) for r in promoters] + [("distal", e, *spots[p]) for e, p in links]
    meets = lambda rows: {(p, e, k) for p, c, s, t in rows if None not in (c, t) for k, e, rc, rs, re in regions if rs < re and c == rc and s < re and rs < t}
    rest = df(promoters, "entity string"), spark.createDataFrame(links, "entity string, peak string"), df(peaks + peaks, "peak string")
    found = N.probe_regions(df(probes + probes, "probe int"), *rest, 16)
    pairs = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [probe" not in pairs and "Deduplicate" not in pairs
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == meets(probes)
    many = probes + [(i, rng.choice("xy"), *span(4)) for i in range(30)] + [(None, "x", 20, 24), (None, "y", 30, 33)]
    got = [tuple(r) for r in N.probe_regions(df(many, "probe int"), *rest, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == meets(many)
    for wrong in (peaks + [("p3", "z", 1, 2)], peaks + [("alone", "x", 1, 2), ("alone", "x", 1, 3)], [p for p in peaks if p[0] != links[0][1]]):
        with pytest.raises(ValueError):
            N.probe_regions(df(probes, "probe int"), *rest[:2], df(wrong, "peak string"), 16)


def test_exons_of_the_declared_release_only(spark):
    exons = spark.createDataFrame([("a", "new", "x", 0, 10), ("a", "new", "x", 10, 12), ("a", "new", "x", 20, 25), ("a", "old", "x", 0, 99), ("b", "old", "x", 3, 4), ("c", "new", "x", 1, 2), ("a", "new", "y", 2, 3)], "entity string, release string, chrom string, start int, end int")
    declared = spark.createDataFrame([("a", "new"), ("b", "old"), ("d", "new")], "entity string, release string")
    assert sorted(map(tuple, N.exon_unions(exons, declared).collect())) == [("a", "x", 0, 12), ("a", "x", 20, 25), ("a", "y", 2, 3), ("b", "x", 3, 4)]


def test_peaks_to_binding_rows(spark):
    peaks = [("P", "x", 0, 100, 110, 9.0, 5), ("P", "x", 1, 105, 115, 4.0, 5), ("P", "x", 0, 300, 310, 9.0, 5), ("P", "x", 1, 305, 306, 9.0, None), ("Q", "x", 0, 104, 106, 2.0, 5), ("Q", "x", 1, 104, 106, 3.0, 5), ("R", "x", 0, 104, 106, 3.0, 5), ("R", "x", 1, 104, 106, 3.0, 5)]
    df = spark.createDataFrame(peaks, "protein string, chrom string, rep int, start int, end int, signal double, p int")
    kept = N.reproducible_peaks(df, ["protein", "chrom"], "rep", F.col("p") > 1, 2, 16)
    assert sorted(tuple(r[c] for c in ("protein", "start", "end", "peaks", "best")) for r in kept.collect()) == [("P", 100, 115, 2, 9.0), ("Q", 104, 106, 2, 3.0), ("R", 104, 106, 2, 3.0)]
    blocks = spark.createDataFrame([("x", 90, 120, "y", 1000, 5000, "-")], "chrom string, block_start int, block_end int, target_chrom string, target_start int, target_size int, strand string")
    # the peak of P lands on 3975 to 3990 and that of Q on 3984 to 3986
    regions = spark.createDataFrame([("g", "gene", "y", 3900, 4000), ("g", "exon", "y", 3984, 3985), ("g", "exon", "y", 3989, 3995), ("h", "gene", "y", 3990, 3999), ("i", "gene", "y", 3989, 3999), ("j", "gene", "x", 90, 120)], "entity string, kind string, chrom string, start int, end int")
    mapping = spark.createDataFrame([("P", "u1"), ("P", "u2"), ("P", "u2"), ("Q", "u3"), ("R", None)], "protein string, protein_id string")
    got = N.binding_rows(kept.withColumn("cut", F.lit(1)), blocks, regions, mapping, ["cut"], 16)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("g", "P", "u1", 1, 1, 9.0, 0.5), ("g", "P", "u2", 1, 1, 9.0, 0.5), ("g", "Q", "u3", 1, 1, 3.0, 1.0), ("i", "P", "u1", 1, 0, 9.0, 0.5), ("i", "P", "u2", 1, 0, 9.0, 0.5)]
    assert [tuple(r) for r in N.threshold_table(got, ["cut"]).collect()] == [(1, 5, 2, 3, 3)]
    assert N.binding_rows(kept.limit(0).withColumn("cut", F.lit(1)), blocks, regions, mapping, ["cut"], 16).count() == 0


def test_reproducible_peaks_do_not_depend_on_the_order_of_equal_intervals(spark):
    """Equal intervals that open an island, whichever of them comes first."""
    rows = [("p", "c", 0, 10, 14, 5.0), ("p", "c", 1, 10, 14, 6.0), ("p", "c", 0, 20, 24, 7.0), ("p", "c", 1, 20, 24, 8.0), ("p", "c", 1, 20, 24, 8.0)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        peaks = spark.createDataFrame(order, "protein string, chrom string, rep int, start int, end int, signal double").repartition(3)
        got = N.reproducible_peaks(peaks, ["protein", "chrom"], "rep", F.lit(True), 2, 8).orderBy("start").collect()
        assert [(r.start, r.end, r.peaks, r.best) for r in got] == [(10, 14, 2, 6.0), (20, 24, 3, 8.0)]


def test_reproducible_peaks_equal_plain_unions_and_stay_in_their_tasks(spark):
    """Short, long, touching, equal and empty peaks, nulls and settings, against a loop; rows dealt by protein and chrom move once."""
    rng = random.Random(11)
    rows = [(rng.choice("pq"), rng.choice("xy"), rng.randrange(4), s := rng.randrange(400), s + rng.choice([0, 1, 3, 9]), float(rng.randrange(9))) for _ in range(220)]
    rows += [("p", "x", 0, None, 5, 1.0), ("p", None, 0, 3, 5, 1.0), (None, "x", 1, 3, 5, 1.0), ("p", "x", 1, 3, None, 1.0), ("q", "y", None, 7, 9, 8.0)]
    peaks = spark.createDataFrame(rows, "protein string, chrom string, rep int, start int, end int, signal double").repartition(4, "protein", "chrom")
    peaks = peaks.withColumn("least", F.explode(F.array(F.lit(0), F.lit(3), F.lit(6))))
    for replicates in (1, 2, 3):
        want = []
        for least in (0, 3, 6):
            for by in ((p, c) for p in "pq" for c in "xy"):
                own, unions = sorted((s, e, sig, rep) for p, c, rep, s, e, sig in rows if (p, c) == by and None not in (s, e) and sig >= least and rep is not None), []
                own = sorted(own + [(s, e, sig, None) for p, c, rep, s, e, sig in rows if (p, c) == by and rep is None and sig >= least], key=lambda r: r[:3])
                for s, e, *_ in own:
                    if unions and s <= unions[-1][1]:
                        unions[-1][1] = max(unions[-1][1], e)
                    else:
                        unions.append([s, e])
                for us, ue in unions:
                    held = [r for r in own if us <= r[0] and r[1] <= ue and r[0] < ue and us < r[1]]
                    if len({r[3] for r in held} - {None}) >= replicates:
                        want.append((least, *by, us, ue, len(held), max(r[2] for r in held)))
        found = N.reproducible_peaks(peaks, ["least", "protein", "chrom"], "rep", F.col("signal") >= F.col("least"), replicates, 8)
        got = [tuple(r[c] for c in ("least", "protein", "chrom", "start", "end", "peaks", "best")) for r in found.collect()]
        assert sorted(got) == sorted(want) and len(want) > 10
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_binding_lines_move_once_for_all_settings(spark, tmp_path):
    """Plan of the query over the tables: peaks are written before they are lifted, and a gene of one exon is not a row of its own."""
    from assaylake.plans import genome as P
    from assaylake.plans.binding import Tables

    met = {}
    kept, rows = N.reproducible_peaks, N.binding_rows
    try:
        N.reproducible_peaks = lambda *a, **k: met.setdefault("kept", kept(*a, **k))
        N.binding_rows = lambda *a, **k: met.setdefault("regions", a[2]) and rows(*a, **k)
        out, _ = P.bound(Tables(spark, "/root/testdata/sf0.001"), P.GRID)
    finally:
        N.reproducible_peaks, N.binding_rows = kept, rows
    moved = met["kept"]._jdf.queryExecution().optimizedPlan().toString()
    assert moved.index("Generate explode") < moved.index("RepartitionByExpression [protein")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    genes = met["regions"].where("kind = 'gene'").join(met["regions"].where("kind = 'exon'"), ["entity", "chrom", "start", "end"], "left_semi")
    assert met["regions"].where("kind = 'gene'").count() > 0 and genes.count() == 0
