import random

import numpy as np
from pyspark.sql import functions as F

from stratakit.functions import exprs as X
from stratakit.operators import profile
from stratakit.sources import sam


def line(name, rname, pos, cigar, seq, flag=0, nm=0, score=None):
    """A SAM line; quality letters count up, so that their order shows."""
    qual = "".join(chr(48 + k % 70) for k in range(len(seq)))
    tags = [f"NM:i:{nm}", "tp:A:P"] + ([f"AS:i:{score}"] if score is not None else [])
    return "\t".join([name, str(flag), rname, str(pos), "37", cigar, "*", "0", "0", seq, qual, *tags])


#: Four alignments of two taxa and a third: a deletion, an insertion, an overlap, trailing marks of the reference name.
READS = [
    line("m1", "S1|1|80|901", 5, "3S8M2D6M1S", "TTACCGGATTACAGGCAT", nm=3, score=20),
    line("m2", "S1|1|80|901", 18, "7M1I10M", "GATTACAGATTACAGGTT", nm=2, score=18),
    line("m3", "S1|101|220|901|", 150, "12M", "CCATGGCCATGG", flag=16, score=24),
    line("m4", "T7|1|60|902.0", 40, "10M2S", "AACCGGTTAANN", nm=1, score=11),
]


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_fragments_by_hand(spark):
    rows = {r.rname: r for r in profile.fragments(sam.counted(sam.parse_sam(lines(spark, ["@SQ\tSN:x", *READS])))).collect()}
    # [5, 20] and [18, 34]: 33 bases with mismatches 3 + 2, gaps 2 + 1, reads of 18 letters; covered 5 to 34
    assert tuple(rows["S1|1|80|901"])[1:] == (33, 2, 5, 3, 36, 30)
    assert tuple(rows["S1|101|220|901"])[1:] == (12, 1, 0, 0, 12, 12)  # the trailing bar goes
    assert tuple(rows["T7|1|60|902"])[1:] == (10, 1, 1, 0, 12, 10)  # and so does the final .0
    strict = sam.parse_sam(lines(spark, READS), 0.9)
    # m1 14 of 18 letters, m2 17 of 18, m3 12 of 12, m4 10 of 12
    assert {r.qname for r in sam.counted(strict).collect()} == {"m2", "m3"}
    counts = sam.counters(strict).first()
    assert (counts.alignments, counts.invalid_match, counts.mapped_reads) == (4, 2, 2)


def test_exclusion_counts_every_line(spark):
    ex = spark.createDataFrame([("S1",), ("none",)], "acc string")
    parsed = sam.parse_sam(lines(spark, READS), 0.0, ex)
    assert sam.counters(parsed).first().excluded_acc == 3
    assert [r.acc for r in sam.counted(parsed).collect()] == ["T7"]


def test_malformed_lines_are_counted(spark):
    bad = ["q\t0\tS1|1|80|901", "q\tx\tS1|1|80|901\t1\t37\t5M\t*\t0\t0\tA\tH", READS[0].replace("S1|1|80|901", "S1|80|901"), ""]
    parsed = sam.parse_sam(lines(spark, [*READS, *bad]), 0.0)
    assert sam.counters(parsed).first().malformed == len(bad)
    assert sam.counted(parsed).count() == len(READS)


def test_regions(spark):
    rows = [("a", 1, 5), ("a", 4, 8), ("a", 10, 12), ("b", 31, 44), ("b", 45, 50), ("c", 1, 9), ("c", 2, 3), ("c", 1, 9)]
    df = spark.createDataFrame(rows, "rname string, region_start long, region_end long")
    merged = sorted(map(tuple, profile.merged_regions(df).select("rname", "start", "end").collect()))
    assert merged == [("a", 1, 8), ("a", 10, 12), ("b", 31, 50), ("c", 1, 9)]


def test_covered_length_against_sets(spark):
    random.seed(4)
    rows = [(f"f{random.randrange(5)}", s := random.randrange(1, 300), s + random.randrange(0, 40)) for _ in range(400)]
    df = spark.createDataFrame(rows, "rname string, region_start long, region_end long").withColumns({c: F.lit(0) for c in ("nm", "ins_len", "del_len", "read_len")})
    want = {}
    for name, s, e in rows:
        want.setdefault(name, set()).update(range(s, e + 1))
    for parts in (1, 7):
        got = {r.rname: r.sc for r in profile.fragments(df.repartition(parts)).collect()}
        assert got == {k: len(v) for k, v in want.items()}


def test_best_hit_ties_and_mates(spark):
    row = lambda q, flag, score, k: line(q, f"A|1|100|{k}", 1, "10M", "ACGTACGTAC", flag, score=score)
    values = [row("r", 0, 5, 1), row("r", 0, 9, 2), row("r", 0, 9, 3), row("r", 256, 99, 4), row("r", 128, 1, 5), row("s", 0, None, 6)]
    got = {r.qkey: r.taxid for r in profile.best_hits(sam.parse_sam(lines(spark, values))).collect()}
    assert got == {"r": "2", "r/2": "5", "s": "6"}


def test_python_floats(spark):
    values = [0.0, 1.0, 0.5, 0.0005, 0.00005, 0.000012, 0.000001, 0.1, 0.123456, 12.5, 1234.5, 0.99]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.py_float(F.col("v"))).collect()] == [repr(v) for v in values]


def test_half_even(spark):
    df = spark.createDataFrame([(0.1234565,), (0.1234575,)], "v double")
    assert [r[0] for r in df.select(X.round6(F.col("v"))).collect()] == np.round([0.1234565, 0.1234575], 6).tolist()


def test_revcomp(spark):
    df = spark.createDataFrame([("ACGTN",), ("acgRYu",), ("AX",), ("",), ("KMBVDHSW",)], "s string")
    got = [r[0] for r in df.select(X.revcomp(F.col("s"))).collect()]
    assert got == ["NACGT", "aRYcgt", None, "", "WSDHBVKM"]
    table = X.complements()
    assert len(table) == 32 and all(table[table[c]] == c for c in table if c not in "Uu")


def test_zscore_closed_form(spark):
    rows = [(b, t, n) for b in (1, 500) for t in (1000, 77) for n in (1, 50, 76)] + [(0, 10, 0), (5, 10, 10), (5, 0, 3)]
    for r in spark.createDataFrame(rows, "b long, t long, n long").select("*", X.zscore(F.col("b"), F.col("t"), F.col("n")).alias("z")).collect():
        want = ((r.t - r.n) / r.n) ** 0.5 if r.b and 0 < r.n < r.t else 0.0
        assert abs(r.z - want) < 1e-9
