import pytest
from pyspark.sql import functions as F

from graphweave.functions import sequence as S


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_expand_motif():
    assert sorted(S.expand_motif("GANTC")) == ["GAATC", "GACTC", "GAGTC", "GATTC"]
    assert S.expand_motif("gatc, AN") == ["GATC", "AA", "AT", "AC", "AG"]


def test_counts_do_not_overlap(spark):
    assert one(spark, S.count_motifs(F.col("s"), ["AA"]), s="AAAAA") == 2
    assert one(spark, S.count_motifs(F.col("s"), ["GATC"]), s="GATCGATC") == 2
    assert one(spark, S.flank_count(F.col("s"), F.length("s"), 4, ["GATC"]), s="GATCTTTTGATC") == 3


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"


def test_kmers(spark):
    rows = spark.createDataFrame([("a", "ACGTN"), ("b", "AC"), ("c", "ACG" * 300)], "ctg string, seq string")
    out = S.kmers(rows, 3).orderBy("ctg", "start").collect()
    assert [r.kmer for r in out if r.ctg == "a"] == ["ACG", "ACG"]
    assert not [r for r in out if r.ctg == "b"]
    own = [r for r in out if r.ctg == "c"]
    assert [r.start for r in own] == list(range(898))
    seq = "ACG" * 300
    flip = str.maketrans("ACGT", "TGCA")
    assert [r.kmer for r in own] == [min(seq[i : i + 3], seq[i : i + 3][::-1].translate(flip)) for i in range(898)]


def test_bins(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 30)], "ctg string, len long")
    out = S.split_sequence(rows, 30).orderBy("ctg", "bin_no").collect()
    assert [(r.frag, r.frag_len) for r in out] == [("a_bin1", 30), ("a_bin2", 30), ("a_bin3", 30), ("a_bin4", 10), ("b", 30)]


def test_positions(spark):
    assert one(spark, S.half(F.col("p"), F.lit(100)), p=10) == "H"
    assert one(spark, S.half(F.col("p"), F.lit(80)), p=70) == "T"
    assert one(spark, S.is_flank(F.col("p"), F.lit(100), 20), p=10)
    assert not one(spark, S.is_flank(F.col("p"), F.lit(100), 20), p=50)
    got = one(spark, S.orientation_distances(F.lit(9), F.lit(69), F.lit(100), F.lit(80)))
    assert [(x.ori, x.dist) for x in got] == [("++", 160), ("+-", 102), ("-+", 78), ("--", 20)]
    assert one(spark, S.bin_number(F.col("p"), 30), p=70) == 3 and one(spark, S.bin_offset(F.col("p"), 30), p=70) == 10


def test_thresholds():
    assert S.parse_threshold("x", "1.5X") == (1.5, "multiple") and S.parse_threshold("x", "0.2") == (0.2, "fraction")
    for bad in ("2", "-1X", "many"):
        with pytest.raises(ValueError):
            S.parse_threshold("x", bad)
    assert S.detect_format("a/b.pairs.gz") == "bgzipped_pairs"
    with pytest.raises(ValueError):
        S.detect_format("a.txt")


def test_counted_kmers(spark, monkeypatch):
    """The same as one row a k-mer, which isn't made; large alphabets, long texts in pieces, letters beyond the first plane, and NUL."""
    monkeypatch.setattr(S, "PIECE", 50)
    wide = "".join(chr(0x4E00 + (k * k * 7919) % 20000) for k in range(300))
    texts = ["ACGTACGTAACGNACGTTACG" * 20, "ACG", "abc\x00\x00\x00\x00\x00\x00", "\U0001F600a\U0001F601bcdef" * 3, "", None]
    for own in (texts, [*texts, wide]):
        rows = spark.createDataFrame([(k, None if k % 3 == 0 else f"s{k % 2}", t) for k, t in enumerate(own)], "ctg long, source string, seq string").coalesce(1)
        for canonical in (True, False):
            plain = S.kmers(rows, 6, canonical=canonical)
            for by, size in (([], None), (["source"], None), (["ctg", "source"], 20)):
                keys = [*by, *(["bin"] if size else []), "kmer"]
                one = plain.withColumn("bin", F.floor(F.col("start") / 20)).groupBy(*keys).agg(F.count("*").alias("cnt"))
                counted = S.counted_kmers(rows, 6, by, size, canonical=canonical)
                assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
                two = counted.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
                assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_kmers_are_dealt(spark, monkeypatch):
    """Files of one row group still give as many tasks as their rows need."""
    from graphweave.plans import sequence_queries as Q

    monkeypatch.setattr(Q, "DEALT", 10)
    assert Q._kmers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 20
