
import pytest

from graphweave.sources import formats as X


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">c1 some words\nacgt\nGATC\n\n>c2 collapsed > x\nAAAA\n>c1 later\nGATCGATC\n")
    f = X.read_fasta(spark, p, ["GATC"])
    assert rows(f, "ctg", "seq", "len", "re_sites") == [("c1", "GATCGATC", 8, 3), ("c2", "AAAA", 4, 1)]
    assert rows(X.evaluation_lengths(f), "ctg", "len") == [("c1", 8)]
    with pytest.raises(ValueError):
        X.read_fasta(spark, put(tmp_path / "e.fa", "\n"), strict=True)
    with pytest.raises(ValueError):
        X.read_fasta(spark, put(tmp_path / "h.fa", "ACGT\n>c\nAC\n"), strict=True)


def test_pairs_and_sam(spark, tmp_path):
    p = put(tmp_path / "a.pairs", "# head\n\nr1\tc1\t10\tc2\t70\t+\t-\nr2 c1 5 c1 9 + +\n")
    assert rows(X.read_pairs(spark, p), "read", "ref", "pos", "mref", "mpos") == [("r1", "c1", 9, "c2", 69), ("r2", "c1", 4, "c1", 8)]
    assert X.read_pairs(spark, p, inter_only=True).count() == 1
    s = X.read_sam(spark, put(tmp_path / "a.sam", "@HD\tVN:1\tSO:queryname\nr\t65\tc1\t10\t60\t4M\t=\t20\t0\tACGT\t*\tNM:i:2\nr\t1153\tc1\t20\t60\t4M\tc2\t10\t0\tACGT\t*\n"))
    assert rows(s, "flag", "nm", "rnext", "duplicate") == [(65, 2, "c1", False), (1153, 0, "c2", True)]
    assert rows(X.sam_contacts(s), "ref", "pos", "mref", "mpos") == [("c1", 9, "c1", 19)]
    assert X.sorting_order(spark.createDataFrame([("@HD\tVN:1\tSO:queryname",)], "line string")) == "queryname"
    with pytest.raises(ValueError):
        X.sorting_order(spark.createDataFrame([("@HD\tVN:1\tSO:coordinate",)], "line string"))


def test_groups_and_graphs(spark, tmp_path):
    g = X.read_clusters(spark, put(tmp_path / "c.txt", "#Group\tnContigs\tContigs\ng1\t2\ta b\ng2\t1\tc\n"))
    assert rows(g, "grp", "ctg") == [("g1", "a"), ("g1", "b"), ("g2", "c")]
    lens = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "ctg string, len long")
    assert rows(X.long_groups(g, lens, 8), "ctg") == [("a",), ("b",)]
    X.write_clusters(g, lens, str(tmp_path / "out"))
    assert rows(X.read_clusters(spark, str(tmp_path / "out")), "grp", "ctg") == rows(g, "grp", "ctg")
    s = X.read_gfa(spark, [put(tmp_path / "a.gfa", "H\tx\nS\ta\t*\tLN:i:5\trd:i:9\nS\tb\t*\tLN:i:9\trd:i:1\nS\tq\t*\tLN:i:1\trd:i:1\n")])
    assert rows(X.check_gfa(s, lens), "ctg", "reason") == [("b", "length"), ("c", "missing"), ("q", "extra")]
    a = X.read_assembly(spark, put(tmp_path / "x.assembly", ">a 1 5\n>b 2 6\n>c 3 7\n1 -2\n3\n"))
    assert rows(a, "grp", "pos", "ctg", "orient") == [(1, 1, "a", "+"), (1, 2, "b", "-"), (2, 1, "c", "+")]
    put(tmp_path / "group_chr1.txt", "#Contig\tRECounts\tLength\nchr1_1_7_1_2_-\t3\t9\n")
    assert rows(X.read_truth(spark, str(tmp_path / "group_chr1.txt")), "src", "idx", "orient") == [("chr1", 7, "-")]
    assert rows(X.count_files(spark, str(tmp_path), "*.gfa"), "n") == [(1,)]


def test_clm(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", "+-", 4, "1 1 7 7")], "i string, j string, ori string, n long, line string")
    X.write_clm(d, str(tmp_path / "clm"))
    assert [tuple(r) for r in X.read_clm(spark, str(tmp_path / "clm")).collect()] == [("a", "b", "+-", 4, [1, 1, 7, 7])]


def test_tours_agp_paf(spark, tmp_path):
    put(tmp_path / "group1_x.tour", ">INIT\na+ b-\n\nb+ a-\n\n")
    assert rows(X.read_tours(spark, str(tmp_path / "*.tour")), "grp", "pos", "ctg", "orient") == [("group1", 1, "b", "+"), ("group1", 2, "a", "-")]
    agp = X.read_agp(spark, put(tmp_path / "a.agp", "s\t1\t100\t1\tW\tc1\t1\t100\t+\ns\t101\t200\t2\tU\t100\tscaffold\tyes\tx\ns\t201\t280\t3\tW\tc2\t1\t80\t-\n"))
    truth = spark.createDataFrame([("p", "c1", 1, "+")], "src string, ctg string, idx int, orient string")
    assert rows(X.agp_members(agp, truth), "pos", "ctg", "len", "orient", "src") == [(1, "c1", 100, "+", "p"), (2, "c2", 80, "-", None)]
    X.write_agp(agp, str(tmp_path / "agp"))
    assert X.read_agp(spark, str(tmp_path / "agp")).where("type = 'W'").count() == 2
    paf = put(tmp_path / "a.paf", "q1\t10\t0\t9\t+\tr1\t20\t1\t10\t8\t9\t60\ttp:A:P\tde:f:0.5\nq2\t5\n")
    out = X.read_paf(spark, paf).orderBy("queryID").collect()
    assert out[0].lenAln == 9 and out[1].refID is None
    assert X.filter_paf_lines(spark, paf, ["q1"]).first().numResidueMatches in (4, 5)
    ann = X.read_annotation(spark, put(tmp_path / "k.tsv", "contig\tstart\tend\tprimary_source\talpha\tstatistics\nc\t1\t9\thap1\t0.5\t{'hap1': 3, 'shared': 2}\n")).first()
    assert ann.stats == {"hap1": 3, "shared": 2}
    assert X.read_name_set(spark, put(tmp_path / "n.txt", "a\na\n\nb\n")).count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from graphweave.streaming.contacts import run_to_memory, streaming_edges

    data = spark.createDataFrame([("a", "b", k, 3 * k) for k in range(7)] + [("c", "a", 1, 2)], "ref string, mref string, pos long, mpos long")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_to_memory(stream, "edge_counts", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(spark.table("edge_counts"), "i", "j", "links") == rows(streaming_edges(data), "i", "j", "links") == [("a", "b", 7), ("a", "c", 1)]
