"""BAM files in splits against one pass."""

import random

import pytest

from graphweave.sources import bam as B


def build(n, block, seed=1, order="queryname"):
    rng = random.Random(seed)
    names = [f"c{k}" for k in range(5)]
    out, records = B.encode_header(names, [1000] * 5, order), []
    for _ in range(n):
        q = "".join(rng.choice("abcXYZ0189_:") for _ in range(rng.randrange(1, 20)))
        records.append((q, rng.choice([65, 129, 1089, 0]), rng.randrange(-1, 5), rng.randrange(-1, 10**6), rng.randrange(61), rng.randrange(-1, 5), rng.randrange(-1, 10**6), rng.randrange(300)))
        out += B.encode_record(*records[-1])
    name = lambda k: names[k] if k >= 0 else "*"
    want = [(q, f, name(r), p, mq, name(m), mp, x) for q, f, r, p, mq, m, mp, x in records]
    return b"".join(B.squeezed(out[k : k + block]) for k in range(0, len(out), block)) + B.END, want


def rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("n,block", [(0, 100), (1, 37), (50, 37), (400, 61), (400, 1000), (3000, 5000), (3000, 60000)])
def test_splits_make_up_the_file(tmp_path, n, block):
    """Records across many blocks, blocks across splits, splits without a record."""
    data, want = build(n, block)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(data)
    header = B.read_header(path)
    whole = rows(B.read_split(path, 0, len(data), header))
    assert [r[1:9] for r in whole] == want and all(a[0] < b[0] for a, b in zip(whole, whole[1:], strict=False))
    for parts in (2, 8, 40):
        size, got = -(-len(data) // parts), []
        for a in range(0, len(data), size):
            got += rows(B.read_split(path, a, min(a + size, len(data)), header, step=random.Random(a).choice([1, 500, 1 << 20])))
        assert got == whole


def test_source_and_filters(spark, tmp_path):
    data, want = build(500, 300)
    (tmp_path / "a.bam").write_bytes(data)
    (tmp_path / "b.bam").write_bytes(build(7, 300, 2)[0])
    B.register(spark)
    one = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    split = spark.read.format("bam").option("split", len(data) // 8 + 1).load(str(tmp_path / "a.bam"))
    assert split.rdd.getNumPartitions() == 8
    show = lambda df: sorted(tuple(r) for r in df.collect())
    assert show(one) == show(split) and sorted(r[1:9] for r in show(one)) == sorted(want)
    wanted = [r for r in want if r[1] & 64 and r[2] != r[5] and r[4] >= 20]
    assert sorted(r[1:9] for r in show(split.where("first_read = true and inter = true and mapq >= 20"))) == sorted(wanted)
    assert split.where("first_read and mapq >= 20 and pos < 1000").count() == sum(bool(r[1] & 64) and r[4] >= 20 and r[3] < 1000 for r in want)
    both = spark.read.format("bam").option("inter_only", True).option("first_only", True)
    assert both.load(str(tmp_path)).count() == both.load(f"file://{tmp_path}/*.bam").count() > sum(bool(r[1] & 64) and r[2] != r[5] for r in want)


def test_bad_files(tmp_path):
    (tmp_path / "a.bam").write_bytes(build(5, 100, order="coordinate")[0])
    with pytest.raises(ValueError, match="coordinate"):
        B.read_header(str(tmp_path / "a.bam"))
    data = build(300, 500)[0]
    (tmp_path / "b.bam").write_bytes(data[: len(data) - 40])
    with pytest.raises(ValueError, match="cut off"):
        rows(B.read_split(str(tmp_path / "b.bam"), 0, len(data), B.read_header(str(tmp_path / "b.bam"))))
    (tmp_path / "c.bam").write_bytes(b"no file")
    with pytest.raises(ValueError):
        B.read_header(str(tmp_path / "c.bam"))


def test_written_files_come_back(spark, tmp_path):
    sample = [("r1", 65, "c1", 9, 60, "c2", 69, 1), ("r1", 129, "c2", 69, 60, "c1", 9, 3), ("r2", 65, "*", -1, 0, "c1", 8, 0)] * 900
    df = spark.createDataFrame(sample, "qname string, flag int, rname string, pos long, mapq int, rnext string, pnext long, nm long").repartition(3)
    out = B.write_bam(df, [("c1", 100), ("c2", 80)], f"file://{tmp_path}/out", block=1000)
    assert sum(r.n_rows for r in out.collect()) == len(sample)
    B.register(spark)
    back = spark.read.format("bam").option("split", 700).load(f"file://{tmp_path}/out")
    assert sorted(tuple(r)[1:9] for r in back.collect()) == sorted(sample)


def test_many_splits_take_few_tasks_and_headers(spark, tmp_path, monkeypatch):
    """The header has a name for each contig: reading it in each of many splits grows with the square of the table."""
    data, want = build(3000, 500)
    (tmp_path / "a.bam").write_bytes(data)
    whole = B.BamReader({"path": str(tmp_path), "split": str(len(data) // 50)})
    monkeypatch.setattr(B, "TASKS", 7)
    reader = B.BamReader({"path": str(tmp_path), "split": str(len(data) // 50)})
    pieces = reader.partitions()
    assert len(pieces) <= 7 and (pieces[0].start, pieces[-1].end) == (0, len(data)) and all(a.end == b.start for a, b in zip(pieces, pieces[1:], strict=False))
    headers, read = [], B.read_header
    monkeypatch.setattr(B, "read_header", lambda path: headers.append(path) or read(path))
    got = [r for p in pieces for r in rows(reader.read(p))]
    assert [r[1:9] for r in got] == want and len(headers) == 1
    monkeypatch.setattr(B, "TASKS", 1024)
    assert len(whole.partitions()) > 49 and [r for p in whole.partitions() for r in rows(whole.read(p))] == got
