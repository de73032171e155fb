"""Which texts the pipeline's near_duplicates stage takes as similar: 80 % of five-word shingles."""

import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def kept_of(spark, rows, place):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in P.near_duplicates(spark, docs, str(place)).collect()}


def test_five_words_at_80_percent(spark, tmp_path):
    """82 of 100 five-word shingles (83 of 101 of four) are enough, 79 of 100 aren't."""
    a, b = ([f"{x}{k}" for k in range(104)] for x in "ab")
    assert kept_of(spark, [(1, " ".join(a)), (2, " ".join(a[:86])), (3, " ".join(b)), (4, " ".join(b[:83]))], tmp_path) == {1, 3, 4}


def test_short_texts_at_80_percent(spark, tmp_path):
    """Four and five shingles: wherever the fifth falls among the hashes."""
    rows = [(2 * k + j, " ".join([f"a{k}w{i}" for i in range(8)] + ["more"] * j)) for k in range(60) for j in range(2)]
    assert kept_of(spark, rows, tmp_path) == {2 * k for k in range(60)}


def test_leaks_without_id_and_of_one_of_two_texts(spark, tmp_path):
    """A leak leaves without an id too, and takes no clean text of its id along."""
    import corpus_pipeline as P
    from tests_prose import prose

    item = prose("en", 30, "leak") + "."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak, clean = f"{prose('de', 40, 1)} {item} {prose('de', 40, 2)}", prose("en", 60, "clean")
    rows = [(None, leak), (None, clean), (5, leak), (5, clean), (6, None), (None, None)]
    rows += [(100 + k, prose("en" if k % 2 else "de", 60, k)) for k in range(60)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != leak], key=str)
