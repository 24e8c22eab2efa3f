"""Batches of pairs: nulls among them, and those too large to be taken at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import affine
from seqloom.operators.affine import affine_align
from seqloom.operators.pairwise import align
from seqloom.plans.pairwise_queries import document_script_check

PAIRS = "a string, b string"


def test_pairs_with_a_null_have_no_script(spark):
    made = [("ACGT", "AGT"), (None, "A"), ("A", None), ("é", "e"), (None, None)]
    al = align(F.col("a"), F.col("b"), unit="char")
    found = {(r.a, r.b): (r.al.score, r.al.ops) for r in spark.createDataFrame(made, PAIRS).coalesce(1).select("a", "b", al.alias("al")).collect()}
    none = (None, None)
    assert found == {("ACGT", "AGT"): (1, "MDMM"), (None, "A"): none, ("A", None): none, ("é", "e"): (1, "X"), none: none}
    empty = spark.createDataFrame([(None, None)], PAIRS).select(al.alias("al")).first().al
    assert empty.score is None and empty.ops is None


def test_large_batches_are_sliced(monkeypatch):
    monkeypatch.setattr(affine, "SLICE_SYMBOLS", 10)
    patterns, texts = ["AAAA", "A", "", "C" * 50, "G"], ["AAAA", "AC", "", "C", "T"]
    found = list(affine.slices(patterns, texts))
    assert [p for some, _ in found for p in some] == patterns and [t for _, some in found for t in some] == texts
    assert [len(some) for some, _ in found] == [2, 2, 1] and list(affine.slices([], [])) == []


def test_affine_scripts_of_slices(spark, monkeypatch):
    made = spark.createDataFrame([("ACGTACGT", "ACTACGGT"), ("A" * 30, "A" * 28 + "CC"), ("", "AC")], PAIRS).coalesce(1)
    rows = lambda: sorted(map(tuple, made.select("a", affine_align(F.col("a"), F.col("b")).alias("al")).select("a", "al.*").collect()))
    want = rows()
    monkeypatch.setattr(affine, "SLICE_SYMBOLS", 5)
    assert rows() == want


def test_scripts_are_counted_by_document(spark, tmp_path, capsys):
    docs = [(1, "aé\nae\nbb", "xx"), (2, "abc\nabd", None), (2, "q\nr\ns", "yy"), (3, "alone", "xx"), (None, "a\nb", "xx")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = document_script_check(spark, str(tmp_path))
    assert found.columns == ["lang", "unit", "pairs", "valid", "byte_score"]
    assert {tuple(r) for r in found.collect()} == {
        ("xx", "byte", 2, 2, 4), ("xx", "char", 2, 2, None), (None, "byte", 3, 3, 3), (None, "char", 3, 3, None),
        ("yy", "byte", 3, 3, 3), ("yy", "char", 3, 3, None),
    }
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out.partition("Initial Plan")[2]
    assert plan.count("RoundRobinPartitioning") == 1  # texts are dealt out once
