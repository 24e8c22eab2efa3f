import random

import pytest
from brute import levenshtein, replay
from pyspark.sql import functions as F

from seqloom.functions import cigar, maths, stats, symbols, text
from seqloom.functions.timing import Stopwatch, observed
from seqloom.operators.numbering import number_within
from seqloom.operators.pairwise import align, align_wavefront, edit_distance
from seqloom.operators.pograph import star_graph
from seqloom.operators.skew import spread_join
from seqloom.session import materialise
from seqloom.streaming.growth import run_path_growth, run_path_growth_in_steps, stream_of
from test_graphs import random_star_sequences, rows


def test_number_within_spreads_a_heavy_key(spark):
    rng = random.Random(1)
    data = [(1 if rng.random() < 0.6 else rng.randint(2, 9), i) for i in rng.sample(range(5000), 3000)]
    numbered = number_within(spark.createDataFrame(data, "k long, at long"), ["k"], ["at"])
    want = []
    for key in {k for k, _ in data}:
        want += [(key, at, pos) for pos, at in enumerate(sorted(a for k, a in data if k == key))]
    assert rows(numbered, "k", "at", "pos") == sorted(want)


def test_spread_join_equals_the_plain_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i % 7, i) for i in range(200)], "k long, id long")
    right = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    spread = spread_join(left, right, "k", "id", hot_rows=20)
    assert rows(spread, "k", "id", "v") == rows(left.join(right, "k"), "k", "id", "v")


TEXTS = ["", "a", "kitten", "sitting", "héllo wörld", "hello world", "x" * 300 + "é", "y" + "x" * 290]


def test_distances_in_bytes_and_characters(spark):
    couples = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame(couples, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        "a", "b", text.distance(a, b).alias("bytes"), text.distance(a, b, "char").alias("chars"),
        edit_distance(a, b).alias("any"), text.distance_within(a, b, 3).alias("near"),
        align(a, b).alias("al"), align_wavefront(a, b, unit="char")["score"].alias("wave"),
    ).collect()
    for r in got:
        by_byte, by_char = levenshtein(r.a.encode(), r.b.encode()), levenshtein(r.a, r.b)
        assert (r.bytes, r.any, r.chars, r.wave) == (by_byte, by_byte, by_char, by_char)
        assert r.near == (by_byte if by_byte <= 3 else None)
        assert r.al.score == by_byte == replay(r.a.encode(), r.b.encode(), r.al.ops)


def test_cigar_algebra(spark):
    df = spark.createDataFrame(
        [("MMXID", "ABCE", "ABDF"), ("MMMM", "ABCD", "ABXD"), ("MM", "ABCD", "ABX"), ("M?M", "AB", "AB"), ("", "", "")],
        "ops string, p string, t string",
    )
    ops, p, t = F.col("ops"), F.col("p"), F.col("t")
    got = df.select(
        cigar.edit_score(ops).alias("score"), cigar.is_valid(ops, p, t).alias("valid"),
        cigar.compact(ops).alias("text"), cigar.pretty(ops, p, t).alias("drawn"),
        F.when(ops.rlike("^[MXID]*$"), cigar.refine(ops, p, t)).alias("refined"),
        cigar.compare(ops, F.lit("MMXIM")).alias("compared"),
        cigar.leading(ops, F.lit(1), F.lit(2)).alias("led"), cigar.matches(ops).alias("matches"),
    ).collect()
    assert [r.score for r in got] == [3, 0, 0, None, 0]
    assert [r.valid for r in got] == [True, False, False, False, True]
    assert got[0].text == "2M1X1I1D" and got[0].led == "DDIMMXID" and got[0].matches == 2
    assert [r.compared for r in got] == [ord("D") - ord("M"), -1, -3, -2, -5]
    assert [r.refined for r in got[:3]] == ["MMXID", "MMXM", "MMDDI"]
    assert tuple(got[0].drawn) == ("ABC-E", "||   ", "ABDF-")
    assert tuple(got[1].drawn) == ("ABCD", "||X|", "ABXD")
    assert tuple(got[2].drawn) == ("ABCD", "||??", "ABX")


def test_scripts_in_both_units(spark):
    df = spark.createDataFrame(
        [("é", "e"), ("naïve", "naive"), ("漢字x", "x漢字"), ("", "é"), ("ab", "ab"), (None, "x")], "a string, b string"
    )
    a, b = F.col("a"), F.col("b")
    for unit in ("byte", "char"):
        al = df.withColumn("ops", align(F.coalesce(a, F.lit("")), b, unit=unit)["ops"])
        got = al.select(
            "a", "b", "ops", cigar.is_valid(F.col("ops"), a, b, unit).alias("valid"),
            cigar.refine(F.lit(""), a, b, unit).alias("plain"), cigar.pretty(F.col("ops"), a, b, unit).alias("drawn"),
            cigar.compare(a, b, unit).alias("compared"),
        ).collect()
        assert [r.valid for r in got] == [True] * 5 + [None] and got[5].plain is None and got[5].drawn.ops is None
        for r in got[:5]:
            size = (lambda s: len(s.encode())) if unit == "byte" else len
            assert r.plain == "D" * size(r.a) + "I" * size(r.b)
            assert unit == "byte" or r.drawn.pattern.replace("-", "") == r.a and r.drawn.text.replace("-", "") == r.b
    assert got[1].compared == ord("ï") - ord("i")


def test_numbers_within_null_keys(spark):
    from seqloom.operators.numbering import number_within

    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)] + [("b", 1)], "k string, i long")
    got = number_within(df.repartition(5), ["k"], ["i"]).collect()
    assert len(got) == 101 and all(r.pos == (r.i if r.k != "b" else 0) for r in got)


def test_fold_and_refine_keep_the_distance(spark):
    rng = random.Random(2)
    couples = [("".join(rng.choices("ab", k=rng.randint(0, 9))), "".join(rng.choices("ab", k=rng.randint(0, 9))))
               for _ in range(40)]
    df = spark.createDataFrame(couples, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", text.distance_by_fold(a, b).alias("d"), align(a, b)["ops"].alias("ops")).collect():
        assert r.d == levenshtein(r.a, r.b) == replay(r.a, r.b, r.ops)


def test_combined_counters_equal_one_counter(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("x"), (F.col("id") % 7).alias("k"))
    whole = stats.counter(df, "x").first()
    merged = stats.combine(stats.counter(df, "x", "k")).first()
    for name in ("total", "samples", "min", "max"):
        assert whole[name] == merged[name]
    for name in ("mean", "variance", "stddev"):
        assert whole[name] == pytest.approx(merged[name])
    assert stats.counter(df.limit(1), "x").first().variance == 0


def test_counters_of_large_values_keep_their_spread(spark):
    df = spark.range(8).select((F.col("id") + 10**9).alias("x"), (F.col("id") % 2).alias("k"), F.lit(1).alias("one"))
    parts = stats.counter(df, "x", "k", "one")
    assert stats.combine(parts).first().variance == pytest.approx(6.0)
    assert stats.combine(parts, "one").first().variance == pytest.approx(6.0)
    assert stats.combine(parts.withColumn("one", F.lit(None).cast("int")), "one").first().variance == pytest.approx(6.0)


def test_whole_division_is_exact(spark):
    top = 2**63 - 1
    row = spark.range(1).select(
        maths.divide_down(F.lit(2**60 + 1), F.lit(3)).alias("a"), maths.divide_down(F.lit(2**53 + 1), F.lit(1)).alias("b"),
        maths.divide_up(F.lit(2**60 + 1), F.lit(3)).alias("c"), maths.divide_up(F.lit(top), F.lit(top)).alias("d"),
        maths.divide_up(F.lit(5), F.lit(0)).alias("e"), stats.scaled_count(F.lit(2**60 + 1)).alias("f"),
        stats.hundredths(F.lit(top), 1).alias("g"), stats.hundredths(F.lit(1999), 1000).alias("h"),
        stats.hundredths(F.lit(995_000 + 999), 1000).alias("i"),
    ).first()
    assert tuple(row) == ((2**60 + 1) // 3, 2**53 + 1, -(-(2**60 + 1) // 3), 1, 0, f"{(2**60 + 1) // 10**9}G", f"{top}.00", "2.00", "996.00")


def test_small_helpers(spark):
    row = spark.range(1).select(
        maths.bounded_add(F.lit(7), F.lit(5), F.lit(10)).alias("add"),
        maths.bounded_subtract(F.lit(3), F.lit(5), F.lit(0)).alias("sub"),
        maths.percentage(F.lit(1), F.lit(0)).alias("none"),
        maths.divide_up(F.lit(7), F.lit(2)).alias("up"),
        maths.divide_down(F.lit(7), F.lit(0)).alias("zero"),
        maths.random_int(3, 5, 1).between(3, 5).alias("random"),
        maths.pattern_row(F.lit(5), maths.diagonal(F.lit(5), F.lit(2))).alias("v"),
        symbols.base_index(F.lit("g")).alias("g"), symbols.base_index(F.lit("n")).alias("n"),
        symbols.base_index(F.lit("\x02")).alias("raw"), symbols.hex_digit(F.lit("b")).alias("hex"),
        stats.scaled_whole(F.lit(12345)).alias("k"), stats.duration_text(F.lit(1575)).alias("us"),
    ).first()
    assert tuple(row) == (10, 0, 0.0, 4, 0, True, 2, 2, 4, 2, 11, "12.35K", "1.58 us")


def test_stopwatch_and_observed_counter(spark):
    watch = Stopwatch()
    for _ in range(2):
        watch.start()
        watch.pause()
        watch.resume()
        watch.stop()
    assert len(watch.samples) == 2 and watch.total >= 0
    df, seen = observed(spark.range(10), F.col("id"), "ids")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["total"] == 45 and seen.get["samples"] == 10


def test_streamed_growth_equals_the_batch_graph(spark):
    sequences = random_star_sequences(spark, seed=9)
    written = materialise(sequences.repartition(1), "stream")
    streamed = run_path_growth(stream_of(spark, written))
    batch = star_graph(sequences).paths
    columns = ("graph_id", "seq_rank", "pos", "node_id")
    assert rows(streamed, *columns) == rows(batch, *columns)


def test_growth_goes_on_from_its_state(spark):
    sequences = materialise(random_star_sequences(spark, seed=10), "stream")
    ranks = sorted({r.seq_rank for r in sequences.select("seq_rank").collect()})
    grown = run_path_growth_in_steps([sequences.filter(F.col("seq_rank") == rank) for rank in ranks])
    columns = ("graph_id", "seq_rank", "pos", "node_id")
    assert len(ranks) > 2 and rows(grown, *columns) == rows(star_graph(sequences).paths, *columns)
