from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridkin import functions as fn
from gridkin.functions.hashing import PRIME
from gridkin.operators.families import ClassicFamily

IP_CASES = {
    "192.168.1.1": 3232235777,
    "10.0.0.1": 167772161,
    "0.0.0.0": 0,
    "invalid": 0,
    None: 0,
    "": 0,
    "1.2": 16908288,
    "1.2.3.4.5": 16909060,
    "300.1.1.1": 300 * 256**3 + 65536 + 256 + 1,
    " 10.0.0.1 ": 167772161,
    "1d.0.0.1": 1,
    "inf.0.0.0": 0,
    "nan.0.0.2": 2,
    "-5.0.0.0": -5 * 256**3,
}


def test_ip_to_int(spark):
    df = spark.createDataFrame([(k,) for k in IP_CASES], "ip string")
    got = {r.ip: r.n for r in df.select("ip", fn.ip_to_int("ip").alias("n")).collect()}
    assert got == IP_CASES


def test_to_int(spark):
    cases = {"80": 80, "80.7": 80, "x": 0, "": 0, None: 0, " 443 ": 443, "1e3": 1000, "-2.9": -2, "1f": 0}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", fn.to_int("p").alias("n")).collect()} == cases


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 255), min_size=4, max_size=4))
def test_ip_round_trip(spark, parts):
    text = ".".join(map(str, parts))
    value = spark.range(1).select(fn.ip_to_int(F.lit(text)).alias("n")).first().n
    assert list(value.to_bytes(4, "big")) == parts


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=4), st.data())
def test_flatten_round_trip(spark, shape, data):
    coords = [data.draw(st.integers(0, n - 1)) for n in shape]
    cell = fn.flatten([F.lit(c) for c in coords], shape)
    row = spark.range(1).select(cell.alias("cell")).select("cell", *fn.unflatten("cell", shape)).first()
    assert list(row)[1:] == coords


def test_flatten_is_row_major_and_long(spark):
    big = (2048, 2048, 1024)
    row = spark.range(1).select(
        fn.flatten([F.lit(1), F.lit(2), F.lit(3)], (5, 6, 7)).alias("small"),
        fn.flatten([F.lit(2047), F.lit(2047), F.lit(1023)], big).alias("big"),
    ).first()
    assert (row.small, row.big) == (1 * 42 + 2 * 7 + 3, 2**32 - 1)
    with pytest.raises(ValueError):
        fn.flatten([F.lit(0)], (2, 2))
    with pytest.raises(ValueError):
        fn.total_cells((0, 3))


def test_bucket_of_negative_number(spark):
    assert spark.range(1).select(fn.bucket(F.lit(-5), 4).alias("b")).first().b == 3


def test_poly_hash_known_values(spark):
    df = spark.createDataFrame([("ACGTACGTACGT",), ("TTTTTTTTTTTT",)], "s string")
    for length in (None, 12):
        got = [r.h for r in df.select(fn.poly_hash("s", 41, length).alias("h")).collect()]
        assert got == [1330247614, 140564667]


def test_kmers(spark):
    df = spark.createDataFrame([("ACGTNACGTAC",), ("ACG",), ("",)], "s string")
    got = [sorted(r.k) for r in df.select(fn.kmers("s", 4).alias("k")).collect()]
    assert got == [["ACGT", "CGTA", "GTAC"], [], []]


def test_shingles_cover_whole_text(spark):
    words = [f"w{i}" for i in range(5000)]
    df = spark.createDataFrame([(" ".join(words),), ("one two",), (None,)], "t string")
    sizes = [r.n for r in df.select(F.size(fn.shingle_cells("t", 3)).alias("n")).collect()]
    assert sizes == [4998, 0, 0]


def test_premix_matches_kernel_and_permutes(spark):
    family = ClassicFamily(4)
    cells = [0, 1, 2, PRIME - 1, PRIME, PRIME + 1, 2**40, 2**60 + 7]
    got = [r.x for r in spark.createDataFrame([(c,) for c in cells], "cell long")
           .select(fn.premix("cell").alias("x")).collect()]
    import numpy as np

    assert got == family.kernel()._mix(np.array(cells)).tolist()
    sample = family.kernel()._mix(np.arange(200_000))
    assert len(np.unique(sample)) == 200_000


def test_compare_expressions(spark):
    row = spark.range(1).select(
        fn.estimate(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(0))).alias("est"),
        fn.exact_ratio(F.lit(1), F.lit(2), F.lit(2)).alias("third"),
        fn.exact_ratio(F.lit(0), F.lit(0), F.lit(0)).alias("none"),
        fn.similarity_class(F.lit(0.5)).alias("c1"),
        fn.similarity_class(F.lit(0.51)).alias("c2"),
        fn.similarity_class(F.lit(0.2)).alias("c3"),
        fn.pair_label(F.lit("x"), F.lit(7)).alias("p"),
        fn.shape_label(F.array(F.lit(10), F.lit(20))).alias("s"),
    ).first()
    assert row.est == 0.5 and abs(row.third - 1 / 3) < 1e-12 and row.none == 0.0
    assert (row.c1, row.c2, row.c3) == ("MED", "HIGH", "LOW")
    assert (row.p, row.s) == ("x<->7", "10×20")


def test_progress_fields(spark):
    lines = [
        "PROGRESS: 12/250 pairs elapsed=1.0s",
        "DONE: algo=kron load_level=7 elapsed=3.41s mae=0.0210",
        "OOM: algo=minhash",
        "PROGRESS: 3/0 pairs",
        None,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: (r.fraction, r.elapsed_s, r.mae, r.oom)
           for r in df.withColumns(fn.progress_fields("line")).collect()}
    assert got[0] == (12 / 250, None, None, False)
    assert got[1] == (1.0, 3.41, 0.021, False)
    assert got[2] == (0.0, None, None, True)
    assert got[3][0] == 3.0
    assert got[4] == (0.0, None, None, False)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, b int")
    assert fn.clean_names(df, {"a": "x", "zz": "y"}).columns == ["x", "b"]
