"""Cases that once were dropped, and sessions that change between two reads."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridkin.llm import bpe, language_id, mixing, quality_classifier, quality_rules, queries, secret_scan, token_counts

SF = "/root/testdata/sf0.001"
ENTRY = Path(__file__).resolve().parents[2] / "__spark_entry__.py"


def test_token_counts_when_the_cores_change(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(400)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    write = token_counts.write_token_files

    def then_change(*args, **kwargs):
        write(*args, **kwargs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")

    token_counts.write_token_files = then_change
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        found = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(table).collect()}
    finally:
        token_counts.write_token_files = write
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    encoding = token_counts._encoding(public_tokenizers.path(token_counts.VOCABULARY))
    assert found == {i: len(encoding.encode_ordinary("word " * (i % 50))) for i in range(400)}
    assert spark.conf.get(token_counts._SPLITS, None) is None


def test_token_counts_that_do_not_fit_are_an_error(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string")
    write = token_counts.write_token_files
    monkeypatch.setattr(token_counts, "write_token_files", lambda d, folder: write(d.where("doc_id < 39"), folder))
    with pytest.raises(RuntimeError, match="dealt out"):
        token_counts.document_token_counts(docs)
    monkeypatch.undo()
    assert token_counts.document_token_counts(docs.limit(0)).count() == 0


def test_words_of_any_length_are_learned_from():
    """Expectation over a long word equals that of the short form, and an unspaced language is learned."""
    pieces = language_id.pieces_of(public_tokenizers.path(language_id.VOCABULARY))
    rng = np.random.default_rng(0)
    counts = Counter({"▁" + "".join(rng.choice(list("abcdeinrst漢"), n)): int(n) for n in range(3, 30)})
    short = language_id.learn_language(counts, pieces, 2)
    kept = language_id.SHORT
    try:
        language_id.SHORT = 5
        long = language_id.learn_language(counts, pieces, 2)
    finally:
        language_id.SHORT = kept
    assert np.allclose(short, long)
    text = "▁" + "日本語東京大学" * 30
    p = language_id.learn_language(Counter({text: 5}), pieces)
    seen = [pieces.number[c] for c in set("日本語東京大学") if c in pieces.number]
    assert seen and p[seen].max() > 100 / pieces.unknown


def test_long_labelled_texts_are_learned_from(spark):
    words = quality_classifier.PASSAGE * quality_classifier.SAMPLE_PASSAGES
    good, bad = "calm words of prose here " * (words // 4), "# $$$ !!! ### " * (words // 3)
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality_classifier.learn(docs, labels)
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert min(scores[i] for i in (1, 3)) > 0.7 > 0.3 > max(scores[i] for i in (0, 2))


def test_attention_over_passages_by_hand():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["one", "two", "#x", "Three!"], n)) for n in (1, 64, 65, 500)] + [""]
    x, counts = quality_classifier.PassageEncoder()(texts)
    model = quality_classifier.fit(x, counts, np.array([0, 1, 0, 1, 0.0]), rounds=20)
    w, start = model.weights, 0
    for n, p in zip(counts, model.score(x, counts), strict=True):
        z = (x[start : start + n] - model.mean) / model.scale
        start += n
        h = [np.tanh(sum(r[i] * w["w"][i] for i in range(len(r))) + w["b"]) for r in z]
        a = np.array([sum(np.tanh(v @ w["v"]) * (1 / (1 + np.exp(-(v @ w["u"])))) * w["g"]) for v in h])
        a = np.exp(a) / np.exp(a).sum()
        total = sum(share * v for share, v in zip(a, h, strict=True))
        assert np.isclose(p, 1 / (1 + np.exp(-(total @ w["c"] + w["d"]))))


def test_repeated_words_by_both_forms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 3, 4, 30, 200)] + ["x y z " * 40, "same " * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    repeated = lambda: docs.select("doc_id", quality_rules.text_stats(F.col("text"))["n_repeat_words"].alias("n"))
    want = sorted(map(tuple, repeated().collect()))
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 2)  # every text of more than three words is too long for the fast form
    assert sorted(map(tuple, repeated().collect())) == want
    monkeypatch.setattr(quality_rules, "_window_hash", lambda words, i: F.lit(7).cast("long"))
    assert sorted(map(tuple, repeated().collect())) == want
    by_hand = []
    for i, t in enumerate(texts):
        w = t.split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        by_hand.append((i, len(covered)))
    assert want == by_hand


def test_verdict_equals_the_rules():
    """The conditional expression and the plain conjunctions agree; see the fixture of statistics."""
    rules = [(quality_rules.Condition(0, True, 5.0), quality_rules.Condition(1, False, 2.0)), (quality_rules.Condition(2, True, 0.5),)]
    rows = [(n, n * c, s) for n in (3, 6, 9) for c in (1, 2, 4) for s in (0, 4)]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    stats = [(n, c, s, 0, 0, 1) for n, c, s in rows]
    schema = ", ".join(f"{name} long" for name in quality_rules.STATS)
    df = spark.createDataFrame(stats, schema).select(F.struct(*quality_rules.STATS).alias("s"))
    got = df.select(quality_rules.verdict(F.col("s"), rules).alias("kept"), "s.*", *[v.alias(k) for k, v in quality_rules.features(F.col("s")).items() if k != "n_words"]).collect()
    for r in got:
        values = [float(r["n_words"]), *[r[f] for f in quality_rules.FEATURES[1:]]]
        assert r["kept"] == (not any(quality_rules._covers(rule, values) for rule in rules))
    assert {r["kept"] for r in got} == {True, False}


def test_frequent_words_are_about_as_many_as_wanted(spark):
    counts = spark.range(1, 5001).selectExpr("concat('w', id) AS word", "cast(5000 / id as bigint) AS n")
    for wanted in (10, 100, 1000, 4000, 10_000):
        words = {r.word for r in bpe.frequent_words(counts, wanted).collect()}
        assert min(wanted, 5000) * 0.8 - 5 <= len(words) <= wanted * 1.2 + 5
        assert wanted < 100 or {f"w{i}" for i in range(1, wanted // 3)} <= words
    assert bpe.frequent_words(counts.limit(0), 10).count() == 0


def test_letter_pairs_of_texts_cut_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab c\né漢"), n)) for n in (0, 1, 2, 50, 500)] + [None]
    want = Counter()
    for t in texts:
        kept = [c for c in (t or "") if 0x20 < ord(c) < 0x80]
        want.update(ord(a) << 8 | ord(b) for a, b in zip(kept, kept[1:], strict=False))
    import pyarrow as pa

    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(secret_scan, "PIECE", piece)
        batch = pa.record_batch({"text": pa.array([t or "" for t in texts])})
        found = pa.Table.from_batches(list(secret_scan._pairs(iter([batch.slice(1), batch.slice(0, 1)]))))
        assert dict(zip(*[c.to_pylist() for c in found.columns], strict=True)) == dict(want)


def test_battery_accepts_planted_keys_and_no_words(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    words = ["the", "river", "house", "under", "people", "winter", "garden", "story", "market"]
    docs = []
    for i in range(300):
        prose = " ".join(rng.choice(words, 60))
        key = "".join(rng.choice(letters, 64)) if i < 60 else "".join(rng.choice(words, 14))
        docs.append((i, f"{prose} {key} {prose}"))
    found = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum("random" in found[i] for i in range(60)) >= 54
    assert sum("random" in found[i] for i in range(60, 300)) == 0


@pytest.mark.parametrize("name", ["op1_topk", "op10_language_id", "op9_jaccard_join"])
def test_first_query_of_a_process_in_another_folder(tmp_path, name):
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", "{ENTRY}")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["{name}"](spark, "{SF}").count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-1500:]


def test_mix_comes_near_its_targets_beside_clashing_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.pareto(1.2) * 20 + 1)), f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("x") for c in ("s", "first", "rate", "offset", "of", "wanted", "t0", "place", "order", "target", "copies")}
    )
    mixed = mixing.mix(docs)
    taken = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"), F.max("size").alias("m"))
    far = [abs(r.n - r.t) / r.t for r in taken.collect()]
    assert max(far) < 0.1, far
    assert mixed.agg(F.max("copies")).first()[0] <= 3
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, mixed.select("doc_id", "copies").collect()))
    assert set(mixing.mixed_documents(docs).columns) == set(docs.columns)


def test_every_query_has_a_name_and_most_have_sql():
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
