"""The operations of the package against brute force, on edge cases and on the small tables."""

from __future__ import annotations

import collections
import hashlib
import re
from pathlib import Path

import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridkin.llm import (
    bpe,
    jaccard_join,
    language_id,
    mixing,
    quality_classifier,
    quality_rules,
    queries,
    quotation,
    secret_scan,
    token_counts,
    topk,
)
from gridkin.llm.lexicon import Lexicon, write_lexicon

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, "a", "en"),
    (2, "", "a", "en"),
    (3, "one two three four one two three", "b", None),
    (3, "one two three four one two three", "b", None),
    (4, "A b c <|endoftext|> it's İſ 漢 42", None, "de"),
    (None, "token = abcdef0123456789 and AKIA" + "Q7" * 10, "a", "en"),
    (5, LONG, "c", "en"),
    (6, LONG + " more", "c", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns named like results."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"size": F.lit("x"), "ids": F.lit(1), "score": F.lit(2)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = oracle.connect(SF)
    assert oracle.spark_result(queries.QUERIES[name](spark, SF)) == oracle.sql_result(con, queries.SQL[name])


def test_topk_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan"), 1.0]), (63, [1.0]), (None, [1.0, 1.0])]
    rows += [(0, [1.0, 0.0]), (1, [9.0, 9.0]), (10, [1.0, 9.0])]  # ids on two rows: all are candidates and queries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("id", "vec", "score", "rank", "row", "query")}
    )
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 10 == 0, 5).collect())
    ok = [(i, np.floor(256 * np.array(v))) for i, v in [*rows[:60], *rows[-3:]]]
    want = []
    for at, (q, v) in enumerate(ok):
        if q % 10 == 0:
            best = sorted((-int(v @ w), i) for j, (i, w) in enumerate(ok) if j != at)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0, 5).count() == 0
    long = spark.createDataFrame([(i, [float(i)] * 50_000) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(long, F.col("id") == 0, 2).orderBy("rank").collect()] == [1, 2]
    big = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(big, F.col("id") == 0, 2).collect()


def test_token_files_across_blocks(spark, tmp_path):
    sep = token_counts.SEPARATOR
    streams = [[5] * 7 + [sep, sep] + [6] * 40 + [sep] + [7] * 3, [sep], [1] * 33]
    (tmp_path / "t").mkdir()
    for i, s in enumerate(streams):
        (tmp_path / "t" / f"f{i}").write_bytes(np.array(s, "<u2").tobytes())
    for block in (2, 6, 16, 1 << 20):
        got = token_counts.token_counts(spark, str(tmp_path / "t"), block=block).collect()
        assert sorted((r.file[-2:], r.document, r.n_tokens) for r in got) == [
            ("f0", 0, 7), ("f0", 1, 0), ("f0", 2, 40), ("f0", 3, 3), ("f1", 0, 0), ("f2", 0, 33),
        ]


def test_token_counts_of_documents(docs, odd):
    encoding = token_counts._encoding(public_tokenizers.path(token_counts.VOCABULARY))
    for df in (docs, odd):
        want = sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or ""))) for r in df.collect())
        assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.document_token_counts(df).collect()) == want


def test_bpe_equals_the_library(spark, docs, odd, none):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    lexicon = bpe.ship_lexicon(bpe.word_counts(docs), 500)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd, none):
        want = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((str(r.doc_id), len(ids), sha(" ".join(map(str, ids))), sha(text)))
        got = bpe.round_trip_digests(df, lexicon).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    back = bpe.decode(bpe.encode(docs, lexicon=lexicon)).select("doc_id", "text").collect()
    assert len(back) == docs.count() and "ids" in bpe.encode(odd).columns


def test_lexicon(tmp_path):
    entries = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["nation", "station", "a", "an", "ration"])}
    write_lexicon(tmp_path / "x", entries)
    lexicon = Lexicon(str(tmp_path / "x"))
    words = [*entries, b"", b"nat", b"nations", b"zzz"]
    place = lexicon.positions(words)
    assert (place[5:] == -1).all()
    for word, p in zip(entries, place, strict=False):
        assert lexicon.outputs(np.array([p]))[0].tolist() == entries[word]


def test_secret_base_spans(docs, odd, none):
    def brute(text):
        out = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

    for df in (docs, odd, none):
        want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text or "").encode()).hexdigest()) for r in df.collect())
        got = secret_scan.secrets(df).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    kept = {r.doc_id: r for r in secret_scan.redact(odd).collect()}
    assert kept[None].text == "[secret] and [secret]" and kept[1].text is None and kept[5].text == LONG


def test_quotation_levels_and_order(spark):
    rows = [
        (1, 0, "user", "How are you?"),
        (1, 1, "assistant", "> how  ARE you?\n\nFine."),
        (1, 2, "user", ">> How are you?\n> Fine.\nGood."),
        (1, 3, "user", "On Monday x wrote:\n> How are you?\nAlso asked."),
        (1, 4, "user", "> nobody said this\nNew."),
        (2, 0, "user", None),
        (None, 0, "user", "> How are you?\nNo thread."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").union(
        spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string")
    )
    got = {(r.conv_id, r.turn): (r.root, r.depth, r.parent, r.text) for r in quotation.conversations(df).collect()}
    assert got == {
        (1, 0): (0, 0, None, "How are you?"),
        (1, 1): (0, 1, 0, "Fine."),
        (1, 2): (0, 2, 1, "Good."),
        (1, 3): (0, 1, 0, "Also asked."),
        (1, 4): (4, 0, None, "New."),
        (2, 0): (0, 0, None, ""),
        (None, 0): (0, 0, None, "No thread."),
    }
    assert quotation.conversations(df.limit(0)).count() == 0


def test_mixing_targets(spark, docs, odd, none):
    size = lambda t: len(WORD.findall(t or ""))
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        sizes = collections.Counter()
        for r in df.collect():
            sizes[r.source] += size(r.text)
        names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
        target, open_ = dict.fromkeys(names, 0.0), set(names)
        left = float(sum(sizes.values()))
        while left > 1e-6 and open_:
            share = left / sum(weight[s] for s in open_)
            for s in open_:
                target[s] += share * weight[s]
            left = sum(max(target[s] - 3 * sizes[s], 0) for s in names)
            target = {s: min(t, 3.0 * sizes[s]) for s, t in target.items()}
            open_ = {s for s in open_ if target[s] < 3 * sizes[s]}
        taken, largest = collections.Counter(), collections.Counter()
        for r in got:
            assert r["size"] == size(r.text) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
            assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
            taken[r.source] += r.copies * r["size"]
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in names)
        again = sorted((str(r.doc_id), r.copies) for r in mixing.mix(df).collect())
        assert again == sorted((str(r.doc_id), r.copies) for r in got)
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_quality_statistics(docs, odd, none, labels):
    for df in (docs, odd, none):
        want = []
        for r in df.collect():
            text = r.text or ""
            w = WORD.findall(text)
            seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
            want.append((str(r.doc_id), *n, len(w) < 50 or 100 * len(covered) > 50 * len(w)))
        got = quality_rules.quality(df, []).collect()
        assert sorted((str(r.doc_id), *r[1:6], r.base_failed) for r in got) == sorted(want)
        assert all(r.kept != r.base_failed for r in got)
    rules = quality_rules.learned_rules(docs, labels)
    assert quality_rules.kept_documents(odd, rules).columns == odd.columns
    assert quality_rules.learned_rules(none, labels) == []


def test_learned_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    rows = rng.random((600, len(quality_rules.FEATURES)))
    low = (rows[:, 2] > 0.7) & (rows[:, 4] > 0.5)
    rules = quality_rules.learn_list(rows.tolist(), low.tolist())
    found = [any(quality_rules._covers(r, row) for r in rules) for row in rows]
    assert np.mean(np.array(found) == low) > 0.97


def _components(rows):
    sets, root = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else ({tuple(w)} if w else set())
        root[i] = i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return sorted((i, len(sets[i]), root[i]) for i in ids)


@pytest.mark.parametrize("boundary", [None, 8, 24])
def test_jaccard_components(spark, docs, monkeypatch, boundary):
    """Light, heavy and mixed pairs around all sizes, against all pairs."""
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda sizes: boundary)
    rng = np.random.default_rng(boundary or 1)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    for n in (1, 2, 3, 9, 11, 12, 13, 20, 21, 22, 23, 26, 30, 45, 90, 200):
        words = [f"q{n}x{i}" for i in range(n)]
        for _ in range(4):
            cut = words[: n - int(rng.integers(0, max(n // 12, 1) + 1))]
            rows.append((100_000 + len(rows), " ".join(cut)))
    rows += [(200_000, None), (200_001, ""), (200_002, "Q9X0 q9x1")]
    got = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == _components(rows)


def test_one_of_each_group(odd, none):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert jaccard_join.one_of_each(none).count() == 0 and jaccard_join.linked_components(none).count() == 0


def test_segmentations_are_summed():
    pieces = language_id.pieces_of(public_tokenizers.path(language_id.VOCABULARY))
    rng = np.random.default_rng(2)
    p = np.append(rng.random((pieces.none, 2)), np.zeros((1, 2)), 0)
    for word in ("▁the", "▁tion漢a", "▁antion"):
        def total(at, word=word):
            if at == len(word):
                return np.ones(2)
            out = np.zeros(2)
            for end in range(at + 1, len(word) + 1):
                number = pieces.number.get(word[at:end], pieces.unknown if end == at + 1 else None)
                if number is not None:
                    out = out + p[number] * total(end)
            return out

        fast = language_id.forward(pieces.lattice([word, word]), p)[-1, 0]
        np.testing.assert_allclose(fast, total(0))
        np.testing.assert_allclose(np.exp(language_id.forward_long(pieces.edges(word), np.log(p + 1e-300))), total(0))


def test_languages_of_held_out_documents(docs, odd, none):
    model = language_id.learn(docs)
    held = language_id.predict(docs, model).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[5].score > 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.learn(none)).collect()} == {"und"}


def test_classifier_on_held_out_documents(docs, labels, odd, none):
    model = quality_classifier.learn(docs, labels)
    held = quality_classifier.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.8
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, model).collect())
    flat = quality_classifier.learn(none, labels)
    assert {r.score for r in quality_classifier.score(odd, flat).collect()} == {0.5}


def test_attention_gradients():
    rng = np.random.default_rng(4)
    counts, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(8, quality_classifier.FEATURES))
    w = quality_classifier.fit(x, counts, y, rounds=1).weights

    def loss(w):
        p = quality_classifier._run(x, counts, w)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in quality_classifier._gradients(x, counts, y, w).items():
        at = tuple(0 for _ in np.shape(g))
        up, down = ({k: np.array(v, float) for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        assert np.asarray(g)[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-3, abs=1e-7)


def test_pipeline_stages(spark, odd, docs):
    frame = docs.limit(150)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
            assert stage(spark, odd, SF).columns == odd.columns
            assert stage(spark, odd.limit(0), SF).count() == 0
        frame = out
    assert {"ids", "n_tokens"} <= set(frame.columns) and Path(SF).is_dir()
