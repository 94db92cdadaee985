"""Filter audit, vector codes and personal data against brute force and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.llm import filter_audit, personal_data, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit


def failures(text, copy):
    words = WORD.findall(text)
    return {
        f
        for f, fails in zip(
            "ABCDE",
            (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                re.search(r"[#$%&*|]", text) is not None,
                copy,
            ),
            strict=True,
        )
        if fails
    }


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((part or "", failures(text, copy), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                removed[f] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not r[1] & {*before, f} for r in mine),
                    len(gone),
                    sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(40_000))
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (3, "x y", "b"), (4, "x y", ""),
    (None, "x y", "a"), (5, LONG, "a"), (6, LONG, "b"), (6, LONG + " #", "b"), (7, "x " * 300, "a"),
    (8, "SHOUT " * 3, "a"), (9, " ".join(f"v{i}" for i in range(250)), "a"), (10, "é&\x0b\x1c x", "c"),
]
LABELS = [(9, 1, 0), (7, 0, 1), (7, 1, None), (None, 1, 1), (4, None, None), (99, 1, 1)]


def audited(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(
        {"part": F.lit(1), "bits": F.lit("x"), "hash": F.lit(2), "n": F.lit(None)}
    )
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))
    rows = filter_audit.audit(table, said).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("rows_per_salt", [filter_audit.ROWS_PER_SALT, 1])
def test_audit_equals_brute_force(spark, monkeypatch, rows_per_salt):
    monkeypatch.setattr(filter_audit, "ROWS_PER_SALT", rows_per_salt)
    assert audited(spark, DOCS, LABELS) == audit_by_hand(DOCS, LABELS)


def test_audit_shuffles_the_shared_hashes_when_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    assert audited(spark, DOCS, []) == audit_by_hand(DOCS, [])


def test_audit_compares_texts_of_equal_hash(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    docs = [d for d in DOCS if d[0] not in (3, 6)]  # rows of one id are told apart by their hash
    assert audited(spark, docs, LABELS) == audit_by_hand(docs, LABELS)


def test_audit_of_nothing(spark):
    assert audited(spark, [], LABELS) == {}


# Vector codes


def codes_by_hand(rows, entries=64):
    kept = []
    for i, vec, label in rows:
        if vec is not None and len(vec) and all(x is not None and np.isfinite(x) for x in vec):
            kept.append((i, [int(np.floor(256.0 * x)) for x in vec], label))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = len(kept[0][1]) // 16
    parts = lambda v: [v[p * size : (p + 1) * size] for p in range(16)]
    books = [[parts(r[1])[p] for r in first] for p in range(16)]

    def assign():
        out = []
        for _, v, _ in kept:
            near = [
                min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
                for p, x in enumerate(parts(v))
            ]
            out.append(near)
        return out

    for _ in range(2):
        near = assign()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [parts(kept[i][1])[p] for i in range(len(kept)) if near[i][p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    by_label = collections.Counter()
    for (_, _, label), n in zip(kept, near, strict=True):
        by_label[label] += sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        (i is None, i or 0, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), by_label[label], digest)
        for (i, _, label), n in zip(kept, near, strict=True)
    )


def coded(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"vec": F.lit("x"), "error": F.lit(1), "said": F.lit(None)}
    )
    out = vector_codes.compressed(table)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((r[0] is None, r[0] or 0, *tuple(r)[1:]) for r in out.collect())


def vectors(n, width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.2 * rng.normal(size=width)], i % 3) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(400, 32), (90, 16), (70, 80), (10, 48)])
def test_codes_equal_brute_force(spark, monkeypatch, n, width):
    monkeypatch.setattr(vector_codes, "CHUNK_VALUES", 1 << 11)
    rows = vectors(n, width)
    rows += [rows[0], rows[5], (None, rows[1][1], None), (7_000, rows[2][1], None), (3, rows[4][1], 1)]
    rows += [(8_000, None, 1), (8_001, [None] * width, 1), (8_002, [float("nan")] * width, 1), (-1, [float("inf")] * width, 1)]
    assert coded(spark, rows) == codes_by_hand(rows)


def test_codes_of_equal_vectors_and_of_nothing(spark):
    rows = [(i, [0.5] * 16, None) for i in range(100)]
    assert coded(spark, rows) == codes_by_hand(rows)
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [], 1)]) == []


def test_codes_refuse_what_cannot_be_cut(spark):
    for rows in ([(1, [1.0] * 15, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="cut into|different lengths|beyond"):
            coded(spark, rows)


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(0)
    for _ in range(50):
        values, entries = rng.integers(-40, 40, (64, 4)), rng.integers(-40, 40, (30, 4))
        values //= rng.integers(1, 20)
        may = vector_codes.shortlists(values.min(0)[None], values.max(0)[None], entries)[0]
        assert may[vector_codes.nearest(values, entries)[0]].all()


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = vector_codes.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# Personal data


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        total += sum(divmod((1 + i % 2) * int(c), 10))
    return total % 10 == 0


def base_by_hand(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = [
        (m.start(), k, m.end(), name)
        for k, (name, (pattern, check)) in enumerate(kinds.items())
        for m in re.finditer(pattern, text)
        if check(m[0])
    ]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)]


PIECES = [
    "a@b.c", "x.y%z+1@mail-1.example.org", "@", "a@b", "é漢😀", " ", "\n", ".", "1.2.3.4", "255.255.255.255", "256.1.1.1",
    "001.02.3.0004", "1.2.3", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "5", "-", "+1 (743) 555-3824",
    "+49 30 1234567", "+1 2", "+", "(", "12 34", "378282246310005", "%d@e.f", "0" * 30, "a" * 50, ":", "+123456789012345678",
]


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(PIECES, rng.integers(1, 14))) for _ in range(1500)]
    rows = personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_by_hand(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in personal_data.NAMES[:4]] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        counts = collections.Counter(s.split(":")[0] for s in want)
        assert [r[f"n_{k}"] for k in personal_data.NAMES[:4]] == [counts[k] for k in personal_data.NAMES[:4]]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal_data.find(docs).orderBy("doc_id").collect()
    return [[(personal_data.NAMES[s["kind"]], s["found"], s["score"]) for s in (*r["base"], *r["more"])] for r in rows]


def test_validators_and_nearby_words(spark):
    iban, spaced = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    got = found(
        spark,
        [
            f"IBAN: {iban}.", f"pay to {spaced} TODAY", f"{iban[:-1]}1", f"{iban}7", f"x{iban}", "AT61 1904 3002 3457 3201 TELEPHONE",
            "ssn 123-45-6789", "123-45-6789", "ssn 000-45-6789", "order, ssn 123-45-6789",
            "call 555-123-4567", "555-123-4567", "tel (555) 123-4567 now", "call +1 (555) 123-4567", "call 1555-123-4567",
            "version 1.2.3.4", "server 1.2.3.4", "card 4111 1111 1111 1111", "order no 4111111111111111",
        ],
    )
    assert got == [
        [("account", iban, 1.0)], [("account", spaced, 0.9)], [], [], [], [("account", "AT61 1904 3002 3457 3201", 0.9)],
        [("ssn", "123-45-6789", 0.7)], [], [], [],
        [("local_phone", "555-123-4567", 0.7)], [], [("local_phone", "(555) 123-4567", 0.7)], [("phone", "+1 (555) 123-4567", 1.0)], [],
        [("ip", "1.2.3.4", 0.3)], [("ip", "1.2.3.4", 1.0)], [("card", "4111 1111 1111 1111", 1.0)], [("card", "4111111111111111", 0.4)],
    ]


def test_mod_97_equals_long_division(spark):
    rng = np.random.default_rng(2)
    codes = ["".join(rng.choice(list("ABCXYZ0123456789"), n)) for n in rng.integers(15, 34, 200)]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", personal_data.mod_97(F.col("c")).alias("r")).collect()
    for r in rows:
        turned = r["c"][4:] + r["c"][:4]
        assert r["r"] == int("".join(str(int(x, 36)) for x in turned)) % 97


def test_personal_data_on_odd_tables(spark):
    many = "10.0.0.1 x " * 5_000
    hard = ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "a.b@" * 50_000, "a@" + "b." * 100_000, "+1" + "." * 300_000, "+1 " * 50_000]
    rows = [(None, "a@b.c", 1), (1, None, 2), (2, "", 3), (3, "a@b.c", 4), (3, "a@b.c", 4), (4, many, 5)]
    rows += [(10 + i, t, 6) for i, t in enumerate(hard)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int").withColumns({"spans": F.lit(1), "more": F.lit(2)})
    got = [(r["doc_id"], r["spans"]) for r in personal_data.personal_data(docs).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 4) == [(1, ""), (2, ""), (3, "email:0:5"), (3, "email:0:5")]
    assert (None, "email:0:5") in got
    assert dict(got)[4] == ",".join(f"ip:{11 * i}:{11 * i + 8}" for i in range(5_000))
    for i, text in enumerate(hard):
        if i != 4:  # the pattern of the standard library tries this one from each of its places
            assert dict(got)[10 + i] == ",".join(base_by_hand(text) if i in (2, 3) else [])
    assert dict(got)[14] == "email:0:200001"
    assert personal_data.personal_data(docs.where("false")).count() == 0


def test_personal_data_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = personal_data.personal_data(docs.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
