"""Secret scan: three fixed patterns, and a randomness test battery for what has no pattern.

Long runs of code characters are candidates.  The smallest alphabet that holds a candidate (decimal, hex,
base 32, ...) is taken as its encoding, and three tests ask whether its symbols look drawn at random from
it: chi-squared uniformity, runs about the middle of the alphabet, and correlation of neighbours.  Their
p-values are combined (Fisher).

What a claim of randomness is held against is ordinary text: the letter pairs of all documents are counted,
strings of as many common letters as the alphabet has are drawn from these counts with a fixed seed and put
through the same battery.  A candidate's p-value is the share of those strings, of its alphabet and length class,
that look at least as random.  Within each length class the candidates of all documents are then accepted
by the Benjamini-Hochberg rule, so short strings, on which the tests have little power, face the strictest
bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import free_name, in_slices, map_arrow, small_batches, stored_in_small_batches, text_or_empty

# The base patterns.  A match that is too short is dropped after it has been found.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run that is long enough; shorter runs need not be found to be dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Smallest first; among equals the first that holds the candidate.
ALPHABETS = (
    _DIGITS,
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
)
_SETS = [frozenset(a) for a in ALPHABETS]
_CODES = [np.array([a.find(chr(c)) for c in range(128)]) for a in ALPHABETS]
# Length classes: first length of each.
CLASSES = (20, 24, 32, 40, 64, 128)
NULL_STRINGS = 4_000
# Bytes of text that letter pairs are counted in at a time.
PIECE = 1 << 20
FALSE_SHARE = 0.01
# Below this a candidate is not random for its own alphabet, whatever text does.
RANDOM_AT_LEAST = 0.001


def _two_sided(z: np.ndarray) -> np.ndarray:
    """Normal tail by the logistic approximation, good to a few per cent far out."""
    z = np.minimum(np.abs(z), 20.0)
    return 2 / (1 + np.exp(0.07056 * z**3 + 1.5976 * z))


def battery(symbols: np.ndarray, size: int) -> np.ndarray:
    """Sum of the log p-values of the three tests for each row of equally long symbol strings."""
    rows, n = symbols.shape
    counts = np.zeros((rows, size))
    np.add.at(counts, (np.arange(rows)[:, None], symbols), 1)
    chi = size / n * (counts**2).sum(1) - n
    df = size - 1
    z = (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    uniform = np.where(z > 0, _two_sided(z) / 2, 1 - _two_sided(z) / 2)

    high = symbols >= size / 2
    n1 = high.sum(1)
    n2 = n - n1
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 2 * n1 * n2 / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = np.where((n1 == 0) | (n2 == 0), 2.0 ** (1 - n), _two_sided((runs - mean) / np.sqrt(var)))

    x = symbols - symbols.mean(1, keepdims=True)
    spread = (x**2).sum(1)
    serial = (x[:, 1:] * x[:, :-1]).sum(1) / np.maximum(spread, 1e-9)
    p_serial = np.where(spread == 0, 1e-30, _two_sided(serial * np.sqrt(n)))
    return np.log(np.maximum(np.stack([uniform, p_runs, p_serial]), 1e-30)).sum(0)


def _length_class(n: int) -> int:
    return int(np.searchsorted(CLASSES, n, "right")) - 1


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in in_slices(batches, 1 << 16, 0, PIECE):
        text = batch[0]
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        firsts = offsets[:-1]
        last = 0  # the character before the next one, 0 where a document begins
        for start in range(int(offsets[0]), int(offsets[-1]), PIECE):
            end = min(start + PIECE, int(offsets[-1]))
            part = data[start:end]
            keep = (part > 0x20) & (part < 0x80)
            # A pair does not reach from one document into the next: a mark of 0 stands before each.
            part = np.where(keep, part, 1)
            marks = firsts[(firsts >= start) & (firsts < end)] - start
            part = np.insert(part, marks, 0)
            part = np.concatenate([[last], part[part != 1]]).astype(np.uint16)
            last = int(part[-1])
            codes = part[:-1] << 8 | part[1:]
            total += np.bincount(codes[(part[:-1] > 0) & (part[1:] > 0)], minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.record_batch({"pair": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})


def letter_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pair, n)``: neighbouring ASCII characters of all texts, white space left out; 2**16 rows at most."""
    texts = docs.select(text_or_empty(text_col).alias("text"))
    return map_arrow(texts, _pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def null_scores(pairs: DataFrame, seed: int = 1) -> np.ndarray:
    """Sorted battery scores of text-like strings, by (alphabet, length class).

    Strings are drawn from the pair counts; without any counts all characters are equally likely.
    """
    counts = np.zeros((256, 256))
    with small_batches(pairs.sparkSession):
        rows = pairs.collect()
    for row in rows:
        counts[row["pair"] >> 8, row["pair"] & 255] = row["n"]
    counts = counts[0x21:0x7F, 0x21:0x7F] + 1e-9
    common = np.argsort(-counts.sum(1), kind="stable")
    by_size = {size: _text_like(counts, common[:size], seed) for size in {len(a) for a in ALPHABETS}}
    return np.stack(
        [
            np.stack([np.sort(battery(by_size[len(a)][:, :n], len(a))) for n in CLASSES])
            for a in ALPHABETS
        ]
    )


def _text_like(counts: np.ndarray, letters: np.ndarray, seed: int) -> np.ndarray:
    """Strings in which these letters follow each other as in the texts; symbols are places in ``letters``."""
    pairs = counts[np.ix_(letters, letters)]
    steps = np.cumsum(pairs, 1)
    steps /= steps[:, -1:]
    start = pairs.sum(1)
    rng = np.random.default_rng(seed)
    state = rng.choice(len(letters), NULL_STRINGS, p=start / start.sum())
    chain = [state]
    for _ in range(CLASSES[-1] - 1):
        draw = rng.random(NULL_STRINGS)[:, None]
        state = np.minimum((steps[state] < draw).sum(1), len(letters) - 1)
        chain.append(state)
    return np.stack(chain, 1)


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted.  ``runs``: the long runs of code characters, if known."""
    out = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Hex characters are code characters, so a long hex run lies inside a long code run.
    for a, b in candidates(text) if runs is None else runs:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def scored_candidates(
    text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]], null: np.ndarray
) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, rank) of the candidates that touch no base span and pass as random.

    The rank is the number of text-like strings that look at least as random.
    """
    out = []
    for a, b in runs:
        if any(s < b and a < e for s, _, e in base):
            continue
        body = text[a:b].rstrip("=")
        letters = set(body)
        kind = next((i for i, s in enumerate(_SETS) if letters <= s), None)
        if kind is None:
            continue
        symbols = _CODES[kind][np.frombuffer(body.encode(), np.uint8)]
        score = float(battery(symbols[None, :], len(ALPHABETS[kind]))[0])
        if np.exp(score) * (1 - score + score**2 / 2) < RANDOM_AT_LEAST:
            continue
        length = _length_class(len(body))
        scores = null[kind, length]
        out.append((a, b, length, int(len(scores) - np.searchsorted(scores, score, "left"))))
    return out


def _scan(batches: Iterator[pa.RecordBatch], null: np.ndarray) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    guess = pa.struct([(n, pa.int32()) for n in ("start", "end", "length_class", "rank")])
    for batch in in_slices(batches, column=1):
        base, found = [], []
        for text in batch[1].to_pylist():
            runs = candidates(text)
            spans = base_spans(text, runs)
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            scored = scored_candidates(text, runs, spans, null) if runs else []
            found.append([dict(zip(("start", "end", "length_class", "rank"), s, strict=True)) for s in scored])
        yield pa.record_batch(
            [batch[0], pa.array(base, pa.list_(span)), pa.array(found, pa.list_(guess))],
            names=["doc_id", "base", "found"],
        )


def scan(docs: DataFrame, null: np.ndarray) -> DataFrame:
    """``(doc_id, base, found)``, stored: base spans and scored candidates of every whole text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    schema = (
        "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
        "found array<struct<start:int,end:int,length_class:int,rank:int>>"
    )
    return stored_in_small_batches(map_arrow(plain, lambda b: _scan(b, null), schema), "secret-scan")


def accepted_ranks(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """Highest accepted rank of each length class (-1: none), by Benjamini-Hochberg over all candidates.

    The counted ranks are ``len(CLASSES) * (NULL_STRINGS + 1)`` rows at most.
    """
    counted = (
        scanned.select(F.explode("found").alias("c"))
        .groupBy(F.col("c.length_class").alias("length_class"), F.col("c.rank").alias("rank"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    out = []
    for length in range(len(CLASSES)):
        rows = sorted((r["rank"], r["n"]) for r in counted if r["length_class"] == length)
        total, seen, best = sum(n for _, n in rows), 0, -1
        for rank, n in rows:
            seen += n
            if (rank + 1) / (NULL_STRINGS + 1) <= false_share * seen / total:
                best = rank
        out.append(best)
    return out


def _joined(spans) -> object:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per document.

    A null or empty text has no spans; repeated rows are scanned each; a null doc_id stays null; other
    columns are ignored, whatever their names; texts of any length are scanned whole; an empty table gives no
    rows.  ``spans`` also holds the accepted candidates, as kind ``random``.
    """
    null = null_scores(letter_pairs(docs))
    scanned = scan(docs, null)
    limits = F.array(*[F.lit(r) for r in accepted_ranks(scanned)])
    more = F.transform(
        F.filter("found", lambda c: c["rank"] <= F.get(limits, c["length_class"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", more))).alias("spans"),
    )


def _redact(batches: Iterator[pa.RecordBatch], null: np.ndarray, limits: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, column=-1):
        texts = []
        for text in batch[-1].to_pylist():
            if text is None:
                texts.append(None)
                continue
            runs = candidates(text)
            base = base_spans(text, runs)
            spans = [(a, b) for a, _, b in base]
            spans += [(a, b) for a, b, c, rank in scored_candidates(text, runs, base, null) if rank <= limits[c]]
            parts, at = [], 0
            for a, b in sorted(spans):
                if a >= at:
                    parts += [text[at:a], "[secret]"]
                at = max(at, b)
            texts.append("".join([*parts, text[at:]]) if parts else text)
        yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by ``[secret]``; overlapping spans become one.

    A null text stays null, all other columns stay as they are.
    """
    null = null_scores(letter_pairs(docs))
    limits = accepted_ranks(scan(docs, null))
    rest = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias(free_name(rest, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    mapped = map_arrow(plain, lambda b: _redact(b, null, limits), schema)
    return mapped.select(*[F.col(f"`{plain.columns[-1]}`").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
