"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words.  Every passage is encoded by a small learned layer over word
shapes, hashed words and repetition; gated attention, learned from document labels only, weighs the
passages; the weighted representation is scored.  A bounded sample of labelled documents is encoded by Spark
and fitted on the driver (a few thousand parameters); scoring is one pass over all texts, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import held_out, in_slices, map_arrow, text_or_empty

PASSAGE = 64
# Labelled documents learned from, at most, and passages of each of them; of a longer one so many, evenly spaced.
SAMPLE = 4_000
SAMPLE_PASSAGES = 256
BUCKETS = 24
SHAPES = 8
FEATURES = SHAPES + BUCKETS + 2
HIDDEN, GATE = 16, 8
ROUNDS = 250
THRESHOLD = 0.7
WORDS_REMEMBERED = 400_000
# Characters counted as symbols and as ends of clauses.
_SYMBOLS, _ENDS = frozenset("#*$%&|<>~^=+_\\{}[]"), frozenset(".,;:!?")


def _word_features(word: str) -> list[float]:
    n = len(word)
    return [
        min(n, 30) / 10,
        float(n == 1),
        sum(map(str.isupper, word)) / n,
        sum(map(str.isdigit, word)) / n,
        sum(c in _SYMBOLS for c in word) / n,
        float(word[-1] in _ENDS),
        word.count("!") / n,
        float(not any(map(str.isalnum, word))),
    ]


class PassageEncoder:
    """Raw features of passages; remembers a bounded number of words."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._table = np.zeros((0, SHAPES + BUCKETS), np.float32)

    def _learn(self, words: list[str]) -> None:
        table = np.zeros((len(words), SHAPES + BUCKETS), np.float32)
        table[:, :SHAPES] = [_word_features(w) for w in words]
        hashed = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in words], np.uint64)
        sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
        table[np.arange(len(words)), SHAPES + (hashed % np.uint64(BUCKETS)).astype(int)] = sign
        known = len(self._code)
        self._code.update((w, known + i) for i, w in enumerate(words))
        self._table = np.concatenate([self._table, table])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all passages, and the number of passages of each text.

        A text without words is one passage without features.
        """
        cut = [t.split() for t in texts]
        words = [w for c in cut for w in c]
        if len(self._code) > WORDS_REMEMBERED:
            self._forget()
        if new := set(words).difference(self._code):
            self._learn(sorted(new))
        codes = np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))
        sizes = np.array([len(c) for c in cut], np.int64)
        counts = np.maximum(-(-sizes // PASSAGE), 1)
        text = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = (np.cumsum(counts) - counts)[text] + within // PASSAGE
        out = np.zeros((int(counts.sum()), FEATURES), np.float32)
        if not len(words):
            return out, counts
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        used = passage[first]
        length = np.diff(np.append(first, len(words)))[:, None].astype(np.float32)
        out[used, :-2] = np.add.reduceat(self._table[codes], first, axis=0) / length
        distinct = np.unique(passage << 32 | codes) >> 32
        out[:, -2] = np.bincount(distinct, minlength=len(out)) / PASSAGE
        # Share of words whose pair with the next word came earlier in the text.
        pair = (codes * 0x9E3779B1 + np.append(codes[1:], 0)) ^ (text * 0x7FEB352D << 20)
        _, at = np.unique(pair, return_index=True)
        again = np.ones(len(words), np.float32)
        again[at] = 0
        out[used, -1] = np.add.reduceat(again, first) / length[:, 0]
        return out, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _run((x - self.mean) / self.scale, counts, self.weights)["p"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _run(x: np.ndarray, counts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Encode passages, weigh them by gated attention, score the weighted sum."""
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ w["w"] + w["b"])
    t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (t * s) @ w["g"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
    a /= np.repeat(np.add.reduceat(a, starts), counts)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def _gradients(x: np.ndarray, counts: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    r = _run(x, counts, w)
    starts = np.cumsum(counts) - counts
    dz_out = (r["p"] - y) / len(y)
    dz = np.repeat(dz_out[:, None] * w["c"], counts, axis=0)
    da = (dz * r["h"]).sum(1)
    da = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, starts), counts))
    dts = da[:, None] * w["g"]
    dv, du = dts * r["s"] * (1 - r["t"] ** 2), dts * r["t"] * r["s"] * (1 - r["s"])
    dh = (r["a"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - r["h"] ** 2)
    return {
        "w": x.T @ dh,
        "b": dh.sum(0),
        "v": r["h"].T @ dv,
        "u": r["h"].T @ du,
        "g": (r["t"] * r["s"]).T @ da,
        "c": r["z"].T @ dz_out,
        "d": dz_out.sum(),
    }


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """Adam on the log loss with a small weight decay.  Without rows the score is one half everywhere."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "g": (GATE,), "c": (HIDDEN,)}
    w = {k: rng.normal(0, 0.3, n) if len(n) > 1 or k in "gc" else np.zeros(n) for k, n in shapes.items()} | {"d": np.zeros(())}
    if not len(y):
        w = {k: np.zeros_like(v) for k, v in w.items()}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(float)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        for k, g in _gradients(x, counts, y, w).items():
            g = g + 1e-4 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            w[k] = w[k] - 0.03 * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    return Model(mean, scale, w)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = PassageEncoder()
    for batch in in_slices(batches, column=2):
        x, counts = encoder(batch[2].to_pylist())
        starts = np.cumsum(counts) - counts
        some = [np.unique(np.linspace(0, c - 1, min(c, SAMPLE_PASSAGES)).astype(int)) for c in counts]
        raw = [x[start + at].tobytes() for start, at in zip(starts, some, strict=True)]
        yield pa.record_batch([batch[0], batch[1], pa.array(raw, pa.binary())], names=["doc_id", "quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, chosen by hash of the id; held-out ones are left out.

    The driver gets ``sample`` rows of at most ``SAMPLE_PASSAGES`` passages of ``FEATURES`` floats.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    # At most ``sample`` ids.
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    encoded = map_arrow(joined, _encoded, "doc_id long, quality int, x binary")
    rows = encoded.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate([*parts, np.zeros((0, FEATURES), np.float32)])
    return fit(x, np.array([len(p) for p in parts], np.int64), np.array([r["quality"] for r in rows], float))


_encoder: list[PassageEncoder] = []


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    if not _encoder:
        _encoder.append(PassageEncoder())  # stays in the process, with the words it remembers
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            p = model.score(*_encoder[0](part[2].to_pylist()))
            yield pa.record_batch(
                [part[0], part[1], pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document, from its whole text alone.

    A null text is scored as an empty one; texts of any length are scored over all their passages; repeated rows
    are scored each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), text_or_empty("text").alias("text")
    )
    return map_arrow(
        plain, lambda b: _scored(b, model), "doc_id long, held_out boolean, score double, predicted int"
    )
