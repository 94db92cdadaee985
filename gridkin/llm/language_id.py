"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  A language is a probability for each piece; a word's
probability in a language is the sum, over all ways to cut it into pieces, of the products of their
probabilities, which a forward pass computes.  Piece probabilities are learned by expectation maximisation
(forward and backward passes) from the counted words of a bounded sample of labelled texts.  Pieces do not reach
over white space, so a text's log probability is the sum over its words, and equal words are scored once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm.common import held_out, map_arrow, map_groups, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
WORD_MARK = "▁"
UNDETERMINED = "und"
# Labelled texts per language that probabilities are learned from, and languages, at most.
TEXTS_PER_LANGUAGE = 400
LANGUAGES = 500
# Parts of a language that are ranked before the whole.
RANKED_PARTS = 32
ROUNDS = 4
# Share of probability that is spread over all pieces, and the cost of a character outside the vocabulary.
SMOOTHING = 0.01
UNKNOWN = 1e-7
WORDS_REMEMBERED = 400_000


# Words up to this length are worked on together, in plain probabilities; longer ones one by one, in logs.
SHORT = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _slots(h: np.ndarray) -> np.ndarray:
    """20 well spread bits of a hash."""
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)


class Pieces:
    """The vocabulary's pieces, found by a rolling hash of code points.

    Number ``unknown`` stands for a character that is no piece, ``none`` for "no piece here".
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.number = {p: i for i, p in enumerate(usable)}
        self.unknown, self.none = len(usable), len(usable) + 1
        self.longest = max(map(len, usable))
        # Tables of 2**20 slots; a piece goes into the first one where its slot is free.
        self._tables: list[tuple[np.ndarray, np.ndarray]] = []
        base, whole = int(_BASE), (1 << 64) - 1
        sums = [reduce(lambda h, c: (h * base + ord(c)) & whole, piece, 0) for piece in usable]
        places = _slots(np.array(sums, np.uint64)).tolist()
        for i, (h, slot) in enumerate(zip(sums, places, strict=True)):
            for hashes, numbers in self._tables:
                if numbers[slot] == self.none:
                    break
            else:
                hashes, numbers = np.zeros(1 << 20, np.uint64), np.full(1 << 20, self.none, np.int32)
                self._tables.append((hashes, numbers))
            hashes[slot], numbers[slot] = h, i

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: entry L - 1 has the piece of length L at (word, start)."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        out, h = [], np.zeros((len(words), n + 1), np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            h = h[:, :-1] * _BASE + codes[:, length - 1 :]
            slot = _slots(h)
            found = np.full(h.shape, self.none, np.int32)
            for hashes, numbers in self._tables:
                hit = hashes[slot] == h
                found[hit] = numbers[slot[hit]]
            if length == 1:
                found[found == self.none] = self.unknown
            out.append(found)
        return out

    def ends(self, word: str) -> np.ndarray:
        """For one word: the piece of length L that ends before place e, at (L - 1, e)."""
        lattice = self.lattice([word])
        out = np.full((len(lattice), len(word) + 1), self.none)
        for length, found in enumerate(lattice, 1):
            out[length - 1, length:] = found[0]
        return out

    def edges(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end the (start, piece) of the pieces that end there; for long words."""
        n = len(word)
        out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            if word[a] not in self.number:
                out[a + 1].append((a, self.unknown))
            for b in range(a + 1, min(a + self.longest, n) + 1):
                if (piece := self.number.get(word[a:b])) is not None:
                    out[b].append((a, piece))
        return out


@cache
def pieces_of(path: str) -> Pieces:
    """One per process."""
    return Pieces(path)


def words_of(text: str) -> list[str]:
    """Lower-case words with the vocabulary's mark of a word start."""
    return [WORD_MARK + w for w in text.lower().split()]


def forward_long(edges: list[list[tuple[int, int]]], logp: np.ndarray) -> np.ndarray:
    """Log probability of one word in every language, in logs throughout."""
    alpha = np.full((len(edges), logp.shape[1]), -np.inf)
    alpha[0] = 0.0
    for end in range(1, len(edges)):
        into = edges[end]
        terms = alpha[[a for a, _ in into]] + logp[[p for _, p in into]]
        top = terms.max(0)
        alpha[end] = top + np.log(np.exp(terms - top).sum(0))
    return alpha[-1]


def expected_long(ends: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in one word under one language, in logs throughout."""
    longest, n = ends.shape[0], ends.shape[1] - 1
    weight = logp[ends]
    # Places before the word are never reached.
    alpha, beta = np.full(longest + n + 1, -np.inf), np.full(n + longest + 1, -np.inf)
    alpha[longest] = 0.0
    beta[n] = 0.0
    with np.errstate(invalid="ignore"):
        for e in range(1, n + 1):
            alpha[longest + e] = np.logaddexp.reduce(alpha[longest + e - 1 : e - 1 : -1] + weight[:, e])
        back = np.full((longest, n + longest), -np.inf)  # by start
        for length in range(1, longest + 1):
            back[length - 1, : n + 1 - length] = weight[length - 1, length:]
        for a in range(n - 1, -1, -1):
            beta[a] = np.logaddexp.reduce(beta[a + 1 : a + 1 + longest] + back[:, a])
        starts = np.arange(n + 1)[None, :] - np.arange(1, longest + 1)[:, None]
        share = np.exp(alpha[longest + starts] + weight + beta[: n + 1] - beta[0])
    share[(starts < 0) | ~np.isfinite(share)] = 0.0
    return np.bincount(ends.ravel(), share.ravel(), minlength=len(logp))


def forward(lattice: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Probability of every prefix: positions by words by languages.  ``p`` ends with unknown and none."""
    words, n = lattice[0].shape
    alpha = np.zeros((n + 1, words, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, n + 1):
        for length in range(1, min(len(lattice), end) + 1):
            alpha[end] += alpha[end - length] * p[lattice[length - 1][:, end - length]]
    return alpha


def by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Places of words of one length, some thousands at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or len(words[order[at]]) != len(words[order[start]]) or at - start == most:
            yield order[start:at]
            start = at


def _with_ends(share: np.ndarray) -> np.ndarray:
    """Piece probabilities with those of an unknown character and of no piece."""
    return np.concatenate([share * (1 - UNKNOWN), [UNKNOWN, 0.0]])


def learn_language(counts: Counter[str], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation; unknown and none come last."""
    size = pieces.unknown
    words = sorted(w for w in counts if len(w) <= SHORT)
    times = np.array([counts[w] for w in words], float)
    long = [(pieces.ends(w), counts[w]) for w in sorted(counts) if len(w) > SHORT]
    groups = [(np.array(g), pieces.lattice([words[i] for i in g])) for g in by_length(words)]
    p = _with_ends(np.full(size, 1 / size))
    for _ in range(rounds):
        expected = np.zeros(size + 2)
        for group, lattice in groups:
            alpha = forward(lattice, p[:, None])[:, :, 0]
            n = len(alpha) - 1
            beta = np.zeros_like(alpha)
            beta[n] = times[group] / alpha[n]
            for start in range(n - 1, -1, -1):
                for length in range(1, min(len(lattice), n - start) + 1):
                    piece = lattice[length - 1][:, start]
                    into = p[piece] * beta[start + length]
                    beta[start] += into
                    expected += np.bincount(piece, alpha[start] * into, minlength=size + 2)
        with np.errstate(divide="ignore"):
            logp = np.log(p)
        for ends, n in long:
            expected += n * expected_long(ends, logp)
        total = expected[:size].sum()
        share = expected[:size] / total if total else np.full(size, 1 / size)
        p = _with_ends((1 - SMOOTHING) * share + SMOOTHING / size)
    return p


@dataclass(frozen=True)
class Model:
    languages: list[str]
    p: np.ndarray  # pieces, unknown and none, by languages
    path: str


def _language(key: tuple, rows: pa.Table, path: str) -> pa.Table:
    """Probabilities of one language from its bounded sample."""
    counts: Counter[str] = Counter()
    for text in rows["text"].to_pylist():
        counts.update(words_of(text))
    return pa.table({"lang": [key[0].as_py()], "p": [learn_language(counts, pieces_of(path)).tobytes()]})


def learn(docs: DataFrame, path: str | None = None, per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` labelled texts of each language, chosen by hash of the id.

    Only rows that are not held out and have a language take part.  Each language is one task; the driver
    gets one vector of piece probabilities per language, for the ``LANGUAGES`` most frequent ones at most.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    labelled = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"
    )
    frequent = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # Ranking needs no text but its hash, so the texts of chosen rows only are moved.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    keyed = labelled.withColumn("mark", F.xxhash64("text"))
    slim = keyed.select("lang", "doc_id", "mark").join(F.broadcast(frequent.select("lang")), "lang", "left_semi")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    # First within parts of a language, so that what one task ranks does not grow with the language.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(RANKED_PARTS))
    within = F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))
    some = slim.distinct().withColumn("within", within).where(F.col("within") <= per_language).drop("within")
    chosen = some.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    # At most LANGUAGES * per_language rows of a few numbers.
    sample = keyed.join(F.broadcast(chosen), ["lang", "doc_id", "mark"], "left_semi").dropDuplicates(
        ["lang", "doc_id", "mark"]
    )
    texts = sample.select("lang", "text")
    rows = map_groups(texts, ["lang"], lambda key, table: _language(key, table, path), "lang string, p binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"].encode())
    p = np.stack([np.frombuffer(r["p"]) for r in rows], 1) if rows else np.zeros((pieces_of(path).none + 1, 0))
    return Model([r["lang"] for r in rows], p, path)


class Scorer:
    """Scores texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.model.languages)))

    def _learn(self, words: list[str]) -> None:
        scores = np.zeros((len(words), len(self.model.languages)))
        for group in by_length(words):
            if len(words[group[0]]) <= SHORT:
                lattice = self.pieces.lattice([words[i] for i in group])
                scores[group] = np.log(forward(lattice, self.model.p)[-1])
            else:
                with np.errstate(divide="ignore"):
                    logp = np.log(self.model.p)
                for i in group:
                    scores[i] = forward_long(self.pieces.edges(words[i]), logp)
        n = len(self._code)
        self._code.update((w, n + i) for i, w in enumerate(words))
        self._scores = np.concatenate([self._scores, scores])

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; all languages are equally likely beforehand."""
        names = self.model.languages
        cut = [words_of(t) for t in texts]
        words = [w for c in cut for w in c]
        if len(self._code) > WORDS_REMEMBERED:
            self._forget()
        if new := set(words).difference(self._code):
            self._learn(sorted(new))
        codes = np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([len(c) for c in cut]).astype(np.int64)
        total = np.zeros((len(texts), len(names)))
        for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=True)):
            total[i] = self._scores[codes[a:b]].sum(0)
        known = np.array([bool(names) and any(map(str.isalpha, t)) for t in texts])
        if not names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        found = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return found, np.where(known, share, 0.0)


_scorers: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """That of the latest model stays in the process, with the words it knows."""
    key = hashlib.sha256(model.p.tobytes() + repr(model.languages).encode()).hexdigest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            found, share = scorer(part[2].to_pylist())
            yield pa.record_batch(
                [part[0], part[1], pa.array(found, pa.string()), pa.array(share, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per document; only the text is looked at.

    A null text, one without any letter, and every text under a model without languages is ``und`` with
    score 0.  Of languages with equal scores the first by code point is taken.  Texts of any length are scored
    whole; repeated rows are predicted each; a null doc_id stays null; an empty table gives no rows.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), text_or_empty("text").alias("text")
    )
    return map_arrow(
        plain, lambda b: _predicted(b, model), "doc_id long, held_out boolean, lang_pred string, score double"
    )
