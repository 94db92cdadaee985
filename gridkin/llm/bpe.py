"""BPE encoding and decoding with a lexicon of frequent words.

The words of all texts are counted once; the frequent ones are encoded on the driver and compiled, with
their ids, into a minimal acyclic transducer (``lexicon``) that Spark ships to the executors, where it is
memory-mapped.  Encoding cuts a text into words, looks new words up in the transducer and merges what it
does not know, pair by pair, exactly as the merge table says.  The lexicon only saves work: any lexicon
gives the same ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridkin.llm.common import free_name, in_slices, map_arrow, ragged_gather, stored_in_small_batches, text_or_empty
from gridkin.llm.lexicon import Lexicon, write_lexicon

VOCABULARY = "word_bpe_49k.json"
LEXICON_WORDS = 65_536
# Longer words never enter the lexicon; they are merged when met.
LEXICON_BYTES = 64
# Words of so many symbols are merged without a heap.
SHORT = 32
# Words remembered by one task, and characters worked on at a time.
REMEMBERED = 300_000
CHUNK = 4_000_000

# Characters whose treatment is the same in every Unicode version, so that ``re`` may cut them: Latin up to
# U+017F without the dotted capital I, general punctuation, currency signs.  Other texts go through the
# library's own normalizer and pre-tokenizer.
_PLAIN = re.compile("[\x00-įı-ſ‐-‧‰-⁞₠-₿]*")
_RANGE = [chr(c) for c in range(0x180)]
_LETTERS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "N")
_SPACE = "\t-\r \x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


class Vocabulary:
    """Merge table, special tokens and byte alphabet of a tokenizer file with word ends."""

    def __init__(self, path: str):
        self.path = path
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        # The byte alphabet: printable bytes stand for themselves, the others for code points from 256.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in shown}
        letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
        self._byte_of = {c: b for b, c in letter.items()}
        self._inner = [self.ids.get(letter[b]) for b in range(256)]
        self._final = [self.ids.get(letter[b] + self.suffix) for b in range(256)]
        names = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        size = max(names) + 1
        self.pieces = _packed([names.get(i, "").encode() + b" " for i in range(size)])
        self.decimals = _packed([b"%d " % i for i in range(size)])
        self.known = np.array([i in names for i in range(size)])
        self._special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        self._library = Tokenizer.from_file(path)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: of all adjacent pairs the earliest learned merges first, from the left."""
        symbols = [self._inner[b] for b in word[:-1]] + [self._final[word[-1]]]
        n = len(symbols)
        if n <= SHORT:
            return self._merge_short(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        table = self.merges
        heap = []
        for i in range(n - 1):
            if (found := table.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, None
            right[i] = after = right[j]
            if after < n:
                left[after] = i
            for p, q in ((left[i], i), (i, after)):
                if p >= 0 and q < n and (found := table.get((symbols[p], symbols[q]))) is not None:
                    heapq.heappush(heap, (found[0], p, symbols[p], symbols[q], found[1]))
        return [s for s in symbols if s is not None]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """The same without a heap: look for the best pair again after each merge."""
        get, never = self.merges.get, (len(self.merges), 0)
        found = [get(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found)) is not never:
            i = found.index(best)
            symbols[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((symbols[i - 1], symbols[i]), never)
            if i < len(found):
                found[i] = get((symbols[i], symbols[i + 1]), never)
        return symbols

    def cut(self, text: str) -> list[str]:
        """The words of a text, special tokens among them as they stand."""
        if "<|" not in text or not self._special.search(text):
            return self._words(text)
        out, at = [], 0
        for found in self._special.finditer(text):
            out += self._words(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _CUT.findall(text.lower())
        normal = self._library.normalizer.normalize_str(text)
        cut = self._library.pre_tokenizer.pre_tokenize_str(normal)
        byte_of = self._byte_of
        return [bytes(byte_of[c] for c in word).decode() for word, _ in cut]


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per process."""
    return Vocabulary(path)


class Encoder:
    """Turns texts into ids; remembers a bounded number of words."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._starts, self._lengths, self._ids = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        special = self.vocab.specials
        place = self.lexicon.positions(raw) if self.lexicon else np.full(len(raw), -1)
        known = np.flatnonzero(place >= 0)
        ids, lengths = (
            self.lexicon.outputs(place[known]) if len(known) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        )
        merged = [
            [special[words[i]]] if words[i] in special else self.vocab.merge(raw[i])
            for i in np.flatnonzero(place < 0)
        ]
        order = [words[i] for i in known] + [words[i] for i in np.flatnonzero(place < 0)]
        n = len(self._code)
        self._code.update((w, n + i) for i, w in enumerate(order))
        more = np.concatenate([lengths, np.fromiter(map(len, merged), np.int64, len(merged))]).astype(np.int64)
        at = len(self._ids)
        self._ids = np.concatenate([self._ids, ids, np.array([i for m in merged for i in m], np.int64)])
        self._starts = np.concatenate([self._starts, at + np.cumsum(more) - more])
        self._lengths = np.concatenate([self._lengths, more])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's end (one more edge than texts)."""
        cut = [self.vocab.cut(t) for t in texts]
        words = [w for c in cut for w in c]
        if len(self._code) > REMEMBERED:
            self._forget()
        if new := set(words).difference(self._code):
            self._learn(sorted(new))
        codes = np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))
        ids, ends = ragged_gather(self._ids, self._starts[codes], self._lengths[codes])
        per_text = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)[per_text]


def decoded(vocab: Vocabulary, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Tokens joined by a blank, as the library does for a vocabulary without a decoder.

    Ids that the vocabulary does not have are left out.
    """
    return _joined(vocab, vocab.pieces, ids, edges)


def _joined(vocab: Vocabulary, parts: tuple, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    good = (ids >= 0) & (ids < len(vocab.known))
    good[good] = vocab.known[ids[good]]
    edges = np.concatenate([[0], np.cumsum(good)])[edges]
    ids = ids[good]
    flat, starts, lengths = parts
    out, ends = ragged_gather(flat, starts[ids], lengths[ids])
    at = np.concatenate([[0], ends])[edges]
    raw = out.tobytes()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``CHUNK`` characters; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab, counts = vocabulary(path), Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in in_slices(batches, 1024, 0):
        for part in _chunks(batch[0].to_pylist()):
            for text in part:
                counts.update(vocab.cut(text))
            if len(counts) > 2 * REMEMBERED:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(word, n)`` over all texts, as the vocabulary cuts them; null counts as empty."""
    path = path or public_tokenizers.path(VOCABULARY)
    texts = docs.select(text_or_empty(text_col).alias("text"))
    partial = map_arrow(texts, lambda b: _counted(b, path), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, n_words: int) -> DataFrame:
    """``(word)``: about ``n_words`` of the most frequent ones, without a sort.

    A histogram of the counts, in steps of a tenth, tells the step in which the last of these words lies; all
    words above it are taken, and of that step those whose hash falls into the share that is wanted.
    """
    rows = counts.where(F.octet_length("word").between(1, LEXICON_BYTES))
    rows = stored_in_small_batches(rows.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 7).cast("int")), "word-counts")
    # At most 63 * 7 steps.
    steps = sorted(map(tuple, rows.groupBy("step").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    seen, last, share = 0, None, 1.0
    for step, k in steps:
        last = step
        if seen + k >= n_words:
            share = (n_words - seen) / k
            break
        seen += k
    if last is None:
        return rows.select("word")
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    return rows.where((F.col("step") > last) | ((F.col("step") == last) & part)).select("word")


def ship_lexicon(counts: DataFrame, n_words: int = LEXICON_WORDS, path: str | None = None) -> str:
    """Compile the most frequent words and send the file to all executors; returns its name there.

    About ``n_words`` words of at most ``LEXICON_BYTES`` bytes reach the driver: a few MB whatever the corpus.
    """
    vocab = vocabulary(path or public_tokenizers.path(VOCABULARY))
    words = [r["word"] for r in frequent_words(counts, n_words).collect()]
    entries = {w.encode(): vocab.merge(w.encode()) for w in words if w not in vocab.specials}
    file = Path(tempfile.mkdtemp(prefix="gridkin-lexicon-")) / f"lexicon-{uuid.uuid4().hex}.bin"
    write_lexicon(file, entries)
    counts.sparkSession.sparkContext.addFile(str(file))
    return file.name


_encoders: dict[tuple[str, str | None], Encoder] = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    """The latest one stays in the process, with the words it remembers."""
    if (path, lexicon) not in _encoders:
        _encoders.clear()
        opened = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        _encoders[path, lexicon] = Encoder(vocabulary(path), opened)
    return _encoders[path, lexicon]


def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's end (one more edge than texts)."""
        cut = [self.vocab.cut(t) for t in texts]
        words = [w for c in cut for w in c]
        if len(self._code) > REMEMBERED:
            self._forget()
        if new := set(words).difference(self._code):
            self._learn(sorted(new))
        codes = np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))
        ids, ends = ragged_gather(self._ids, self._starts[codes], self._lengths[codes])
        per_text = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)[per_text]


def decoded(vocab: Vocabulary, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Tokens joined by a blank, as the library does for a vocabulary without a decoder.

    Ids that the vocabulary does not have are left out.
    """
    return _joined(vocab, vocab.pieces, ids, edges)


def _joined(vocab: Vocabulary, parts: tuple, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    good = (ids >= 0) & (ids < len(vocab.known))
    good[good] = vocab.known[ids[good]]
    edges = np.concatenate([[0], np.cumsum(good)])[edges]
    ids = ids[good]
    flat, starts, lengths = parts
    out, ends = ragged_gather(flat, starts[ids], lengths[ids])
    at = np.concatenate([[0], ends])[edges]
    raw = out.tobytes()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``CHUNK`` characters; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab, counts = vocabulary(path), Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in in_slices(batches, 1024, 0):
        for part in _chunks(batch[0].to_pylist()):
            for text in part:
                counts.update(vocab.cut(text))
            if len(counts) > 2 * REMEMBERED:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(word, n)`` over all texts, as the vocabulary cuts them; null counts as empty."""
    path = path or public_tokenizers.path(VOCABULARY)
    texts = docs.select(text_or_empty(text_col).alias("text"))
    partial = map_arrow(texts, lambda b: _counted(b, path), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, n_words: int) -> DataFrame:
    """``(word)``: about ``n_words`` of the most frequent ones, without a sort.

    A histogram of the counts, in steps of a tenth, tells the step in which the last of these words lies; all
    words above it are taken, and of that step those whose hash falls into the share that is wanted.
    """
    rows = counts.where(F.octet_length("word").between(1, LEXICON_BYTES))
    rows = stored_in_small_batches(rows.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 7).cast("int")), "word-counts")
    # At most 63 * 7 steps.
    steps = sorted(map(tuple, rows.groupBy("step").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    seen, last, share = 0, None, 1.0
    for step, k in steps:
        last = step
        if seen + k >= n_words:
            share = (n_words - seen) / k
            break
        seen += k
    if last is None:
        return rows.select("word")
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    return rows.where((F.col("step") > last) | ((F.col("step") == last) & part)).select("word")


def ship_lexicon(counts: DataFrame, n_words: int = LEXICON_WORDS, path: str | None = None) -> str:
    """Compile the most frequent words and send the file to all executors; returns its name there.

    About ``n_words`` words of at most ``LEXICON_BYTES`` bytes reach the driver: a few MB whatever the corpus.
    """
    vocab = vocabulary(path or public_tokenizers.path(VOCABULARY))
    words = [r["word"] for r in frequent_words(counts, n_words).collect()]
    entries = {w.encode(): vocab.merge(w.encode()) for w in words if w not in vocab.specials}
    file = Path(tempfile.mkdtemp(prefix="gridkin-lexicon-")) / f"lexicon-{uuid.uuid4().hex}.bin"
    write_lexicon(file, entries)
    counts.sparkSession.sparkContext.addFile(str(file))
    return file.name


_encoders: dict[tuple[str, str | None], Encoder] = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    """The latest one stays in the process, with the words it remembers."""
    if (path, lexicon) not in _encoders:
        _encoders.clear()
        opened = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        _encoders[path, lexicon] = Encoder(vocabulary(path), opened)
    return _encoders[path, lexicon]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, lexicon: str | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, lexicon)
    for batch in in_slices(batches, 1024, -1):
        at = 0
        for part in _chunks(batch[-1].to_pylist()):
            ids, edges = encoder.encode(part)
            column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
            kept = batch.slice(at, len(part))
            at += len(part)
            yield pa.record_batch([*kept.columns[:-1], column], names=[*kept.schema.names[:-1], "ids"])


def encode(
    docs: DataFrame,
    *,
    text_col: str = "text",
    ids_col: str = "ids",
    lexicon: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Replaces the text by ``ids_col`` (array of int); all other columns stay.

    A null or empty text has no ids.  A column that is already called ``ids_col`` is replaced.  ``lexicon``
    is the name that ``ship_lexicon`` gave.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), ids_col.lower())]
    plain = docs.select(*[F.col(f"`{c}`") for c in rest], text_or_empty(text_col).alias(free_name(rest, "text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]]
    out = free_name(rest, "ids")
    mapped = map_arrow(
        plain,
        lambda batches: (
            b.rename_columns([*b.schema.names[:-1], out]) for b in _encoded(batches, path, lexicon)
        ),
        ", ".join([*fields, f"`{out}` array<int>"]),
    )
    return mapped.withColumnRenamed(out, ids_col)


def _digests(batches: Iterator[pa.RecordBatch], path: str, lexicon: str | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, lexicon)
    vocab = encoder.vocab
    for batch in in_slices(batches, 1024, 1):
        at = 0
        for part in _chunks(batch[1].to_pylist()):
            ids, edges = encoder.encode(part)
            hashed = [
                [hashlib.sha256(x).hexdigest() for x in texts]
                for texts in (_joined(vocab, vocab.decimals, ids, edges), decoded(vocab, ids, edges))
            ]
            yield pa.record_batch(
                {
                    "doc_id": batch[0].slice(at, len(part)),
                    "n_tokens": pa.array(np.diff(edges), pa.int64()),
                    "ids_sha256": pa.array(hashed[0], pa.string()),
                    "decoded_sha256": pa.array(hashed[1], pa.string()),
                }
            )
            at += len(part)


def round_trip_digests(docs: DataFrame, lexicon: str | None, path: str | None = None) -> DataFrame:
    """Encode and decode every text and keep the digests only: ids joined by blanks, and decoded text.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per document.  A null text counts as empty and has
    no ids; texts of any length are encoded whole; repeated rows are encoded each; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return map_arrow(
        plain,
        lambda b: _digests(b, path, lexicon),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        lists = batch[-1].cast(pa.list_(pa.int64())).fill_null([])
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        texts = [x.decode() for x in decoded(vocab, flat, edges.astype(np.int64))]
        yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)


def decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Replaces the ids by the decoded text; null or no ids give the empty text."""
    path = path or public_tokenizers.path(VOCABULARY)
    rest = [c for c in df.columns if c.lower() not in (text_col.lower(), ids_col.lower())]
    plain = df.select(*[F.col(f"`{c}`") for c in rest], F.col(ids_col).alias(free_name(rest, "ids")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]]
    out = plain.columns[-1]
    mapped = map_arrow(plain, lambda b: _decoded(b, path), ", ".join([*fields, f"`{out}` string"]))
    return mapped.withColumnRenamed(out, text_col)
