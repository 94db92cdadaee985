"""Quality rules: fixed base rules and a learned decision list, all as Spark column expressions.

Statistics of whole texts are built-in functions on the row itself, so no text moves.  The decision list is
learned by sequential covering from labelled statistics: a rule, a conjunction of thresholds, is grown
condition by condition by information gain on two thirds of the rows, pruned from its end on the other
third, kept if it is precise there, and the rows it covers are removed before the next one is grown.  The
rules become one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import SPACES, held_out

# Low bits of a window's hash that hold its place in the text.
PLACE_BITS = 21
# Labelled rows that the list is learned from, at most; taken by hash of the id.
SAMPLE = 20_000
CUTS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
# Share of low-quality rows that a rule must reach on the rows it was not grown on, and rows it must cover.
PRECISE = 0.95
LEAST_COVERED = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = (
    "n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "line_length",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _neighbours(items: Column) -> Column:
    """Pairs of each item with the next one, as fields ``0`` and ``1``."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n))


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _same_window(words: Column, i: Column, j: Column) -> Column:
    same = F.lit(True)
    for k in range(3):
        same = same & (F.get(words, i + k) == F.get(words, j + k))
    return same


def _covered(twins: Column) -> Column:
    """Words in the union of the 3-word windows at the places ``a`` and ``b`` of the pairs."""
    places = let(
        twins,
        lambda t: F.sort_array(
            F.array_distinct(F.concat(F.transform(t, lambda p: p["a"]), F.transform(t, lambda p: p["b"])))
        ),
    )
    return let(
        places,
        lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(
            F.aggregate(_neighbours(d), F.lit(3), lambda n, p: n + F.least(F.lit(3), p["1"] - p["0"]))
        ),
    )


def _repeated(words: Column) -> Column:
    """Number of words that lie in 3-word windows found twice or more.

    Window hashes are sorted to bring equal windows together.  The fast form sorts plain longs, the hash with
    its last bits given to the place; where two neighbours agree in the hash bits but not in their words, or
    a text has too many words, the words are sorted with the hashes.  Both compare words.
    """
    mask = (1 << PLACE_BITS) - 1
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    packed = F.transform(
        starts,
        lambda i: _window_hash(words, i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
    )
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    near = let(
        F.sort_array(packed),
        lambda s: F.transform(
            F.filter(
                _neighbours(s),
                lambda p: F.shiftright(p["0"], PLACE_BITS) == F.shiftright(p["1"], PLACE_BITS),
            ),
            lambda p: F.struct(place(p["0"]).alias("a"), place(p["1"]).alias("b")),
        ),
    )
    slow = let(
        F.array_sort(
            F.transform(
                starts,
                lambda i: F.struct(
                    _window_hash(words, i).alias("h"), *[F.get(words, i + k).alias(f"w{k}") for k in range(3)], i.alias("i")
                ),
            )
        ),
        lambda s: F.transform(
            F.filter(
                _neighbours(s),
                lambda p: reduce(lambda x, y: x & y, [p["0"][c] == p["1"][c] for c in ("h", "w0", "w1", "w2")]),
            ),
            lambda p: F.struct(p["0"]["i"].alias("a"), p["1"]["i"].alias("b")),
        ),
    )
    fast = let(
        near,
        lambda t: F.when(F.forall(t, lambda p: _same_window(words, p["a"], p["b"])), _covered(t)).otherwise(
            _covered(slow)
        ),
    )
    return (
        F.when(F.size(words) < 4, F.lit(0)).when(F.size(words) > mask, _covered(slow)).otherwise(fast)
    )


def text_stats(text: Column) -> Column:
    """Struct of ``STATS``, all long; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    trimmed = lambda t: F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = lambda t: let(
        trimmed(t),
        lambda x: F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, SPACES, -1)),
    )
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def row(t: Column) -> Column:
        from_words = let(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated")))
        from_lines = let(
            lines(t), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))
        )
        return let(
            F.struct(from_words.alias("w"), from_lines.alias("x")),
            lambda s: F.struct(
                *[
                    value.cast("long").alias(name)
                    for name, value in zip(
                        STATS,
                        (
                            s["w"]["n"],
                            F.length(t) - count(t, r"[\x20\x09-\x0D]"),
                            count(t, r"[#*$%&|<>]"),
                            s["x"]["n"] - s["x"]["kinds"],
                            s["w"]["repeated"],
                            s["x"]["n"],
                        ),
                        strict=True,
                    )
                ]
            ),
        )

    return let(text, row)


def base_failed(stats: Column) -> Column:
    """The fixed rules: fewer than 50 words, or more than half of them in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    """Numbers that do not depend on the length of a text, beside the length itself."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(stats["n_lines"], F.lit(1)).cast("double")
    values = (
        stats["n_words"].cast("double"), stats["word_chars"] / words, stats["n_symbols"] / words,
        stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words, stats["n_words"] / lines,
    )
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, row: Sequence[float]) -> bool:
        value = row[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: Sequence[float]) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(bad: list, good: list) -> Rule:
    """Add the condition with the largest information gain until no good row is left."""
    rule: Rule = ()
    while good and bad and len(rule) < MAX_CONDITIONS:
        p0, n0 = len(bad), len(good)
        best, gain = None, 0.0
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in bad} | {r[f] for r in good})
            step = max(len(values) // CUTS, 1)
            cuts = [(a + b) / 2 for a, b in zip(values[::step], values[1::step], strict=False)]
            bads, goods = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            i = j = 0
            for cut in cuts:
                while i < p0 and bads[i] <= cut:
                    i += 1
                while j < n0 and goods[j] <= cut:
                    j += 1
                for above, p, n in ((True, p0 - i, n0 - j), (False, i, j)):
                    if p >= LEAST_COVERED:
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if g > gain + 1e-9:
                            best, gain = Condition(f, above, cut), g
        if best is None:
            break
        rule = (*rule, best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def _worth(rule: Rule, bad: list, good: list) -> tuple[float, int]:
    p = sum(_covers(rule, r) for r in bad)
    n = sum(_covers(rule, r) for r in good)
    return (p / (p + n) if p + n else 0.0), p


def learn_list(rows: Sequence[Sequence[float]], low: Sequence[bool]) -> list[Rule]:
    """Ordered rules for low quality.  Every third row is kept from growing, to prune and to accept.

    No rows, or rows of one kind only, give an empty list, which rejects nothing.
    """
    grow = [(r, x) for i, (r, x) in enumerate(zip(rows, low, strict=True)) if i % 3]
    check = [(r, x) for i, (r, x) in enumerate(zip(rows, low, strict=True)) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow([r for r, x in grow if x], [r for r, x in grow if not x])
        bad, good = [r for r, x in check if x], [r for r, x in check if not x]
        # Of all beginnings of the rule the most precise one, the shortest of equals.
        options = [(*_worth(rule[:n], bad, good), -n) for n in range(1, len(rule) + 1)]
        precise, covered, n = max(options, default=(0.0, 0, 0), key=lambda o: (o[0], o[2]))
        if precise < PRECISE or covered < LEAST_COVERED:
            break
        rule = rule[:-n]
        rules.append(rule)
        grow = [(r, x) for r, x in grow if not _covers(rule, r)]
        check = [(r, x) for r, x in check if not _covers(rule, r)]
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Features and label of at most ``sample`` labelled documents, chosen by hash of the id.

    Held-out documents (``held_out``) are left out, so that the list can be judged on them.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``sample`` ids: a few hundred KB.
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text_stats(F.col("text")).alias("s"))
    values = joined.select("doc_id", "quality", *[v.alias(k) for k, v in features(F.col("s")).items()])
    return values.orderBy(F.xxhash64("doc_id"), *values.columns).limit(sample)


def learned_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Collects the bounded sample of numbers (no texts) and learns the list from it."""
    rows = labelled_stats(docs, labels).collect()
    return learn_list([[r[f] for f in FEATURES] for r in rows], [r["quality"] == 0 for r in rows])


def verdict(stats: Column, rules: Sequence[Rule]) -> Column:
    """The first rule that covers a text rejects it; a text that none covers stays."""
    values = list(features(stats).values())
    out = None
    for rule in rules:
        whole = F.lit(True)
        for c in rule:
            whole = whole & (values[c.feature] > c.cut if c.above else values[c.feature] <= c.cut)
        out = F.when(whole, F.lit(False)) if out is None else out.when(whole, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(doc_id, statistics, base_failed, kept)``: one row per document, repeated rows included.

    A null or empty text has no words and fails; texts of any length are taken whole; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_stats(F.col("text")).alias("s"))
    return rows.select(
        "doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"),
        (~base_failed(F.col("s")) & verdict(F.col("s"), rules)).alias("kept"),
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The documents that pass, with all their columns."""
    # One expression, so that the filter computes the statistics once.
    return docs.where(let(text_stats(F.col("text")), lambda s: ~base_failed(s) & verdict(s, rules)))
