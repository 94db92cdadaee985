"""Quotation linking against brute force: partial, interleaved, nested and re-wrapped quotes."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.llm import quotation

MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+")


def parse(text):
    """(level, normalised lines) of every passage."""
    out, open_level = [], None
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        level, bare = (found[0].count(">"), line[found.end() :]) if found else (0, line)
        said = "" if re.fullmatch(r"[^\n]{1,200} wrote:[ \t]*", bare) else " ".join(bare.split()).lower()
        if not said:
            open_level = None
            continue
        if open_level != level:
            out.append((level, []))
        out[-1][1].append(said)
        open_level = level
    return out


def parents(messages):
    held = {}
    for turn, text in messages:
        held[turn] = {s for level, lines in parse(text) if level == 0 for s in (" ".join(lines), *lines)}
    out = {}
    for turn, text in messages:
        score = {}
        for level, lines in parse(text):
            if level == 0:
                continue
            latest = lambda s, turn=turn: max((t for t in held if t < turn and s in held[t]), default=None)
            whole = " ".join(lines)
            cited = [(latest(whole), len(whole))]
            if cited[0][0] is None:
                cited = [(latest(s), len(s)) for s in lines]
            for parent, n in cited:
                if parent is not None:
                    score[level, parent] = score.get((level, parent), 0) + n
        best = min(score, key=lambda k: (k[0], -score[k], -k[1]), default=None)
        out[turn] = best[1] if best else None
    return out


def wrapped(rng, text, width):
    words, lines = text.split(" "), [[]]
    for w in words:
        if len(lines[-1]) >= width:
            lines.append([])
        lines[-1].append(w)
    return "\n".join((" " * int(rng.integers(1, 3))).join(x) for x in lines)


def thread(rng, n):
    """Messages of some paragraphs that quote parts of earlier ones in every way."""
    said, out = [], []
    for turn in range(n):
        own = ["\n".join(" ".join(rng.choice(list("abcdefgh"), 5)) for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(1, 4))]
        said.append(own)
        parts = []
        for _ in range(rng.integers(0, 4)):
            if turn == 0:
                break
            source = said[int(rng.integers(turn))]
            text = source[int(rng.integers(len(source)))] if rng.random() < 0.7 else "\n\n".join(source)
            if rng.random() < 0.3:
                text = text.split("\n")[0]
            if rng.random() < 0.3:
                text = "\n".join(wrapped(rng, x.replace("\n", " "), 3) for x in text.split("\n\n"))
            mark = ["> ", ">", ">> ", "> > ", ">>>"][int(rng.integers(5))]
            parts.append("\n".join(mark + x.upper() if rng.random() < 0.2 else mark + x for x in text.split("\n")))
        pieces = [*parts, *own]
        order = rng.permutation(len(pieces))
        lines = ["On Monday x wrote:"] if rng.random() < 0.3 else []
        out.append((turn * 3, "\n".join([*lines, *[pieces[i] + ("\n" if rng.random() < 0.5 else "") for i in order]])))
    return out


@pytest.mark.parametrize("span", [quotation.SPAN, 4])
def test_parents_equal_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(quotation, "SPAN", span)
    rng = np.random.default_rng(span)
    threads = {c: thread(rng, int(rng.integers(1, 12))) for c in range(60)}
    rows = [(c, t, "user", text) for c, messages in threads.items() for t, text in messages]
    got = quotation.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {(c, t): p for c, messages in threads.items() for t, p in parents(messages).items()}
    assert {(r.conv_id, r.turn): r.parent for r in got} == want
    assert sum(p is not None for p in want.values()) > 100


def test_kinds_of_quotes(spark):
    first = "One thing is this.\nAnd that.\n\nAnother paragraph\nof two lines."
    rows = [
        (0, first),
        (1, "> Another paragraph\n> of two lines.\nPartly quoted."),
        (2, "> one  thing is this. and that.\nRe-wrapped."),
        (3, ">> Another paragraph of two lines.\nOnly at level two."),
        (4, "> One thing is this.\nYes.\n> And that.\nNo."),
        (5, "> Partly quoted.\n>> Another paragraph\n>> of two lines.\nNested."),
        (6, "> Yes.\n> No.\n> And that.\nLines of two messages."),
        (7, "> of two lines.\n> unknown line\nOne line of a passage."),
        (8, "> nothing known\nNew."),
    ]
    df = spark.createDataFrame([("c", t, "u", x) for t, x in rows], "conv_id string, turn long, role string, text string")
    got = {r.turn: (r.parent, r.text) for r in quotation.conversations(df).collect()}
    assert {t: p for t, (p, _) in got.items()} == {0: None, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: None}
    assert got[4][1] == "Yes.\nNo." and got[5][1] == "Nested."


def test_long_and_odd_messages(spark):
    long = "\n".join(f"line {i}" for i in range(3_000))
    rows = [
        ("c", 0, "u", long), ("c", 1, "u", "\n".join("> " + x for x in long.split("\n")) + "\nAll of it."),
        ("c", 2, "u", "> line 7\nOne."), ("c", 2, "u", "> line 7\nOne."), ("d", 0, None, ""), ("d", None, "u", "> line 7"),
        (None, 1, "u", "> line 7"), ("e", 5, "u", "x" * 200_000), ("e", 6, "u", ">" * 1_000 + "x"),
    ]
    rows += [("hot", t, "u", "> same\nsame") for t in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns(
        {c: F.lit(1) for c in ("parent", "u", "h1", "level", "span", "root")}
    )
    got = quotation.conversations(df).collect()
    found = {(r.conv_id, r.turn): (r.parent, r.depth) for r in got}
    assert found["c", 1] == (0, 1) and found["c", 2] == (0, 1) and found["e", 6] == (None, 0)
    assert all(found["hot", t] == (t - 1, t) for t in range(1, 3_000)) and found["hot", 0] == (None, 0)
    assert len(got) == len(rows) - 1
    assert quotation.conversations(df.where("false")).count() == 0


def test_built_in_functions_only(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = quotation.conversations(df.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
