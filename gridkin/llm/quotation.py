"""Chat formatting by quotation linking: reply-ordered conversations without quotes, in built-in functions.

A message may quote earlier ones, line by line, with one ``>`` per level, whole or in part, and with answers in
between.  Consecutive lines of one level are a passage; blank lines and attribution lines part passages.  A
passage is normalised (markers off, white space and case folded) and hashed, and so are its lines; the same is
done with what each message says itself.  Equal hashes in one conversation link a passage, at whatever level, to
the latest earlier message that holds it: the whole passage if any message does, which a different line width does
not hinder, else line by line.

A message answers the one that it quotes at the lowest level, among these the one with the most text quoted, then
the latest.  Quotes go, and messages are numbered along their replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.operators.storage import write_and_read

# Quote markers at the start of a line, blanks between them allowed.
MARKS = r"^[\x20\t]*(?:>[\x20\t]?)+"
ATTRIBUTION = r"^[^\n]{1,200} wrote:[\x20\t]*$"
# Turns that are looked through together for the latest one that holds a text.
SPAN = 1024


def _level(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, MARKS, 0), F.lit(">"))


def normal(text: Column) -> Column:
    """White space folded to single blanks, lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_UNITS = "array<struct<level:int,passage:int,whole:boolean,h1:long,h2:long,n:int>>"


def passages(text: Column) -> Column:
    """Array of ``(level, text, lines)``: runs of lines of one level, normalised; level 0 is own text."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: let(
            F.regexp_replace(x, MARKS, ""),
            lambda bare: F.struct(
                _level(x).alias("level"), F.when(F.rlike(bare, F.lit(ATTRIBUTION)), "").otherwise(normal(bare)).alias("text")
            ),
        ),
    )

    def edge(n: Column, i: Column, side: int) -> Column:
        """Whether a line is the first (-1) or last (1) of its run."""
        own, other = F.get(n, i), F.get(n, i + side)
        return (own["text"] != "") & (other.isNull() | (other["text"] == "") | (other["level"] != own["level"]))

    def runs(n: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(n) - 1)
        firsts, lasts = F.filter(places, lambda i: edge(n, i, -1)), F.filter(places, lambda i: edge(n, i, 1))
        return F.zip_with(
            firsts,
            lasts,
            lambda i, j: let(
                F.transform(F.slice(n, i + 1, j - i + 1), lambda x: x["text"]),
                lambda t: F.struct(F.get(n, i)["level"].alias("level"), F.array_join(t, " ").alias("text"), t.alias("lines")),
            ),
        )

    return let(lines, runs)


def units(found: Column) -> Column:
    """Hashes of the passages and, where a passage has several lines, of these."""

    def unit(level: Column, i: Column, whole: bool, text: Column) -> Column:
        return F.struct(
            level.alias("level"), i.alias("passage"), F.lit(whole).alias("whole"), F.xxhash64(text).alias("h1"),
            F.xxhash64(text, F.lit(1)).alias("h2"), F.length(text).alias("n"),
        )

    def of(p: Column, i: Column) -> Column:
        own = F.array(unit(p["level"], i, True, p["text"]))
        lines = F.transform(p["lines"], lambda x: unit(p["level"], i, False, x))
        return F.when(F.size(p["lines"]) > 1, F.concat(own, lines)).otherwise(own)

    return F.flatten(F.transform(found, of)).cast(_UNITS)


def own_text(text: Column) -> Column:
    """What the writer added: lines without a quote mark, attribution lines off, trimmed."""
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: (_level(x) == 0) & ~F.rlike(x, F.lit(ATTRIBUTION)),
    )
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \t\r\n"))


def linked(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, parent)``, stored: own text, and the turn that is answered or null.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``text``.
    """
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    text = F.col("text")
    parsed = base.select("conv_id", "turn", "role", own_text(text).alias("own"), units(passages(text)).alias("u"))
    stored = write_and_read(parsed.distinct(), "messages")
    best = answered(stored.select("conv_id", "turn", F.explode("u").alias("u")).select("conv_id", "turn", "u.*"))
    return write_and_read(
        stored.join(best, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "role", F.col("own").alias("text"), "parent"
        ),
        "replies",
    )


def answered(hashed: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)`` from the hashed units of all messages; messages that quote nothing known are left out."""
    known = hashed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    key = ["conv_id", "h1", "h2"]
    held = known.where(F.col("level") == 0).select(*key, "turn").distinct()
    asked = known.where(F.col("level") > 0).select(*key, "turn").distinct()
    cited = write_and_read(latest_before(asked, held, key), "cited")
    quoted = known.where(F.col("level") > 0).join(cited, [*key, "turn"])
    # A passage by itself, or else its lines; both lie in one row of the message.
    each = quoted.groupBy("conv_id", "turn", "level", "passage").agg(
        F.max(F.when(F.col("whole"), F.struct("parent", "n"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.struct("parent", "n"))).alias("lines"),
    )
    found = each.select(
        "conv_id", "turn", "level",
        F.inline(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.col("lines"))),
    )
    scored = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("n"))
    first = F.min(F.struct(F.col("level"), (-F.col("n")).alias("n"), (-F.col("parent")).alias("p")))
    return scored.groupBy("conv_id", "turn").agg((-first["p"]).alias("parent"))


def latest_before(asked: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, turn, parent)``: for each asked (key, turn) the latest smaller turn that is held; none, no row.

    Turns meet in spans of ``SPAN``; what spans before hold comes from one row per span, so a text that a whole
    long conversation repeats is not gone through in one piece.
    """
    span = F.floor(F.col("turn") / SPAN).alias("span")
    marked = asked.select(*key, "turn", span, F.lit(False).alias("has")).unionByName(
        held.select(*key, "turn", span, F.lit(True).alias("has"))
    )
    own = F.when(F.col("has"), F.col("turn"))
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("near", F.max(own).over(inside)).where(~F.col("has"))
    ends = held.select(*key, "turn", span).groupBy(*key, "span").agg(F.max("turn").alias("last"))
    both = ends.unionByName(asked.select(*key, span, F.lit(None).cast("long").alias("last")).distinct())
    spans = both.groupBy(*key, "span").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*key, "span", F.max("last").over(earlier).alias("far"))
    return (
        near.join(spans, [*key, "span"])
        .select(*key, "turn", F.coalesce("near", "far").alias("parent"))
        .where(F.col("parent").isNotNull())
    )


def conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, root, depth, turn, parent, role, text)``: one row per message, quotes taken out.

    ``root`` is the first turn of the message's chain of replies and ``depth`` its distance from it: ordered
    by (root, depth, turn) a conversation reads in reply order.  A message that quotes nothing known starts a
    chain.  A null text counts as empty, repeated rows are one, rows of a null conversation or turn are chains
    of their own.  Chains are followed by doubling, so a chain of n replies takes log n joins.
    """
    replies = linked(messages)
    links = replies.where(F.col("parent").isNotNull()).select("conv_id", "turn", "parent").distinct()
    up = links.select("conv_id", "turn", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"))
    done = None
    while True:
        known = up if done is None else up.unionByName(done)
        far = known.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        jumped = write_and_read(
            up.join(far, ["conv_id", "to"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("next", "to").alias("to"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "chains",
        )
        # Only messages that have not come to the beginning of their chain go on.
        ended = jumped.where(~F.col("moved")).drop("moved")
        done = ended if done is None else done.unionByName(ended)
        up = jumped.where("moved").drop("moved")
        if up.limit(1).count() == 0:
            break
    ends = done.select("conv_id", "turn", F.col("to").alias("root"), F.col("steps").alias("depth"))
    return replies.join(ends, ["conv_id", "turn"], "left").select(
        "conv_id",
        F.coalesce("root", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "turn",
        "parent",
        "role",
        "text",
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """Replies as mail programs and people write them; gives plain turns the form that the operation is for.

    Of three turns the first quotes the turn before it and, a level deeper, the one before that; the second quotes
    the first and the last line of the turn before and answers in between; the third quotes the turn before the
    last, at level two only.
    """
    plain = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    stored = write_and_read(plain, "turns")

    def earlier(n: int) -> DataFrame:
        return stored.groupBy("conv_id", (F.col("turn") + n).alias("turn")).agg(F.min("text").alias(f"t{n}"))

    quote = lambda text, marks: F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit(f"\n{marks}")))
    joined = stored.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    end = lambda i: quote(F.element_at(F.split("t1", "\n", -1), i), "> ")
    forms = (
        F.concat_ws("\n", quote(F.col("t2"), ">> "), quote(F.col("t1"), "> "), F.col("text")),
        F.concat_ws("\n", end(1), F.col("text"), end(-1)),
        F.concat_ws("\n", quote(F.col("t2"), "> > "), F.col("text")),
    )
    form = F.pmod("turn", F.lit(3))
    return joined.select(
        "conv_id", "turn", "role", F.when(form == 0, forms[0]).when(form == 1, forms[1]).otherwise(forms[2]).alias("text")
    )
