"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust a score.

All of it is built-in functions on the row itself, so no text moves and no Python runs.  For each kind the text
is split at the proposals; the pieces between them give both the places (a running sum of lengths) and the words
before and after each one, so the work is in proportion to the text however many proposals it holds.

Proposals of the four base kinds that pass their check (address parts, Luhn, number of digits) are always found.
The method adds account numbers (country's length, mod 97), social security numbers and telephone numbers without
a country code; these are found where their score reaches ``FOUND``.  A score is the weight of the kind, raised
by a word that names it within reach and lowered by one that names something else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import text_or_empty

# Code points before and after a proposal in which a word counts as nearby.
BEFORE, AFTER = 40, 20
RAISE, LOWER = 0.4, 0.3
FOUND = 0.6
# Proposals whose lengths are summed at a time.
_RUN = 64

# Lengths of international bank account numbers by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC",
}


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes without backtracking over groups, so that very long matches pass.

    ``near`` and ``not_near`` are expressions over lower-case text; ``hint`` must hold for a text to be searched.
    """

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column, Column, Column], Column]
    weight: float
    near: str
    not_near: str


def _has(*marks: str) -> Callable[[Column], Column]:
    return lambda text: F.greatest(*[F.contains(text, F.lit(m)) for m in marks], F.lit(False))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """12 to 19 digits whose sum, every second one from the right doubled, is a multiple of ten."""
    backwards = F.reverse(digits(found))
    value = lambda c, i: F.get(
        F.when(i % 2 == 0, F.array(*[F.lit(d) for d in range(10)])).otherwise(
            F.array(*[F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)])
        ),
        c.cast("int"),
    )
    total = F.aggregate(F.transform(F.split(backwards, ""), value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(backwards).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def mod_97(code: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 99), F.substring(code, 1, 4))
    step = lambda r, c: F.when(
        F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97
    ).otherwise((r * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def account(found: Column, after: Column) -> Column:
    """The beginning of a proposal that is an account number of its country's length, null if none is.

    ``after`` is the text that follows the proposal.
    """
    lengths = F.lit(None).cast("int")
    for n, countries in ACCOUNT_LENGTHS.items():
        lengths = F.when(F.substring(found, 1, 2).isin(*countries.split()), F.lit(n)).otherwise(lengths)

    def cut(n: Column) -> Column:
        # In groups of four, or in one piece.
        upto = F.when(F.contains(found, F.lit(" ")), n + F.floor((n - 1) / 4).cast("int")).otherwise(n)
        part = F.substring(found, F.lit(1), upto)
        code = F.replace(part, F.lit(" "), F.lit(""))
        follows = F.substring(F.concat(found, F.substring(after, 1, 1)), upto + 1, F.lit(1))
        right = (F.length(code) == n) & ~F.rlike(follows, F.lit("[A-Za-z0-9]")) & (mod_97(code) == 1)
        return F.when(right, part)

    return F.get(F.transform(F.array(lengths), cut), F.lit(0))


# Neither inside a longer number, word or code.
_INSIDE_BEFORE = r"(?:[A-Za-z]|[0-9+][\x20().-]{0,2})\z"
_INSIDE_AFTER = r"^(?:[A-Za-z0-9@]|[.\x20-]?[0-9])"


def _whole(before: Column, after: Column) -> Column:
    return ~F.rlike(before, F.lit(_INSIDE_BEFORE)) & ~F.rlike(after, F.lit(_INSIDE_AFTER))


_LOCAL = r"[A-Za-z0-9._%+-]"
_word = lambda w: rf"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|\z)"
_CALL = rf"phone|{_word('tel')}|telef|{_word('call')}|mobil|{_word('cell')}|{_word('fax')}|whatsapp|anruf|llam|appel"
_OTHER_NUMBER = r"isbn|issn|order|invoice|ticket|article|serial|model|doi"

# The patterns of the first four kinds, written so that they find the same matches without trying a
# run of characters again from each of its places (\G: where the last match ended).
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _has("@"),
        lambda found, before, after: F.lit(True), 0.9, r"mail|contact|kontakt|write|reply|@", r"example|noreply|no-reply",
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _has("."),
        lambda found, before, after: F.rlike(
            found, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z")
        ),
        0.6, rf"{_word('ip')}|address|host|server|login|client|visitor", r"version|release|build|section|chapter",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda text: F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
        lambda found, before, after: luhn(found), 0.7, r"card|visa|master|amex|credit|debit|karte|tarjeta|carte|cvv", _OTHER_NUMBER,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has("+"),
        lambda found, before, after: F.length(digits(found)).between(9, 15), 0.8, _CALL, _OTHER_NUMBER,
    ),
    Kind(
        "account", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30}+)",
        lambda text: F.rlike(text, F.lit(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9][A-Z0-9]{4}")),
        lambda found, before, after: account(found, after).isNotNull() & ~F.rlike(before, F.lit(r"[A-Za-z0-9]\z")), 0.9, r"iban|account|konto|cuenta|compte|bank", r"",
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda text: F.rlike(text, F.lit(r"[0-9]-[0-9]{2}-[0-9]")),
        lambda found, before, after: ~F.rlike(found, F.lit("^(?:000|666|9)|-00-|0000\\z")) & _whole(before, after),
        0.3, rf"{_word('ssn')}|social.security", _OTHER_NUMBER,
    ),
    Kind(
        "local_phone", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}",
        lambda text: F.rlike(text, F.lit(r"[0-9]{3}[\x20.-][0-9]{4}")),
        lambda found, before, after: _whole(before, after), 0.3, _CALL, _OTHER_NUMBER,
    ),
)
BASE = 4
NAMES = tuple(k.name for k in KINDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_starts(lengths: Column) -> Column:
    """Sum of all earlier numbers for each place of an array.

    Sums of runs first, so that neither a long array nor its copies are gone through once per place.
    """
    add = lambda a, b: a + b
    total = lambda array: F.aggregate(array, F.lit(0).cast("long"), add)
    one = F.lit(1)
    runs = lambda n: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _RUN).cast("int")),
        lambda i: total(F.slice(n, i * _RUN + 1, F.lit(_RUN))),
    )

    def before_runs(sums: Column) -> Column:
        first = F.array(F.lit(0).cast("long"))
        return F.aggregate(sums, first, lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + s)))

    def places(n: Column) -> Column:
        return let(
            before_runs(runs(n)),
            lambda starts: F.transform(
                n,
                lambda _, i: F.get(starts, F.floor(i / _RUN).cast("int"))
                + total(F.slice(n, F.floor(i / _RUN).cast("int") * _RUN + one, F.pmod(i, F.lit(_RUN)))),
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(places(lengths))


_SPAN = "array<struct<start:long,kind:int,end:long,score:double,found:string>>"


def spans_of(text: Column, number: int) -> Column:
    """Spans of one kind: ``array<struct<start, kind, end, score, found>>`` in code points, in their order."""
    kind = KINDS[number]
    nothing = F.array().cast(_SPAN)

    def scored(found: Column, before: Column, after: Column) -> Column:
        nearby = F.lower(F.concat(F.substring(before, -BEFORE, BEFORE), F.lit(" "), F.substring(after, 1, AFTER)))
        rise = F.when(F.rlike(nearby, F.lit(kind.near)), F.lit(RAISE)).otherwise(0.0)
        fall = F.when(F.rlike(nearby, F.lit(kind.not_near)), F.lit(LOWER)).otherwise(0.0) if kind.not_near else F.lit(0.0)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.weight) + rise - fall)), 2)

    def placed(s: Column) -> Column:
        pieces, found, starts = s["pieces"], s["found"], s["starts"]

        def one(match: Column, i: Column) -> Column:
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            start = F.get(starts, i) + F.length(before)
            text = account(match, after) if kind.name == "account" else match
            right = kind.check(match, before, after)
            return F.when(
                right,
                F.struct(
                    start.alias("start"),
                    F.lit(number).alias("kind"),
                    (start + F.length(text)).alias("end"),
                    scored(match, before, after).alias("score"),
                    text.alias("found"),
                ),
            )

        least = 0.0 if number < BASE else FOUND
        return F.filter(F.transform(found, one), lambda x: x.isNotNull() & (x["score"] >= least)).cast(_SPAN)

    def cut(t: Column) -> Column:
        def with_pieces(found: Column) -> Column:
            pieces = F.split(t, kind.pattern, -1)
            lengths = lambda p: F.transform(found, lambda m, i: F.length(F.get(p, i)) + F.length(m))
            parts = let(
                pieces,
                lambda p: F.struct(
                    p.alias("pieces"), found.alias("found"), running_starts(lengths(p)).alias("starts")
                ),
            )
            return F.when(F.size(found) == 0, nothing).otherwise(let(parts, placed))

        return let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), with_pieces)

    return F.when(kind.hint(text), cut(text)).otherwise(nothing)


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, more)``: spans of the base kinds and those the method adds, each sorted by start.

    One row per document, repeated rows each; a null or empty text has no spans; a null id stays null; other
    columns are ignored, whatever their names.  An added span that overlaps a base span is left out, unless it is
    an account number, which may hold digits that look like a card.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    sort = lambda kinds: F.array_sort(F.concat(*[spans_of(F.col("text"), k) for k in kinds]))
    found = rows.select(
        "doc_id", sort(range(BASE)).alias("base"), sort(range(BASE, len(KINDS))).alias("more")
    )
    free = lambda s: (s["kind"] == NAMES.index("account")) | ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    )
    return found.select("doc_id", "base", F.filter("more", free).alias("more"))


def _joined(spans: Column | str) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, least_score)``, one row per document.

    ``least_score`` is the lowest score of the document's spans, null where there are none.  For the cases that
    ``find`` defines the digest is that of no spans.
    """
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    spans = F.array_sort(F.concat("base", "more"))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{NAMES[i]}") for i in range(BASE)],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.array_min(F.transform(spans, lambda s: s["score"])).alias("least_score"),
    )
