"""Operator 6: personal data by regular expressions and checksums, all in DataFrame functions.

An expression proposes spans, a validator (digit counts, Luhn, mod-97) confirms
them.  Whole words within NEAR code points raise the score of a span.  Base kinds
are returned whatever their score; of the added kinds those that a checksum or a
fixed shape supports pass LEAST_SCORE on their own, and the weak ones
(``phone_local``, ``id_number``) only with such a word nearby.  Places are code points:
as no expression looks around its match (other than to start where the previous
match or a run of its first class starts, which changes no match), the leftmost
occurrence of a matched string after the previous match is the match itself.
Account numbers are sought from every place and end at the last word end that
passes mod-97.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = "[^0-9]"
NEAR = 40
LEAST_SCORE = 0.5
NEAR_SCORE = 0.2
_SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, _DIGITS, "")


def luhn(x: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    each = F.split(F.reverse(_digits(x)), "")

    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int") * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(each, weigh), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number leaves 1 when its first four characters go last and letters count from 10."""
    plain = F.regexp_replace(x, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def _address(x: Column) -> Column:
    """Whether all four parts are at most 255."""
    parts = F.transform(F.split(x, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda x: F.length(_digits(x)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """name, expression, cheap test of the text, validator, score alone, whole words (also in the plural) that raise it, whether it is base, the kind that covers it, and whether shorter ends are tried."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    beside: str | None = None
    shorter: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True), 0.9, "e?mail|contact"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: F.contains(t, F.lit(".")), _address, 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", lambda t: F.lit(True), lambda x: F.length(_digits(x)).between(16, 19) & luhn(x), 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), _between(8, 15), 0.6, "phone|telephone|call|tel|fax|mobile"),
    # what the method adds to the base: numbers that stand beside others, accounts and keys,
    # and numbers of a shape that only the words nearby make personal
    Kind("card_run", r"[0-9]++", lambda t: F.lit(True), lambda x: F.length(x).between(15, 16) & luhn(x), 0.6, "card|visa|credit|pay", False, "card"),
    Kind("phone_run", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", lambda t: F.contains(t, F.lit("+")), lambda x: F.lit(True), 0.6, "phone|telephone|call|tel|fax|mobile", False, "phone"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", lambda t: F.lit(True), mod97, 0.8, "iban|account|bank", False, shorter=True),
    Kind("secret", r"""(?i:token|key|secret|password) ?[=:] ?"[^"\s]{8,}"?""", lambda t: F.contains(t, F.lit('"')), lambda x: F.lit(True), 0.7, "api|auth|login", False),
    Kind("phone_local", r"[0-9]++(?:[.-][0-9]++)*+", lambda t: t.rlike("[0-9][.-][0-9]"), lambda x: x.rlike(r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\z"), 0.4, "phone|telephone|call|tel|fax|mobile", False, "phone"),
    Kind("id_number", r"[0-9]++(?:[.-][0-9]++)*+", lambda t: t.rlike("[0-9]-[0-9]"), lambda x: x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), 0.4, "ssn|social security|tax|insurance", False, "phone"),
)


def _located(text: Column, found: Column) -> Column:
    """Ends (exclusive, from 0) of matched strings, each sought after the one before."""
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("e"))

    def step(acc: Column, x: Column) -> Column:
        end = F.position(x, text, acc["p"] + 1) - 1 + F.length(x)
        return F.struct(end.alias("p"), F.concat(acc["e"], F.array(end)).alias("e"))

    return F.aggregate(found, start, step, lambda acc: acc["e"])


def _ended(kind: Kind, text: Column, found: Column) -> Column:
    """(x, e) of valid matches and their ends, each match cut at the last word end that makes it valid.

    ``found`` has the longest match from every place, so the leftmost occurrence
    after the start before is the match itself.  A match that ends inside a word
    counts last; one that starts inside a valid one before it is left out.
    """
    kept = "array<struct<x:string,e:int>>"

    def cut(x: Column) -> Column:
        """Prefixes that end before a space, the longest first."""
        words = F.split(x, " ")
        return F.transform(F.sequence(F.size(words) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))

    def ends(x: Column, after: Column) -> Column:
        own, rest = F.array(x), F.filter(cut(x), lambda p: F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 12)
        return F.filter(F.when(after.rlike("[A-Za-z0-9]"), F.concat(rest, own)).otherwise(F.concat(own, rest)), kind.valid)

    def step(acc: Column, x: Column) -> Column:
        at = F.position(x, text, acc["p"] + 1)

        def add(at: Column) -> Column:
            best = F.when(at > acc["e"], F.get(ends(x, F.substr(text, at + F.length(x), F.lit(1))), F.lit(0)))

            def put(best: Column) -> Column:
                end = at - 1 + F.length(best)
                new = F.array(F.struct(best.alias("x"), end.alias("e")))
                return F.struct(at.alias("p"), F.coalesce(end, acc["e"]).alias("e"), F.when(best.isNull(), acc["s"]).otherwise(F.concat(acc["s"], new)).cast(kept).alias("s"))

            return F.transform(F.array(best), put)[0]

        return F.transform(F.array(at), add)[0]

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("e"), F.array().cast(kept).alias("s"))
    return F.aggregate(found, start, step, lambda acc: acc["s"])


def _spans(kind: Kind, text: Column) -> Column:
    # where shorter ends are tried, the longest match from every place, also inside others
    pattern = f"(?=({kind.pattern}))" if kind.shorter else kind.pattern
    found = F.when(kind.guard(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind.shorter)))).otherwise(F.array().cast("array<string>"))

    def span(x: Column, end: Column) -> Column:
        start = end - F.length(x)
        # one more code point on each side tells whether the outermost words are whole
        first = F.greatest(start - NEAR - 1, F.lit(0))
        left = F.lpad(F.substr(text, first + 1, start - first), NEAR + 1, " ")
        near = F.lower(F.concat(left, F.lit(" "), F.rpad(F.substr(text, end + 1, F.lit(NEAR + 1)), NEAR + 1, " ")))
        score = F.when(near.rlike(f"[^a-z](?:{kind.context})s?[^a-z]"), F.lit(min(1.0, kind.score + NEAR_SCORE))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), x.alias("text"), score.alias("score"))

    def of(own: Column) -> Column:
        if kind.shorter:
            valid = _ended(kind, text, own)
        else:
            valid = F.filter(F.zip_with(own, _located(text, own), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda s: kind.valid(s["x"]))
        spans = F.transform(valid, lambda s: span(s["x"], s["e"]))
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)

    # the one-element array names the matches; most texts have nothing valid, and are not searched for places
    some = (lambda own: F.size(own) > 0) if kind.shorter else lambda own: F.exists(own, kind.valid)
    return F.transform(F.array(found), lambda own: F.when(some(own), of(own)).otherwise(F.array().cast(_SPAN)))[0]


def _outside(spans: Column) -> Callable[[Column], Column]:
    """Whether none of ``spans`` covers a span."""

    def test(s: Column) -> Column:
        return ~F.exists(spans, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    return test


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row, its text, and ``spans`` (kind, start, end, text, score), by kind, then start.

    Base kinds (email, ip, card, phone) are all returned; added ones where their
    score is enough and no base span of their sort covers them.  A null text is
    empty; an empty table gives no rows; repeated rows repeat their spans.
    """
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    names = [f"__{k.name}" for k in KINDS]
    rows = rows.select("*", *[_spans(k, F.col("__text")).alias(n) for k, n in zip(KINDS, names, strict=True)])
    parts = []
    for k, n in zip(KINDS, names, strict=True):
        own = F.col(n)
        if k.beside:
            own = F.when(F.size(own) == 0, own).otherwise(F.filter(own, _outside(F.col(f"__{k.beside}"))))
        parts.append(own)
    return rows.select(*keep, "__text", *names[:4], F.concat(*parts).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans, and all spans as text."""
    base = [k.name for k in KINDS if k.base]
    rows = find_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select(
        "doc_id",
        *[F.size(f"__{n}").cast("long").alias(f"n_{n}") for n in base],
        F.sha2(_listed(F.concat(*[F.col(f"__{n}") for n in base])), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with each span of the text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first.  A
    text without spans (or null) stays as it is.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col("text"))
    found = find_pii(rows, ("__row",)).select("__row", "__text", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("__spans"))
    text = F.col("__text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        between = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(F.regexp_replace(s["kind"], "_(run|local)$", "")), F.lit("]"))
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], between, mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(F.col("__spans"), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    done = found.select("__row", F.when(F.size("__spans") > 0, clean).otherwise(F.col("__row.text")).alias("__clean"))
    return done.select(*[F.col("__clean").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
