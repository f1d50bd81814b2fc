"""Personal data in texts: patterns propose, checksums confirm, context words adjust scores.

Everything is a column expression over one row; nothing is shuffled. A pattern's matches
and the text between them give all positions, in code points, as running sums of lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import bind
from matchloom.llm.common import packed, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card")
BLOCK = 128  # matches whose positions are summed up at a time
NEAR = 40  # code points of context on either side, up to the neighbouring match

# Each pattern matches what its plain form matches: it starts where a run of its first
# class starts or where the last match ended, and quantifiers that can't give back are
# possessive, so that long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
GATES = {"email": "@", "phone": "+"}
# Words that speak for a kind, in four languages.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|adresse|server|host|login",
    "card": "card|visa|credit|karte|carte|tarjeta|payment|zahlung",
    "phone": r"phone|\btel|call|mobile|fax|anruf|appel|llam",
    "iban": "iban|bank|konto|account|compte|cuenta|swift|bic",
    "short_card": "card|visa|amex|credit|karte|carte|tarjeta|payment|zahlung",
}
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.4}
BONUS = 0.15


@dataclass(frozen=True)
class PiiConfig:
    """``least``: score from which an added span counts. Base spans always count."""

    least: float = 0.5
    added: tuple[str, ...] = ADDED


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    empty = F.array().cast("array<string>")
    return F.when(F.instr(text, GATES[kind]) > 0, found).otherwise(empty) if kind in GATES else found


def _gaps(text: Column, kind: str, matches: Column) -> Column:
    return F.when(F.size(matches) > 0, F.split(text, PATTERNS[kind], -1))


def _running(steps: Column) -> Column:
    """Sums of ``step`` of all entries before each one, for ``steps`` of structs (step, ahead), plus its own ``ahead``.

    Appending copies an array, so sums are taken in blocks, then over blocks: time grows with the number of entries.
    """

    def block(rows: Column) -> Column:
        seed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(rows, seed, lambda acc, s: F.struct(
            (acc["at"] + s["step"]).alias("at"), F.array_append(acc["sums"], acc["at"] + s["ahead"]).alias("sums")))

    def joined(parts: Column) -> Column:
        before = block(F.transform(parts, lambda p: F.struct(p["at"].alias("step"), F.lit(0).cast("long").alias("ahead"))))
        return bind(before["sums"], lambda first: F.flatten(F.transform(
            parts, lambda p, i: F.transform(p["sums"], lambda x: x + F.get(first, i)))))

    def cut(rows: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
        return bind(F.transform(blocks, lambda k: block(F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))), joined)

    return bind(steps, cut)


def _placed(matches: Column, gaps: Column) -> Column:
    """Structs (start, end, value, near) of a kind's matches."""
    n = F.size(matches)
    steps = F.zip_with(F.slice(gaps, 1, n), matches, lambda g, m: F.struct(
        (F.length(g) + F.length(m)).cast("long").alias("step"), F.length(g).cast("long").alias("ahead")))
    return F.when(n > 0, F.transform(F.arrays_zip(_running(steps).alias("start"), matches.alias("value")), lambda s, i: F.struct(
        s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"),
        F.concat(F.substring(F.get(gaps, i), -NEAR, NEAR), F.lit(" "),
                 F.substring(F.get(gaps, i + 1), 1, NEAR)).alias("near"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Do the digits of a short string pass Luhn's check?"""
    doubled = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""),
                          lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                          .otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Does an account number pass the mod-97 check?"""
    bare = F.regexp_replace(value, " ", "")
    moved = F.split(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4)), "")
    numbers = F.transform(F.filter(moved, lambda c: c != ""), lambda c: F.when(
        c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.when(
        x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def _small_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))


def _checked(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return F.when(count.between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod97(value)).otherwise(False)
    if kind == "short_card":
        return F.when(count.between(13, 15), luhn(value)).otherwise(False)
    return F.lit(True)


def _scored(kind: str, spans: Column) -> Column:
    """The spans that pass the kind's check, with their scores."""
    good = F.filter(spans, lambda s: _checked(kind, s["value"]))
    return F.coalesce(F.transform(good, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        (F.lit(SCORE[kind]) + F.when(F.lower(s["near"]).rlike(CONTEXT[kind]), BONUS).otherwise(0.0)).alias("score"))),
        F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"))


def find(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``docs`` with a column ``pii``: array of (kind, start, end, value, score).

    ``docs`` has a column text; null counts as empty. Spans are ordered by kind as listed in
    ``BASE`` then ``ADDED``, then by start; positions are code points, end exclusive. Kinds are
    matched apart from each other, so spans of two kinds may overlap. Rows are independent:
    repeated ones get equal results, an empty table gives no rows, all other columns stay.
    """
    kinds = [k for k in (*BASE, *config.added) if k in PATTERNS]
    work = docs.select(packed(docs, "pii"), text_or_empty().alias("_text"))
    work = work.withColumns({f"_m_{k}": _matches(F.col("_text"), k) for k in kinds})
    work = work.withColumns({f"_g_{k}": _gaps(F.col("_text"), k, F.col(f"_m_{k}")) for k in kinds})
    work = work.withColumns({f"_p_{k}": _placed(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in kinds})
    lists = [_scored(k, F.col(f"_p_{k}")) for k in BASE]
    for k in config.added:
        source = F.col("_p_card" if k == "short_card" else f"_p_{k}")
        lists.append(F.filter(_scored(k, source), lambda s: s["score"] >= config.least))
    return work.select("_row.*", F.concat(*lists).alias("pii"))


def described(spans: Column, *kinds: str) -> Column:
    """``kind:start:end`` of spans, comma-joined; of the named kinds only, if any are named."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
