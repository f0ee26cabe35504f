"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Everything is a column expression, so the operator is a projection: no shuffle, no Python.  Positions come from marking
the matches in the text, splitting at the marks and adding up the lengths of the pieces.  The patterns are written so that
each is matched in linear time and without recursion (possessive loops; no second try inside a run that has failed).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK, _OTHER = "\u0001", "\u0002"
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """guard: a cheap test of the whole text; valid: confirms a match; words: near words that raise the score."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    words: str


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _small_parts(v: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, r"\."), small)


def _mod97(v: Column) -> Column:
    """The check of international account numbers: letters count 10 to 35, the first four signs go last."""
    bare = F.regexp_replace(v, " ", "")
    signs = F.split(F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4)), "")

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(F.length(sign) == 0, rest).when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(signs, F.lit(0), step) == 1)


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda v: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda t: t.rlike(r"[0-9]\.[0-9]"), _small_parts, 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda t: t.rlike("[0-9][ -]?[0-9]"), lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)), 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda v: F.length(_digits(v)).between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), _mod97, 0.9, "iban|account|bank"),
)
BASE = ("email", "ip", "card", "phone")


def _starts(lengths: Column) -> Column:
    """Running sums before each element, built in blocks so that thousands of pieces stay cheap."""
    zero = F.lit(0)
    none = F.expr("cast(array() as array<int>)")
    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))

    def put(done: Column, n: Column) -> Column:
        return F.struct((done["at"] + n).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all"))

    def join(done: Column, block: Column) -> Column:
        moved = F.transform(block["all"], lambda x: x + done["at"])
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["all"], F.array(moved)).alias("all"))

    inner = F.transform(blocks, lambda b: F.aggregate(b, F.struct(zero.alias("at"), none.alias("all")), put))
    outer = F.aggregate(inner, F.struct(zero.alias("at"), F.expr("cast(array() as array<array<int>>)").alias("all")), join)
    return F.flatten(outer["all"])


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: odd pieces are matches, even ones what lies between."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _found(text: Column, kind: Kind) -> Column:
    def spans(pieces: Column) -> Column:
        def one(starts: Column) -> Column:
            def span(i: Column) -> Column:
                value, near = F.get(pieces, i), F.lower(F.substring(F.get(pieces, i - 1), -40, 40))
                score = F.when(near.rlike(kind.words), F.lit(round(kind.score + 0.1, 2))).otherwise(F.lit(kind.score))
                return F.struct(F.lit(kind.name).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(value)).alias("end"), score.alias("score"), value.alias("value"))

            return F.filter(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), span), lambda s: kind.valid(s["value"]))

        return F.when(F.size(pieces) > 1, let(_starts(F.transform(pieces, F.length)), one))

    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double,value:string>>)")
    return F.coalesce(F.when(kind.guard(text), let(_pieces(text, kind.pattern), spans)), none)


def find_pii(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii``: an array of (kind, start, end, score, value), by kind as listed, then start.

    Offsets count code points, end exclusive.  Matches of a kind are leftmost and do not overlap; those that fail their
    check are dropped without a second try.  Null and empty texts have an empty array, texts of any
    length are one row's work.  Every input row gives one row; an input
    column ``pii`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("pii")
    for kind in kinds:
        rows = rows.withColumn(f"_pii_{kind.name}", _found(text, kind))
    return rows.withColumn("pii", F.concat(*(F.col(f"_pii_{k.name}") for k in kinds))).drop(*(f"_pii_{k.name}" for k in kinds))


def redact_pii(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replace confirmed spans by ``[KIND]``, kind after kind; null texts stay null."""

    def cleaned(text: Column, kind: Kind) -> Column:
        def joined(pieces: Column) -> Column:
            def piece(p: Column, i: Column) -> Column:
                return F.when((i % 2 == 1) & kind.valid(p), F.lit(f"[{kind.name.upper()}]")).otherwise(p)

            return F.when(F.exists(F.transform(pieces, lambda p, i: (i % 2 == 1) & kind.valid(p)), lambda x: x), F.array_join(F.transform(pieces, piece), ""))

        return F.coalesce(F.when(kind.guard(text), let(_pieces(text, kind.pattern), joined)), text)

    rows = docs
    for kind in kinds:
        rows = rows.withColumn(text_col, cleaned(F.col(text_col), kind))
    return rows


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans, all spans and the highest score."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("pii")).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("score"))
