"""Places of pattern matches in texts, with SQL functions only.

Every match is wrapped in two control characters, the text is split at the first of them, and the pieces' lengths give
the places.  Lengths are counted in code points.  Where a text holds one of the two characters itself, it is replaced
by a third that no pattern here matches, which moves nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: Pieces summed at once: the places of n matches take n times the root of n steps, not n squared.
GROUP = 300
SPAN = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def plain(text: Column) -> Column:
    """The text that patterns are applied to: null as empty, the two markers replaced."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)


def _run(pieces: Column) -> Column:
    """(n, spans): the length of some pieces of the form match, CLOSE, rest; and the matches' places within."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        m = F.instr(p, CLOSE) - 1
        span = F.struct(acc["n"].alias("start"), (acc["n"] + m).alias("end"), F.substring(p, F.lit(1), m).alias("match"))
        return F.struct((acc["n"] + F.length(p) - 1).alias("n"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pieces, start, step)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>>: leftmost non-overlapping matches of a Java pattern in ``plain`` text."""
    pieces = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN)
    n = F.size(pieces)
    groups = F.transform(F.sequence(F.lit(0), F.floor((n - 2) / GROUP).cast("int")), lambda g: _run(F.slice(pieces, g * GROUP + 2, F.lit(GROUP))))
    bases = F.aggregate(groups, F.array(F.length(F.get(pieces, F.lit(0)))), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["n"])))
    placed = F.zip_with(groups, F.slice(bases, F.lit(1), F.size(groups)), lambda g, b: F.transform(g["spans"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"), s["match"].alias("match"))))
    return F.when(n < 2, F.array().cast(SPAN)).otherwise(F.flatten(placed))


def tagged(spans: Column, kind: int) -> Column:
    """array<struct<kind, start, end>>"""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def disjoint(spans: Column, kind: str) -> Column:
    """Of spans in order of preference, those that overlap none kept before."""
    return F.aggregate(spans, F.array().cast(kind), lambda acc, s: F.when(F.exists(acc, lambda a: overlaps(a, s)), acc).otherwise(F.concat(acc, F.array(s))))


def replaced(text: Column, spans: Column, tag: Callable[[Column], Column]) -> Column:
    """The text with each of the spans, which are in order and don't overlap, replaced by ``tag(span)``."""
    n = F.size(spans)
    before = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(_between(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), F.get(spans, i)["start"]), tag(F.get(spans, i))))
    last = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.when(n < 1, text).otherwise(F.concat(F.array_join(before, ""), last))


def _between(text: Column, lo: Column, hi: Column) -> Column:
    return F.substring(text, lo + 1, hi - lo)


def united(spans: Column, kind: str) -> Column:
    """Spans in order of start, overlapping ones merged into one of the first one's kind."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) < 1, F.array(s)).when(s["start"] < last["end"], merged).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), step)
