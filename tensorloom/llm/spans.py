"""Regular-expression matches with their places, in SQL functions only.

A span is a struct of ``kind`` (its number in a list of kinds), ``start`` and
``end`` in code points, end exclusive.  Spark has no function that gives the
places of all matches, but the pieces between them (``split``) and the matches
(``regexp_extract_all``) have lengths that add up to places.

The patterns of this package repeat groups possessively: nothing that follows
could match what they gave back, so the matches are the same, and Java's
matcher then loops where it would recurse on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int>"
MATCH = "array<struct<start:int,end:int,body:string>>"


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """All leftmost, non-overlapping matches, with ``start``, ``end`` and ``body``.

    ``needs`` is a cheap condition that any text with a match fulfils.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast(MATCH)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["body"])
        one = F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body"))
        return F.when(x["body"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out")))

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("body"), g.alias("gap")))
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(needs, placed).otherwise(empty)


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def spelled(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas, in the given order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    """Sorted by start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, marks: list[str]) -> Column:
    """``text`` with each span replaced by the mark of its kind.

    Spans that overlap become one, with the mark of the first.
    """
    names = F.array(*map(F.lit, marks))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"))
        longer = F.struct(s["end"].alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).when(s["end"] > acc["at"], longer).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start(spans), start, step, rest))
