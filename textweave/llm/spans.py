"""Positions of pattern matches in whole texts, with DataFrame functions only.

A span is a struct (start, end, value): code points, end exclusive. Patterns passed in must be written
so that Java matches them without deep recursion on long texts: repeated groups possessive. All work here
grows in proportion to the text and the matches in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
#: Numbers that are summed up one by one, and how often sums are summed up in turn: 64^4 matches of a text.
CHUNK, LEVELS = 64, 4
#: Code points of a piece from which a shorter one is cut.
PIECE = 2048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, combine: Callable[[Column, Column], Column] = lambda x, y: x + y, levels: int = LEVELS) -> Column:
    """For each place of an array of int the sum (or another ``combine`` of whole numbers from 0 on) of those before it.

    An array that grows with each step would be copied each time. So numbers are taken in chunks, and the
    sums of the chunks are run through in the same way.
    """
    zero = F.lit(0)

    def direct(xs: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda seen, x: F.struct(combine(seen["at"], x).alias("at"), F.concat(seen["out"], F.array(seen["at"])).alias("out"))
        return F.aggregate(xs, first, step, lambda seen: seen["out"])

    def chunked(xs: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.ceil(F.size(xs) / CHUNK).cast("int") - 1), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))

        def joined_up(cs: Column) -> Column:
            bases = running(F.transform(cs, lambda c: F.aggregate(c, zero, lambda x, y: combine(x, y))), combine, levels - 1)
            return F.flatten(F.zip_with(F.transform(cs, direct), bases, lambda own, base: F.transform(own, lambda x: combine(x, base))))

        return let(chunks, joined_up)

    if not levels:
        return direct(numbers)
    return let(numbers, lambda xs: F.when(F.size(xs) <= CHUNK, direct(xs)).otherwise(chunked(xs)))


def matches(text: Column, pattern: str, screen: Column, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in ``text``.

    ``value_group`` is the group of ``pattern`` that is the value, 0 being the match. Texts for which
    ``screen`` is false must have no match; they aren't searched. The text is read once for the matches
    and once for the gaps between them, whose lengths tell the places.
    """

    def placed(found: Column, gaps: Column) -> Column:
        before = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
        value = (lambda m: F.regexp_extract(m, pattern, value_group)) if value_group else (lambda m: m)

        def span(at: Column, m: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), value(m).alias("value"))

        return let(before, lambda at: F.transform(found, lambda m, i: span(at, m, i)))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(ms, gaps))))
    return F.coalesce(F.when(screen, found), F.array().cast(f"array<{SPAN}>"))


def ordered(kinds: Sequence[str], columns: Sequence[Column]) -> Column:
    """The spans of several kinds as one array of (start, rank, end, kind), by start and then by kind as listed."""

    def named(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[named(rank, kind, spans) for rank, (kind, spans) in enumerate(zip(kinds, columns, strict=True))]))


def valued(spans: Column, value: str) -> Column:
    """The spans with another value."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(value).alias("value")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def first_from(starts: Column, least: Column) -> Column:
    """The first place of the ascending array ``starts`` that holds ``least`` or more, by halving; its size if there is none."""

    def step(seen: Column, _: Column) -> Column:
        mid = F.floor((seen["lo"] + seen["hi"]) / 2).cast("int")
        below = F.get(starts, mid) < least
        lo, hi = F.when(below, mid + 1).otherwise(seen["lo"]), F.when(below, seen["hi"]).otherwise(mid)
        return F.when(seen["lo"] < seen["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(seen)

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(starts)))), F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi")), step, lambda seen: seen["lo"])


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the (start, end, value) spans replaced by its value. Of a span that begins within an earlier one only the rest behind that one is replaced."""

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """From ``start`` to ``end``: a part of one piece, or the end of one, whole ones and the beginning of another."""
        of = lambda at: F.floor(at / PIECE).cast("int")
        part = lambda i, low, length: F.coalesce(F.substring(F.get(pieces, i), low + 1, length), F.lit(""))
        one, last = of(start), of(end)
        whole = F.when(last - one > 1, F.array_join(F.slice(pieces, one + 2, last - one - 1), "")).otherwise("")
        across = F.concat(part(one, start - one * PIECE, F.lit(PIECE)), whole, part(last, F.lit(0), end - last * PIECE))
        return F.when(one == last, part(one, start - one * PIECE, end - start)).otherwise(across)

    def put_together(pieces: Column, ss: Column, reached: Column) -> Column:
        behind = lambda i: F.greatest(F.get(reached, i), F.get(ss, i)["end"])
        each = F.transform(ss, lambda s, i: F.concat(cut(pieces, F.get(reached, i), F.greatest(F.get(reached, i), s["start"])), F.when(s["end"] > F.get(reached, i), s["value"]).otherwise("")))
        end = F.when(F.size(ss) > 0, behind(F.size(ss) - 1)).otherwise(0)
        return F.concat(F.array_join(each, ""), cut(pieces, end, F.length(text)))

    def over(ss: Column) -> Column:
        reached = running(F.transform(ss, lambda s: s["end"]), F.greatest)
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
        return let(reached, lambda r: let(pieces, lambda p: put_together(p, ss, r)))

    return let(F.array_sort(spans), lambda ss: F.when(F.size(ss) > 0, over(ss)).otherwise(text))
