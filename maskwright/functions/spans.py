"""Spans: finding them with offsets, resolving overlaps, cutting them out.

A span is ``struct<pii_type, rule, ord, start, end, value>`` with half-open
code-point offsets, and always ``substring(text, start + 1, end - start) = value``.
All functions take and return columns and need only the current row, so they run
inside one narrow stage, in batch and in streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as fv

# The mark is put around matches so that one regex pass yields matches and gaps.
# If a text contains the mark itself, it is read as the other control character,
# which no pattern treats differently.
MARK, MARK_STAND_IN = "\x01", "\x02"

HITS = "array<struct<start:int,end:int,value:string,before:string>>"
SPANS = "array<struct<pii_type:string,rule:string,ord:int,start:int,end:int,value:string>>"
RULE_ORDER = {rule: i for i, (rule, _) in enumerate(fv.RULES)}
RULE_TYPE = dict(fv.RULES)


def no_hits() -> Column:
    return F.array().cast(HITS)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def markable(text: Column) -> Column:
    """The text with the mark character replaced, for use as input of ``scan``."""
    return F.when(
        F.contains(text, F.lit(MARK)), F.translate(text, MARK, MARK_STAND_IN)
    ).otherwise(text)


CHUNK = 256


def reserve(df: DataFrame, *names: str) -> None:
    """An error where a table has columns of names that are about to be used, whatever their case."""
    taken = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"columns of the table have reserved names: {', '.join(taken)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that a table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table.  One ``select`` of what stays and what is new is checked once; each
    further step would have the expressions below walked again."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(array: Column) -> Column:
    """The array cut into arrays of CHUNK elements; none if it is empty."""
    n = F.ceil(F.size(array) / CHUNK).cast("int")
    return F.transform(
        F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n),
        lambda i: F.slice(array, i * CHUNK + 1, F.lit(CHUNK)),
    )


def sums_before(sizes: Column) -> Column:
    """For each number the sum of those before it.

    An array cannot grow in place, so the sums are gathered chunk by chunk: the copying
    stays near the length of the array, where one long fold would square it.
    """

    def running(array: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before")),
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")),
        )

    def joined(inner: Column) -> Column:
        outer = running(F.transform(inner, lambda c: c["sum"]))["before"]
        return F.flatten(F.zip_with(inner, outer, lambda c, at: F.transform(c["before"], lambda x: x + at)))

    def summed(xs: Column) -> Column:
        return F.when(F.size(xs) <= CHUNK, running(xs)["before"]).otherwise(let(F.transform(chunks(xs), running), joined))

    return let(sizes, summed)


def scan(
    text: Column,
    pattern: str | Column,
    groups: tuple[int, ...] = (0,),
    hit: int = 0,
) -> Column:
    """Leftmost non-overlapping matches of a JVM pattern, with offsets, one after the other.

    ``groups`` are the regex groups to cut each match into and ``hit`` is the
    index of the one to report.  The groups must add up to the match, except that
    ``(0, 1)`` reports group 1 of patterns whose match ends with group 1.  ``before`` is the part
    in front of the hit; for ``(0,)`` the match before and the gap between.
    """
    tail = groups == (0, 1)
    marked = F.regexp_replace(
        text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(MARK + "".join(f"${g}{MARK}" for g in groups))
    )
    width = len(groups) + 1
    slot = hit + 1

    def sizes(parts: Column) -> Column:
        if tail:  # group 1 lies inside the match
            return F.transform(parts, lambda x, i: F.when(i % width == 2, 0).otherwise(F.length(x)))
        return F.transform(parts, F.length)

    def hits(parts: Column) -> Column:
        n = F.floor((F.size(parts) - 1) / width).cast("int")
        matches = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n)

        def found(i: Column, starts: Column) -> Column:
            at = i * width + slot
            value = parts[at]
            start = starts[at] - F.length(value) if tail else starts[at]
            before = parts[at - 1]
            if width == 2:
                before = F.concat(F.when(i > 0, parts[F.greatest(at - 2, F.lit(0))]).otherwise(F.lit("")), before)
            return F.struct(
                start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before.alias("before")
            )

        def only(value: Column) -> Column:
            start = sum((F.length(parts[i]) for i in range(1, slot)), F.length(parts[0]))
            start = start - F.length(value) if tail else start
            one = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), parts[slot - 1].alias("before"))
            return F.when(F.length(value) > 0, F.array(one)).otherwise(no_hits())

        listed = let(sums_before(sizes(parts)), lambda starts: F.transform(matches, lambda i: found(i, starts)))
        # one match, as most short texts have it, needs no sums
        return (
            F.when(F.size(parts) <= 1, no_hits())
            .when(F.size(parts) == width + 1, only(parts[slot]))
            .otherwise(F.filter(listed, lambda h: F.length(h["value"]) > 0))
        )

    return let(F.split(marked, MARK, -1), hits)


def occurrences(text: Column, literal: Column) -> Column:
    """Start offsets of every non-overlapping, case-sensitive occurrence of a literal."""
    size = F.length(literal)

    def starts(gaps: Column) -> Column:
        whole = sums_before(F.transform(gaps, lambda g: F.length(g) + size))
        return F.transform(F.slice(whole, F.lit(2), F.size(gaps) - 1), lambda at: at - size)

    return let(F.split(text, F.concat(F.lit("\\Q"), literal, F.lit("\\E")), F.lit(-1)), starts)


def unnest(df: DataFrame, keys: Sequence[str], array: str | Column, name: str) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimizer filter its input on ``size(array) > 0`` and
    push that below the projection that computes the array, which would then run
    several times.  The outer form with a test of its output does not.
    """
    return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def with_each(array: str | Column, value: str | Column, function) -> Column:
    """``function(element, value)`` for every element of an array column.

    A column that is only read inside a lambda may be merged into it by the optimizer
    and then computed for every element; handed over like this it is computed once.
    """
    return F.zip_with(array, F.array_repeat(value, F.size(array)), function)


def before_window(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters directly before an offset."""
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


def last(text: Column, width: int) -> Column:
    """The last ``width`` characters, or all there are."""
    return F.when(F.length(text) > width, F.substring(text, F.lit(-width), F.lit(width))).otherwise(text)


def value_at(text: Column, hit: Column) -> Column:
    """The value as the text has it: other than scanned if it holds the mark character."""
    return F.when(
        F.contains(hit["value"], F.lit(MARK_STAND_IN)), F.substring(text, hit["start"] + 1, hit["end"] - hit["start"])
    ).otherwise(hit["value"])


def tag(hits: Column, rule: str) -> Column:
    """Give hits their category and rule."""
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(RULE_TYPE[rule]).alias("pii_type"),
            F.lit(rule).alias("rule"),
            F.lit(RULE_ORDER[rule]).alias("ord"),
            h["start"].alias("start"),
            h["end"].alias("end"),
            h["value"].alias("value"),
        ),
    )


def resolve(spans: Column) -> Column:
    """Greedy sweep: by start, longer first, then rule order; keep what starts at or
    after the end of the last *kept* span.  Dropped spans do not block later ones."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            (s["start"] - s["end"]).alias("shorter"),
            s["ord"].alias("ord"),
            s.alias("span"),
        ),
    )
    def step(acc: Column, k: Column) -> Column:
        return F.when(
            k["start"] >= acc["end"],
            F.struct(
                k["span"]["end"].alias("end"),
                F.concat(acc["kept"], F.array(k["span"])).alias("kept"),
            ),
        ).otherwise(acc)

    def sweep(acc: Column, chunk: Column) -> Column:
        swept = F.aggregate(chunk, F.struct(acc["end"].alias("end"), no_spans().alias("kept")), step)
        return let(
            swept,
            lambda s: F.struct(s["end"].alias("end"), F.concat(acc["kept"], F.array(s["kept"])).alias("kept")),
        )

    def swept(ordered: Column) -> Column:
        few = F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), no_spans().alias("kept")), step, lambda acc: acc["kept"])
        many = F.aggregate(
            chunks(ordered),
            F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{SPANS}>").alias("kept")),
            sweep,
            lambda acc: F.flatten(acc["kept"]),
        )
        return F.when(F.size(ordered) <= CHUNK, few).otherwise(many)

    return let(F.sort_array(keyed), swept)


def resolved(spans: str) -> Column:
    """``resolve`` of a column of spans; fewer than two need no sweep.

    The column is read several times, so the optimizer doesn't merge what computes it into the
    lambdas of the sweep, where all of it would be interpreted.
    """
    return F.when(F.size(spans) > 1, resolve(F.col(spans))).otherwise(F.col(spans))


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with every span replaced; ``replacement`` maps a span to a column.

    ``spans`` should be a plain column: it is read several times.  Pieces are cut from the text
    at four bytes a character, where a place is found at once instead of by counting.
    """

    def piece(wide: Column, start: Column, size: Column) -> Column:
        return F.decode(F.substring(wide, start * 4 + 1, size * 4), "UTF-32")

    def joined(wide: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        pieces = F.zip_with(
            spans,
            F.slice(ends, F.lit(1), F.size(spans)),
            lambda s, done: F.concat(piece(wide, done, s["start"] - done), replacement(s)),
        )
        done = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), piece(wide, done, F.length(text) - done))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), joined)).otherwise(text)
