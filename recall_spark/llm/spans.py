"""Places of regular-expression matches in a text, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<begin:int,end:int,match:string,before:string,after:string>>"
SPAN = "array<struct<begin:int,place:int,kind:string,end:int>>"
CONTEXT = 24
#: Matches whose places are summed in one go: a longer text takes time in proportion to its matches, not to their square.
STEP = 256


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def located(text: Column, pattern: str, when: Column) -> Column:
    """Leftmost non-overlapping matches in code points (end exclusive), with what stands around them.

    What lies between the matches, from split(), gives their places by its lengths, summed within parts of STEP
    matches and then over the parts. when: a cheap condition that holds of every text with a match."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr(f"cast(array() as {MATCH})")

    def rows(p: Column) -> Column:
        def row(match: Column, i: Column) -> Column:
            before, after = F.get(p["pieces"], i), F.get(p["pieces"], i + 1)
            return F.struct((F.length(before) + F.length(match)).alias("on"), F.length(match).alias("size"), match.alias("match"),
                F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

        return F.transform(p["matches"], row)

    def parts(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / STEP).cast("int")), lambda i: F.slice(r, i * STEP + 1, STEP))

    def starts(ps: Column) -> Column:
        sums = F.transform(ps, lambda part: F.aggregate(part, F.lit(0), lambda at, r: at + r["on"]))
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))

        def add(done: Column, n: Column) -> Column:
            return F.struct((done["at"] + n).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all"))

        return F.aggregate(sums, first, add, lambda done: done["all"])

    def step(done: Column, r: Column) -> Column:
        end = done["at"] + r["on"]
        here = F.struct((end - r["size"]).alias("begin"), end.alias("end"), r["match"].alias("match"), r["before"].alias("before"),
            r["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(here)).alias("found"))

    def placed(ps: Column) -> Column:
        def part_from(part: Column, at: Column) -> Column:
            return F.aggregate(part, F.struct(at.alias("at"), empty.alias("found")), step, lambda done: done["found"])

        return F.flatten(F.zip_with(ps, starts(ps), part_from))

    both = F.struct(pieces.alias("pieces"), matches.alias("matches"))
    folded = let(both, lambda p: let(rows(p), lambda r: let(parts(r), placed)))
    return F.when(when & text.rlike(pattern), folded).otherwise(empty)


def spans(matches: Column, kind: str, place: int) -> Column:
    """Matches of one kind as spans that sort by begin, then by place (the kind's number)."""
    return F.transform(matches,
        lambda m: F.struct(m["begin"].alias("begin"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def joined(all_spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.sort_array(all_spans),
        lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def number_of(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")
