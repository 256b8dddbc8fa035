"""Regular-expression spans with code-point offsets, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Matches of a text that are gathered at once.
RUN = 256


def let(value: Column, body) -> Column:
    """The body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0, context: int = 0) -> Column:
    """array<struct<start,stop,hit,part,before>> of the leftmost non-overlapping matches.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches, so the
    running sum of both lengths gives the offsets. ``part`` is the given group. No match or a null
    text: an empty array. Offsets count code points; the stop is exclusive. ``before`` is what lies
    between a match and the one before it, or the text's beginning: its last ``context`` code points
    after one more of it, or after a space where there is none.
    """
    gaps = F.split(text, pattern, -1)
    last = lambda p: F.when(F.length(p) > context, F.right(p, F.lit(context + 1))).otherwise(F.concat(F.lit(" "), p))
    hits = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.transform(gaps, lambda p: F.length(p)).alias("gap"),
        F.transform(gaps, last if context else lambda p: F.lit("")).alias("before"),
    )
    kind = "array<struct<start:int,stop:int,hit:string,part:string,before:string>>"

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        found = F.struct(begin.alias("start"), end.alias("stop"), x["hit"].alias("hit"), x["part"].alias("part"), x["before"].alias("before"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out")))

    def run(acc, some):
        # an array grows by copying: matches are gathered in short runs, and the runs in an array of runs
        begin = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
        got = F.aggregate(some, begin, step)
        return let(got, lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    def folded(found):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda k: F.slice(found, k * RUN + 1, F.lit(RUN)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(runs, start, run)["out"])

    return F.when(text.rlike(pattern), let(hits, folded)).otherwise(F.array().cast(kind))


def labelled(kind: str, order: int, found: Column) -> Column:
    """Turns matches into array<struct<kind,order,start,stop>>."""
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("order"), m["start"].alias("start"), m["stop"].alias("stop")
        ),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def by_start(spans: Column) -> Column:
    """Sorted by start, then by the order in which kinds are listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def by_kind(spans: Column) -> Column:
    """Sorted by the order in which kinds are listed, then by start."""
    keyed = F.transform(spans, lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_sort(keyed)
