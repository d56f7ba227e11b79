"""Functions on trace arrays and on trace comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that an ambiguity code stands for.
AMBIGUITY = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}


def clip_samples(samples: Column, start: Column, end: Column) -> Column:
    """Points [start, end] of a channel, 0-based."""
    return F.slice(samples, start + 1, F.greatest(F.lit(0), F.least(end, F.size(samples) - 1) - start + 1))


def downscale(samples: Column, top: Column, most: int = 255) -> Column:
    """To at most ``most``, truncating."""
    return F.transform(samples, lambda x: F.when(top > most, F.floor(x * F.lit(float(most)) / top)).otherwise(x).cast("long"))


def pair_means(samples: Column) -> Column:
    """Truncated means of neighbouring pairs; an odd last point goes."""
    n = F.floor(F.size(samples) / 2).cast("int")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor((F.get(samples, 2 * i) + F.get(samples, 2 * i + 1)) / 2).cast("long"))
    )


def background_level(samples: Column, share: float = 0.05) -> Column:
    """The value a twentieth of the way up the sorted non-zero points; 0 without any."""
    some = F.sort_array(F.filter(samples, lambda x: x != 0))
    return F.coalesce(F.get(some, F.floor(F.size(some) * F.lit(share)).cast("int")), F.lit(0))


def _plus(weight: float):
    return lambda a, x: a + x * F.lit(weight)


def separate_dyes(channels: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Each new channel is a weighted sum of the four at every point."""

    def mixed(weights: list[float]) -> Column:
        out = F.transform(channels[0], lambda x: x * F.lit(weights[0]))
        for c, w in zip(channels[1:], weights[1:]):
            out = F.zip_with(out, c, _plus(w))
        return F.transform(out, lambda x: F.greatest(F.lit(0), F.round(x)).cast("long"))

    return [mixed(row) for row in matrix]


def called_confidence(base: Column, a: Column, c: Column, g: Column, t: Column) -> Column:
    """Confidence of the called base; ambiguity codes average their bases, others are 0."""
    own = {"A": a, "C": c, "G": g, "T": t, "U": t}
    b, out = F.upper(base), F.lit(0)
    for code, column in own.items():
        out = F.when(b == code, column).otherwise(out)
    for code, members in AMBIGUITY.items():
        total = sum((own[m] for m in members), F.lit(0))
        out = F.when(b == code, F.floor(total / len(members))).otherwise(out)
    return out.cast("long")


def max_called(samples: Column, positions: Column) -> Column:
    """Greatest sample at a called position."""
    return F.array_max(F.transform(positions, lambda p: F.get(samples, p)))


def comments(info: Column) -> Column:
    """``KEY=value`` lines as a map; later keys win."""
    pairs = F.transform(F.filter(F.split(info, "\n"), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))
    return F.map_from_entries(pairs)


def range_text(first: Column, last: Column) -> Column:
    return F.concat(first.cast("string"), F.lit(".."), last.cast("string"))


def unique_id(name: Column, taken: Column) -> Column:
    """``name`` if it is free, else the first free of name.1, name.2, ..."""
    numbers = F.sequence(F.lit(1), F.size(taken) + 1)
    free = F.filter(F.transform(numbers, lambda k: F.concat(name, F.lit("."), k.cast("string"))), lambda x: ~F.array_contains(taken, x))
    return F.when(F.array_contains(taken, name), F.get(free, 0)).otherwise(name)


def original_confidence(base: Column, places: Column, a: Column, c: Column, g: Column, t: Column) -> Column:
    """Confidence of edited bases by their original places (1-based): 0 for an inserted base
    (place 0), 2 where the original base isn't A, C, G or T."""

    def own(p: Column) -> Column:
        b = F.upper(F.substring(base, p.cast("int"), F.lit(1)))
        i = p.cast("int") - 1
        return F.when(p == 0, 0).when(b == "A", F.get(a, i)).when(b == "C", F.get(c, i)).when(b == "G", F.get(g, i)).when(b == "T", F.get(t, i)).otherwise(2).cast("long")

    return F.transform(places, own)


def running_sums(values: Column) -> Column:
    """Prefix sums, as from flow steps to base places."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"] + x)).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def edited_positions(positions: list[int], edits: list[int], points: int) -> list[int]:
    """Sample positions of edited bases: of kept bases (their original numbers, 1-based) the
    original ones, of inserted ones (0) evenly between their neighbours in whole steps."""
    out = [positions[e - 1] if e else 0 for e in edits]
    at = 0
    while at < len(out):
        if edits[at]:
            at += 1
            continue
        end = at
        while end < len(out) and not edits[end]:
            end += 1
        low = out[at - 1] if at else 0
        step = ((out[end] if end < len(out) else points) - low) // (end - at + 1)
        for k in range(at, end):
            low += step
            out[k] = low
        at = end
    return out
