"""Operators over alignment records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basestream.model import DUPLICATE, MATE_UNMAPPED, PAIRED, PROPER, QC_FAIL, QUERY_OPS, READ1, READ2, REF_OPS, REVERSE, UNMAPPED
from basestream.operators.ordering import parts_for


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(bit) != 0


def flagstat(aln: DataFrame) -> DataFrame:
    """Eleven counters for reads that pass and fail quality control, in one pass."""
    paired, mapped = has(PAIRED), ~has(UNMAPPED)
    both = paired & mapped & ~has(MATE_UNMAPPED)
    elsewhere = both & (F.col("mate_ref_id") != F.col("ref_id"))
    tests = {
        "total": F.lit(True), "duplicates": has(DUPLICATE), "mapped": mapped, "paired": paired, "proper": paired & has(PROPER),
        "read1": paired & has(READ1), "read2": paired & has(READ2), "singletons": paired & mapped & has(MATE_UNMAPPED),
        "both_mapped": both, "mate_other_ref": elsewhere, "mate_other_ref_mapq5": elsewhere & (F.col("mapq") >= 5),
    }
    return aln.groupBy(has(QC_FAIL).cast("int").alias("qc_fail")).agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


def in_range(aln: DataFrame, ref_id: int, start: int, end: int) -> DataFrame:
    """Records that overlap [start, end] (0-based, closed) of a reference."""
    return aln.where((F.col("ref_id") == ref_id) & (F.col("pos") <= end) & (F.col("pos") + F.col("span") - 1 >= start))


def parse_range(text: str) -> tuple[str | None, int | None, int | None]:
    """``ref[:start[-end]]`` as (ref, start, end), 1-based and closed; one number is both
    ends, no colon is the whole reference, and ``*`` the records without one (None)."""
    if text == "*":
        return None, None, None
    name, colon, span = text.partition(":")
    if not colon:
        return name, None, None
    low, dash, high = span.partition("-")
    if not low.isdigit() or (dash and not high.isdigit()):
        raise ValueError(f"malformed range {text!r}")
    return name, int(low), int(high if dash else low)


def in_named_range(aln: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Records of a range by reference name; ``names`` (id, name) is the header's table."""
    name, start, end = parse_range(text)
    if name is None:
        return aln.where(F.col("ref_id") < 0)
    found = names.where(F.col("name") == name).select("id").take(1)
    if not found:
        raise ValueError(f"unknown reference {name!r}")
    kept = aln.where(F.col("ref_id") == found[0]["id"])
    return kept if start is None else kept.where((F.col("pos") + 1 <= end) & (F.col("pos") + F.col("span") >= start))


def order_breaks(aln: DataFrame, block: int = 65536) -> DataFrame:
    """Records that stand behind a later (ref_id, pos) in file order; unmapped ones sort last.
    Neighbours are found inside blocks, with one boundary row a block."""
    place = F.struct(F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")).alias("r"), F.col("pos").alias("p"))
    b = aln.withColumn("blk", F.floor((F.col("file_ord") - 1) / block)).withColumn("place", place)
    ends = b.groupBy("blk").agg(F.max_by("place", "file_ord").alias("own"))
    tails = ends.select("blk", F.lag("own").over(Window.orderBy("blk")).alias("tail"))
    w = Window.partitionBy("blk").orderBy("file_ord")
    prev = F.coalesce(F.lag("place").over(w), F.when(F.row_number().over(w) == 1, F.col("tail")))
    return b.join(tails, "blk", "left").withColumn("before", prev).where(F.col("before") > F.col("place")).drop("blk", "place", "tail", "before")


def slice_references(sliced: DataFrame) -> DataFrame:
    """How often each slice uses a reference, and its bases there."""
    return sliced.where(F.col("ref_id") >= 0).groupBy("slice_id", "ref_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("span").alias("bases"))


def slice_counts(sliced: DataFrame) -> DataFrame:
    """Records, mapped records and bases of each slice."""
    return sliced.groupBy("slice_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(~has(UNMAPPED)).alias("mapped"), F.sum("span").alias("bases"))


def merge_sorted(*inputs: DataFrame) -> DataFrame:
    """k-way merge: inputs in coordinate order become one; ties go to the earlier input.
    Records without a reference come last."""
    out = None
    for n, df in enumerate(inputs):
        part = df.withColumn("input_no", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


MERGE_KEY = ["place", "pos", "strand", "not_read1", "input_no", "file_ord"]


def merge_order(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")).alias("place"),
        has(REVERSE).cast("int").alias("strand"),
        (~has(READ1)).cast("int").alias("not_read1"),
    )


def depth_sweep(aln: DataFrame, band: int = 1 << 16) -> DataFrame:
    """Depth of every covered position from +1/-1 events; a long span costs two events,
    not one row a base. Bands of positions bound the running sums, so one reference
    doesn't land in one task; a record that crosses bands enters each of them once."""
    used = aln.where(~has(UNMAPPED) & (F.col("ref_id") >= 0))
    last = F.col("pos") + F.col("span") - 1
    cut = used.select("ref_id", "pos", last.alias("last"), F.explode(F.sequence(F.floor(F.col("pos") / band), F.floor(last / band))).alias("band"))
    low, high = F.greatest(F.col("pos"), F.col("band") * band), F.least(F.col("last"), F.col("band") * band + band - 1)
    events = cut.select("ref_id", "band", F.explode(F.array(F.struct(low.alias("pos"), F.lit(1).alias("d")), F.struct((high + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("ref_id", "band", "e.pos").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("ref_id", "band").orderBy("pos")
    runs = steps.select("ref_id", "pos", F.sum("d").over(w).alias("depth"), F.lead("pos").over(w).alias("until")).where("depth > 0")
    return runs.select("ref_id", F.explode(F.sequence(F.col("pos"), F.col("until") - 1)).alias("pos"), "depth")


def depth_explode(aln: DataFrame, band: int = 1 << 10) -> DataFrame:
    """The same by one row a base. Records meet in bands of positions, dealt to as many
    tasks as the input needs: a task counts the positions of its bands, however the input
    is ordered. Four tasks at most share a band's records, and their sums meet again."""
    n = parts_for(aln)
    used = aln.where(~has(UNMAPPED) & (F.col("ref_id") >= 0))
    last = F.col("pos") + F.col("span") - 1
    cut = used.select("ref_id", "pos", last.alias("last"), F.explode(F.sequence(F.floor(F.col("pos") / band), F.floor(last / band))).alias("band"), (F.spark_partition_id() % 4).alias("part"))
    low, high = F.greatest(F.col("pos"), F.col("band") * band), F.least(F.col("last"), F.col("band") * band + band - 1)
    each = cut.repartition(n, "ref_id", "band", "part").select("ref_id", "band", "part", F.explode(F.sequence(low, high)).alias("pos"))
    parts = each.groupBy("ref_id", "band", "part", "pos").agg(F.count(F.lit(1)).alias("n"))
    return parts.repartition(n, "ref_id", "band").groupBy("ref_id", "band", "pos").agg(F.sum("n").alias("depth")).drop("band")


def consensus(bases: DataFrame) -> DataFrame:
    """Base with most votes of (ref_id, pos, base); ties go A, C, G, T, *; N doesn't vote,
    a position without votes is N."""
    votes = [F.count_if(F.upper("base") == b).alias(f"v{k}") for k, b in enumerate("ACGT*")]
    out, best = F.lit("N"), F.lit(0)
    for k, b in enumerate("ACGT*"):
        out = F.when(F.col(f"v{k}") > best, b).otherwise(out)
        best = F.greatest(best, F.col(f"v{k}"))
    return bases.groupBy("ref_id", "pos").agg(*votes).select("ref_id", "pos", out.alias("base"), best.alias("votes"))


def template_length(aln: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """TLEN per template: the extent of its records on one reference, positive for the
    leftmost (on a tie for read 1), negative for the others, 0 when references differ,
    a record is unmapped or the template has one record. ``scope`` names columns such as
    slice_id that templates don't cross."""
    w = Window.partitionBy(*(scope or []), "qname")
    lo, hi = F.min("pos").over(w), F.max(F.col("pos") + F.col("span") - 1).over(w)
    told = aln.select(
        "*", lo.alias("lo"), hi.alias("hi"), F.count(F.lit(1)).over(w).alias("members"),
        (F.min("ref_id").over(w) == F.max("ref_id").over(w)).alias("one_ref"), F.max(has(UNMAPPED).cast("int")).over(w).alias("lost"),
    )
    ties = told.withColumn("ties", F.count_if(F.col("pos") == F.col("lo")).over(w))
    size = F.col("hi") - F.col("lo") + 1
    first = (F.col("pos") == F.col("lo")) & ((F.col("ties") == 1) | has(READ1))
    tlen = F.when(~F.col("one_ref") | (F.col("lost") == 1) | (F.col("members") < 2), F.lit(0)).when(first, size).otherwise(-size)
    return ties.withColumn("tlen", tlen.cast("long")).drop("lo", "hi", "members", "one_ref", "lost", "ties")


def mate_distance(aln: DataFrame) -> DataFrame:
    """Records between one and its next mate in file order; null for the last."""
    w = Window.partitionBy("qname").orderBy("file_ord")
    return aln.withColumn("next_mate", F.lead("file_ord").over(w) - F.col("file_ord") - 1)


def position_delta(aln: DataFrame, block: int = 65536) -> DataFrame:
    """``aln`` with ap: the distance from the record before on the same reference in file
    order, or from 0. Neighbours are found inside blocks of file order, with one boundary
    row a block and reference, so a reference isn't one task."""
    b = aln.withColumns({"blk": F.floor((F.col("file_ord") - 1) / block), "ref": F.coalesce("ref_id", F.lit(-(2**31)))}).repartition(parts_for(aln), "ref", "blk")
    # In a struct, as a neighbour without a position is a neighbour.
    ends = b.groupBy("ref", "blk").agg(F.max_by(F.struct("pos"), "file_ord").alias("own"))
    tails = ends.select("ref", "blk", F.lag("own").over(Window.partitionBy("ref").orderBy("blk")).alias("tail"))
    w = Window.partitionBy("ref", "blk").orderBy("file_ord")
    told = b.withColumn("before", F.lag(F.struct("pos")).over(w)).join(tails, ["ref", "blk"], "left")
    return told.withColumn("ap", F.col("pos") - F.coalesce("before.pos", F.when(F.col("before").isNull(), F.col("tail.pos")), F.lit(0))).drop("ref", "blk", "tail", "before")


def name_complete(aln: DataFrame, expected: Column) -> DataFrame:
    """Templates all of whose records are in the slice, so their names may be dropped:
    records agree on the expected number and that many are present."""
    seen = aln.withColumn("expected", expected).groupBy("slice_id", "qname").agg(
        F.count(F.lit(1)).alias("present"), F.min("expected").alias("low"), F.max("expected").alias("high")
    )
    return seen.select("slice_id", "qname", "present", ((F.col("low") == F.col("high")) & (F.col("present") == F.col("high"))).alias("complete"))


def add_slices(aln: DataFrame, records: int = 1000) -> DataFrame:
    """Slices of at most ``records`` records in file order that don't cross from one run
    of a reference to the next. Run starts come from neighbours inside blocks of file
    order, with one boundary row a block, so no window spans the table."""
    runs = ref_runs(aln, records * 64)
    return runs.withColumn("slice_id", F.concat_ws(":", F.col("run_start"), F.floor((F.col("file_ord") - F.col("run_start")) / records)))


def ref_runs(aln: DataFrame, block: int = 65536) -> DataFrame:
    """``aln`` with run_start: the file order at which its run of equal ref_id began."""
    b = aln.withColumn("blk", F.floor((F.col("file_ord") - 1) / block)).repartition(parts_for(aln), "blk")
    # The block before may be any number below: file order can have gaps.
    ends = b.groupBy("blk").agg(F.max_by("ref_id", "file_ord").alias("own"))
    tails = ends.select("blk", F.lag("own").over(Window.orderBy("blk")).alias("tail"))
    w = Window.partitionBy("blk").orderBy("file_ord")
    starts = b.join(F.broadcast(tails), "blk", "left").withColumn("prev", F.coalesce(F.lag("ref_id").over(w), F.when(F.row_number().over(w) == 1, F.col("tail"))))
    marked = starts.withColumn("s", F.when(F.col("prev").isNull() | (F.col("prev") != F.col("ref_id")), F.col("file_ord")))
    known = marked.withColumn("run", F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A run that began in an earlier block: the latest start before, one row a block.
    last = known.groupBy("blk").agg(F.max("s").alias("last"))
    carried = last.withColumn("carry", F.max("last").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).select("blk", "carry")
    return known.join(F.broadcast(carried), "blk", "left").withColumn("run_start", F.coalesce("run", "carry")).drop("blk", "tail", "prev", "s", "run", "carry")


def run_extent(runs: DataFrame) -> DataFrame:
    """Reference, records and extent of each run of ``ref_runs``. There may be nearly as many
    runs as records, so they are dealt to as many tasks as the input needs."""
    return runs.repartition(parts_for(runs), "run_start").groupBy("run_start").agg(
        F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max(F.col("pos") + F.col("span") - 1).alias("last_pos")
    )


def slice_extent(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy("slice_id", "ref_id").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("span") - 1).alias("end"), F.count(F.lit(1)).alias("records"), F.sum("span").alias("bases")
    )


def build_index(extents: DataFrame) -> DataFrame:
    """Range index rows: reference, first position, span."""
    return extents.select("ref_id", "slice_id", "start", (F.col("end") - F.col("start") + 1).alias("span"))


def probe_index(index: DataFrame, ref_id: int, start: int, end: int) -> DataFrame:
    return index.where((F.col("ref_id") == ref_id) & (F.col("start") <= end) & (F.col("start") + F.col("span") - 1 >= start))


def _piled(bases: DataFrame, predicate: Callable[[], Column] | Column | None) -> DataFrame:
    """(ref_id, pos, c, width): the entries of a column by file_ord and nth, and its widest
    insertion. Depth, not the table, bounds a column."""
    kept = bases if predicate is None else bases.where(predicate() if callable(predicate) else predicate)
    entry = F.struct("file_ord", "nth", "shown", "sign", "qual", "next_qual", "tail", "ended")
    return stepped(kept).groupBy("ref_id", "pos").agg(F.sort_array(F.collect_list(entry)).alias("c"), F.max("nth").alias("width"))


def stepped(kept: DataFrame) -> DataFrame:
    """``kept`` with the qualities of gaps: columns that other reads insert before a gap's
    own are steps of its quality too."""
    wide = kept.where("inserts and nth > 0").groupBy("ref_id", "pos").agg(F.max("nth").alias("width"))
    w = Window.partitionBy("file_ord", "chain", "skip").orderBy("pos", "nth").rowsBetween(Window.unboundedPreceding, -1)
    over = kept.where("gapped").join(wide, ["ref_id", "pos"], "left")
    more = F.coalesce(F.sum(F.when(F.col("tail"), F.coalesce("width", F.col("nth")) - F.col("nth"))).over(w), F.lit(0)).cast("int")
    told = over.withColumn("qual", F.when(F.col("steps") > 0, _halved("before_qual", F.col("steps") + more)).otherwise(F.col("qual")))
    return kept.where("not gapped").unionByName(told.drop("width"))


def _halved(start: Column | str, steps: Column, to: Column | str = "next_qual") -> Column:
    """(prev + next) / 2 in integers, ``steps`` times over."""
    start, to = (F.col(x) if isinstance(x, str) else x for x in (start, to))
    return to + F.floor((start - to) / F.pow(F.lit(2.0), F.least(steps, F.lit(31)))).cast("int")


def pileup(bases: DataFrame, predicate: Callable[[], Column] | Column | None = None) -> DataFrame:
    """Columns of (ref_id, pos): depth, bases and qualities in order of arrival
    (file_ord), from ``read_bases``. Inserted bases stand behind their column's base; the
    quality is that of the column's last inserted place."""
    from basestream.functions.sequence import quality_char

    at_end = lambda x: F.when(x["ended"], x["qual"]).otherwise(_halved(x["qual"], F.col("width") - x["nth"], x["next_qual"]))
    # Where nothing is inserted, every entry is a base of its own.
    plain = F.col("width") == 0
    return _piled(bases, predicate).select(
        "ref_id", "pos", F.when(plain, F.size("c")).otherwise(F.size(F.filter("c", lambda x: x["nth"] == 0))).cast("long").alias("depth"),
        F.array_join(F.col("c.shown"), "").alias("bases"),
        F.when(plain, F.array_join(F.transform("c.qual", quality_char), ""))
        .otherwise(F.array_join(F.transform(F.filter("c", lambda x: x["tail"]), lambda x: quality_char(at_end(x))), "")).alias("quals"),
    )


def pileup_columns(bases: DataFrame, predicate: Callable[[], Column] | Column | None = None) -> DataFrame:
    """The layout with insertion columns (ref_id, pos, nth): a read that goes on beyond an
    insertion it lacks shows * there."""
    from basestream.functions.sequence import quality_char

    there = lambda x, n: (x["nth"] == n) | (x["tail"] & ~x["ended"] & (x["nth"] < n))
    cols = _piled(bases, predicate).select("ref_id", "pos", "c", F.explode(F.sequence(F.lit(0), F.col("width"))).alias("n"))
    held = cols.withColumn("c", F.filter("c", lambda x: there(x, F.col("n"))))
    return held.select(
        "ref_id", "pos", F.col("n").alias("nth"), F.size("c").cast("long").alias("depth"),
        F.array_join(F.transform("c", lambda x: F.when(x["nth"] == F.col("n"), x["sign"]).otherwise("*")), "").alias("bases"),
        F.array_join(F.transform("c", lambda x: quality_char(_halved(x["qual"], F.col("n") - x["nth"], x["next_qual"]))), "").alias("quals"),
    )


def _walked(ops: Column) -> Column:
    """The operations with columns of their own, each with where it begins: r and q are
    reference and query bases before it, n inserted places at its position, t gap columns
    since the last base, and skip the place behind a skip if no base followed yet."""
    kind = "array<struct<op:string,len:int,r:int,q:int,n:int,t:int,skip:int>>"
    zero = F.struct(*[F.lit(0).alias(k) for k in "rqnt"], F.lit(-1).alias("skip"), F.array().cast(kind).alias("out"))

    def step(a, o):
        ref, query, op = o["op"].isin(*REF_OPS), o["op"].isin(*QUERY_OPS), o["op"]
        base, inner = op.isin(*"M=XI"), op.isin("I", "P")
        own = ref | (inner & (a["r"] > 0))
        mine = F.struct(op.alias("op"), o["len"].alias("len"), *[a[k].alias(k) for k in ("r", "q", "n", "t", "skip")])
        return F.struct(
            (a["r"] + F.when(ref, o["len"]).otherwise(0)).alias("r"), (a["q"] + F.when(query, o["len"]).otherwise(0)).alias("q"),
            F.when(ref, 0).when(own, a["n"] + o["len"]).otherwise(a["n"]).alias("n"),
            F.when((base & own) | (op == "N"), 0).when(own, a["t"] + o["len"]).otherwise(a["t"]).alias("t"),
            F.when(base & own, 0).when(op == "N", a["r"] + o["len"]).otherwise(a["skip"]).alias("skip"),
            F.when(own, F.concat(a["out"], F.array(mine))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(F.filter(ops, lambda o: o["len"] > 0), zero, step, lambda a: a["out"])


def match_all_along() -> tuple[Column, Column, Column]:
    """Whether a read needs no walk of its CIGAR; then, how many bases match and how many are clipped before."""
    whole = F.coalesce(F.col("cigar").rlike("^([0-9]+H)?([0-9]+S)?([1-9][0-9]*[M=X])+([0-9]+S)?([0-9]+H)?$"), F.lit(False))
    matched = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[M=X]"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))
    # One operation, as most reads have, is a number and a sign.
    matched = F.coalesce(F.substring("cigar", F.lit(1), F.length("cigar") - 1).try_cast("int"), matched)
    clipped = F.when(F.contains("cigar", F.lit("S")), F.coalesce(F.regexp_extract("cigar", "^(?:[0-9]+H)?([0-9]+)S", 1).try_cast("int"), F.lit(0))).otherwise(0)
    return whole, matched, clipped


def _letters() -> tuple[Column, Column]:
    letters = F.regexp_replace(F.upper("seq"), "[^ACMGRSVTWYHKDB]", "N")
    given = lambda c: F.when((F.col(c) == "*") | (F.col(c) == ""), F.array().cast("array<string>"))
    return given("seq").otherwise(F.split(letters, "")).alias("b"), given("qual").otherwise(F.split("qual", "")).alias("q")


def read_bases(aln: DataFrame) -> DataFrame:
    """One row per column of a read along its CIGAR (needs cigar, seq and qual as in
    alignment text): reference columns have nth 0, inserted and padded ones nth 1 on.

    ``shown`` is the pileup sign: ^ and mapping quality before a read's first base and
    behind a skip, $ after its last, before and in a skip, lower case on the reverse
    strand, +len before inserted bases, * in deletions, . in skips. ``sign`` is the base
    alone. Clips and insertions before the first column have none. Gaps take the mean of
    the quality before and of the next base, skips 0, bases past the sequence are N of 255."""
    from basestream.functions.sequence import quality_char

    whole, matched, clipped = match_all_along()
    walked = walked_bases(aln.where(~whole))
    # Reads that match all along need no walk: their columns are plain expressions of a row a base.
    along = F.struct(*_letters(), matched.alias("n"), clipped.alias("from"))
    plain = aln.where(whole).select("ref_id", F.col("pos").alias("at"), "file_ord", "flag", "mapq", F.explode(F.array(along)).alias("p"))
    b, q = F.col("p.b"), F.col("p.q")
    score = lambda i: F.when(i < F.size(b), F.coalesce(F.ascii(F.get(q, i)) - 33, F.lit(255))).otherwise(255)
    following = lambda i: F.when(i < F.size(b), score(i)).otherwise(score(F.greatest(F.lit(0), i - 1)))
    mark = F.concat(F.lit("^"), quality_char(F.col("mapq")))
    k, j, ended = F.col("k"), F.col("p.from") + F.col("k"), F.col("k") == F.col("p.n") - 1
    sign = F.coalesce(F.get(b, j), F.lit("N"))
    made = {
        "gapped": F.lit(False), "inserts": F.lit(False), "nth": F.lit(0), "sign": sign,
        "shown": F.concat(F.when(k == 0, mark).otherwise(""), F.when(has(REVERSE), F.lower(sign)).otherwise(sign), F.when(ended, "$").otherwise("")),
        "qual": score(j).cast("int"), "next_qual": following(j + 1), "before_qual": F.lit(255), "steps": F.lit(0), "chain": j + 1, "skip": F.lit(0), "tail": F.lit(True), "ended": ended,
    }
    each = plain.select("*", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("k"))
    return each.select("ref_id", (F.col("at") + k).alias("pos"), "file_ord", "flag", "mapq", *[v.alias(c) for c, v in made.items()]).unionByName(walked)


def walked_bases(aln: DataFrame) -> DataFrame:
    """``read_bases`` of reads whose CIGAR is walked in higher-order functions."""
    from basestream.functions import cigar
    from basestream.functions.sequence import quality_char

    # Explode keeps the parts columns of their own, made once a read.
    parts = F.struct(*_letters(), _walked(cigar.parse(F.col("cigar"))).alias("ops"))
    told = ["gapped", "inserts"]
    read = aln.select(
        "ref_id", F.col("pos").alias("at"), "file_ord", "flag", "mapq", F.col("cigar").contains("D").alias("gapped"), F.col("cigar").rlike("[IP]").alias("inserts"), F.explode(F.array(parts)).alias("p")
    )
    b, q, ops, n_ops = F.col("p.b"), F.col("p.q"), F.col("p.ops"), F.size("p.ops")
    score = lambda i: F.when(i < F.size(b), F.coalesce(F.ascii(F.get(q, i)) - 33, F.lit(255))).otherwise(255)
    following = lambda i: F.when(i < F.size(b), score(i)).otherwise(score(F.greatest(F.lit(0), i - 1)))
    reverse, mark = has(REVERSE), F.concat(F.lit("^"), quality_char(F.col("mapq")))
    cased = lambda c: F.when(reverse, F.lower(c)).otherwise(c)

    def columns(o, i):
        op, after, prior = o["op"], F.get(ops, i + 1)["op"], F.when(i > 0, F.get(ops, i - 1)["op"])
        inner, base = op.isin("I", "P"), op.isin(*"M=XI")
        more = F.aggregate(F.filter(ops, lambda x: (x["r"] == o["r"]) & (x["op"] == "I")), F.lit(0), lambda s, x: s + x["len"])
        size = F.when((o["n"] == 0) & F.coalesce(after != "P", F.lit(True)), o["len"]).otherwise(more)
        leads = (op == "I") & ((o["n"] == 0) | ~F.exists(ops, lambda x: (x["r"] == o["r"]) & (x["op"] == "I") & (x["n"] < o["n"])))

        def column(k):
            last, j = k == o["len"] - 1, o["q"] + k
            steps = F.when(op.isin("D", "P"), o["t"] + k + 1).otherwise(0)
            before = F.when(o["skip"] != 0, F.lit(0)).otherwise(score(o["q"] - 1))
            nxt = F.when(base, following(j + 1)).otherwise(following(o["q"]))
            sign = F.when(base, F.coalesce(F.get(b, j), F.lit("N"))).when(op == "N", ".").otherwise("*")
            ends = (op == "N") | (last & F.coalesce(after == "N", F.lit(True)))
            shown = F.concat(
                F.when((k == 0) & F.coalesce(prior == "N", F.lit(True)) & ~((op == "N") & (i > 0)), mark).otherwise(""),
                F.when(leads & (k == 0), F.concat(F.lit("+"), size.cast("string"))).otherwise(""),
                F.when(op == "P", "").otherwise(cased(sign)), F.when(ends, "$").otherwise(""),
            )
            return F.struct(
                F.when(inner, o["r"] - 1).otherwise(o["r"] + k).alias("off"), F.when(inner, o["n"] + k + 1).otherwise(0).alias("nth"), sign.alias("sign"), shown.alias("shown"),
                F.when(base, score(j)).when(op == "N", 0).otherwise(_halved(before, steps, nxt)).cast("int").alias("qual"), nxt.alias("next_qual"),
                before.alias("before_qual"), steps.alias("steps"), F.when(base, j + 1).otherwise(o["q"]).alias("chain"),
                F.when(base, 0).when(op == "N", o["r"] + k + 1).otherwise(o["skip"]).alias("skip"),
                F.when(last, ~F.coalesce(after.isin("I", "P"), F.lit(False))).otherwise(~inner).alias("tail"), (last & (i == n_ops - 1)).alias("ended"),
            )

        return F.transform(F.sequence(F.lit(0), o["len"] - 1), column)

    every = read.select("ref_id", "at", "file_ord", "flag", "mapq", *told, F.explode(F.flatten(F.transform(ops, columns))).alias("c"))
    rest = [F.col(f"c.{k}") for k in ("nth", "sign", "shown", "qual", "next_qual", "before_qual", "steps", "chain", "skip", "tail", "ended")]
    return every.select("ref_id", (F.col("at") + F.col("c.off")).alias("pos"), "file_ord", "flag", "mapq", *told, *rest)
