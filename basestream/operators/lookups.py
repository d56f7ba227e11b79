"""Header tables, name lookups, as-of joins and archive indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_lookup(records: DataFrame, names: DataFrame, key: str = "rname") -> DataFrame:
    """Numbers of reference names; unknown names get new numbers after the known ones,
    in name order, with length 0."""
    known = names.select(F.col("name").alias(key), F.col("id").alias("known_id"))
    missing = records.select(key).distinct().join(known, key, "left_anti")
    most = names.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("most"))
    added = missing.crossJoin(F.broadcast(most)).select(key, (F.col("most") + F.row_number().over(Window.orderBy(key))).alias("known_id"))
    return records.join(known.unionByName(added), key, "left").withColumnRenamed("known_id", "ref_id")


def chain_leaves(programs: DataFrame) -> DataFrame:
    """Programs that no other names as its predecessor."""
    parents = programs.where("prev_id is not null").select(F.col("prev_id").alias("id")).distinct()
    return programs.join(parents, "id", "left_anti")


def add_program(programs: DataFrame, name: str) -> DataFrame:
    """A program appended to every leaf of the chains, under ids ``name``, ``name.1``, ..."""
    leaves = chain_leaves(programs).select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))
    made = leaves.select(F.when(F.col("k") == 0, F.lit(name)).otherwise(F.concat(F.lit(name + "."), F.col("k").cast("string"))).alias("id"), F.col("id").alias("prev_id"))
    return programs.select("id", "prev_id").unionByName(made)


def as_of(events: DataFrame, headers: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """``events`` with the ``value`` of the latest header at or before them: union and a
    running last value, one shuffle, no range join. Headers come first among equals."""
    both = events.withColumn("_h", F.lit(1)).withColumn(value, F.lit(None).cast(dict(headers.dtypes)[value])).unionByName(
        headers.select(*keys, *at, value).withColumn("_h", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(*at, "_h").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_h = 1").drop("_h")


def archive_index(entries: DataFrame, size: Column, order: str, blocks: int = 4096) -> DataFrame:
    """Position of each entry in an archive: sizes before it. Blocks of the order key are
    summed first, so the running sum runs inside blocks and over one row a block."""
    sized = entries.withColumn("size", size.cast("long")).withColumn("blk", F.floor(F.col(order) / blocks))
    totals = sized.groupBy("blk").agg(F.sum("size").alias("t"))
    base = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("blk", "base")
    w = Window.partitionBy("blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(base, "blk").withColumn("position", F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0))).drop("blk", "base")


def archive_find(index: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    return index.join(names.select(key).distinct(), key, "left_semi")


def same_headers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two headers list the same (id, name, len), in one row."""
    cols = ["id", "name", "len"]
    left, right = a.select(*cols), b.select(*cols)
    odd = left.exceptAll(right).unionByName(right.exceptAll(left))
    return odd.agg((F.count(F.lit(1)) == 0).alias("compatible"))


def header_lines(text: DataFrame) -> DataFrame:
    """(line_no, type, tags) of header lines ``@XX<TAB>KK:value...``; a comment's text is its CO tag."""
    body = F.regexp_replace("value", "^@[A-Z][A-Z]\t?", "")
    pairs = F.transform(F.split(body, "\t"), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t))))
    kind = F.substring("value", 2, 2)
    return text.where(F.col("value").startswith("@")).select(
        "line_no", kind.alias("type"), F.when(kind == "CO", F.create_map(F.lit("CO"), body)).otherwise(F.map_from_entries(F.array_distinct(pairs))).alias("tags")
    )


def rebuild_header(lines: DataFrame) -> DataFrame:
    """Header text: HD first, then types in the order they first appear."""
    first = lines.groupBy("type").agg(F.min("line_no").alias("seen"))
    ranked = lines.join(first, "type").withColumn("rank", F.when(F.col("type") == "HD", -1).otherwise(F.col("seen")))
    return ranked.orderBy("rank", "line_no")


def read_groups(records: DataFrame, groups: DataFrame, tag: Column) -> DataFrame:
    """``records`` with rg_id, the number of the header's read group that ``tag`` names;
    -1 without the tag or such a group. The header is broadcast."""
    known = groups.select(F.col("name").alias("_rg"), F.col("id").alias("_rg_id"))
    return records.withColumn("_tag", tag).join(F.broadcast(known), F.col("_tag") == F.col("_rg"), "left").select(*records.columns, F.coalesce("_rg_id", F.lit(-1)).alias("rg_id"))


def update_header(lines: DataFrame, kind: str, name_key: str, name: str, changes: dict[str, str]) -> DataFrame:
    """Header lines (line_no, type, tags) with keys of one line added or replaced; a line that
    isn't there is added at the end."""
    tags = F.col("tags")
    hit = (F.col("type") == kind) & (F.element_at(tags, F.lit(name_key)) == name)
    new = F.create_map(*[F.lit(x) for kv in changes.items() for x in kv])
    changed = F.map_concat(F.map_filter(tags, lambda k, _: ~k.isin(*changes)), new)
    edited = lines.select("line_no", "type", F.when(hit, changed).otherwise(tags).alias("tags"))
    about = lines.agg((F.coalesce(F.max("line_no"), F.lit(-1)) + 1).cast(dict(lines.dtypes)["line_no"]).alias("line_no"), F.coalesce(F.max(hit), F.lit(False)).alias("there"))
    added = F.create_map(*[F.lit(x) for kv in ({name_key: name} | changes).items() for x in kv])
    return edited.unionByName(about.where("not there").select("line_no", F.lit(kind).alias("type"), added.alias("tags")))


def find_header(lines: DataFrame, kind: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """Header lines of a type, and with a key of that value if one is given."""
    found = lines.where(F.col("type") == kind)
    return found if key is None else found.where(F.element_at("tags", F.lit(key)) == value)


def remove_header(lines: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    hit = (F.col("type") == kind) & (F.element_at("tags", F.lit(key)) == value)
    return lines.where(~F.coalesce(hit, F.lit(False)))


def trace_files(experiments: DataFrame, traces: DataFrame) -> DataFrame:
    """``experiments`` (name, trace_name) with found, the trace file that it names, or else
    the experiment's own sequence (its name)."""
    known = traces.select(F.col("name").alias("_t"), F.col("path").alias("_path"))
    return experiments.join(known, F.col("trace_name") == F.col("_t"), "left").select(*experiments.columns, F.coalesce("_path", F.concat(F.lit("SQ:"), "name")).alias("found"))


def archive_count(index: DataFrame) -> DataFrame:
    """Entries and bytes of an archive from its index alone."""
    return index.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(F.col("position") + F.col("size")).alias("end"))


def filter_blocks(blocks: DataFrame, drop_series: list[str] = (), keep_tags: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Whole blocks (container, series, ...): series to drop, tag series (three letters and
    more) to keep, and a range of containers. Records are not decoded."""
    kept = blocks.where(~F.col("series").isin(*drop_series)) if drop_series else blocks
    if keep_tags is not None:
        kept = kept.where((F.length("series") < 3) | F.col("series").isin(*keep_tags))
    if first is not None:
        kept = kept.where(F.col("container") >= first)
    return kept if last is None else kept.where(F.col("container") <= last)
