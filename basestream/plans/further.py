"""More queries over the driver's tables, each beside its SQL: templates, tags, headers,
ranges, blocks and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basestream.functions import records as rec
from basestream.functions import sequence, trace
from basestream.operators import alignments as al
from basestream.operators import lookups, piles, statistics, templates
from basestream.plans.adapters import ALN, SEQS, alignments, header, records, sequences, table, with_reads
from basestream.plans.catalogue import POSITION, READ, TRACE, _by_position, _traces, long, query

# --- templates ----------------------------------------------------------------------

SLICED = ALN + """, sl as (select *, (file_ord - 1) // 500 as slice_id from aln),
nx as (select *, coalesce(lead(pos) over w, first_value(pos) over w) as npos, coalesce(lead(flag) over w, first_value(flag) over w) as nflag,
  coalesce(lead(ref_id) over w, first_value(ref_id) over w) as nref, coalesce(lead(file_ord) over w, first_value(file_ord) over w) as nord,
  min(pos) over (partition by qname) as lo, max(pos + span) over (partition by qname) as hi from sl window w as (partition by qname order by file_ord))"""


def _sliced(spark, d):
    return alignments(spark, d).withColumn("slice_id", F.floor((F.col("file_ord") - 1) / 500))


MATED = SLICED + """, md as (select file_ord, slice_id, qname, cast(1 + (flag & 64) + (flag & 128) + (flag & 16) + (case when nflag & 16 <> 0 then 32 else 0 end) as int) as flag,
  0 as ref_id, pos, span, case when l_partkey % 5 = 0 then 0 else npos end as mate_pos, case when pos = lo then hi - lo else lo - hi end as tlen from nx),
pv as (select *, lag(file_ord) over w as p_ord, lag(flag) over w as p_flag, lag(pos) over w as p_pos, lag(span) over w as p_span, lag(mate_pos) over w as p_mate, lag(tlen) over w as p_tlen
  from md window w as (partition by slice_id, qname order by file_ord)),
sg as (select *, case when pos < p_pos or (pos = p_pos and flag & 64 <> 0) then 1 else -1 end as sgn, greatest(pos + span, p_pos + p_span) - least(pos, p_pos) as size from pv)"""


@query("with" + MATED + """ select file_ord, file_ord - p_ord as mate_line, coalesce(mate_pos = p_pos and p_mate = pos and (flag & 32 <> 0) = (p_flag & 16 <> 0) and (p_flag & 32 <> 0) = (flag & 16 <> 0)
 and tlen = sgn * size and p_tlen = -sgn * size, false) as attached from sg""")
def mate_pairing(spark, d):
    w, t = Window.partitionBy("qname").orderBy("file_ord"), Window.partitionBy("qname")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    low, high = F.min("pos").over(t), F.max(F.col("pos") + F.col("span")).over(t)
    flag = F.lit(1) + F.col("flag").bitwiseAND(64 + 128 + 16) + F.when(nxt("flag").bitwiseAND(16) != 0, 32).otherwise(0)
    mated = _sliced(spark, d).select(
        "slice_id", "file_ord", "qname", flag.cast("int").alias("flag"), F.lit(0).alias("ref_id"), "pos", "span",
        F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(nxt("pos")).alias("mate_pos"), F.when(F.col("pos") == low, high - low).otherwise(low - high).alias("tlen"),
    )
    return templates.pair_mates(mated).select("file_ord", "mate_line", "attached")


@query("with" + SLICED + """ select file_ord, cast((flag & ~40) + case when nord = file_ord then 0 else (case when nflag & 16 <> 0 then 32 else 0 end) + (case when nflag & 4 <> 0 then 8 else 0 end) end as bigint) as flag,
 cast(case when nord = file_ord then -1 else nref end as bigint) as mate_ref_id, case when nord = file_ord then -1 else npos end as mate_pos from nx""")
def mate_fields(spark, d):
    return long(templates.mate_fields(alignments(spark, d)).select("file_ord", "flag", "mate_ref_id", "mate_pos"))


@query("with" + ALN + "select l_returnflag as tag, case l_returnflag when 'A' then 0 when 'N' then 1 else -1 end as rg_id, count(*) as n from aln group by 1, 2")
def read_group_lookup(spark, d):
    groups = spark.range(2).select(F.col("id"), F.when(F.col("id") == 0, "A").otherwise("N").alias("name"))
    found = lookups.read_groups(records(spark, d).withColumn("tag", F.col("l_returnflag")), groups, F.col("tag"))
    return found.groupBy("tag", F.col("rg_id").cast("long").alias("rg_id")).agg(F.count(F.lit(1)).alias("n"))


TC = """t as (select event_id, user_id % 2 as flag, case when event_id % 5 = 0 then user_id % 6 end as tc, event_id % 3 = 0 as sa from events)"""


def _counted_tags(spark, d):
    e = table(spark, d, "events")
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    tc = F.when(F.col("event_id") % 5 == 0, F.col("user_id") % 6)
    tags = rec.add_tag(rec.add_tag(empty, "TC", "i", tc), "SA", "Z", F.when(F.col("event_id") % 3 == 0, "x"))
    return e.select("event_id", "user_id", "event_type", (F.col("user_id") % 2).cast("int").alias("flag"), tags.alias("tags"))


@query("with " + TC + "select event_id, cast(case when tc is not null then greatest(flag + 1, tc) when sa then 2147483647 else flag + 1 end as bigint) as expected from t")
def template_count(spark, d):
    return _counted_tags(spark, d).select("event_id", rec.expected_templates(F.col("flag"), F.col("tags")).alias("expected"))


# --- tags ---------------------------------------------------------------------------

@query("with " + TC + "select event_id, tc as as_int, case when sa then 'x' end as as_text, cast(null as double) as as_float from t")
def tag_typed(spark, d):
    t = F.col("tags")
    return _counted_tags(spark, d).select("event_id", rec.tag_int(t, "TC").alias("as_int"), rec.tag_text(t, "SA").alias("as_text"), rec.tag_float(t, "TC").alias("as_float"))


@query("with " + TC + """, a as (select t.event_id, e.event_type, user_id, tc, sa from t join events e using (event_id)),
p as (select event_id, 'SA' as k, 'Z' as y, 'x' as v from a where sa union all select event_id, 'TC', 'Z', event_type from a union all select event_id, 'XN', 'i', cast(user_id as varchar) from a
 union all select event_id, 'XB', 'B', 's,' || user_id || ',' || (user_id + 1) from a)
select event_id, string_agg(k || ':' || y || ':' || v, ' ' order by k) as tags from p group by event_id""")
def tag_add(spark, d):
    u = F.col("user_id")
    t = rec.add_tag_array(rec.add_tag(F.col("tags"), "TC", "Z", F.col("event_type")), "XB", "s", F.array(u, u + 1))
    t = rec.add_tags_from_text(t, F.concat(F.lit("XN:i:"), u.cast("string")))
    shown = F.transform(rec.tag_entries(t), lambda e: F.concat_ws(":", e["name"], e["type"], e["value"]))
    return _counted_tags(spark, d).select("event_id", F.array_join(shown, " ").alias("tags"))


@query("with " + TC + "select k as name, y as type, count(*) as n from (select 'TC' as k, 'i' as y from t where tc is not null union all select 'SA', 'Z' from t where sa) group by 1, 2")
def tag_iterate(spark, d):
    each = _counted_tags(spark, d).select(F.explode(rec.tag_entries(F.col("tags"))).alias("e"))
    return each.groupBy(F.col("e.name").alias("name"), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + TC + "select event_id, cast(case when tc is not null then tc when user_id % 3 = 0 then null else 7 end as bigint) as nm from t join events using (event_id)")
def md_nm_if_absent(spark, d):
    known = F.when(F.col("user_id") % 3 != 0, F.lit(7))  # no reference for the others
    t = rec.fill_tag(F.col("tags"), "TC", "i", known)
    return _counted_tags(spark, d).select("event_id", rec.tag_int(t, "TC").alias("nm"))


SWAP = " + ".join(f"(case when flag & {a} <> 0 then {b} else 0 end)" for a, b in rec.FLAG_BITS.items())


@query("with" + ALN + f"select cast(flag as bigint) as flag, cast({SWAP} as bigint) as swapped, cast(flag & 2007 as bigint) as back, count(*) as n from aln group by 1, 2, 3")
def flag_remap(spark, d):
    swapped = rec.swap_flags(F.col("flag"))
    told = records(spark, d).select("flag", swapped.alias("swapped")).withColumn("back", rec.swap_flags(F.col("swapped"), back=True))
    return long(told.groupBy("flag", "swapped", "back").agg(F.count(F.lit(1)).alias("n")))


@query("with" + ALN + "select l_returnflag as rname, count(*) as n, sum(pos) as pos, cast(sum(case when flag & 1 <> 0 then -1 else 0 end) as bigint) as mates, '*' as seq from aln group by 1")
def record_new(spark, d):
    made = rec.record(qname=F.col("qname"), rname=F.col("l_returnflag"), pos=F.col("pos"), flag=F.col("flag"))
    told = records(spark, d).select(made.alias("r")).select(rec.copy_record(F.col("r"), mate_ref_id=F.when(al.has(1, "r.flag"), F.col("r.mate_ref_id")).otherwise(0)).alias("r"))
    return told.groupBy("r.rname").agg(F.count(F.lit(1)).alias("n"), F.sum("r.pos").alias("pos"), F.sum(F.col("r.mate_ref_id").cast("long")).alias("mates"), F.max("r.seq").alias("seq"))


# --- headers, names -----------------------------------------------------------------

@query("""select n_nationkey + 1 as line_no, 'SQ' as type, case when n_nationkey = 7 then 'AS=x,LN=5,SN=' || n_name else 'LN=' || (1000 + n_nationkey * 10) || ',SN=' || n_name end as tags from nation where n_nationkey <> 3
union all select 26, 'RG', 'ID=g1,SM=s'""")
def header_edit(spark, d):
    h = header(spark, d)
    lines = h.select((F.col("id") + 1).cast("long").alias("line_no"), F.lit("SQ").alias("type"), F.create_map(F.lit("SN"), F.col("name"), F.lit("LN"), F.col("len").cast("string")).alias("tags"))
    seventh, third = (h.where(F.col("id") == k).first()["name"] for k in (7, 3))
    edited = lookups.update_header(lines, "SQ", "SN", seventh, {"LN": "5", "AS": "x"})
    edited = lookups.remove_header(lookups.update_header(edited, "RG", "ID", "g1", {"SM": "s"}), "SQ", "SN", third)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return edited.select("line_no", "type", shown.alias("tags"))


@query("select c_custkey, coalesce(p.p_name, 'SQ:' || c_name) as found from customer left join part p on p.p_partkey = c_custkey and c_custkey % 3 = 0")
def trace_file_lookup(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("path"))
    exps = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("trace_name"))
    return lookups.trace_files(exps, parts).select("c_custkey", "found")


@query("select count(*) as entries, cast(sum(length(html)) as bigint) as bytes, cast(sum(length(html)) as bigint) as \"end\" from pages")
def archive_count(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("name"), "page_id", "html")
    return lookups.archive_count(lookups.archive_index(p, F.length("html"), "page_id"))


@query("""with t as (select l_orderkey // 100 as container, ['RN','BF','QS','NMi','MDZ','XAZ'] as s, l_linenumber as size from lineitem), u as (select container, unnest(s) as series, size from t)
select container, series, cast(sum(size) as bigint) as bytes from u where series <> 'QS' and series <> 'MDZ' and container between 3 and 20 group by 1, 2""")
def block_filter(spark, d):
    series = F.explode(F.array(*[F.lit(x) for x in ("RN", "BF", "QS", "NMi", "MDZ", "XAZ")]))
    blocks = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("container"), series.alias("series"), F.col("l_linenumber").alias("size"))
    return lookups.filter_blocks(blocks, ["QS"], ["NMi", "XAZ"], 3, 20).groupBy("container", "series").agg(F.sum("size").alias("bytes"))


@query("select c_custkey, cast(list_reduce(list_prepend(0::hugeint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::hugeint)), lambda h, c: (h * 9 + c) % 4294967296) as bigint) as hash from customer")
def name_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", rec.tcl_hash(F.col("c_name")).alias("hash"))


TYPES = " ".join(f"when '{t}' then {k}" for k, t in enumerate(rec.TRACE_TYPES))


@query(f"with t as (select event_id, list_extract(['SCF','scf','ZTR','abi','none','SFF'], cast(event_id % 6 + 1 as int)) as name from events) select name, case upper(name) {TYPES} else 0 end as code, case when upper(name) = 'NONE' then 'UNK' else upper(name) end as back, count(*) as n from t group by 1, 2, 3")
def trace_types(spark, d):
    names = F.get(F.array(*[F.lit(x) for x in ("SCF", "scf", "ZTR", "abi", "none", "SFF")]), (F.col("event_id") % 6).cast("int"))
    told = table(spark, d, "events").select(names.alias("name")).withColumn("code", rec.trace_code(F.col("name")).cast("long"))
    return told.groupBy("name", "code", rec.trace_name(F.col("code")).alias("back")).agg(F.count(F.lit(1)).alias("n"))


# --- ranges, order, slices ----------------------------------------------------------

@query("with" + ALN + """ select 'ref1:131-261' as "range", count(*) as n, sum(pos) as pos from aln where ref_id = 1 and pos + 1 <= 261 and pos + span >= 131
union all select 'ref2:300', count(*), sum(pos) from aln where ref_id = 2 and pos + 1 <= 300 and pos + span >= 300 union all select 'ref3', count(*), sum(pos) from aln where ref_id = 3
union all select '*', count(*), sum(pos) from aln where ref_id < 0""")
def range_text_filter(spark, d):
    r = records(spark, d)
    names = spark.range(4).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("ref"), F.col("id").cast("string")).alias("name"))
    out = None
    for text in ("ref1:131-261", "ref2:300", "ref3", "*"):
        part = al.in_named_range(r, names, text).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")).select(F.lit(text).alias("range"), "n", "pos")
        out = part if out is None else out.unionByName(part)
    return out


@query("with" + ALN + ", s as (select file_ord, ref_id, pos, lag(ref_id) over (order by file_ord) as pr, lag(pos) over (order by file_ord) as pp from aln) select file_ord, cast(ref_id as bigint) as ref_id, pos from s where pr > ref_id or (pr = ref_id and pp > pos)")
def order_breaks(spark, d):
    return long(al.order_breaks(alignments(spark, d)).select("file_ord", "ref_id", "pos"))


@query("with" + ALN + ", g as (select *, file_ord * 37 + (file_ord // 1000) * 500000 as fo from aln), r1 as (select *, case when lag(ref_id) over (order by fo) is distinct from ref_id then fo end as s from g), r2 as (select *, max(s) over (order by fo rows unbounded preceding) as run_start from r1) select run_start, cast(min(ref_id) as bigint) as ref_id, count(*) as n from r2 group by 1")
def runs_with_gaps(spark, d):
    gapped = alignments(spark, d).withColumn("file_ord", F.col("file_ord") * 37 + F.floor(F.col("file_ord") / 1000) * 500000)
    return long(al.ref_runs(gapped).groupBy("run_start").agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n")))


@query("with " + POSITION + "select slice_id, cast(ref_id as bigint) as ref_id, count(*) as uses, cast(sum(span) as bigint) as bases from ps group by 1, 2")
def reference_usage(spark, d):
    return long(al.slice_references(al.add_slices(_by_position(spark, d))))


@query("with" + ALN + "select (file_ord - 1) // 500 as slice_id, count(*) as records, count(*) filter (where flag & 4 = 0) as mapped, cast(sum(span) as bigint) as bases from aln group by 1")
def container_counts(spark, d):
    return al.slice_counts(_sliced(spark, d))


@query("with" + ALN + "select file_ord, qname from aln order by file_ord limit 10")
def check_level(spark, d):
    return alignments(spark, d).select("file_ord", "qname").orderBy("file_ord").limit(10)


@query("""with s as (select p_brand as block, list_extract(['raw','gzip','bzip2','rans0','lzma','zstd'], cast(p_partkey % 6 + 1 as int)) as method, cast(round(p_retailprice) as bigint) as size from part),
c as (select block, method, sum(size) * (1 + (case method when 'gzip' then 0.04::double when 'bzip2' then 0.08::double when 'lzma' then 0.04::double when 'zstd' then 0.03::double else 0.0::double end) / 2) as cost from s group by 1, 2)
select block, arg_min(method, cost) as method from c group by 1""")
def best_method(spark, d):
    method = F.get(F.array(*[F.lit(x) for x in ("raw", "gzip", "bzip2", "rans0", "lzma", "zstd")]), (F.col("p_partkey") % 6).cast("int"))
    trials = table(spark, d, "part").select(F.col("p_brand").alias("block"), method.alias("method"), F.round("p_retailprice").cast("long").alias("size"))
    return statistics.best_method(trials, ["block"])


@query("select source, cast(sum(length(text)) as bigint) as raw, count(distinct doc_id) * 8 as packed, round(100.0::double * (count(distinct doc_id) * 8) / sum(length(text)), 2) as ratio from documents group by 1")
def compression_ratio(spark, d):
    t = table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("raw"), (F.count_distinct("doc_id") * 8).alias("packed"))
    return t.select("source", "raw", "packed", statistics.ratio(F.col("raw"), F.col("packed")).alias("ratio"))


# --- bases and traces ---------------------------------------------------------------

@query("with " + SEQS + "select doc_id, case when doc_id % 4 = 0 then replace(seq, 'N', '.') else seq end as seq from seqs")
def fastq_cset(spark, d):
    dotted = F.translate("seq", "N", ".")
    return sequences(spark, d).select("doc_id", rec.fastq_bases(dotted, F.when(F.col("doc_id") % 4 == 0, "0")).alias("seq"))


@query("with " + TRACE + ", b as (select vec_id, list_transform(generate_series(1, len(v)), lambda i: substr('ACNT-G', cast((vec_id + i) % 6 + 1 as int), 1)) as b, v from tr) select vec_id, list_transform(generate_series(1, len(v)), lambda i: case when b[i] in ('A','C','G','T') then v[i] else 0 end) as conf from b")
def fastq_confidence(spark, d):
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.substring(F.lit("ACNT-G"), ((F.col("vec_id") + i) % 6 + 1).cast("int"), F.lit(1))), "")
    return _traces(spark, d).select("vec_id", rec.fastq_confidence(letters, F.col("v")).alias("conf"))


@query("with " + TRACE + "select vec_id, array_to_string(v, ' ') as av, list_sum(v) as total from tr")
def accuracy_line(spark, d):
    t = _traces(spark, d).select("vec_id", rec.accuracy_string(F.col("v")).alias("av"))
    return t.select("vec_id", "av", F.aggregate(rec.accuracy_values(F.col("av")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("with " + TRACE + "select vec_id, list_transform(generate_series(1, len(v)), lambda i: list_sum(v[1:i])) as sums from tr")
def prefix_sums(spark, d):
    return _traces(spark, d).select("vec_id", trace.running_sums(F.col("v")).alias("sums"))


@query("with " + TRACE + """, o as (select vec_id, v, list_transform(generate_series(1, len(v)), lambda i: (i * 7 + vec_id) % (len(v) + 1)) as p from tr)
select vec_id, list_transform(p, lambda x: case when x = 0 then 0 else case substr('ACGTN', cast((x - 1) % 5 + 1 as int), 1) when 'A' then v[x] when 'C' then v[x] + 1 when 'G' then v[x] + 2 when 'T' then v[x] + 3 else 2 end end) as conf from o""")
def opos_confidence(spark, d):
    n = F.size("v")
    places = F.transform(F.sequence(F.lit(1), n), lambda i: (i * 7 + F.col("vec_id")) % (n + 1))
    more = lambda k: F.transform("v", lambda x: x + k)
    t = _traces(spark, d).select("vec_id", F.expr("substring(repeat('ACGTN', int(size(v) / 5) + 1), 1, size(v))").alias("b"), places.alias("p"), *[more(k).alias(c) for k, c in enumerate("acgt")])
    return t.select("vec_id", trace.original_confidence(F.col("b"), F.col("p"), *[F.col(c) for c in "acgt"]).alias("conf"))


CLIP = """c as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 20 as l, 40 + l_partkey % 30 as r, l_suppkey % 50 as vl, l_suppkey % 50 + l_partkey % 40 as vr from lineitem)"""


@query("with " + CLIP + """, k as (select case when vl <= l and vr <= l then l when vl <= l + 1 and vr < r then vr else l end as a,
 case when vl <= l and vr <= l then r when vl <= l + 1 and vr < r then r when vl <= l + 1 then l + 1 when vl < r then vl else r end as b from c) select a as "left", b as "right", count(*) as n from k group by 1, 2""")
def vector_clip(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    left, right = rec.vector_clip(p % 20, 40 + p % 30, s % 50, s % 50 + p % 40)
    return table(spark, d, "lineitem").groupBy(left.alias("left"), right.alias("right")).agg(F.count(F.lit(1)).alias("n"))


@query("with" + ALN + """, b as (select ref_id, pos + k as pos, file_ord, mapq, substr('ACGT', cast((k + pos) % 4 as int) + 1, 1) as base from (select *, unnest(generate_series(0, span - 1)) as k from aln where flag & 4 = 0 and ref_id >= 0 and mapq >= 40))
select cast(ref_id as bigint) as ref_id, pos, 0 as nth, count(*) as depth, string_agg(base, '' order by file_ord) as bases, string_agg(chr(cast(least(mapq, 93) + 33 as int)), '' order by file_ord) as quals from b group by 1, 2""")
def pileup_gap5(spark, d):
    kept = alignments(spark, d, *READ).where(~al.has(4) & (F.col("ref_id") >= 0) & (F.col("mapq") >= 40))
    return long(piles.pileup_columns(with_reads(kept)))


INDEL = """i as (select ref_id, file_ord, pos as p, l_linenumber as n from aln where flag & 4 = 0 and flag & 16 = 0 and mapq >= 45),
e as (select ref_id, file_ord, unnest([{'p': p, 'b': '^NA', 'd': 1}, {'p': p + 1, 'b': 'C+1T', 'd': 1}, {'p': p + 2, 'b': '*$', 'd': 1}, {'p': p + 3, 'b': '.', 'd': 1}, {'p': p + 4, 'b': '^NG$', 'd': 1}]) as x from i)"""


@query("with" + ALN + "," + INDEL + " select cast(ref_id as bigint) as ref_id, x.p as pos, count(*) as depth, string_agg(case when x.b = '.' then '.$' else x.b end, '' order by file_ord) as bases from e group by 1, 2")
def pileup_indel(spark, d):
    """Reads of two bases, an inserted one, a deletion, a skip and a last base."""
    kept = alignments(spark, d, *READ).where(~al.has(4) & ~al.has(16) & (F.col("mapq") >= 45))
    reads = kept.withColumns({"cigar": F.lit("2M1I1D1N1M"), "seq": F.lit("ACTG"), "qual": F.lit("IIII"), "mapq": F.lit(45)})
    return long(piles.pileup(reads).drop("quals"))


@query("with " + SEQS + "select doc_id, rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) as seq from seqs")
def plain_lines(spark, d):
    return sequences(spark, d).select("doc_id", sequence.wrap(F.col("seq")).alias("seq"))
