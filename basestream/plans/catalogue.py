"""The queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.functions import cigar, sequence, tags, trace
from basestream.operators import alignments as al
from basestream.operators import lookups, piles, signal, statistics
from basestream.operators.ordering import number_rows
from basestream.plans.adapters import ALN, FLOWS, PROGRAMS, SEQS, alignments, flows, header, programs, records, sequences, table, with_reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, as the SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# --- whole-table counters -------------------------------------------------------

@query("with" + ALN + """
select cast(case when flag & 512 <> 0 then 1 else 0 end as bigint) as qc_fail, count(*) as total,
  count(*) filter (where flag & 1024 <> 0) as duplicates, count(*) filter (where flag & 4 = 0) as mapped,
  count(*) filter (where flag & 1 <> 0) as paired, count(*) filter (where flag & 1 <> 0 and flag & 2 <> 0) as proper,
  count(*) filter (where flag & 1 <> 0 and flag & 64 <> 0) as read1, count(*) filter (where flag & 1 <> 0 and flag & 128 <> 0) as read2,
  count(*) filter (where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 <> 0) as singletons,
  count(*) filter (where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0) as both_mapped,
  count(*) filter (where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0 and mate_ref_id <> ref_id) as mate_other_ref,
  count(*) filter (where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0 and mate_ref_id <> ref_id and mapq >= 5) as mate_other_ref_mapq5
from aln group by 1""")
def flagstat(spark, d):
    return long(al.flagstat(records(spark, d)))


@query("with" + ALN + "select count(*) as records, sum(span) as bases, count(distinct qname) as templates from aln")
def read_count(spark, d):
    return long(records(spark, d).agg(F.count(F.lit(1)).alias("records"), F.sum("span").alias("bases"), F.count_distinct("qname").alias("templates")))


@query("with" + ALN + "select l_returnflag as read_group, l_linestatus as region, count(*) as n, sum(span) as bases from aln group by 1, 2")
def read_group_counts(spark, d):
    return records(spark, d).groupBy(F.col("l_returnflag").alias("read_group"), F.col("l_linestatus").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("span").alias("bases"))


@query("with" + ALN + "select count(*) filter (where flag & 512 = 0) as good, count(*) filter (where flag & 512 <> 0) as bad, count(*) as total from aln")
def good_bad_counts(spark, d):
    return statistics.read_counts(records(spark, d), al.has(512))


@query("with" + ALN + """select case when flag & 16 <> 0 then '-' else '+' end as strand, case when mapq >= 30 then 'high' else 'low' end as quality,
count(*) as n from aln where flag & 4 = 0 and ref_id >= 0 group by 1, 2""")
def strand_counts(spark, d):
    kept = records(spark, d).where(~al.has(4) & (F.col("ref_id") >= 0))
    return kept.groupBy(F.when(al.has(16), "-").otherwise("+").alias("strand"), F.when(F.col("mapq") >= 30, "high").otherwise("low").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


# --- filters, ranges, tags ---------------------------------------------------------

@query("with" + ALN + "select qname, cast(ref_id as bigint) as ref_id, pos, cast(span as bigint) as span, cast(flag as bigint) as flag from aln where ref_id = 1 and pos <= 260 and pos + span - 1 >= 130")
def range_filter(spark, d):
    return long(al.in_range(records(spark, d), 1, 130, 260).select("qname", "ref_id", "pos", "span", "flag"))


TAG_SQL = """tagged as (select event_id, ['AA', 'XB', 'X1', 'NM', 'MD'] as ks, [event_type, cast(user_id as varchar), cast(event_id % 7 as varchar), cast(event_id % 5 as varchar), cast(user_id % 3 as varchar)] as vs from events),
  pairs as (select event_id, unnest(ks) as k, unnest(vs) as v from tagged)"""


def _tagged(spark, d):
    s = lambda c: c.cast("string")
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        "event_id", F.create_map(F.lit("AA"), F.col("event_type"), F.lit("XB"), s(u), F.lit("X1"), s(e % 7), F.lit("NM"), s(e % 5), F.lit("MD"), s(u % 3)).alias("tags")
    )


def _shown(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("with " + TAG_SQL + "select event_id, string_agg(k || '=' || v, ',' order by k) as tags from pairs where regexp_full_match(k, 'X[A-Z]|.M') group by event_id")
def tag_keep(spark, d):
    return _tagged(spark, d).select("event_id", _shown(tags.keep(F.col("tags"), ["X[A-Z]", ".M"])).alias("tags"))


@query("with " + TAG_SQL + "select event_id, string_agg(k || '=' || v, ',' order by k) as tags from pairs where not regexp_full_match(k, 'X[A-Z]|.M') group by event_id")
def tag_drop(spark, d):
    return _tagged(spark, d).select("event_id", _shown(tags.drop(F.col("tags"), ["X[A-Z]", ".M"])).alias("tags"))


@query("select event_id, case when event_type = 'click' then 'A' when user_id % 3 = 0 then 'Z' else 'none' end as found from events")
def tag_get(spark, d):
    t = _tagged(spark, d).withColumn("t", F.col("tags"))
    return t.select("event_id", F.when(F.element_at("t", "AA") == "click", "A").when(F.element_at("t", "MD") == "0", "Z").otherwise("none").alias("found"))


@query("select c_custkey, cast(round(c_acctbal * 100) as bigint) as v, case when round(c_acctbal * 100) >= 0 then case when round(c_acctbal * 100) < 256 then 'C' when round(c_acctbal * 100) < 65536 then 'S' else 'I' end when round(c_acctbal * 100) >= -128 then 'c' when round(c_acctbal * 100) >= -32768 then 's' else 'i' end as t from customer")
def tag_integer_types(spark, d):
    v = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, d, "customer").select("c_custkey", v.alias("v"), tags.integer_type(v).alias("t"))


@query("select c_custkey, c_name from customer where c_name in ('Customer#000000007', 'Customer#7', 'customer_7') or starts_with(c_name, 'Customer#00000001') or starts_with(c_name, 'Customer#1') or starts_with(c_name, 'Customer#0000001')")
def prefix_or_name_filter(spark, d):
    return table(spark, d, "customer").where(sequence.name_matches(F.col("c_name"), ["Customer#000000007", "Customer#7", "customer_7"], ["Customer#00000001", "Customer#1", "Customer#0000001"])).select("c_custkey", "c_name")


@query("select page_id, string_agg(c, ',' order by c) as kept from (select page_id, unnest(['BASE','CNF4','SMP4:PROC','SMP4:SLXI','CNF1','REGN']) as c from pages) where c in ('BASE','CNF4','SMP4:PROC') or (c = 'REGN' and page_id % 2 = 0) group by page_id")
def chunk_filter(spark, d):
    from basestream.sources.archives import keep_chunks

    made = lambda kind, process=None: F.struct(
        kind.alias("type"), (F.create_map(F.lit("TYPE"), F.lit(process)) if process else F.create_map().cast("map<string,string>")).alias("metadata")
    )
    region = F.when(F.col("page_id") % 2 == 0, "REGN").otherwise("TEXT")
    chunks = F.array(made(F.lit("BASE")), made(F.lit("CNF4")), made(F.lit("SMP4"), "PROC"), made(F.lit("SMP4"), "SLXI"), made(F.lit("CNF1")), made(region))
    kept = keep_chunks(chunks, ["BASE", "CNF4", "SMP4", "REGN"], ["PROC"])
    shown = F.transform(kept, lambda c: F.concat_ws(":", c["type"], F.element_at(c["metadata"], "TYPE")))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(shown), ",").alias("kept"))


# --- order, merge, slices, index ---------------------------------------------------

@query("with" + ALN + """, m as (select *, cast(l_orderkey % 3 as bigint) as input_no from aln)
select row_number() over (order by ref_id, pos, case when flag & 16 <> 0 then 1 else 0 end, case when flag & 64 <> 0 then 0 else 1 end, input_no, file_ord) as rank, qname, input_no, file_ord from m""")
def merge_sorted(spark, d):
    a = alignments(spark, d)
    parts = [a.where(F.col("l_orderkey") % 3 == k) for k in range(3)]
    merged = al.merge_order(al.merge_sorted(*parts))
    return long(number_rows(merged, [F.col(c) for c in al.MERGE_KEY], "rank").select("rank", "qname", "input_no", "file_ord"))


@query("with" + ALN + ", s as (select *, lag(ref_id) over (order by file_ord) as prev from aln) select count(*) filter (where prev > ref_id) as breaks, count(*) as n from s")
def order_check(spark, d):
    a = al.ref_runs(alignments(spark, d))
    starts = a.where("file_ord = run_start").select("run_start", "ref_id")
    # A run's predecessor is the record before its start.
    before = a.select((F.col("file_ord") + 1).alias("run_start"), F.col("ref_id").alias("prev"))
    return starts.join(before, "run_start", "left").agg(F.count_if(F.col("prev") > F.col("ref_id")).alias("breaks")).crossJoin(a.agg(F.count(F.lit(1)).alias("n")))


DEPTH_SQL = "with" + ALN + """, e as (select ref_id, unnest(generate_series(pos, pos + span - 1)) as pos from aln where flag & 4 = 0)
select cast(ref_id as bigint) as ref_id, pos, count(*) as depth from e group by 1, 2"""


@query(DEPTH_SQL)
def depth(spark, d):
    return long(al.depth_sweep(records(spark, d)))


@query(DEPTH_SQL)
def depth_by_base(spark, d):
    return long(al.depth_explode(records(spark, d)))


RUNS = ALN + """, r1 as (select *, case when lag(ref_id) over (order by file_ord) is distinct from ref_id then file_ord end as s from aln),
runs as (select *, max(s) over (order by file_ord rows unbounded preceding) as run_start from r1),
sl as (select *, run_start || ':' || ((file_ord - run_start) // 100) as slice_id from runs)"""


@query("with" + RUNS + "select run_start, cast(min(ref_id) as bigint) as ref_id, count(*) as n, min(pos) as first_pos, max(pos + span - 1) as last_pos from runs group by 1")
def multiref_runs(spark, d):
    return long(al.run_extent(al.ref_runs(alignments(spark, d, "ref_id", "pos", "span"))))


def _by_position(spark, d):
    """Records in coordinate order, so that runs of a reference are long."""
    return number_rows(records(spark, d), [F.col(c) for c in ("ref_id", "pos", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")])


POSITION = """pa as (select *, row_number() over (order by ref_id, pos, l_orderkey, l_linenumber, l_suppkey, price) as po from
 (select cast(l_suppkey % 4 as int) as ref_id, cast(l_partkey as bigint) as pos, cast(10 + l_linenumber * 5 as int) as span, l_orderkey, l_linenumber, l_suppkey, l_extendedprice as price from lineitem)),
pr as (select *, min(po) over (partition by ref_id) as run_start from pa),
ps as (select *, run_start || ':' || ((po - run_start) // 1000) as slice_id from pr),
ext as (select slice_id, cast(ref_id as bigint) as ref_id, min(pos) as "start", max(pos + span - 1) as "end", count(*) as records, sum(span) as bases from ps group by 1, 2)"""


@query("with " + POSITION + "select * from ext")
def slice_extent(spark, d):
    return long(al.slice_extent(al.add_slices(_by_position(spark, d))))


@query("with " + POSITION + 'select ref_id, slice_id, "start", "end" - "start" + 1 as span from ext')
def crai_build(spark, d):
    return long(al.build_index(al.slice_extent(al.add_slices(_by_position(spark, d)))))


@query("with " + POSITION + 'select ref_id, slice_id, "start", "end" - "start" + 1 as span from ext where ref_id = 2 and "start" <= 900 and "end" >= 700')
def crai_probe(spark, d):
    return long(al.probe_index(al.build_index(al.slice_extent(al.add_slices(_by_position(spark, d)))), 2, 700, 900))


# --- templates ----------------------------------------------------------------------

@query("with" + ALN + """, t as (select *, min(pos) over w as lo, max(pos + span - 1) over w as hi, count(*) over w as members,
 min(ref_id) over w = max(ref_id) over w as one, max(flag & 4) over w as lost from aln window w as (partition by qname)),
u as (select *, count(*) filter (where pos = lo) over (partition by qname) as ties from t)
select file_ord, qname, cast(case when not one or lost <> 0 or members < 2 then 0
 when pos = lo and (ties = 1 or flag & 64 <> 0) then hi - lo + 1 else -(hi - lo + 1) end as bigint) as tlen from u""")
def mate_tlen(spark, d):
    return al.template_length(alignments(spark, d)).select("file_ord", "qname", "tlen")


@query("with" + ALN + "select file_ord, lead(file_ord) over (partition by qname order by file_ord) - file_ord - 1 as next_mate from aln")
def mate_distance(spark, d):
    return al.mate_distance(alignments(spark, d)).select("file_ord", "next_mate")


@query("with" + RUNS + """select '' || ((file_ord - 1) // 500) as slice_id, qname, count(*) as present,
 min(case when flag & 1 <> 0 then 2 else 1 end) = max(case when flag & 1 <> 0 then 2 else 1 end) and count(*) = max(case when flag & 1 <> 0 then 2 else 1 end) as complete
 from aln group by 1, 2""")
def name_complete(spark, d):
    a = alignments(spark, d).withColumn("slice_id", F.floor((F.col("file_ord") - 1) / 500).cast("string"))
    return al.name_complete(a, F.when(al.has(1), 2).otherwise(1))


@query("with" + ALN + """, p as (select file_ord, lag(pos) over (partition by ref_id order by file_ord) as prev, pos from aln) select file_ord, pos - coalesce(prev, 0) as ap from p""")
def position_delta(spark, d):
    return al.position_delta(alignments(spark, d, "ref_id", "pos")).select("file_ord", "ap")


# --- bases --------------------------------------------------------------------------

VOTES = ALN + """, v as (select ref_id, pos, substr('ACGT*N', cast(1 + (l_orderkey + l_linenumber * 7 + l_suppkey) % 6 as int), 1) as base from aln),
c as (select ref_id, pos, base, count(*) as n from v where base <> 'N' group by all),
r as (select *, row_number() over (partition by ref_id, pos order by n desc, instr('ACGT*', base)) as k from c)"""


def _votes(spark, d):
    at = (F.col("l_orderkey") + F.col("l_linenumber") * 7 + F.col("l_suppkey")) % 6 + 1
    return records(spark, d).select("ref_id", "pos", F.substring(F.lit("ACGT*N"), at.cast("int"), F.lit(1)).alias("base"))


@query("with" + VOTES + ", p as (select distinct ref_id, pos from v) select cast(p.ref_id as bigint) as ref_id, p.pos, coalesce(base, 'N') as base, coalesce(n, 0) as votes from p left join r on p.ref_id = r.ref_id and p.pos = r.pos and k = 1")
def consensus_vote(spark, d):
    return long(al.consensus(_votes(spark, d)))


PILE = ALN + """, b as (select ref_id, pos + k as pos, file_ord, flag, mapq,
  (case when k = 0 then '^' || chr(cast(least(mapq, 93) + 33 as int)) else '' end)
  || (case when flag & 16 <> 0 then lower(substr('ACGT', cast((k + pos) % 4 as int) + 1, 1)) else substr('ACGT', cast((k + pos) % 4 as int) + 1, 1) end)
  || (case when k = span - 1 then '$' else '' end) as shown
 from (select *, unnest(generate_series(0, span - 1)) as k from aln where flag & 4 = 0 and ref_id >= 0))"""


READ = ["ref_id", "pos", "span", "mapq", "flag"]


def _reads(spark, d):
    return with_reads(alignments(spark, d, *READ).where(~al.has(4) & (F.col("ref_id") >= 0)))


@query("with" + PILE + "select cast(ref_id as bigint) as ref_id, pos, count(*) as depth, string_agg(shown, '' order by file_ord) as bases, string_agg(chr(cast(least(mapq, 93) + 33 as int)), '' order by file_ord) as quals from b group by 1, 2")
def pileup(spark, d):
    return long(piles.pileup(_reads(spark, d)))


@query("with" + PILE + "select cast(ref_id as bigint) as ref_id, pos, count(*) as depth, string_agg(shown, '' order by file_ord) as bases from b where mapq >= 20 and flag & 1024 = 0 group by 1, 2")
def pileup_predicate(spark, d):
    return long(piles.pileup(_reads(spark, d).where("mapq >= 20"), ~al.has(1024)).drop("quals"))


@query("with " + SEQS + """select doc_id, length(seq) - length(replace(seq,'A','')) as "A", length(seq) - length(replace(seq,'C','')) as "C", length(seq) - length(replace(seq,'G','')) as "G",
length(seq) - length(replace(seq,'T','')) as "T", length(seq) - length(replace(seq,'N','')) as n_count, length(seq) as total from seqs where true""".replace('as n_count', 'as "N"'))
def base_composition(spark, d):
    c = sequence.composition(F.col("seq"))
    # Spark's column names ignore case; these are unique either way.
    return long(sequences(spark, d).select("doc_id", *[v.alias(k) for k, v in c.items()]))


@query("with " + SEQS + "select doc_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as rc from seqs")
def reverse_complement(spark, d):
    return sequences(spark, d).select("doc_id", sequence.reverse_complement(F.col("seq")).alias("rc"))


@query("select l_orderkey, cast(case when q >= 40 then 40 when q >= 35 then 37 when q >= 30 then 33 when q >= 25 then 27 when q >= 20 then 22 when q >= 10 then 15 when q >= 2 then 6 when q >= 1 then 1 else 0 end as bigint) as bin, count(*) as n from (select l_orderkey, cast(round(l_quantity) as bigint) as q from lineitem) group by 1, 2")
def quality_bin(spark, d):
    q = F.round("l_quantity").cast("long")
    return long(table(spark, d, "lineitem").groupBy("l_orderkey", sequence.bin_quality(q).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


@query("select v as score, chr(cast(33 + floor(10 * log10(1 + pow(10.0, greatest(v, 0) / 10.0)) + 0.499) as int)) as q from (select unnest(generate_series(-40, 40)) as v)")
def logodds_phred(spark, d):
    return spark.range(-40, 41).select(F.col("id").alias("score"), sequence.logodds_phred(F.col("id")).alias("q"))


CIG = ALN + ", c as (select *, (span - 5) || 'M' || (l_linenumber) || 'I' || 3 || 'D' || 2 || 'N' || (l_linenumber + 1) || 'S' as cigar from aln)"


def _cigars(spark, d):
    s = lambda c: c.cast("string")
    n = F.col("l_linenumber")
    return records(spark, d).withColumn("cigar", F.concat(s(F.col("span") - 5), F.lit("M"), s(n), F.lit("I3D2N"), s(n + 1), F.lit("S")))


@query("with" + CIG + "select cigar, cast(span - 5 + 3 + 2 as bigint) as ref_span, cast(span - 5 + l_linenumber + l_linenumber + 1 as bigint) as query_span, count(*) as n from c group by 1, 2, 3")
def cigar_span(spark, d):
    ops = cigar.parse(F.col("cigar"))
    told = _cigars(spark, d).withColumn("ops", ops)
    return told.groupBy(cigar.render(F.col("ops")).alias("cigar"), cigar.reference_span(F.col("ops")).alias("ref_span"), cigar.query_span(F.col("ops")).alias("query_span")).agg(F.count(F.lit(1)).alias("n"))


@query("with" + ALN + """, b as (select pos * 99991 % 536000000 as s, pos * 99991 % 536000000 + span * 997 as e from aln)
select s, e, cast(case when s >> 14 = (e - 1) >> 14 then 4681 + (s >> 14) when s >> 17 = (e - 1) >> 17 then 585 + (s >> 17) when s >> 20 = (e - 1) >> 20 then 73 + (s >> 20)
 when s >> 23 = (e - 1) >> 23 then 9 + (s >> 23) when s >> 26 = (e - 1) >> 26 then 1 + (s >> 26) else 0 end as bigint) as bin from b""")
def reg2bin(spark, d):
    s = (F.col("pos") * 99991 % 536000000).cast("long")
    e = (s + F.col("span") * 997).cast("long")
    return records(spark, d).select(s.alias("s"), e.alias("e"), cigar.reg2bin(s, e).alias("bin"))


@query("with " + SEQS + "select doc_id, md5(seq) as md5 from seqs")
def md5_ref(spark, d):
    return sequences(spark, d).select("doc_id", F.md5(F.col("seq").cast("binary")).alias("md5"))


@query()
def crc_sum(spark, d):
    s = sequences(spark, d).withColumn("slice_id", F.floor(F.col("doc_id") / 100))
    return statistics.crc_sums(s, ["slice_id"], "seq")


@query("with " + SEQS + "select doc_id, substr(seq, l + 1, greatest(r - l - 1, 0)) as kept from (select doc_id, seq, cast(doc_id % 17 as bigint) as l, greatest(least(length(seq), 400 + doc_id % 50), doc_id % 17 + 1) as r from seqs)")
def quality_clip(spark, d):
    s = sequences(spark, d)
    left, right = sequence.cutoffs((F.col("doc_id") % 17).cast("int"), F.lit(0), F.length("seq"), (400 + F.col("doc_id") % 50).cast("int"))
    return s.select("doc_id", sequence.clip(F.col("seq"), left, right).alias("kept"))


@query("select l_orderkey, l_linenumber, count(*) as n, sum(greatest(a, b)) as lefts, sum(least(case when c = 0 then 101 else c end, case when d = 0 then 101 else d end)) as rights from (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey % 9 as a, l_suppkey % 7 as b, l_partkey % 60 as c, l_suppkey % 50 as d from lineitem) group by 1, 2")
def flow_clip(spark, d):
    k = F.col
    left, right = sequence.flow_clip(F.lit(100), k("l_partkey") % 9, k("l_suppkey") % 7, k("l_partkey") % 60, k("l_suppkey") % 50)
    return long(table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(left).alias("lefts"), F.sum(right).alias("rights")))


@query("with " + SEQS + "select doc_id, '@d' || doc_id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) as record from seqs")
def fastq_out(spark, d):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return sequences(spark, d).select("doc_id", sequence.fastq(name, F.col("seq"), F.repeat(F.lit("I"), F.length("seq"))).alias("record"))


@query("with " + SEQS + "select doc_id, '>d' || doc_id || chr(10) || trim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) as record from seqs")
def fasta_out(spark, d):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return sequences(spark, d).select("doc_id", sequence.fasta(name, sequence.wrap(F.col("seq"))).alias("record"))


# --- statistics -----------------------------------------------------------------------

BLOCKS = "blocks as (select cast(l_suppkey % 10 as bigint) - 1 as content_id, substr('rgbz', cast(1 + (l_partkey * 7 + l_linenumber) % 4 as int), 1) as method, cast(round(l_extendedprice) as bigint) as comp_size from lineitem)"


def _blocks(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        ((c("l_suppkey") % 10) - 1).cast("long").alias("content_id"), F.substring(F.lit("rgbz"), ((c("l_partkey") * 7 + c("l_linenumber")) % 4 + 1).cast("int"), F.lit(1)).alias("method"),
        F.round("l_extendedprice").cast("long").alias("comp_size"),
    )


@query("with " + BLOCKS + "select content_id, cast(sum(comp_size) as bigint) as bytes, count(*) as blocks from blocks group by 1")
def block_sizes(spark, d):
    return statistics.block_sizes(_blocks(spark, d))


@query("with " + BLOCKS + ", c as (select content_id, method, count(*) as n from blocks group by 1, 2), s as (select *, n / sum(n) over (partition by content_id) as x from c) select content_id, method, n, round(x, 6) as ratio, cast(case when x >= 0.5 then 2 when x >= 0.1 then 1 else 0 end as bigint) as mark from s")
def block_methods(spark, d):
    return long(statistics.block_methods(_blocks(spark, d)))


@query("with h as (select l_suppkey as value, count(*) as n from lineitem group by 1) select count(*) as nvals, min(value) as least, max(value) as greatest, cast(sum(n) as bigint) as total, case when count(*) = 1 then 'constant' else 'external' end as encoding from h")
def column_histogram(spark, d):
    return statistics.summary(statistics.histogram(table(spark, d, "lineitem"), "l_suppkey"))


@query("select value, n from (select l_partkey as value, cast(sum(case when l_linenumber % 2 = 0 then -1 else 1 end) as bigint) as n from lineitem group by 1) where n <> 0")
def histogram_retraction(spark, d):
    return statistics.histogram(table(spark, d, "lineitem"), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1))


@query("with " + SEQS + ", c as (select doc_id, unnest(string_split(seq, '')) as s from seqs where length(seq) > 0), n as (select doc_id, s, count(*) as n from c group by 1, 2) select doc_id, cast(sum(n) as bigint) as total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as bits from n group by 1")
def entropy(spark, d):
    s = sequences(spark, d).where("length(seq) > 0")
    return s.select("doc_id", F.length("seq").cast("long").alias("total"), statistics.text_entropy(F.col("seq")).alias("bits"))


@query("with h as (select l_shipdate as k, l_linenumber as s, count(*) as n from lineitem group by 1, 2) select k as ship, cast(sum(n) as bigint) as total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as bits from h group by 1")
def column_entropy(spark, d):
    return statistics.entropy(table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ship"), "l_linenumber"), ["ship"], "l_linenumber")


@query("with " + FLOWS + ", q as (select user_id, v // 1000 as b, lag(v // 1000) over (partition by user_id order by ts, event_id) as prev from flows) select b as value, cast(sum(case when b is not distinct from prev then 1 else -2 end) as bigint) as benefit, count(*) as n from q group by 1")
def rle_benefit(spark, d):
    return statistics.run_benefit(flows(spark, d).withColumn("b", F.expr("v div 1000")), "b", ["user_id"], ["ts", "event_id"])


@query("with " + FLOWS + "select user_id, arg_min(event_id, (ts, event_id)) as first_name, arg_max(event_id, (ts, event_id)) as last_name, count(*) as n from flows group by 1")
def first_last_per_header(spark, d):
    return statistics.first_last(flows(spark, d), ["user_id"], "event_id", ["ts", "event_id"])


# --- signal -------------------------------------------------------------------------------

def _delta_sql(expr: str) -> str:
    lags = ", ".join(f"coalesce(lag(v, {k}) over w, 0) as l{k}" for k in (1, 2, 3))
    return f"with {FLOWS}, l as (select event_id, v, {lags} from flows window w as (partition by user_id order by ts, event_id)) select event_id, cast((({expr}) % 65536 + 65536) % 65536 as bigint) as delta from l"


@query(_delta_sql("v - l1"))
def delta1(spark, d):
    return signal.deltas(flows(spark, d), "v", ["user_id"], ["ts", "event_id"], 1).select("event_id", "delta")


@query(_delta_sql("v - 2 * l1 + l2"))
def delta2(spark, d):
    return signal.deltas(flows(spark, d), "v", ["user_id"], ["ts", "event_id"], 2).select("event_id", "delta")


@query(_delta_sql("v - 3 * l1 + 3 * l2 - l3"))
def delta3(spark, d):
    return signal.deltas(flows(spark, d), "v", ["user_id"], ["ts", "event_id"], 3).select("event_id", "delta")


@query("with " + FLOWS + "select event_id, cast((v % 65536 + 65536) % 65536 as bigint) as v from flows")
def double_delta(spark, d):
    """Second differences and back again."""
    packed = signal.deltas(flows(spark, d), "v", ["user_id"], ["ts", "event_id"], 2)
    return signal.undo_deltas(packed.drop("v").withColumnRenamed("delta", "v"), "v", ["user_id"], ["ts", "event_id"], 2).select("event_id", "v")


@query("with " + FLOWS + "select event_id, min(v) over w as background, v - min(v) over w as corrected from flows window w as (partition by user_id order by ts, event_id rows between 250 preceding and 249 following)")
def sliding_min_background(spark, d):
    return signal.sliding_background(flows(spark, d), "v", ["user_id"], ["ts", "event_id"]).select("event_id", "background", "corrected")


@query("with " + FLOWS + ", n as (select user_id, v, (row_number() over (partition by user_id order by ts, event_id) - 1) // 2 as pair from flows) select user_id, pair, cast(sum(v) // 2 as bigint) as average from n group by 1, 2 having count(*) = 2")
def pair_average(spark, d):
    return signal.pair_average(flows(spark, d), "v", ["user_id"], ["ts", "event_id"])


@query("with " + FLOWS + ", m as (select *, max(v) over (partition by user_id) as top from flows) select event_id, cast(case when top > 255 then floor(v * 255.0::double / top + 0.5) else v end as bigint) as scaled from m")
def rescale(spark, d):
    return signal.rescale(flows(spark, d), "v", ["user_id"], 255).select("event_id", "scaled")


@query("with " + FLOWS + "select event_id, v - 5000 - least(min(v - 5000) over (partition by user_id), 0) as raised from flows")
def noneg(spark, d):
    return signal.no_negatives(flows(spark, d).withColumn("v", F.col("v") - 5000), "v", ["user_id"]).select("event_id", "raised")


@query("with " + FLOWS + ", m as (select *, max(case when event_type = 'click' then v end) over (partition by user_id) as top from flows) select event_id, least(v, coalesce(top, v)) as clipped from m")
def clip_called_max(spark, d):
    return signal.clip_at_called(flows(spark, d), "v", F.col("event_type") == "click", ["user_id"]).select("event_id", "clipped")


@query()
def attack_decay_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", signal.attack_decay(F.transform("embedding", lambda x: F.abs(F.round(x * 1000)))).alias("trace"))


@query("select vec_id, list_transform(generate_series(1, len(embedding) // 2), lambda i: cast(round(cast(embedding[i] as double) * 1000) as bigint) - least(cast(round(cast(embedding[i] as double) * 1000) as bigint), cast(round(cast(embedding[i + len(embedding) // 2] as double) * 1000) as bigint))) as a from embeddings")
def channel_background(spark, d):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    half = (F.size("v") / 2).cast("int")
    halves = table(spark, d, "embeddings").withColumn("v", v).select("vec_id", F.slice("v", F.lit(1), half).alias("x"), F.slice("v", half + 1, half).alias("y"))
    return halves.select("vec_id", signal.channel_background(F.col("x"), F.col("y"))[0].alias("a"))


RANGE = """ids as (select distinct user_id, event_id from events),
g as (select user_id % 20 as k, event_id, event_id - row_number() over (partition by user_id % 20 order by event_id) as g from (select distinct user_id % 20 as user_id, event_id from ids)),
r as (select k, min(event_id) as a, max(event_id) as b from g group by k, g)"""


def _ids(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("k"), "event_id")


@query("with " + RANGE + "select k, string_agg(case when a = b then '' || a else a || '..' || b end, ' ' order by a) as ranges from r group by k")
def range_string(spark, d):
    return signal.range_strings(_ids(spark, d), "event_id", ["k"])


@query("select distinct user_id % 20 as k, event_id as value from events")
def range_expand(spark, d):
    return signal.expand_ranges(signal.range_strings(_ids(spark, d), "event_id", ["k"]), "ranges", ["k"])


@query("with " + FLOWS + ", s as (select event_id, v, max(v) over (partition by user_id) as top, sum(v) over (partition by user_id order by ts, event_id rows between 1 following and 1000 following) as t from flows) select event_id, cast(case when t > 0 then least(65535, floor(v * 1000.0::double * top / t)) else v end as bigint) as normal from s")
def window_normalise(spark, d):
    return signal.window_normalise(flows(spark, d), "v", ["user_id"], ["ts", "event_id"]).select("event_id", "normal")


# --- header, joins, archives ---------------------------------------------------------------

@query("with " + PROGRAMS + "select id, prev_id from programs p where not exists (select 1 from programs q where q.prev_id = p.id)")
def pg_chain_leaves(spark, d):
    return lookups.chain_leaves(programs(spark, d)).select("id", "prev_id")


@query("with " + PROGRAMS + ", l as (select id, row_number() over (order by id) - 1 as k from programs p where not exists (select 1 from programs q where q.prev_id = p.id)) select id, prev_id from programs union all select case when k = 0 then 'conv' else 'conv.' || k end, id from l")
def pg_add(spark, d):
    return lookups.add_program(programs(spark, d), "conv")


@query("""with r as (select s_suppkey, case when s_suppkey % 9 = 0 then 'zz' || (s_suppkey % 5) else n_name end as rname from supplier join nation on s_nationkey = n_nationkey),
miss as (select rname, row_number() over (order by rname) + (select max(n_nationkey) from nation) as id from (select distinct rname from r where rname not in (select n_name from nation)))
select s_suppkey, r.rname, cast(coalesce(n_nationkey, miss.id) as bigint) as ref_id from r left join nation on r.rname = n_name left join miss on miss.rname = r.rname""")
def name_lookup_left(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, d, "supplier").join(n, "s_nationkey").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("zz"), (F.col("s_suppkey") % 5).cast("string"))).otherwise(F.col("n_name")).alias("rname")
    )
    return lookups.name_lookup(rows, header(spark, d)).select("s_suppkey", "rname", F.col("ref_id").cast("long").alias("ref_id"))


@query("with " + FLOWS + ", h as (select user_id, ts, event_id as hdr from flows where event_type = 'click') select f.event_id, h.hdr from flows f asof left join h on f.user_id = h.user_id and f.ts >= h.ts where f.event_type <> 'click'")
def asof_header(spark, d):
    f = flows(spark, d)
    heads = f.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("hdr"))
    return lookups.as_of(f.where("event_type <> 'click'"), heads, ["user_id"], ["ts"], "hdr").select("event_id", "hdr")


@query("select url as name, cast(length(html) as bigint) as size, cast(coalesce(sum(length(html)) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as position from pages")
def archive_index(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("name"), "page_id", "html")
    return lookups.archive_index(p, F.length("html"), "page_id").select("name", "size", "position")


@query("select url as name, cast(length(html) as bigint) as size from pages where url in (select url from pages where page_id % 10 = 3)")
def archive_extract(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("name"), "page_id", F.length("html").cast("long").alias("size"))
    return lookups.archive_find(p, p.where("page_id % 10 = 3")).select("name", "size")


@query("select count(*) = 0 as compatible from nation where n_nationkey < 0")
def header_compatible(spark, d):
    # As a control, a header of other lengths and one of fewer lines must differ.
    h, yes = header(spark, d), F.col("compatible")
    same = lookups.same_headers(h, h)
    for other in (h.withColumn("len", F.col("len") + 1), h.where("id > 0")):
        same = same.crossJoin(lookups.same_headers(h, other).select((~yes).alias("differs"))).select((yes & F.col("differs")).alias("compatible"))
    return same


@query("select distinct c_mktsegment as name from customer")
def distinct_names(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).dropDuplicates(["name"])


@query("select 0 as archive, event_id from events where event_id % 2 = 0 union all select 1, event_id from events where event_id % 2 = 1")
def append_archives(spark, d):
    e = table(spark, d, "events").select("event_id")
    return e.where("event_id % 2 = 0").select(F.lit(0).alias("archive"), "event_id").unionByName(e.where("event_id % 2 = 1").select(F.lit(1).alias("archive"), "event_id"))


RENDER = ALN + """, s as (select file_ord, concat_ws(chr(9), qname, flag, 'ref' || ref_id, pos + 1, mapq, span || 'M', case when mate_ref_id = ref_id then '=' else 'ref' || mate_ref_id end, 1, 0, '*', '*', 'NM:i:' || l_linenumber) as line from aln)"""


def _lines(spark, d):
    s = lambda c: c.cast("string")
    from basestream.sources.sam import render_line

    a = alignments(spark, d)
    rec = a.select(
        "file_ord", "qname", "flag", F.concat(F.lit("ref"), s(F.col("ref_id"))).alias("rname"), "pos", "mapq", F.concat(s(F.col("span")), F.lit("M")).alias("cigar"),
        F.concat(F.lit("ref"), s(F.col("mate_ref_id"))).alias("rnext"), F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.lit(None).cast("string").alias("seq"), F.lit(None).cast("string").alias("qual"), F.array(F.concat(F.lit("NM:i:"), s(F.col("l_linenumber")))).alias("tags"),
    )
    return rec.select("file_ord", render_line(rec).alias("line"))


@query("with" + RENDER + "select file_ord, line from s")
def sam_render(spark, d):
    return _lines(spark, d)


@query("with" + ALN + "select qname, cast(flag as bigint) as flag, 'ref' || ref_id as rname, pos, cast(mapq as bigint) as mapq, span || 'M' as cigar, 'ref' || mate_ref_id as rnext, cast(span as bigint) as ref_span, 'NM:i:' || l_linenumber as tag from aln")
def sam_parse(spark, d):
    from basestream.sources.sam import parse_lines

    got = parse_lines(_lines(spark, d).select(F.col("line").alias("value")))
    return long(got.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", cigar.reference_span(cigar.parse(F.col("cigar"))).alias("ref_span"), F.element_at("tags", 1).alias("tag")))


# --- trace arrays ---------------------------------------------------------------------------

TRACE = "tr as (select vec_id, list_transform(embedding, lambda x: cast(round(cast(x as double) * 1000) as bigint)) as v from embeddings)"


def _traces(spark, d):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v"))


@query("with " + TRACE + "select vec_id, v[6:21] as clipped from tr")
def trace_clip(spark, d):
    return _traces(spark, d).select("vec_id", trace.clip_samples(F.col("v"), F.lit(5), F.lit(20)).alias("clipped"))


@query("with " + TRACE + "select vec_id, list_transform(generate_series(0, len(v) // 2 - 1), lambda i: cast(floor((v[2 * i + 1] + v[2 * i + 2]) / 2.0) as bigint)) as means from tr")
def trace_pair_means(spark, d):
    return _traces(spark, d).select("vec_id", trace.pair_means(F.col("v")).alias("means"))


@query("with " + TRACE + ", s as (select vec_id, list_sort(list_filter(v, lambda x: x <> 0)) as s from tr) select vec_id, coalesce(s[cast(floor(len(s) * 0.05::double) as int) + 1], 0) as level from s")
def trace_background_level(spark, d):
    return _traces(spark, d).select("vec_id", trace.background_level(F.col("v")).alias("level"))


@query("with " + TRACE + "select vec_id, list_max(v) as top, list_transform(v, lambda x: case when list_max(v) > 255 then cast(floor(x * 255.0::double / list_max(v)) as bigint) else x end) as scaled from tr")
def trace_downscale(spark, d):
    t = _traces(spark, d).withColumn("top", F.array_max("v"))
    return t.select("vec_id", "top", trace.downscale(F.col("v"), F.col("top")).alias("scaled"))


@query("with a as (select l_orderkey, l_linenumber, l_partkey, substr('ACGTRYN', cast(1 + l_partkey % 7 as int), 1) as b, l_partkey % 50 as a, l_suppkey % 50 as c, l_linenumber * 5 as g, l_orderkey % 40 as t from lineitem) select b as base, count(*) as n, cast(sum(case b when 'A' then a when 'C' then c when 'G' then g when 'T' then t when 'R' then (a + g) // 2 when 'Y' then (c + t) // 2 else 0 end) as bigint) as total from a group by 1")
def called_confidence(spark, d):
    c = F.col
    b = F.substring(F.lit("ACGTRYN"), (c("l_partkey") % 7 + 1).cast("int"), F.lit(1))
    conf = trace.called_confidence(b, c("l_partkey") % 50, c("l_suppkey") % 50, c("l_linenumber") * 5, c("l_orderkey") % 40)
    return table(spark, d, "lineitem").groupBy(b.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("total"))


@query("select event_id, split_part(props, ':', 1) as head, length(props) as n from events")
def comment_fields(spark, d):
    # A comment's value ends with its line, so line feeds are kept as a mark of their own.
    field = trace.comments(F.concat(F.lit("props="), F.replace("props", F.lit("\n"), F.lit("\u0001"))))["props"]
    e = table(spark, d, "events").select("event_id", F.replace(field, F.lit("\u0001"), F.lit("\n")).alias("props"))
    return e.select("event_id", F.substring_index("props", ":", 1).alias("head"), F.length("props").cast("long").alias("n"))
