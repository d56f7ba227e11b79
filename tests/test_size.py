"""What a task holds and what is shuffled, on tables too small to need it."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basestream.operators import alignments as al
from basestream.operators import ordering


@pytest.fixture
def many_parts(monkeypatch):
    """A partition for each 2 KB of the sources, so that small tables have many."""
    own = ordering.parts_for
    few = lambda df: min(40, own(df, 1) * 10)
    monkeypatch.setattr(ordering, "parts_for", few)
    monkeypatch.setattr(al, "parts_for", few)


def written(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def reads(spark, n: int, plain: bool = False):
    rnd = random.Random(5)
    rows = []
    for k in range(n):
        ops = [(rnd.randint(1, 40), rnd.choice("M=X"))]
        while not plain and rnd.random() < 0.5:
            ops += [(rnd.randint(1, 4), rnd.choice("IDNP")), (rnd.randint(1, 30), "M")]
        size = sum(a for a, o in ops if o in "MIS=X") - rnd.choice([0, 0, 0, 3])
        seq = "".join(rnd.choice("ACGTacgtN.R") for _ in range(max(1, size)))
        qual = rnd.choice(["*", "".join(chr(rnd.randint(33, 126)) for _ in seq)])
        clip = rnd.choice(["", "", "2S", "1H1S"])
        rows.append((rnd.choice([0, 0, 1]), rnd.randint(0, 1500) if k % 50 else 700, k, rnd.choice([0, 16, 1024]), rnd.randint(0, 120), clip + "".join(f"{a}{o}" for a, o in ops), rnd.choice([seq, seq, "*"]), qual))
    return spark.createDataFrame(rows, "ref_id int, pos long, file_ord long, flag int, mapq int, cigar string, seq string, qual string")


def same(a, b):
    rows = [sorted(map(tuple, x.collect())) for x in (a.select(*b.columns), b)]
    assert rows[0] == rows[1]
    return rows[0]


@pytest.mark.parametrize("plain", [True, False])
def test_pileup_of_reads(spark, plain):
    from basestream.operators import piles

    r = reads(spark, 400, plain).repartition(3).localCheckpoint()
    kept = ~al.has(1024)
    want = al.pileup(al.read_bases(r), kept).localCheckpoint(), al.pileup_columns(al.read_bases(r), kept).localCheckpoint()
    # Bands laid out at once, and in pieces of few positions and few rows.
    for sizes in ({}, {"entries": 50, "rows": 20}):
        assert len(same(piles.pileup(r, kept, **sizes), want[0])) > 1000
        same(piles.pileup_columns(r, kept, **sizes), want[1])
    assert piles.pileup(r.where("false")).count() == 0


def test_pileup_shuffles_reads(spark):
    from basestream.plans import catalogue, further

    for name, module in (("pileup", catalogue), ("pileup_predicate", catalogue), ("pileup_gap5", further)):
        before = written(spark)
        n = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").agg(F.sum("depth")).first()[0]
        records = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        # Once to number them, once to their bands; a row a base would be n.
        assert written(spark) - before < 2.5 * records and n > records


def test_position_delta_spreads_a_reference(spark, many_parts):
    df = spark.range(1, 3001).select(F.col("id").alias("file_ord"), F.when(F.col("id") % 100 < 97, 0).when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.col("id") % 7).cast("int").alias("ref_id"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("pos"))
    w = Window.partitionBy("ref_id").orderBy("file_ord")
    want = df.withColumn("ap", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0)))
    got = al.position_delta(df, 100)
    same(got, want)
    assert got.where("ref_id = 0").select(F.spark_partition_id()).distinct().count() > 4


def test_runs_are_dealt_by_size(spark, many_parts):
    df = spark.range(1, 3001).select(F.col("id").alias("file_ord"), (F.col("id") * 7919 % 5 % 2).cast("int").alias("ref_id"), F.col("id").alias("pos"), F.lit(3).alias("span"))
    runs = al.ref_runs(df, 100)
    got = al.run_extent(runs)
    assert runs.select(F.spark_partition_id()).distinct().count() > 4 and got.select(F.spark_partition_id()).distinct().count() > 4
    w = Window.orderBy("file_ord")
    starts = df.withColumn("s", F.when(F.lag("ref_id").over(w).eqNullSafe(F.col("ref_id")), None).otherwise(F.col("file_ord"))).withColumn("run_start", F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same(got, starts.groupBy("run_start").agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), (F.max("pos") + 2).alias("last_pos")))


def test_depth_counts_in_bands(spark, many_parts):
    df = spark.range(3000).select(F.lit(0).cast("int").alias("ref_id"), (F.col("id") * 7919 % 9000).alias("pos"), (F.col("id") % 1500 + 1).cast("int").alias("span"), F.lit(0).alias("flag"))
    got = al.depth_explode(df)
    same(got, al.depth_sweep(df))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # No count of positions runs where the input's order alone says which a task meets.
    assert plan.rindex("Generate explode(sequence(greatest") < plan.rindex("REPARTITION_BY_NUM")


def test_parts_follow_the_sources(spark, tmp_path):
    spark.range(300_000).selectExpr("id", "sha2(cast(id as string), 256) as t").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert ordering.parts_for(df) == 4 and ordering.parts_for(df, 1) > 15
    numbered = ordering.number_rows(df, [F.col("t")], keep=["id"])
    assert numbered.columns == ["id", "file_ord"] and numbered.agg(F.min("file_ord"), F.max("file_ord"), F.count_distinct("file_ord")).first()[:] == (1, 300_000, 300_000)
