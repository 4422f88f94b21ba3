"""Serial numbers, reconciliation by buckets, mergeable distinct counts and grouping sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from merchantry.operators import aggregate, distinct, netting, sync
from merchantry.plans import statements

KEYS = ["p", "q"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs(spark, rows):
    return spark.createDataFrame(rows, "p int, q string")


def test_serials_have_no_gap_over_partitions_and_runs(spark):
    rng = random.Random(1)
    source = [(p, f"q{q}") for p in range(90) for q in range(5)]
    rng.shuffle(source)
    known, rest = source[:200], source[200:]
    first = sync.serial_key(pairs(spark, known).repartition(7), KEYS)
    assert [(r.p, r.q) for r in sorted(first.collect(), key=lambda r: r.serial)] == sorted(known)
    both = sync.with_continued_serials(pairs(spark, source).repartition(5), first, KEYS)
    got = {(r.p, r.q): r.serial for r in both.collect()}
    assert sorted(got.values()) == list(range(1, 451))
    assert [got[k] for k in sorted(known)] == list(range(1, 201))
    assert [got[k] for k in sorted(rest)] == list(range(201, 451))
    assert "Window" not in plan_of(both)


def test_serials_of_empty_tables(spark):
    none = pairs(spark, [])
    assert sync.serial_key(none, KEYS).collect() == []
    numbered = sync.with_continued_serials(pairs(spark, [(1, "a")]), sync.serial_key(none, KEYS), KEYS)
    assert [tuple(r) for r in numbered.select(*KEYS, "serial").collect()] == [(1, "a", 1)]


def test_only_unequal_buckets_are_compared(spark):
    source = spark.range(50_000).select(F.col("id").cast("int").alias("p"), F.concat(F.lit("q"), F.col("id") % 7).alias("q"))
    late = [17, 4_711, 49_999]
    target = source.filter(~F.col("p").isin(late))
    sizes = (256, 65_536)
    same, _ = sync.unequal_buckets(source, source.orderBy(F.desc("p")), KEYS, sizes)
    assert same.isEmpty()
    buckets, size = sync.unequal_buckets(source, target, KEYS, sizes)
    assert size == 65_536 and 1 <= buckets.count() <= 3
    # Of 50,000 keys only the neighbours of the late ones in their fine buckets travel.
    assert sync._in_buckets(source, KEYS, buckets, size).count() < 20
    assert sorted(r.p for r in sync.reconciled_missing(source, target, KEYS, sizes).collect()) == late


def test_reconciliation_equals_the_anti_join(spark):
    rng = random.Random(4)
    row = lambda: (rng.choice([None, *range(40)]), rng.choice([None, "a", "b", "c"]))
    for _ in range(3):
        source, target = pairs(spark, [row() for _ in range(150)]), pairs(spark, [row() for _ in range(110)])
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(sync.reconciled_missing(source, target, KEYS, (4, 16))) == rows(sync.missing_rows(source, target, KEYS))
    none = pairs(spark, [])
    assert sync.reconciled_missing(none, source, KEYS).collect() == []
    assert rows(sync.reconciled_missing(source, none, KEYS)) == rows(source)


def facts(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice([2000, 2001]), rng.randrange(1, 5), rng.choice([None, *range(60)]),
             f"i{rng.randrange(15)}") for _ in range(700)]
    return spark.createDataFrame(rows, "zid int, year int, month int, cusid int, itemcode string"), rows


def test_totals_from_month_bitmaps_equal_a_direct_count(spark):
    df, rows = facts(spark)
    bitmaps = distinct.month_bitmaps(df, {"customers": "cusid", "products": "itemcode"})
    got = {(r.zid, r.year, r.month, r.figure): r.n for r in distinct.distinct_rollup(bitmaps).collect()}
    want = {}
    for zid, year, month, customer, item in rows:
        for figure, value in (("customers", customer), ("products", item)):
            for period in ((year, month), (year, None), (None, None)):
                if value is not None:
                    want.setdefault((zid, *period, figure), set()).add(value)
    assert got == {k: len(v) for k, v in want.items()}


def test_bitmaps_over_several_buckets(spark):
    df = spark.range(100_000).selectExpr("1 as zid", "2000 as year", "int(id % 2) + 1 as month", "id % 70000 as v")
    rollup = distinct.distinct_rollup(distinct.month_bitmaps(df, {"v": "v"}))
    got = {(r.year, r.month): r.n for r in rollup.collect()}
    assert got == {(2000, 1): 35_000, (2000, 2): 35_000, (2000, None): 70_000, (None, None): 70_000}


def test_distinct_counts_multiply_no_row(spark):
    df, _ = facts(spark)
    figures = {"customers": "cusid", "products": "itemcode"}
    assert "Expand" not in plan_of(aggregate.distinct_by_period(df, figures))
    assert "Expand" not in plan_of(distinct.month_bitmaps(df, figures))


def sides(spark):
    rng = random.Random(6)
    def rows(n):
        out = []
        for _ in range(n):
            s, c, i = rng.choice([None, "s1", "s2"]), rng.choice(["c1", "c2", "c3"]), rng.choice(["i1", "i2", None])
            out.append((rng.choice([1, 2]), s, s and f"name {s}", rng.choice([None, "north", "south"]), c, f"name {c}",
                        i, i and f"name {i}", rng.choice(["g1", "g2"]), float(rng.randrange(100))))
        return out
    columns = "zid int, spid string, spname string, area string, cusid string, cusname string, itemcode string, " \
              "itemname string, itemgroup string, "
    return (spark.createDataFrame(rows(120), columns + "totalsales double"),
            spark.createDataFrame(rows(40), columns + "treturnamt double"))


def test_all_cross_relations_equal_the_single_reports(spark):
    sales, returns = sides(spark)
    together = netting.cross_relations(sales, returns)
    got = sorted(tuple(r) for r in together.collect())
    want = []
    for a in netting.DIMENSIONS:
        for b in netting.DIMENSIONS:
            if a != b:
                rows, columns = netting.DIMENSIONS[a], netting.DIMENSIONS[b]
                for r in netting.cross_relation(sales, returns, a, b).collect():
                    want.append((r.zid, a, b, r[rows[0]], r[rows[-1]], r[columns[0]], r[columns[-1]], r.net, r.grand_total))
    assert got == sorted(want) and len({w[1:3] for w in want}) == 20


def test_cross_relations_exchange_their_cells_once(spark):
    sales, returns = sides(spark)
    plan = plan_of(netting.cross_relations(sales, returns))
    assert "Expand" not in plan and "Join" not in plan
    # One aggregate for the cells of each of the ten pairs, none for their totals.
    assert plan.count("Aggregate [") == 10


def test_all_levels_equal_the_single_levels(spark):
    rows = [(1, p, f"a{n % 6}", f"name {n % 6}", "x", f"l{n % 3}", None if n % 4 == 0 else "m", "k", f"line {n % 2}", y, float(n))
            for n, (p, y) in enumerate((p, y) for p in ("P", "Q") for y in ("2000", "2001") for _ in range(8))]
    frame = spark.createDataFrame(
        rows, "zid int, project string, ac_code string, ac_name string, ac_lv1 string, ac_lv2 string, ac_lv3 string, "
              "ac_lv4 string, line string, period string, value double")
    got = sorted(map(repr, (tuple(r) for r in statements.statement_levels(frame).collect())))
    want = []
    for level, columns in statements.LEVELS.items():
        for r in statements.statement_at_level(frame, level).collect():
            want.append(repr((r.zid, r.project, r.period, level, r[columns[0]], r[columns[-1]], r.value)))
    assert got == sorted(want)
