"""Every plain query gives the rows of its SQL."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import pattern as P
from pagemill.operators import layers as L
from pagemill.operators import relational as R
from pagemill.plans import queries, word_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", [*queries.QUERIES, *word_queries.QUERIES])
def test_query_equals_its_sql(spark, duck, name):
    every, sql = queries.QUERIES | word_queries.QUERIES, queries.ORACLE_SQL | word_queries.ORACLE_SQL
    got, want = every[name](spark, SF).toPandas(), duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize(("text", "pattern", "want"), [
    ("图1-1所示", r"图1-1\b", False), ("图1-1 所示", r"图1-1\b", True), ("a　b", r"a\sb", True), ("１２", r"\d+", True), ("宽3.2kg", r"(?<!\w)(\d+(?:\.\d+)?)kg", True), ("a\nb", "a$", False),
])
def test_patterns_are_unicode(spark, text, pattern, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.found(F.col("t"), pattern)).first()[0] is want


def test_tints_and_shades(spark):
    row = spark.range(1).select(L.tinted(F.lit("336699"), F.lit("80"), F.lit(None)).alias("t"), L.tinted(F.lit("336699"), F.lit(None), F.lit("80")).alias("s"), L.tinted(F.lit("ff00aa"), F.lit(None), F.lit(None)).alias("n")).first()
    assert tuple(row) == ("99B3CC", "1A334D", "FF00AA")


def test_nulls_are_unresolved_not_wrong(spark):
    check = R.graded(R.tolerance(F.col("a"), F.lit(10), 1), "ERROR")
    got = [r[0] for r in spark.createDataFrame([(10.5,), (12.0,), (None,)], "a double").select(check).collect()]
    assert got == ["PASS", "ERROR", "MANUAL_REVIEW"]


def test_chain_stops_at_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", None)], "d int, id string, up string")
    assert sorted(tuple(r) for r in L.chains(edges, ["d"], "id", "up").collect()) == [(1, "a", "a", 0), (1, "a", "b", 1), (1, "b", "a", 1), (1, "b", "b", 0), (2, "a", "a", 0)]


@pytest.mark.parametrize("circle", [False, True])
def test_chains_of_many_links(spark, circle):
    n = 130
    rows = spark.range(n * 20).select((F.col("id") / n).cast("int").alias("d"), (F.col("id") % n).alias("node"))
    rows = rows.withColumn("up", F.when(F.col("node") > 0, F.col("node") - 1).otherwise(n - 1 if circle else None))
    got = {(r.d, r.root): (r.n, r.m) for r in L.chains(rows, ["d"], "node", "up").groupBy("d", "root").agg(F.count("*").alias("n"), F.max("depth").alias("m")).collect()}
    assert got == {(d, i): (n, n - 1) if circle else (i + 1, i) for d in range(20) for i in range(n)}


def test_chains_of_two_million_rows(spark):
    rows = spark.range(2_000_000).select((F.col("id") / 4).cast("long").alias("d"), (F.col("id") % 4).alias("node")).withColumn("up", F.when(F.col("node") > 0, F.col("node") - 1))
    assert tuple(L.chains(rows, ["d"], "node", "up").agg(F.count("*"), F.sum("depth"), F.max("depth")).first()) == (5_000_000, 5_000_000, 3)


def test_chains_with_odd_rows(spark):
    rows = [(None, "a", "b"), (None, "b", None), (1, "a", "a"), (1, None, "a"), (1, "b", "x"), (1, "c", "b"), (1, "c", "a"), (1, "b", "x")]
    got = L.chains(spark.createDataFrame(rows, "d int, id string, up string"), ["d"], "id", "up").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "a", "a", 0), (None, "a", "b", 1), (None, "b", "b", 0), (1, "a", "a", 0), (1, "b", "b", 0), (1, "c", "c", 0), (1, "c", "b", 1)], key=repr)
    assert L.chains(spark.createDataFrame([], "d int, id string, up string"), ["d"], "id", "up").count() == 0


def test_brackets_against_a_stack(spark):
    import random

    from pagemill.operators import nesting as N

    rng = random.Random(2)
    rows = [(d, i, rng.choice("((x))y")) for d in range(60) for i in range(rng.randint(0, 40))]
    df = spark.createDataFrame(rows, "d int, i int, c string")
    spans, inner, outer = set(), set(), set()
    for d in range(60):
        open_ = []
        for _, i, c in (r for r in rows if r[0] == d):
            if c == "(":
                open_.append(i)
            elif c == ")":
                if open_:
                    spans.add((d, open_.pop(), i, len(open_) + 1))
            elif open_:
                inner.add((d, i, open_[-1], len(open_)))
                outer |= {(d, i, b, k + 1) for k, b in enumerate(open_)}
        spans |= {(d, b, None, k + 1) for k, b in enumerate(open_)}
    opens, closes = F.col("c") == "(", F.col("c") == ")"
    assert {tuple(r) for r in N.spans(df, ["d"], "i", opens, closes).collect()} == spans
    for every, want in ((False, inner), (True, outer)):
        got = N.contents(df, ["d"], "i", opens, closes, every).select("d", "i", "begin", "level").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_required_names_are_a_short_list(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "a")], "k int, n string")
    names = spark.createDataFrame([("a",), ("c",), (None,), ("a",)], "n string")
    assert sorted(map(tuple, R.missing_required(rows, rows, names, "k", "n").collect()), key=repr) == sorted([(1, "c"), (2, "a"), (2, "c"), (None, "a"), (None, "c")], key=repr)
    assert R.missing_required(rows, rows, names.limit(0), "k", "n").count() == 0
    monkeypatch.setattr(R, "MOST_REQUIRED", 1)
    with pytest.raises(ValueError, match="over 1"):
        R.missing_required(rows, rows, names, "k", "n")
