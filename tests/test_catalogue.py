"""Every query with SQL against DuckDB, agreement of variants, and round trips of sources and sinks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import catalogue, sources, streaming
from sparkloom.operators import degree, edges, helpers, knn, triangles
from sparkloom.plans import kmeans, pagerank, paths
from sparkloom.sources import sinks

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if n not in ("pagerank_mass", "eccentricity")])
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    own = sorted(([r[c] for c in cols] for r in df.collect()), key=repr)
    got = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert own == sorted(([r[names.index(c)] for c in cols] for r in got.fetchall()), key=repr)


def test_edge_cases(spark):
    none = spark.createDataFrame([], sources.EDGE)
    assert triangles.triangles(none).first()[0] == 0
    assert degree.follower_count(none).count() == 0
    loop = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], sources.EDGE)
    assert triangles.triangles(loop).first()[0] == 0  # two of three rotations, over 3
    twice = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1)], sources.EDGE)
    assert triangles.triangles(twice).first()[0] == 2
    assert triangles.triangles(twice, distinct=True).first()[0] == 1
    nulls = spark.createDataFrame([(1, None), (2, None), (3, 4)], sources.EDGE)
    assert {tuple(r) for r in degree.follower_count(nulls).collect()} == {(None, 2), (4, 1)}
    assert edges.max_filter(nulls, 10).count() == 1


def test_iterations(spark):
    ranks = pagerank.pagerank(sources.chain_graph(spark, 1), sources.chain_ranks(spark, 1), 1, 2)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert [r["mass"] for r in pagerank.masses(sources.chain_graph(spark, 3), sources.chain_ranks(spark, 3), 9, 2).collect()] == pytest.approx([1, 1])
    graph = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (7, 8)], "src long, dst long")
    assert {tuple(r) for r in paths.shortest_paths(graph, 0).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert paths.eccentricity(graph, 8).count() == 0
    few = spark.createDataFrame([(1,), (1,), (9,)], "n long")
    assert kmeans.kmeans(few, kmeans.good_start(1, 9, 4))[0] == [1.0, 9.0]


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,2\n3,4\n")
    (tmp_path / "kv.txt").write_text("1,2,3\nx\n")
    assert {tuple(r) for r in sources.edge_file(spark, str(tmp_path / "e.csv")).collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in sources.edge_file(spark, str(tmp_path / "e.csv"), infer=True).collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in sources.key_value_lines(spark, str(tmp_path / "kv.txt")).collect()} == {("1", "2,3"), ("x", "")}
    df = sources.edge_file(spark, str(tmp_path / "e.csv"))
    sinks.tuple_text(df, str(tmp_path / "t"))
    assert {r[0] for r in sources.text_lines(spark, str(tmp_path / "t"), 2).collect()} == {"(1,2)", "(3,4)"}
    sinks.delimited(df, str(tmp_path / "d"), "\t", one_file=True)
    assert {tuple(r) for r in sources.key_value_lines(spark, str(tmp_path / "d"), "\t").collect()} == {("1", "2"), ("3", "4")}
    assert "Scan" in sinks.plan(df) or "Relation" in sinks.plan(df)


def test_row_ids(spark):
    df = spark.createDataFrame([(5,), (1,), (3,), (9,)], "k long")
    assert sorted(tuple(r) for r in helpers.row_ids(df, "k").collect()) == [(1, 10001), (3, 10002), (5, 10003), (9, 10004)]


def test_ml_floors(spark):
    """Above what one answer for all rows would reach."""
    usual = sources.transactions(spark, DIR).agg(F.avg("isFraud")).first()[0]
    rows = {r["model"]: r for r in catalogue._scored(spark, DIR, "random_forest", "gbt", "decision_tree").collect()}
    assert rows.keys() == {"random_forest", "gbt", "decision_tree"}
    for r in rows.values():
        assert r["auc"] > 0.9 and r["accuracy"] > 1 - usual / 2
    again = catalogue.QUERIES["ml_decision_tree"](spark, DIR).first()
    assert again["accuracy"] > 1 - usual / 2
    text = [r["text"] for r in catalogue.QUERIES["ml_tree_rules"](spark, DIR).orderBy("line").collect()]
    assert "depth" in text[0] and any("feature 2" in x for x in text) and any("Predict" in x for x in text)


def test_random_splits(spark):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    for a, b, share in ((*helpers.random_split(rows), 0.8), (*helpers.stratified_split(rows, "label"), 0.7)):
        first, second = ({r["id"] for r in x.collect()} for x in (a, b))
        assert not first & second and len(first | second) == 4000 and abs(len(first) / 4000 - share) < 0.03
    assert abs(a.filter("label = 1").count() / 400 - 0.7) < 0.1


def test_headed_files_and_transactions(spark, tmp_path):
    names = [f.name for f in sources.TRANSACTION]
    row = ["1", "PAYMENT", "9839.64", "C12", "170136.0", "160296.36", "M19", "0.0", "0.0", "0", "0"]
    (tmp_path / "h.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n")
    (tmp_path / "n.csv").write_text(",".join(row) + "\n")
    headed = sources.headed_file(spark, str(tmp_path / "h.csv"))
    assert headed.columns == names and dict(headed.dtypes)["amount"] == "double" and headed.first()["type"] == "PAYMENT"
    for path, header in (("h.csv", True), ("n.csv", False)):
        got = sources.transaction_file(spark, str(tmp_path / path), header)
        assert got.schema == sources.TRANSACTION and [str(x) for x in got.first()] == row
    (tmp_path / "bad.csv").write_text("x,y\n")
    with pytest.raises(Exception):
        sources.edge_file(spark, str(tmp_path / "bad.csv")).collect()


def test_sinks_replace_and_preview(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = lambda: {r[0] for r in sources.text_lines(spark, out).collect()}
    sinks.tuple_text(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), out, "[", "]")
    assert lines() == {"[1,null]", "[2,x]"}
    sinks.tuple_text(spark.createDataFrame([(7, 0.5)], "a long, b double"), out)
    assert lines() == {"(7,0.5)"}
    sinks.delimited(spark.createDataFrame([(3, 4)], "a long, b long"), out, one_file=True)
    assert lines() == {"3,4"}
    assert sinks.preview(spark.range(100), 7).count() == 7 and sinks.preview(spark.range(3)).count() == 3


def test_filter_on_a_renamed_column(spark):
    """A filter may still name a column that was renamed away, as long as it follows the renaming at once."""
    rows = spark.createDataFrame([(1, 2), (5, 6), (9, 1)], sources.EDGE)
    renamed = rows.withColumnRenamed("follower", "F").withColumnRenamed("user", "T")
    assert [tuple(r) for r in renamed.filter(F.col("F") < 6).orderBy("F").collect()] == [(1, 2), (5, 6)]
    by_old = rows.select(F.col("follower").alias("F"), F.col("user").alias("T")).filter(rows["follower"] < 6)
    assert sorted(tuple(r) for r in by_old.collect()) == [(1, 2), (5, 6)]


def test_no_nested_loop_in_nearest_cells(spark, monkeypatch):
    """The pairs of nearest neighbours come from equality joins, and amounts as equal as can be make no large group."""
    plans, cut = [], knn.cut
    monkeypatch.setattr(knn, "cut", lambda df: plans.append(sinks.plan(df, "simple")) or cut(df))
    schema = "txn_id long, type string, amount double, nameOrig string, isFraud int"
    train = [(i, "PAYMENT" if i % 3 else "DEBIT", 50.0 if i % 2 else i * 7.25, f"C{i % 9}", i % 5 == 0) for i in range(1, 400)] + [(998, "DEBIT", None, "C1", 1), (999, "DEBIT", float("nan"), "C1", 1)]
    test = [(1000 + i, "PAYMENT" if i % 2 else "CASH_IN", float(x), f"C{i}", 0) for i, x in enumerate([50, 51, 0, -1e9, 1e9, 1450.5, 49.5, 700])] + [(2000, "DEBIT", None, "C1", 0)]
    train, test = ([(*r[:4], int(r[4])) for r in x] for x in (train, test))
    monkeypatch.setattr(knn, "CELL", 4)
    monkeypatch.setattr(knn, "CROWD", 2)
    got = {(r["id"], r["rank"]): (r["dist"], r["cls"]) for r in knn.nearest_cells(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), 3).collect()}
    want = {}
    for i, t, a, p, _ in test[:-1]:
        dists = {}
        for _, t2, a2, p2, c in train[:-2]:
            d = float(t != t2) + abs(a2 - a) + float(p != p2)
            dists[d] = max(c, dists.get(d, 0))
        want |= {(i, n): x for n, x in enumerate(sorted(dists.items())[:3], 1)}
    assert got == want and plans and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_few_neighbours(spark):
    """k larger than the training rows, none of them, and equal amounts only."""
    schema = "txn_id long, type string, amount double, nameOrig string, isFraud int"
    test = spark.createDataFrame([(5, "a", 1.0, "x", 0)], schema)
    few = spark.createDataFrame([(1, "a", 1.0, "y", 1), (2, "b", 1.0, "x", 0)], schema)
    assert [tuple(r) for r in knn.nearest_cells(few, test, 3).collect()] == [(5, 1.0, 1, 1)]
    assert knn.nearest_cells(few.limit(0), test, 3).count() == 0
    assert knn.nearest_cells(few, test.limit(0), 3).count() == 0


def test_gathered_counts_in_parts(spark):
    """No list of ones is longer than a part of the input."""
    rows = spark.range(8000, numPartitions=8).select(F.col("id").alias("follower"), F.lit(1).cast("long").alias("user"))
    for how in ("group", "fold"):
        got = degree.follower_count(rows, how)
        assert [tuple(r) for r in got.collect()] == [(1, 8000)]
        assert "spark_partition_id" in sinks.plan(got, "extended").lower()


def test_adjacency_in_parts(spark):
    rows = spark.range(900).select((F.col("id") % 2 * F.col("id") % 5).alias("follower"), (F.col("id") % 300).alias("user"))
    whole = {r["follower"]: sorted(map(int, r["neighbors"].split())) for r in edges.adjacency(rows).collect()}
    got = {}
    for r in edges.adjacency_parts(rows, 100).collect():
        users = list(map(int, r["neighbors"].split()))
        assert users == sorted(users) and len(users) < 250
        got.setdefault(r["follower"], []).extend(users)
    assert {f: sorted(u) for f, u in got.items()} == whole


def test_stream(spark, tmp_path):
    """The running count over files of edges is the batch count of all of them."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,2\n3,2\n1,4\n")
    query = streaming.follower_count(streaming.edge_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("counts").collect()} == {(2, 2), (4, 1)}
        (tmp_path / "in" / "b.csv").write_text("5,4\n6,7\n")
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("counts").collect()} == {(2, 2), (4, 2), (7, 1)}
    finally:
        query.stop()
