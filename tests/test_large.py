"""What large tables need, seen on small ones."""

import pytest

from lexispan.operators import graph, resources
from lexispan.plans import queries
from lexispan.plans import sql as plain_sql


@pytest.mark.parametrize("name", ["module_dependencies", "prefix_without_boundary", "resource_usages", "xml_usages"])
def test_nothing_exploded_is_broadcast(name, spark, sf_dir, same):
    """Spark takes exploded rows for few bytes, so a join left to it sends them all through the driver."""
    df = queries.QUERIES[name](spark, sf_dir)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    same(df, queries.ORACLE[name])


def test_prefixes_of_modules_lengths(spark):
    files = spark.createDataFrame([("core/a.kt",), ("core-ui/b.kt",), ("c",), ("x",)], "path string")
    modules = spark.createDataFrame([("core", "core"), ("c", "c"), ("long", "core/a.kt/and/more"), (None, None)], "name string, path string")
    find = lambda m: {(r.path, r.module) for r in graph.longest_prefix(files, m, boundary=False).collect()}
    assert find(modules) == {("core/a.kt", "core"), ("core-ui/b.kt", "core"), ("c", "c")}
    assert find(modules.limit(0)) == set()
    assert find(modules.unionByName(spark.createDataFrame([("root", "")], "name string, path string"))) == find(modules) | {("x", "root")}


def test_layout_lines_that_repeat(spark):
    """Each line has its own id, and a line that is there twice counts twice, not four times."""
    text = '<a.B android:id="@+id/x" class="c.D"/><e.F>'
    lines = spark.createDataFrame([("m.xml", 1, text)] * 2 + [("m.xml", 2, "<e.F>")], "path string, line int, text string")
    rows = sorted((r.line, r.class_name, r.usage_type, r.element_id) for r in resources.xml_usages(lines).collect())
    assert rows == [(1, "a.B", "view_tag", "x")] * 2 + [(1, "c.D", "view_class_attr", "x")] * 2 + [(1, "e.F", "view_tag", "x")] * 2 + [(2, "e.F", "view_tag", None)]


def test_symbols_of_one_place(spark, tmp_path):
    """Symbols of one file, line and kind whose names share the word that is looked for; equal ones; names of one word, and none."""
    import duckdb

    names = ["red ring", "blue ring", "old ring", "old ring", "hot gear", "ring", None, "red bolt"]
    parts = spark.createDataFrame([(k * 200, n, "B", "ECONOMY", 5) for k, n in enumerate(names)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    documents = spark.createDataFrame([(0, "a Gear", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("part", parts), ("documents", documents)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    c = duckdb.connect()
    for name in ("part", "documents"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in queries.QUERIES["unused_symbols"](spark, str(tmp_path)).collect()]
    assert got == c.execute(queries.ORACLE["unused_symbols"]).fetchall() and len(got) == 5


def test_not_in_by_shuffles(spark, sf_dir):
    """NOT IN means what it means in SQL, nulls included, without all rows of its query going through the driver."""
    frame = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).createOrReplaceTempView(name)
    frame("l", [(1, "a"), (2, "b"), (3, None), (4, "c"), (4, "c")], "i int, name string")
    frame("r", [("a", 1), ("a", 2), ("z", 3)], "name string, k int")
    frame("rn", [("a", 1), (None, 2)], "name string, k int")
    frame("e", [], "name string, k int")
    count = lambda q: plain_sql.query(spark, f"SELECT * FROM l WHERE {q}").count()
    assert [count(f"name NOT IN (SELECT name FROM {t})") for t in ("r", "rn", "e")] == [3, 0, 5]
    assert count("i > 2 AND name NOT IN (SELECT name FROM r) AND i NOT IN (SELECT k FROM r)") == 2
    assert count("name NOT IN (SELECT name FROM r WHERE r.k = l.i)") == 3
    assert count("(name) NOT IN (SELECT name FROM r LIMIT 1) OR i = 1") == 4
    for df in (plain_sql.query(spark, "SELECT * FROM l WHERE name NOT IN (SELECT name FROM r)"), queries.QUERIES["sql_not_in"](spark, sf_dir)):
        assert "OR isnull((" not in df._jdf.queryExecution().optimizedPlan().toString()
