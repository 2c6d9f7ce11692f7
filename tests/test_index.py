"""The synthetic index of n symbols, whose answers can be derived, and the rules of text."""

import pytest
from pyspark.sql import functions as F

from lexispan.functions import text as tx
from lexispan.operators import graph, lookup, resources, scan
from lexispan.plans import sql as plain_sql
from lexispan.sources.tree import Roots, path_class, project_type

N = 10_000


@pytest.fixture(scope="module")
def synthetic(spark):
    i = spark.range(N).select(F.col("id").alias("i"))
    module = lambda c: F.concat(F.lit("src/module"), F.floor(c / 100).cast("string"), F.lit("/File"), c.cast("string"), F.lit(".kt"))
    files = i.select(F.col("i").alias("id"), module(F.col("i")).alias("path"), F.lit(1000).alias("mtime"), F.lit(500).alias("size"))
    kinds = F.array(*[F.lit(k) for k in ("class", "interface", "function", "property", "enum")])
    kind = F.get(kinds, (F.col("i") % 5).cast("int"))
    name = F.concat(F.lit("Symbol"), F.col("i").cast("string"))
    symbols = i.select(F.col("i").alias("id"), F.col("i").alias("file_id"), name.alias("name"), kind.alias("kind"), (F.col("i") + 1).cast("int").alias("line"), F.concat(kind, F.lit(" "), name, F.lit(" : SomeType")).alias("signature"))
    inheritance = symbols.filter("kind IN ('class', 'interface')").select(F.col("id").alias("child_id"), F.explode(F.array(F.lit("BaseClass"), F.lit("Serializable"), F.lit("Comparable"))).alias("parent_name"), F.lit("extends").alias("kind"))
    refs = i.select(F.col("i").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
    refs = refs.select("file_id", F.concat(F.lit("Symbol"), ((F.col("file_id") + 7 * F.col("r")) % N).cast("string")).alias("name"), (10 * F.col("r") + 5).cast("int").alias("line")).withColumn("context", F.concat(F.lit("val x = "), "name", F.lit(".create()")))
    return {"files": files, "symbols": symbols, "inheritance": inheritance, "refs": refs, "located": lookup.located(symbols, files)}


def test_full_text(synthetic):
    s = synthetic["located"]
    assert lookup.full_text(s, "Symbol5000", None).count() == 1
    assert lookup.full_text(s, "Symbol50*", None).count() == 111
    assert lookup.full_text(s, "SomeType", None).count() == N
    assert lookup.full_text(s, "Some", None).count() == 0
    assert lookup.full_text(s, "  ", None).count() == 0
    assert lookup.full_text(s, "Symbol0 class", None).count() == 0
    assert lookup.full_text(s, "class Symbol0", None).count() == 1


def test_implementations_and_references(synthetic):
    found = lookup.implementations(synthetic["inheritance"], synthetic["located"], "BaseClass", 100_000)
    assert found.count() == 4000
    assert [r.name for r in lookup.implementations(synthetic["inheritance"], synthetic["located"], "BaseClass", 3).collect()] == ["Symbol0", "Symbol1", "Symbol10"]
    assert [(r.path, r.line) for r in lookup.references(synthetic["refs"], synthetic["files"], "Symbol500").collect()] == [("src/module4/File486.kt", 25), ("src/module4/File493.kt", 15), ("src/module5/File500.kt", 5)]


def test_fuzzy(synthetic):
    assert [r.name for r in lookup.fuzzy(synthetic["located"], "Symbo", 3).collect()] == ["Symbol0", "Symbol1", "Symbol2"]


def test_like_rules(spark):
    df = spark.createDataFrame([("É",), ("é",), ("a_b",), ("aXb",), ("C:\\x",)], "s string")
    hit = lambda p: {r.s for r in df.filter(tx.like(F.col("s"), p)).collect()}
    assert hit("é") == {"é"}
    assert hit("A_B") == {"a_b", "aXb"}
    assert hit("c:\\%") == {"C:\\x"}
    assert {r.s for r in df.filter(tx.glob(F.col("s"), "[A-Z]*")).collect()} == {"C:\\x"}


def test_search_quoting():
    assert [tx.quoted_search(q) for q in ("MyClass", "Slow*", "  ", 'say "hello"')] == ['"MyClass"', '"Slow"*', "", '"say ""hello"""']


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("x\n\ny",)], "t string")
    assert [r.l for r in df.select(tx.text_lines(F.col("t")).alias("l")).collect()] == [["a", "b"], [], ["x", "", "y"]]


def test_closure_cycle_and_depth(spark):
    names = spark.createDataFrame([(i, f"m{i}") for i in range(10)], "id long, name string")
    chain = spark.createDataFrame([(i, i + 1, "api") for i in range(7)], "module_id long, dep_module_id long, dep_kind string")
    assert graph.closure(chain, names).agg(F.max("depth")).first()[0] == 5
    cycle = spark.createDataFrame([(0, 1, "api"), (1, 2, "api"), (2, 0, "api")], "module_id long, dep_module_id long, dep_kind string")
    assert graph.closure(cycle, names).filter("module_id = dependency_id").count() == 3
    stop = spark.createDataFrame([(0, 1, "api"), (1, 2, "implementation"), (2, 3, "api")], "module_id long, dep_module_id long, dep_kind string")
    assert graph.closure(stop, names).filter("module_id = 0").count() == 1


def test_longest_prefix(spark):
    files = spark.createDataFrame([("core/a.kt",), ("core-ui/b.kt",)], "path string")
    modules = spark.createDataFrame([("core", "core"), ("core.ui", "core-ui"), ("root", "")], "name string, path string")
    assert {(r.path, r.module) for r in graph.longest_prefix(files, modules).collect()} == {("core/a.kt", "core"), ("core-ui/b.kt", "core.ui")}


def test_scans(spark):
    rows = ["@Composable", "", "fun Screen(x: Int) {", "  // TODO later", "  load()", "}", "suspend fun load() {", "@Inject lateinit var a: Api"]
    lines = spark.createDataFrame([("a/B.kt", i, t) for i, t in enumerate(rows, 1)], "path string, line int, text string")
    assert [(r.line, r.name) for r in scan.annotated_functions(lines, "@Composable").collect()] == [(3, "Screen")]
    assert [r.name for r in scan.run("suspend", lines).collect()] == ["load"]
    assert [r.category for r in scan.todo(lines).collect()] == ["TODO"]
    assert [r.line for r in scan.callers(lines, "load").collect()] == [5]
    assert [r.line for r in scan.inject(lines, "Api").collect()] == [8]
    edges = graph.call_edges(lines)
    assert ("Screen", "load") in {(r.caller, r.callee) for r in edges.collect()}
    assert {(r.depth, r.caller) for r in graph.call_tree(edges, "load").collect()} == {(1, "Screen")}


def test_sql_gate(spark):
    spark.range(3).createOrReplaceTempView("t3")
    bad = ["DELETE FROM x", "SELECT 1; DROP TABLE x", "update x set y = 1", "WITH t AS (SELECT 1 a)INSERT INTO x SELECT * FROM t", "WITH t AS (SELECT 1 a) /* c */INSERT/* d */INTO x SELECT * FROM t", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1", "CREATE TABLE x AS SELECT 1", "FROM t3 INSERT INTO x SELECT *", "EXPLAIN DROP TABLE x", "SET spark.x = 1", "CACHE TABLE t3", "TRUNCATE TABLE x", "SELECT java_method('java.lang.System', 'exit', 1)", "SHOW TABLES", "not sql", ""]
    for text in bad:
        with pytest.raises(plain_sql.Refused):
            plain_sql.check(spark, text)
    good = ["SELECT ' update ' AS x, 'drop table' AS y", "SELECT 1 AS a_limit", "SELECT * FROM t3 -- insert into x\n", "WITH t AS (SELECT id FROM t3) SELECT * FROM t WHERE id IN (SELECT id FROM t3)", "SELECT id AS `delete` FROM t3;"]
    for text in good:
        assert plain_sql.query(spark, text).count() > 0
    assert plain_sql.query(spark, "EXPLAIN SELECT 1").count() == 1


def test_sql_limits(spark):
    spark.range(500).createOrReplaceTempView("t500")
    rows = lambda text: plain_sql.query(spark, text, 7).count()
    assert rows("SELECT * FROM t500") == rows("SELECT id AS a_limit FROM t500") == rows("SELECT * FROM (SELECT * FROM t500 LIMIT 90)") == 7
    assert rows("SELECT * FROM t500 LIMIT 20") == rows("WITH t AS (SELECT * FROM t500) SELECT * FROM t LIMIT 20") == 20
    assert plain_sql.as_json(plain_sql.query(spark, "SELECT 1 AS a, NULL AS b")).first().json == '{"a":1,"b":null}'


def test_dependency_evidence(spark):
    """Every arm: used directly, through another module, in layouts, by resources, exported, unused."""
    from lexispan.operators import insight

    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    pair = "module string, dependency string"
    deps = df([("app", d, k) for d, k in (("direct", "api"), ("via", "implementation"), ("xml", "implementation"), ("res", "implementation"), ("shown", "api"), ("idle", "implementation"))], f"{pair}, dep_kind string")
    symbols = df([("direct", "D"), ("far", "Far"), ("idle", "I")], "module string, name string")
    refs = df([("app", "D"), ("app", "Far"), ("app", "Far"), ("other", "I")], "module string, name string")
    closed = df([("app", "far", 2, "via"), ("app", "idle", 1, "idle")], f"{pair}, depth int, via string")
    out = insight.dependency_usage(deps, symbols, refs, closed, df([("app", "xml")], pair), df([("app", "res")], pair))
    assert {r.dependency: r.verdict for r in out.collect()} == {"direct": "used_direct", "via": "used_transitive", "xml": "used_xml", "res": "used_resource", "shown": "exported", "idle": "unused"}


def test_escaped_names(spark):
    lines = spark.createDataFrame([("a.kt", i, t) for i, t in enumerate(["public List<String> run() {", "x = run()", "a.run()", "run (1)", "void run()", "->run()"], 1)], "path string, line int, text string")
    assert [r.line for r in scan.callers(lines, "run").collect()] == [3, 4, 6]


def test_resource_names():
    assert [resources.parse_resource(t) for t in ("@string/a", "R.color.b", "ic_x", "color_y", "z")] == [("string", "a"), ("color", "b"), ("drawable", "ic_x"), ("color", "color_y"), ("string", "z")]


def test_roots():
    r = Roots("/a")
    assert r.add("/b") and not r.add("/b")
    with pytest.raises(ValueError, match="overlaps"):
        r.add("/a/c")
    assert r.add("/a/c", force=True) and r.remove("/b") and not r.remove("/b")


def test_project_types(spark):
    kind = lambda *names: project_type(spark.createDataFrame([(n,) for n in names], "path string")).first()[0]
    assert [kind("Cargo.toml"), kind("Cargo.toml", "package.json"), kind("x.txt"), kind("go.mod", "a/Cargo.toml")] == ["rust", "mixed", "unknown", "go"]
    assert [kind("pom.xml"), kind("a/Package.swift"), kind("X.xcodeproj/project.pbxproj"), kind("Build.PL"), kind("Foo.pm"), kind("setup.cfg"), kind("MODULE.bazel"), kind("package.json"), kind("a/b/Package.swift")] == ["android", "ios", "ios", "perl", "perl", "python", "bazel", "frontend", "unknown"]
    df = spark.createDataFrame([("a/build.gradle",), ("x/Main.storyboard",), ("r/res/layout/a.xml",), ("a.kt",), ("b.txt",)], "path string")
    assert [r[0] for r in df.select(path_class(F.col("path"))).collect()] == ["module", "storyboard", "layout", "source", None]
