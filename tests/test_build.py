"""Building, updating and watching an index of a small tree."""

from pyspark.sql import functions as F

from lexispan.plans.build import Store, latest
from lexispan.sources.tree import files_table, walk
from lexispan.streaming.watch import watch

TREE = {
    "app/build.gradle.kts": "dependencies { implementation(project(\":core\"))\n api(projects.ui) }",
    "core/build.gradle.kts": "", "ui/build.gradle.kts": "",
    "core/src/Repo.kt": "package core\ninterface Repo\nclass RealRepo(val x: Int) : Repo {\n  fun load() {}\n}\n",
    "app/src/Main.kt": "package app\nclass Main {\n  val r = RealRepo(1)\n  fun run() { r.load() }\n}\n",
    "app/src/res/layout/main.xml": "<core.View android:id=\"@+id/root\"/>", "node_modules/x.kt": "class Hidden",
}


def contents(spark, tree, mtime=100):
    rows = [(p, mtime, len(t), t) for p, t in tree.items()]
    return spark.createDataFrame(rows, "path string, mtime long, size long, content string")


def test_walk(spark, tmp_path):
    for p, t in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "core/bad.kt").write_bytes(b"\xff\xfeclass")
    (tmp_path / "core/big.kt").write_text("class Big\n" + "x" * 1_100_000)
    found = {r.path: r for r in walk(spark, str(tmp_path)).collect()}
    assert "node_modules/x.kt" not in found and found["core/bad.kt"].content == "" and found["core/big.kt"].content == ""
    assert found["core/src/Repo.kt"].content == TREE["core/src/Repo.kt"]
    assert files_table(walk(spark, str(tmp_path))).count() == 6  # files without a byte are not read
    assert found["app/src/res/layout/main.xml"].path_class == "layout" and found["core/src/Repo.kt"].path_class == "source"
    (tmp_path / ".gitignore").write_text("*.xml\n/core/bad.kt\n")
    assert {r.path for r in walk(spark, str(tmp_path)).collect()} == set(found) - {"app/src/res/layout/main.xml", "core/bad.kt"}
    assert walk(spark, str(tmp_path), use_ignore_files=False).count() == 6


def test_rebuild_update_restore(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    store.rebuild(contents(spark, {k: v for k, v in TREE.items() if "node_modules" not in k}))
    symbols = {(r.name, r.kind) for r in store.read("symbols").collect()}
    assert {("Repo", "interface"), ("RealRepo", "class"), ("load", "function"), ("Main", "class")} <= symbols
    assert {r.parent_name for r in store.read("inheritance").collect()} == {"Repo"}
    assert {r.name for r in store.read("refs").filter("name = 'RealRepo'").collect()} == {"RealRepo"}
    assert {r.name for r in store.read("modules").collect()} == {"app", "core", "ui"}
    assert {(r.dep_kind) for r in store.read("module_deps").collect()} == {"implementation", "api"}
    assert store.read("transitive_deps").count() == 2
    assert [r.class_name for r in store.read("xml_usages").collect()] == ["core.View"]
    changed = dict(TREE, **{"core/src/Repo.kt": "package core\ninterface Other\n"})
    del changed["app/src/Main.kt"], changed["node_modules/x.kt"]
    now = contents(spark, changed).withColumn("mtime", F.when(F.col("path") == "core/src/Repo.kt", 200).otherwise(F.col("mtime")))
    assert store.update(now) == (1, 1)
    assert {r.name for r in store.read("symbols").filter("kind IN ('class', 'interface')").collect()} == {"Other"}
    assert store.read("inheritance").count() == 0
    assert store.update(now) == (0, 0)
    moved = dict(changed, **{"app/src/res/layout/main.xml": "<core.Other/>\n<ui.More/>", "svc/pom.xml": "<dependency><artifactId>core</artifactId></dependency><artifactId>svc</artifactId>"})
    later = contents(spark, moved).withColumn("mtime", F.when(F.col("path").rlike("xml$"), 300).when(F.col("path") == "core/src/Repo.kt", 200).otherwise(F.col("mtime")))
    assert store.update(later) == (2, 0)
    assert {r.class_name for r in store.read("xml_usages").collect()} == {"core.Other", "ui.More"}
    assert "compile" in {r.dep_kind for r in store.read("module_deps").collect()}
    other = Store(spark, f"file://{tmp_path}/other")
    other.restore(store.root)
    assert other.read("symbols").count() == store.read("symbols").count()
    other.clear()
    assert other.read("symbols").count() == 0


def test_watch(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, mtime long, content string").coalesce(1).write.parquet(f"file://{inbox}")
    stream = spark.readStream.schema("path string, mtime long, content string").parquet(f"file://{inbox}")
    q = watch(stream, lambda df, n: seen.append(sorted((r.path, r.content) for r in df.collect())), f"file://{tmp_path}/cp", once=True)
    q.awaitTermination()
    assert seen == [[("a", "y"), ("b", "z")]]


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "gone"), (2, 1, "b")], "k int, v int, t string")
    assert [(r.k, r.t) for r in latest(df, "k", ["v"], "t = 'gone'").collect()] == [(2, "b")]
