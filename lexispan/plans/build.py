"""Building and keeping an index: parse, write, update, restore, clear."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..operators import extract, graph, resources
from ..schema import TABLES
from ..sources import tree as source

STAGES = ("files", "modules", "deps")


def keyed(df: DataFrame, *key: str) -> DataFrame:
    """df with id, a hash of its key: ids stay the same from build to build."""
    return df.withColumn("id", F.xxhash64(*key))


def facts(contents: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, inheritance and refs of contents(path, mtime, size, content): one parse a file, then explodes."""
    files = source.files_table(contents)
    parsed = parsers.parse(contents).withColumn("file_id", F.xxhash64("path"))
    symbols = keyed(parsed, "path", "line", "name", "kind")
    parents = symbols.select(F.col("id").alias("child_id"), F.explode("parents").alias("p")).select("child_id", F.col("p.name").alias("parent_name"), F.col("p.kind").alias("kind"))
    refs = extract.references(extract.lines_of(contents.filter(source.language(F.col("path")).isNotNull())), parsed)
    refs = refs.select(F.xxhash64("path").alias("file_id"), "name", "line", "context")
    return {
        "files": files,
        "symbols": symbols.select("id", "file_id", "name", "kind", "line", F.lit(None).cast("bigint").alias("parent_id"), "signature"),
        "inheritance": keyed(parents, "child_id", "parent_name", "kind").select("id", "child_id", "parent_name", "kind"),
        # look-ups ask for names: sorted, a name's rows lie in few row groups
        "refs": keyed(refs, "file_id", "line", "name").select("id", "file_id", "name", "line", "context").repartitionByRange("name").sortWithinPartitions("name"),
    }


def module_tables(contents: DataFrame) -> DataFrame:
    return extract.all_modules(contents.select("path"), contents, extract.lines_of(contents)).select("id", "name", "path", "kind")


def dependency_tables(contents: DataFrame, modules: DataFrame) -> DataFrame:
    deps = extract.gradle_dependencies(contents, modules).unionByName(extract.maven_dependencies(contents, modules))
    return keyed(deps, "module_id", "dep_module_id", "dep_kind").select("id", "module_id", "dep_module_id", "dep_kind")


def closure_tables(deps: DataFrame, modules: DataFrame) -> DataFrame:
    closed = graph.closure(deps, modules)
    return keyed(closed, "module_id", "dependency_id", "path").select("id", "module_id", "dependency_id", "depth", "path")


def platform_facts(contents: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    lines, files = extract.lines_of(contents), contents.select("path")
    owner = graph.longest_prefix(files, modules).join(modules.select(F.col("name").alias("module"), F.col("id").alias("module_id")), "module").select("path", "module_id")
    xml = resources.xml_usages(lines).join(owner, "path", "left").withColumnRenamed("path", "file_path")
    res = keyed(resources.resource_definitions(files, lines).join(owner, "path", "left").withColumnRenamed("path", "file_path"), "type", "name", "file_path", "line")
    boards = resources.storyboard_usages(lines).join(owner, "path", "left").withColumnRenamed("path", "file_path")
    assets = keyed(resources.ios_assets(files).join(owner, "path", "left").withColumnRenamed("path", "file_path"), "type", "name", "file_path")
    return {
        "xml_usages": keyed(xml, "file_path", "line", "class_name"), "resources": res,
        "resource_usages": keyed(resources.resource_usages(lines, res), "resource_id", "usage_file", "usage_line"),
        "storyboard_usages": keyed(boards, "file_path", "line", "class_name"), "ios_assets": assets,
        "ios_asset_usages": keyed(resources.asset_usages(lines, assets), "asset_id", "usage_file", "usage_line"),
    }


@dataclass
class Store:
    """An index in a folder: each table in versions of which the newest counts, so readers never see half a write."""

    spark: SparkSession
    root: str
    _known: dict[str, str] | None = None

    def _pointer(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[str, str]:
        """Where each table's newest version lies, as of this store's last write or first read."""
        if self._known is None:
            self._known = self._latest()
        return self._known

    def _latest(self) -> dict[str, str]:
        p, fs = self._pointer()
        if not fs.exists(p):
            return {}
        rows = self.spark.read.schema("table string, n long, path string").json(f"{self.root}/_versions").collect()  # a row for each table
        latest: dict[str, tuple[int, str]] = {}
        for r in rows:
            latest[r.table] = max(latest.get(r.table, (0, "")), (r.n, r.path))
        return {k: v[1] for k, v in latest.items()}

    def write(self, tables: dict[str, DataFrame]) -> None:
        p, fs = self._pointer()
        n = 1 + (self.spark.read.json(str(p)).agg(F.max("n")).first()[0] if fs.exists(p) else 0)
        rows = []
        for name, df in tables.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            want = [c.strip().split(" ")[0] for c in TABLES[name].split(",")] if name in TABLES else df.columns
            df.select(*[c if c in df.columns else F.lit(None).cast("bigint").alias(c) for c in want]).write.parquet(path)
            rows.append((name, n, path))
        self.spark.createDataFrame(rows, "table string, n long, path string").coalesce(1).write.mode("append").json(f"{self.root}/_versions")
        self._known = None

    def read(self, name: str) -> DataFrame:
        at = self.versions()
        return self.spark.read.parquet(at[name]) if name in at else self.spark.createDataFrame([], TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        return {k: self.read(k) for k in TABLES if k != "metadata"}

    def rebuild(self, contents: DataFrame, stage: str = "all") -> None:
        if stage not in ("all", "symbols", *STAGES):
            raise ValueError(f"no stage {stage}")
        if stage in ("all", "files", "symbols"):
            self.write(facts(contents))
        if stage in ("all", "modules", "deps"):
            self._modules(contents)
        if stage == "all":
            self.write(platform_facts(contents, self.read("modules")))

    def update(self, contents: DataFrame) -> tuple[int, int]:
        """Takes in new and changed files and leaves out deleted ones: (changed, deleted). Modules and platform tables, which join across
        files, are made anew from the contents if anything changed; without a change nothing is written."""
        changed, deleted = differences(contents, self.read("files"))
        fresh = facts(contents.join(changed.select("path"), "path", "left_semi"))
        gone = changed.select("path").unionByName(deleted.select("path")).select(F.xxhash64("path").alias("file_id"))
        n = changed.count(), deleted.count()
        if n == (0, 0):
            return n
        old = {k: self.read(k) for k in ("files", "symbols", "inheritance", "refs")}
        lost = old["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("child_id"))
        kept = {"files": old["files"].join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti"), "symbols": old["symbols"].join(gone, "file_id", "left_anti"), "refs": old["refs"].join(gone, "file_id", "left_anti"), "inheritance": old["inheritance"].join(lost, "child_id", "left_anti")}
        self.write({k: kept[k].unionByName(fresh[k]) for k in kept})
        self._modules(contents)
        self.write(platform_facts(contents, self.read("modules")))
        return n

    def _modules(self, contents: DataFrame) -> None:
        """Modules, then what depends on them, each from the written table before: the closure's joins read small tables, not their making."""
        self.write({"modules": module_tables(contents)})
        self.write({"module_deps": dependency_tables(contents, self.read("modules"))})
        self.write({"transitive_deps": closure_tables(self.read("module_deps"), self.read("modules"))})

    def clear(self) -> None:
        self.write({k: self.spark.createDataFrame([], v) for k, v in TABLES.items() if k != "metadata"})

    def restore(self, snapshot: str) -> None:
        other = Store(self.spark, snapshot)
        self.write({k: self.spark.read.parquet(v) for k, v in other.versions().items()})


def differences(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new or later files, deleted files) by path and mtime."""
    both = now.select("path", "mtime").join(before.select("path", F.col("mtime").alias("was")), "path", "full_outer")
    return both.filter("mtime IS NOT NULL AND (was IS NULL OR mtime > was)").select("path", "mtime"), both.filter("mtime IS NULL").select("path")


def latest(changes: DataFrame, key: str, version: list[str], deleted: str) -> DataFrame:
    """The last version of each key, without those whose last change deletes them. Combined before the shuffle."""
    row = F.struct(*version, *[c for c in changes.columns if c not in (key, *version)])
    return changes.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.*").filter(~F.expr(deleted))
