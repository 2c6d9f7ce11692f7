"""Module graphs and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import shuffled, written
from .scan import CODE, enclosing_functions, extension

MAX_DEPTH = 5


def dependencies(deps: DataFrame, modules: DataFrame, module: str, reverse: bool = False) -> DataFrame:
    """What a module (by name or path) depends on, or what depends on it."""
    own, other = ("dep_module_id", "module_id") if reverse else ("module_id", "dep_module_id")
    a = modules.filter((F.col("name") == module) | (F.col("path") == module)).select(F.col("id").alias(own))
    b = modules.select(F.col("id").alias(other), "name", "path")
    return deps.join(a, own).join(b, other).select("name", "path", "dep_kind")


def by_kind(deps: DataFrame) -> DataFrame:
    """Modules grouped by how they are depended on: api, implementation, other."""
    kind = F.when(F.col("dep_kind").isin("api", "implementation"), F.col("dep_kind")).otherwise("other")
    return deps.groupBy(kind.alias("dep_group")).agg(F.sort_array(F.collect_list("name")).alias("names"))


def closure(deps: DataFrame, modules: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For every direct edge, what is reached from its end over api edges, to max_depth, with the depth and the path of names.

    At most max_depth joins, each level written before the next; within one starting edge each module keeps its least depth, then its least path."""
    names, deps = written(modules.select("id", "name"), "closure-names"), written(deps.select("module_id", "dep_module_id", "dep_kind"), "closure-edges")
    start = deps.select(F.xxhash64("module_id", "dep_module_id", "dep_kind").alias("edge"), "module_id", F.col("dep_module_id").alias("node"))
    named = lambda df, key, to: df.join(names.select(F.col("id").alias(key), F.col("name").alias(to)), key)
    level = named(named(start, "module_id", "_a"), "node", "_b").withColumns({"depth": F.lit(1), "path": F.concat_ws(" -> ", "_a", "_b")}).drop("_a", "_b").distinct()
    level = written(level, "closure-level")
    api = named(deps.filter("dep_kind = 'api'").select(F.col("module_id").alias("node"), F.col("dep_module_id").alias("next")).distinct(), "next", "_n")
    seen = level
    for d in range(2, max_depth + 1):
        more = level.join(api, "node").select("edge", "module_id", F.col("next").alias("node"), F.lit(d).alias("depth"), F.concat_ws(" -> ", "path", "_n").alias("path"))
        more = more.groupBy("edge", "module_id", "node", "depth").agg(F.min("path").alias("path")).select("edge", "module_id", "node", "depth", "path")
        level = written(more.join(seen.select("edge", "node"), ["edge", "node"], "left_anti").select(*seen.columns), "closure-level")
        seen = seen.unionByName(level)
    return seen.select("module_id", F.col("node").alias("dependency_id"), "depth", "path")


def shortest_paths(closed: DataFrame) -> DataFrame:
    """For indirect dependencies: the shortest path and the module that it goes through first."""
    best = closed.filter("depth > 1").groupBy("module_id", "dependency_id").agg(F.min(F.struct("depth", "path")).alias("b"))
    return best.select("module_id", "dependency_id", F.col("b.depth").alias("depth"), F.col("b.path").alias("path"), F.get(F.split("b.path", " -> "), F.lit(1)).alias("via"))


def longest_prefix(files: DataFrame, modules: DataFrame, boundary: bool = True) -> DataFrame:
    """Each file's module: the one whose path is the longest that the file's path begins with.

    With boundary, whole path components count: a file's ancestor directories are exploded and equi-joined, so no pair of
    file and module is tried. Without, any prefix counts: those as long as some module's path are exploded."""
    if boundary:
        parts = F.split("path", "/")
        dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        tried = files.select("path", F.explode(F.array_distinct(dirs)).alias("prefix"))
    else:
        lengths = F.broadcast(modules.select(F.length("path").alias("n")).distinct())
        tried = files.select("path").join(lengths, F.col("n") <= F.length("path")).select("path", F.left("path", F.col("n")).alias("prefix"))
    hit = tried.join(shuffled(modules.select(F.col("path").alias("prefix"), F.col("name").alias("module"))), "prefix")
    best = hit.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "module"))["module"].alias("module"))
    return best


def segment_join(modules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Modules whose name's last segment is an artifact's id."""
    last = F.element_at(F.split("name", r"\."), -1)
    return modules.withColumn("artifact", last).join(artifacts, "artifact").select("name", "artifact")


def call_edges(lines: DataFrame, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """caller, callee and the caller's path: every call in a line with the function that encloses it. Built once for any number of trees.

    A call's name follows a dot, an arrow or an ampersand, or begins the line; a line that defines the name is no call of it."""
    code = lines.filter(extension(F.col("path")).isin(*extensions)) if extensions else lines
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:[.>&]|^\s*)([A-Za-z_]\w*)\s*\("), 1))
    defined = F.concat(F.regexp_extract_all("text", F.lit(r"\b(?:fun|func|def|sub)\s+(\w+)\s*[<(\{\[]"), 1), F.regexp_extract_all("text", F.lit(r"[\w.>\]]\s+(\w+)\s*\("), 1))
    calls = code.withColumn("callee", F.explode(F.array_except(names, defined))).select("path", "line", "callee")
    return enclosing_functions(calls, code).filter("function IS NOT NULL").select(F.col("function").alias("caller"), "callee", "path").distinct()


def call_tree(edges: DataFrame, name: str, depth: int = 3, limit: int = 10) -> DataFrame:
    """Callers of a function, level by level: at most `limit` for each callee, functions seen before marked and not followed.

    The loop is over levels; each is one join with what the level before has added."""
    spark = edges.sparkSession
    level = spark.createDataFrame([(name,)], "callee string")
    seen, out = level.select(F.col("callee").alias("caller")), None
    for d in range(1, depth + 1):
        w = Window.partitionBy("callee").orderBy("caller", "path")
        found = edges.join(level, "callee").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")
        found = found.join(seen.distinct().withColumn("recursive", F.lit(True)), "caller", "left").withColumn("recursive", F.coalesce("recursive", F.lit(False)))
        rows = found.select(F.lit(d).alias("depth"), "callee", "caller", "path", "recursive")
        out = rows if out is None else out.unionByName(rows)
        level = found.filter("NOT recursive").select(F.col("caller").alias("callee")).distinct()
        seen = seen.unionByName(level.select(F.col("callee").alias("caller")))
    return out
