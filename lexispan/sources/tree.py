"""Source trees and snapshots as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extension

#: Directories that are never walked; fixed values.
EXCLUDED = ("node_modules", "__pycache__", ".build", "build", "dist", "target", "vendor", ".gradle", ".idea", "Pods", "DerivedData", ".next", ".nuxt", ".venv", "venv", ".tox", "coverage", ".cache", "out", "bazel-out", "bazel-bin", "bazel-genfiles", "bazel-testlogs", "buck-out", "_build", ".metals", ".bsp", ".dart_tool", "tmp", "temp", ".mypy_cache", ".pytest_cache", ".ruff_cache", "_site", ".turbo", ".parcel-cache")
#: File endings by language; fixed values.
LANGUAGES = {"kt": "kotlin", "java": "java", "swift": "swift", "m": "objc", "h": "cpp", "pm": "perl", "pl": "perl", "t": "perl", "proto": "proto", "wsdl": "wsdl", "xsd": "wsdl", "cpp": "cpp", "cc": "cpp", "c": "cpp", "hpp": "cpp", "py": "python", "go": "go", "rs": "rust", "rb": "ruby", "cs": "csharp", "dart": "dart", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "vue": "vue", "svelte": "svelte", "scala": "scala", "sc": "scala"}
#: Files of a project's root that tell its kind, as patterns; fixed values.
MARKERS = {"android": r"settings\.gradle\.kts|settings\.gradle|build\.gradle\.kts|build\.gradle|pom\.xml", "ios": r"Package\.swift|[^/]+\.xcodeproj/.*|[^/]+/Package\.swift", "perl": r"Makefile\.PL|Build\.PL|cpanfile|[^/]+\.pm", "frontend": r"package\.json", "python": r"pyproject\.toml|setup\.py|setup\.cfg", "go": r"go\.mod", "rust": r"Cargo\.toml", "bazel": r"WORKSPACE|WORKSPACE\.bazel|MODULE\.bazel"}
#: Files that mark a part of a larger tree, besides those; fixed values.
BUILD_MARKERS = r"Makefile|BUILD|BUILD\.bazel|CMakeLists\.txt"
MAX_BYTES, MAX_DEPTH = 1_000_000, 50


def pruned(path: Column) -> Column:
    """Whether a path lies in a directory that is not walked, is hidden, or lies too deep."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda x: x.isin(*EXCLUDED) | (F.startswith(x, F.lit(".")) & (x != ".") & (x != ".."))) | (F.size(parts) > MAX_DEPTH)


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def path_class(path: Column) -> Column:
    """What a path is for: source, module file, storyboard, asset folder, layout or other resource."""
    return (
        F.when(path.rlike(r"(?:^|/)(?:build\.gradle(?:\.kts)?|Package\.swift|pom\.xml|Podfile(?:\.lock)?|Cartfile(?:\.resolved)?)$"), "module")
        .when(path.rlike(r"\.(?:storyboard|xib)$"), "storyboard").when(path.rlike(r"\.xcassets(?:/|$)"), "asset")
        .when(path.rlike(r"/res/(?:layout|menu|navigation)[^/]*/[^/]+\.xml$"), "layout").when(path.rlike(r"/res/"), "resource")
        .when(language(path).isNotNull(), "source")
    )


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern over paths below the folder, whether it takes back) of each rule of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
        below, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        body = ""
        for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", rule):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if len(part) > 1 else re.escape(part))
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if below else '(?:/.*)?'}$", back))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a path leaves it out."""
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def read_ignored(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, bool]]:
    """The rules of a root's ignore files; readers skip such files, so they are opened by name."""
    rules: list[tuple[str, bool]] = []
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            stream = fs.open(p)
            rules += ignore_rules(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    return rules


def walk(spark: SparkSession, root: str, ignore: DataFrame | None = None, use_ignore_files: bool = True) -> DataFrame:
    """path (below root), mtime (seconds), size, content, path_class of the files of a tree, without those that the root's ignore file leaves out.

    Contents over MAX_BYTES are empty: such a file keeps its row and yields nothing. So do contents that are no UTF-8. Files without a byte are left out by the reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^{re.escape(base)}/", "")
    df = raw.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), guarded(F.col("content"), F.col("length")).alias("content")).filter(~pruned(F.col("path")))
    if use_ignore_files and (rules := read_ignored(spark, root)):
        df = df.filter(~ignored(F.col("path"), rules))
    df = df.withColumn("path_class", path_class(F.col("path")))
    return df.join(ignore, "path", "left_anti") if ignore is not None else df


def guarded(content: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """A file's text; empty for one that is too large or no UTF-8."""
    text = content.cast("string")
    return F.coalesce(F.when((size <= most) & F.is_valid_utf8(text), text), F.lit(""))


def files_table(tree: DataFrame) -> DataFrame:
    return tree.select(F.xxhash64("path").alias("id"), "path", "mtime", "size")


def capped_count(files: DataFrame, cap: int = 65_000) -> int:
    return files.limit(cap).count()


def sub_projects(files: DataFrame) -> DataFrame:
    """Directories right below the root that hold a project marker; if at least two do, all of them."""
    top, rest = F.get(F.split("path", "/"), F.lit(0)), F.regexp_replace("path", "^[^/]+/", "")
    marker = rest.rlike(f"^(?:{'|'.join(MARKERS.values())}|{BUILD_MARKERS})$")
    dirs = files.filter(F.contains("path", F.lit("/")) & ~top.isin(*EXCLUDED) & ~F.startswith(top, F.lit("."))).groupBy(top.alias("dir")).agg(F.bool_or(marker).alias("marked"))
    n = F.sum(F.col("marked").cast("int")).over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row for each directory
    return dirs.withColumn("n", n).filter("n >= 2 OR marked").drop("n")


def project_type(files: DataFrame) -> DataFrame:
    """One row: the kind of project by its marker files, 'mixed' for several, 'unknown' for none."""
    flags = files.agg(*[F.coalesce(F.bool_or(F.col("path").rlike(f"^(?:{p})$")), F.lit(False)).alias(k) for k, p in MARKERS.items()])
    names = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in MARKERS]), lambda x: x.isNotNull())
    return flags.select(F.when(F.size(names) == 0, "unknown").when(F.size(names) > 1, "mixed").otherwise(F.get(names, F.lit(0))).alias("project_type"))


def union_roots(roots: list[DataFrame]) -> DataFrame:
    """Trees of several roots, paths relative to each; the last root that has a path wins."""
    out = None
    for k, df in enumerate(roots):
        df = df.withColumn("_root", F.lit(k))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy("path").orderBy(F.desc("_root"))
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_root")


class Roots:
    """The registry of extra roots, kept as a JSON list."""

    def __init__(self, primary: str, stored: str = "[]"):
        self.primary, self.extra = primary.rstrip("/"), list(json.loads(stored))

    def add(self, root: str, force: bool = False) -> bool:
        root = root.rstrip("/")
        if not force and any(f"{a}/".startswith(f"{b}/") for x in [self.primary, *self.extra] for a, b in ((root, x), (x, root)) if root != x):
            raise ValueError(f"{root} overlaps with a root that is known")
        if new := root not in self.extra:
            self.extra.append(root)
        return new

    def remove(self, root: str) -> bool:
        if there := root.rstrip("/") in self.extra:
            self.extra.remove(root.rstrip("/"))
        return there

    def dumps(self) -> str:
        return json.dumps(self.extra)
