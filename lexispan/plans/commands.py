"""One function for each question that can be asked of an index, by the name of its command.

Index holds the tables of a Store and the lines of its files; every command returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import like
from ..operators import extract, graph, insight, lookup, resources, scan
from . import sql as plain_sql
from .build import Store


@dataclass
class Index:
    store: Store
    contents: DataFrame

    @cached_property
    def spark(self) -> SparkSession:
        return self.store.spark

    @cached_property
    def lines(self) -> DataFrame:
        return extract.lines_of(self.contents)

    @cached_property
    def located(self) -> DataFrame:
        return lookup.located(self["symbols"], self["files"])

    def __getitem__(self, name: str) -> DataFrame:
        return self.store.read(name)

    @cached_property
    def module_of_file(self) -> DataFrame:
        return graph.longest_prefix(self["files"], self["modules"])


def _usages(x: Index, name: str, limit: int = 50, **where) -> DataFrame:
    """Indexed references; the files are scanned only for a name that has none at all."""
    found = lookup.references(x["refs"], x["files"], name, limit, **where)
    if x["refs"].filter(F.col("name") == name).limit(1).count():
        return found
    return scan.usages(x.lines, name, limit=limit).select(F.lit(name).alias("name"), "line", F.col("content").alias("context"), "path")


def _deps(x: Index, module: str, reverse: bool = False) -> DataFrame:
    return graph.by_kind(graph.dependencies(x["module_deps"], x["modules"], module, reverse))


def _unused_deps(x: Index, module: str | None = None) -> DataFrame:
    names = x["modules"].select("id", "name")
    named = lambda df, a, b: df.join(names.select(F.col("id").alias(a), F.col("name").alias("module")), a).join(names.select(F.col("id").alias(b), F.col("name").alias("dependency")), b)
    deps = named(x["module_deps"], "module_id", "dep_module_id").select("module", "dependency", "dep_kind").distinct()
    deps = deps.filter(F.col("module") == module) if module else deps
    closed = named(graph.shortest_paths(x["transitive_deps"].select("module_id", "dependency_id", "depth", "path")), "module_id", "dependency_id").select("module", "dependency", "depth", "via")
    symbols = x.located.join(x.module_of_file, "path").select("module", "name")
    refs = x["refs"].join(x["files"].select(F.col("id").alias("file_id"), "path"), "file_id").join(x.module_of_file, "path").select("module", "name")
    last = F.element_at(F.split("class_name", r"\."), -1)
    xml = x["xml_usages"].join(names.select(F.col("id").alias("module_id"), F.col("name").alias("module")), "module_id").select("module", last.alias("name"))
    xml = xml.join(symbols.select(F.col("module").alias("dependency"), "name"), "name").select("module", "dependency")
    own = x["resources"].join(names.select(F.col("id").alias("module_id"), F.col("name").alias("dependency")), "module_id").select(F.col("id").alias("resource_id"), "dependency")
    used = x["resource_usages"].join(own, "resource_id").join(x.module_of_file.withColumnRenamed("path", "usage_file"), "usage_file").select("module", "dependency")
    return insight.dependency_usage(deps, symbols, refs, closed, xml, used)


def _api(x: Index, module: str) -> DataFrame:
    path = x["modules"].filter((F.col("name") == module) | (F.col("path") == module)).select("path").limit(1).first()
    return scan.public_api(x.lines, (path.path if path else module.replace(".", "/")) + "/")


def _map(x: Index, module: str | None = None, per_dir: int = 5) -> DataFrame:
    return insight.top_per_directory(x.located.filter(like(F.col("path"), f"{module}%")), k=per_dir) if module else insight.directory_kinds(x["files"], x.located)


def _conventions(x: Index) -> DataFrame:
    """Naming, frameworks and architecture, tagged by section."""
    imports = insight.first_rule(insight.import_counts(x["refs"], x["symbols"]), insight.FRAMEWORKS)
    parts = (insight.suffix_counts(x["symbols"]).select(F.lit("naming").alias("section"), F.col("suffix").alias("name"), "n"), imports.select(F.concat(F.lit("framework:"), "category").alias("section"), F.col("label").alias("name"), "n"), insight.architecture(x["files"], insight.ARCHITECTURES).select(F.lit("architecture").alias("section"), F.col("label").alias("name"), F.lit(None).cast("bigint").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scan(name: str) -> Callable[..., DataFrame]:
    return lambda x, query=None, limit=50: scan.run(name, x.lines, query, limit)


def _changed(x: Index, paths: DataFrame) -> DataFrame:
    found = extract.changed_declarations(x.lines.join(paths.select("path"), "path", "left_semi"))
    return lookup.top_of_each(found, ["path"], ["line"], 10)


COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "todo": lambda x, words="TODO|FIXME|HACK": scan.todo(x.lines, words), "callers": lambda x, name, limit=50: scan.callers(x.lines, name, limit=limit),
    "call-tree": lambda x, name, depth=3, limit=10: graph.call_tree(graph.call_edges(x.lines), name, depth, limit), "provides": lambda x, name, limit=20: scan.provides(x.lines, name, limit),
    "composables": lambda x, query=None: scan.annotated_functions(x.lines, "@Composable", query), "previews": lambda x, query=None: scan.annotated_functions(x.lines, "@Preview", query),
    "inject": lambda x, name, limit=50: scan.inject(x.lines, name, limit), "annotations": lambda x, name, limit=50: scan.annotations(x.lines, name, limit=limit), "extensions": lambda x, name, limit=50: scan.extension_functions(x.lines, name, limit),
    "swiftui": lambda x, query=None: scan.swiftui(x.lines, query), "publishers": lambda x, query=None: scan.publishers(x.lines, query), "perl-imports": lambda x, query=None, limit=50: scan.perl_imports(x.lines, query, limit),
    **{name: _scan(name) for name in scan.SCANS},
    "search": lambda x, text, limit=20: lookup.universal(x["files"], x.located, x.lines, text, limit), "file": lambda x, text, limit=20: lookup.files_containing(x["files"], text, limit),
    "symbol": lambda x, name, kind=None, limit=20, fuzzy=False: lookup.fuzzy(x.located, name, limit) if fuzzy else lookup.exact_or_prefix(x.located, name, kind, limit),
    "class": lambda x, name, limit=20, fuzzy=False, **where: lookup.fuzzy(x.located.filter(F.col("kind").isin(*lookup.CLASS_LIKE)), name, limit) if fuzzy else lookup.class_like(x.located, name, limit, **where),
    "implementations": lambda x, name, limit=20: lookup.implementations(x["inheritance"], x.located, name, limit), "hierarchy": lambda x, name: lookup.hierarchy(x["inheritance"], x["symbols"], x.located, name),
    "refs": lambda x, name, limit=20: lookup.cross_references(x.located, x["refs"], x["files"], name, limit), "usages": _usages,
    "module": lambda x, text, limit=20: lookup.modules_matching(x["modules"], text, limit), "deps": _deps, "dependents": lambda x, module: _deps(x, module, True), "unused-deps": _unused_deps, "api": _api,
    "xml-usages": lambda x, module=None: resources.with_module(x["xml_usages"], x["modules"], module), "resource-usages": lambda x, text, module=None: resources.usages_of_resource(x["resource_usages"], x["resources"], text, module), "unused-resources": lambda x: resources.unused(x["resources"], x["resource_usages"], "resource_id"),
    "storyboard-usages": lambda x, module=None: resources.with_module(x["storyboard_usages"], x["modules"], module), "asset-usages": lambda x, name: resources.matching_assets(x["ios_asset_usages"], x["ios_assets"], name), "unused-assets": lambda x: resources.unused(x["ios_assets"], x["ios_asset_usages"], "asset_id"),
    "outline": lambda x, path: extract.outline_of(x.contents, path), "imports": lambda x, path: extract.imports(x.lines, path), "changed": _changed,
    "map": _map, "conventions": _conventions, "unused-symbols": lambda x, module=None, exported_only=True, limit=50: insight.unused_symbols(x.located, x["refs"], x["xml_usages"], x["storyboard_usages"], module, exported_only, limit),
    "stats": lambda x: insight.stats(x.store.tables()), "schema": lambda x: plain_sql.schema(x.spark, x.store.tables()),
    "query": lambda x, text, limit=100: (plain_sql.register(x.store.tables()), plain_sql.query(x.spark, text, limit))[1],
}


def run(index: Index, command: str, *args, as_json: bool = False, **options) -> DataFrame:
    """A command's rows; as JSON objects, one in each row, if asked for."""
    if command not in COMMANDS:
        raise KeyError(f"no command {command}; there are {', '.join(sorted(COMMANDS))}")
    out = COMMANDS[command](index, *args, **options)
    return plain_sql.as_json(out) if as_json else out
