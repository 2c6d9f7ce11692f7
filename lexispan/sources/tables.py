"""A code index made of the driver's tables, and the same relations in DuckDB's SQL.

Documents are files; parts are symbols and their inheritance; regions, nations and suppliers are modules; pages carry
tags, links and calls; events carry versions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_lines
from ..operators import extract, lookup

SYMBOL_FILES = 200


class TableIndex:
    """The relations of an index over one folder of tables, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def contents(self) -> DataFrame:
        path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"), F.col("text").alias("content"))

    @cached_property
    def files(self) -> DataFrame:
        return self.contents.select("id", "path", "mtime", "size")

    @cached_property
    def lines(self) -> DataFrame:
        return extract.lines_of(self.contents)

    @cached_property
    def page_lines(self) -> DataFrame:
        """Pages cut at closing brackets, which stand in for lines."""
        pages = self.table("pages").select(F.format_string("pages/%s.html", F.col("page_id").cast("string")).alias("path"), F.posexplode(F.split("html", ">")).alias("line", "text"))
        return pages.select("path", (F.col("line") + 1).cast("int").alias("line"), "text")

    @cached_property
    def refs(self) -> DataFrame:
        found = extract.references(self.lines).join(self.files.select("path", F.col("id").alias("file_id")), "path")
        return found.select("file_id", "name", "line", "context")

    def refs_to(self, name: str) -> DataFrame:
        found = extract.references(self.lines, only=name).join(self.files.select("path", F.col("id").alias("file_id")), "path")
        return found.select("file_id", "name", "line", "context")

    @cached_property
    def symbols(self) -> DataFrame:
        kind = F.element_at(F.create_map(*[F.lit(x) for x in ("ECONOMY", "class", "LARGE", "interface", "MEDIUM", "function", "PROMO", "property", "SMALL", "enum", "STANDARD", "object")]), F.col("p_type"))
        return self.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % SYMBOL_FILES).alias("file_id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").cast("int").alias("line"), F.concat_ws(" ", "p_brand", "p_name").alias("signature"))

    @cached_property
    def located(self) -> DataFrame:
        return lookup.located(self.symbols, self.files)

    @cached_property
    def inheritance(self) -> DataFrame:
        parent = F.element_at(F.split("name", " "), -1)
        return self.symbols.filter(F.col("kind").isin("class", "interface", "object", "enum")).select(F.col("id").alias("child_id"), parent.alias("parent_name"), F.when(F.col("line") % 2 == 0, "extends").otherwise("implements").alias("kind"))

    @cached_property
    def modules(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lower("r_name").alias("name"), F.lit(None).cast("bigint").alias("up"))
        nation = self.table("nation").join(region.select(F.col("id").alias("n_regionkey"), F.col("name").alias("r")), "n_regionkey")
        nation = nation.select((100 + F.col("n_nationkey")).cast("bigint").alias("id"), F.concat_ws(".", "r", F.lower("n_name")).alias("name"), F.col("n_regionkey").cast("bigint").alias("up"))
        supplier = self.table("supplier").join(nation.select((F.col("id") - 100).alias("s_nationkey"), F.col("name").alias("n")), "s_nationkey")
        supplier = supplier.select((1000 + F.col("s_suppkey")).cast("bigint").alias("id"), F.concat(F.col("n"), F.lit(".s"), F.col("s_suppkey").cast("string")).alias("name"), (100 + F.col("s_nationkey")).cast("bigint").alias("up"))
        return region.unionByName(nation).unionByName(supplier).withColumn("path", F.replace("name", F.lit("."), F.lit("/")))

    @cached_property
    def module_deps(self) -> DataFrame:
        up = self.modules.filter("up IS NOT NULL").select(F.col("id").alias("module_id"), F.col("up").alias("dep_module_id"), F.lit("api").alias("dep_kind"))
        trade = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        pairs = trade.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).filter("a <> b AND (a * 31 + b * 17) % 11 = 0").distinct()
        across = pairs.select((100 + F.col("a")).cast("bigint").alias("module_id"), (100 + F.col("b")).cast("bigint").alias("dep_module_id"), F.when((F.col("a") + F.col("b")) % 2 == 0, "api").otherwise("implementation").alias("dep_kind"))
        return up.unionByName(across)

    @cached_property
    def resources(self) -> DataFrame:
        """Links of pages as resources: type by the first letter's case."""
        found = self.page_lines.select(F.regexp_extract("text", r'a href="/([^"]+)"', 1).alias("name"), F.col("path").alias("file_path")).filter("name <> ''")
        named = found.groupBy("name").agg(F.min("file_path").alias("file_path"))
        return named.select(F.xxhash64("name").alias("id"), F.when(F.col("name").rlike("^[A-Z]"), "layout").otherwise("string").alias("type"), "name", "file_path")

    @cached_property
    def words(self) -> DataFrame:
        return self.lines.select("path", "line", F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("word")).filter("word <> ''")

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "symbols": self.symbols, "refs": self.refs, "inheritance": self.inheritance, "modules": self.modules.drop("up"), "module_deps": self.module_deps, "resources": self.resources}


#: Names that are never references; fixed values.
_STOP = """'if', 'else', 'when', 'while', 'for', 'do', 'try', 'catch', 'finally', 'return', 'break', 'continue', 'throw', 'is', 'in', 'as', 'true', 'false', 'null', 'this', 'super', 'class', 'interface', 'object', 'fun', 'val', 'var',
  'import', 'package', 'private', 'public', 'protected', 'internal', 'override', 'abstract', 'final', 'open', 'sealed', 'data', 'inner', 'enum', 'companion', 'lateinit', 'const', 'suspend', 'inline', 'crossinline', 'noinline', 'reified',
  'annotation', 'typealias', 'get', 'set', 'init', 'constructor', 'by', 'where', 'String', 'Int', 'Long', 'Double', 'Float', 'Boolean', 'Byte', 'Short', 'Char', 'Unit', 'Any', 'Nothing', 'List', 'Map', 'Set', 'Array', 'Pair', 'Triple',
  'MutableList', 'MutableMap', 'MutableSet', 'HashMap', 'ArrayList', 'HashSet', 'Exception', 'Error', 'Throwable', 'Result', 'Sequence'"""
#: The same relations for DuckDB, each with those that it is made of.
CTE = {
    "contents": ((), "SELECT doc_id AS id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, doc_id AS mtime, n_chars AS size, text AS content FROM documents"),
    "files": (("contents",), "SELECT id, path, mtime, size FROM contents"),
    "pieces": (("contents",), "SELECT path, string_split(coalesce(content, ''), chr(10)) AS p FROM contents"),
    "lines": (("pieces",), "SELECT path, i::INTEGER AS line, regexp_replace(p[i], chr(13) || '$', '') AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1 - (p[len(p)] = '')::INT)) AS i FROM pieces)"),
    "page_lines": ((), "SELECT path, i::INTEGER AS line, p[i] AS text FROM (SELECT 'pages/' || page_id || '.html' AS path, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, string_split(html, '>') AS p FROM pages))"),
    "ref_lines": (("lines",), "SELECT *, trim(text, ' ') AS t FROM lines WHERE strlen(trim(text, ' ')) <= 2000 AND NOT regexp_matches(trim(text, ' '), '^(?:import |package |//|/\\*|\\*)')"),
    "refs": (("ref_lines", "files"), rf"""SELECT f.id AS file_id, r.name, r.line, r.context FROM (
        SELECT path, line, CASE WHEN strlen(t) > 500 THEN left(t, 500) || '...' ELSE t END AS context, unnest(list_concat(
          list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9]*$')),
          list_filter(regexp_extract_all(text, '([\p{{L}}\p{{N}}_]+)\s*\(', 1), lambda x: regexp_matches(x, '^[a-z][a-zA-Z0-9]*$') AND strlen(x) > 2))) AS name FROM ref_lines) r
        JOIN files f USING (path) WHERE r.name NOT IN ({_STOP})"""),
    "symbols": ((), f"SELECT p_partkey AS id, p_partkey % {SYMBOL_FILES} AS file_id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'LARGE' THEN 'interface' WHEN 'MEDIUM' THEN 'function' WHEN 'PROMO' THEN 'property' WHEN 'SMALL' THEN 'enum' WHEN 'STANDARD' THEN 'object' END AS kind, p_size::INTEGER AS line, p_brand || ' ' || p_name AS signature FROM part"),
    "located": (("symbols", "files"), "SELECT s.id AS symbol_id, s.name, s.kind, s.line, s.signature, f.path FROM symbols s JOIN files f ON s.file_id = f.id"),
    "inheritance": (("symbols",), "SELECT id AS child_id, string_split(name, ' ')[-1] AS parent_name, CASE WHEN line % 2 = 0 THEN 'extends' ELSE 'implements' END AS kind FROM symbols WHERE kind IN ('class', 'interface', 'object', 'enum')"),
    "modules": ((), """SELECT *, replace(name, '.', '/') AS path FROM (
        SELECT r_regionkey::BIGINT AS id, lower(r_name) AS name, NULL::BIGINT AS up FROM region
        UNION ALL SELECT 100 + n_nationkey, lower(r_name) || '.' || lower(n_name), n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 1000 + s_suppkey, lower(r_name) || '.' || lower(n_name) || '.s' || s_suppkey, 100 + s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""),
    "module_deps": (("modules",), """SELECT id AS module_id, up AS dep_module_id, 'api' AS dep_kind FROM modules WHERE up IS NOT NULL
        UNION ALL SELECT (100 + a)::BIGINT, (100 + b)::BIGINT, CASE WHEN (a + b) % 2 = 0 THEN 'api' ELSE 'implementation' END FROM (
          SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
          WHERE c_nationkey <> s_nationkey AND (c_nationkey * 31 + s_nationkey * 17) % 11 = 0)"""),
    "resources": (("page_lines",), """SELECT CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'layout' ELSE 'string' END AS type, name, min(path) AS file_path
        FROM (SELECT regexp_extract(text, 'a href="/([^"]+)"', 1) AS name, path FROM page_lines) WHERE name <> '' GROUP BY name"""),
    "words": (("lines",), r"SELECT path, line, word FROM (SELECT path, line, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) AS word FROM lines) WHERE word <> ''"),
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body after the common table expressions that it names."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTE[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({CTE[n][1]})" for n in order)
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest[5:]}" if head else rest
    return f"WITH {head} {rest}" if head else rest
