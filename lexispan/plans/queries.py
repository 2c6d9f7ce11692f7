"""The queries over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import extract, graph, insight, lookup, resources, scan
from ..sources import tree
from ..sources.tables import TableIndex, sql
from ..shared import new_path, written
from . import build, code_queries, sql as plain_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, oracle: str | None, make: Callable[[TableIndex], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(TableIndex(spark, sf_dir))
    if oracle is not None:
        ORACLE[name] = oracle


big = lambda c: F.col(c).cast("bigint").alias(c)
SYM = "name, kind, line, signature, path"
LOWER = "lower"

# --- files ---
add("files_contains", sql("SELECT path FROM files WHERE path ILIKE '%src3/%' ORDER BY path LIMIT 50", "files"), lambda x: lookup.files_containing(x.files, "SRC3/", 50))
add("files_by_language", sql(r"SELECT CASE WHEN regexp_extract(path, '\.([^./]+)$', 1) = '' THEN 'other' ELSE regexp_extract(path, '\.([^./]+)$', 1) END AS ext, count(*) AS n_files FROM files GROUP BY ALL", "files"), lambda x: insight.extension_counts(x.files))
add("file_tree_counts", sql("SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS dir, count(*) AS n_files FROM files GROUP BY ALL", "files"), lambda x: insight.directory_counts(x.files, 2))
add("dir_kind_map", sql("""WITH k AS (SELECT string_split(path, '/')[1] AS dir, kind, count(*) AS n FROM located GROUP BY ALL), f AS (SELECT string_split(path, '/')[1] AS dir, count(*) AS n_files FROM files GROUP BY ALL)
  SELECT dir, n_files, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k WHERE k.dir = f.dir) AS kinds FROM f""", "located", "files"),
    lambda x: insight.directory_kinds(x.files, x.located, 1).select("dir", "n_files", F.array_join(F.transform(F.sort_array(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kinds")))
add("top_k_per_dir", sql(f"SELECT dir, r, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'interface' THEN 1 WHEN 'enum' THEN 3 WHEN 'object' THEN 4 ELSE 10 END, name, path, line, symbol_id)::INTEGER AS r FROM (SELECT *, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS dir FROM located)) WHERE r <= 5", "located"), lambda x: insight.top_per_directory(x.located, 2, 5))
add("size_guard", sql("SELECT path, CASE WHEN strlen(content) > 5000 THEN '' ELSE coalesce(content, '') END AS content FROM contents", "contents"), lambda x: x.contents.select("path", tree.guarded(F.col("content").cast("binary"), F.octet_length("content"), 5000).alias("content")))
add("roots_union", sql("SELECT path, max(size) AS size FROM (SELECT path, size FROM files UNION ALL SELECT path, size FROM files WHERE id % 2 = 0) GROUP BY path", "files"), lambda x: tree.union_roots([x.files.select("path", "size"), x.files.filter("id % 2 = 0").select("path", "size")]))

# --- symbols ---
add("symbol_exact", sql(f"SELECT {SYM} FROM located WHERE name = 'cold widget' AND kind = 'class' ORDER BY path, line, name, symbol_id LIMIT 20", "located"), lambda x: lookup.ordered(lookup.by_name(x.located, "cold widget", "class"), 20).select(*lookup.SYMBOL))
add("symbol_prefix_fallback", sql(f"SELECT {SYM} FROM located WHERE name ILIKE 'cold%' ORDER BY length(name), path, line, name, symbol_id LIMIT 20", "located"), lambda x: lookup.exact_or_prefix(x.located, "cold"))
add("symbol_exact_first", sql(f"SELECT {SYM} FROM located WHERE name = 'large bolt' ORDER BY length(name), path, line, name, symbol_id LIMIT 20", "located"), lambda x: lookup.exact_or_prefix(x.located, "large bolt"))
add("class_like", sql(f"SELECT {SYM} FROM located WHERE name = 'small widget' AND kind IN ('class', 'interface', 'object', 'enum') ORDER BY path, line, name, symbol_id LIMIT 20", "located"), lambda x: lookup.class_like(x.located, "small widget"))
add("symbol_fuzzy_ranked", sql(f"SELECT {SYM} FROM located WHERE name ILIKE '%wid%' ORDER BY CASE WHEN name = 'wid' THEN 0 WHEN name ILIKE 'wid%' THEN 1 ELSE 2 END, length(name), path, line, name, symbol_id LIMIT 50", "located"), lambda x: lookup.fuzzy(x.located, "wid", 50))
add("scoped_search", sql(f"SELECT {SYM} FROM located WHERE name = 'cold widget' AND path ILIKE 'en/%' AND path ILIKE '%.txt' ORDER BY path, line, name, symbol_id LIMIT 20", "located"), lambda x: lookup.scoped_by_name(x.located, "cold widget", directory="en/", in_file=".txt"))
add("glob_exported", sql("SELECT DISTINCT name FROM refs WHERE regexp_matches(name, '^[A-Z].*s$')", "refs"), lambda x: x.refs.filter(tx.glob(F.col("name"), "[A-Z]*s")).select("name").distinct())
_tok = lambda c: f"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
add("fts_token", sql(f"SELECT {SYM} FROM located WHERE list_contains({_tok('name')}, 'widget') OR list_contains({_tok('signature')}, 'widget') ORDER BY path, line, name, symbol_id LIMIT 50", "located"), lambda x: lookup.full_text(x.located, "Widget", 50))
add("fts_phrase", sql(f"SELECT {SYM} FROM located WHERE contains(' ' || array_to_string({_tok('name')}, ' ') || ' ', ' cold bolt ') OR contains(' ' || array_to_string({_tok('signature')}, ' ') || ' ', ' cold bolt ') ORDER BY path, line, name, symbol_id", "located"), lambda x: lookup.full_text(x.located, "Cold bolt", None))
add("fts_prefix", sql(f"SELECT {SYM} FROM located WHERE contains(' ' || array_to_string({_tok('name')}, ' '), ' col') OR contains(' ' || array_to_string({_tok('signature')}, ' '), ' col') ORDER BY path, line, name, symbol_id LIMIT 50", "located"), lambda x: lookup.full_text(x.located, "col*", 50))
add("universal_search", sql(f"""SELECT * FROM (SELECT 'file' AS section, path, 0 AS line, path AS text FROM files WHERE path ILIKE '%The%' ORDER BY path LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'symbol', path, line, name FROM located WHERE contains(' ' || array_to_string({_tok('name')}, ' '), ' the') OR contains(' ' || array_to_string({_tok('signature')}, ' '), ' the') ORDER BY path, line, name, symbol_id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'content', path, line, left(trim(text, ' '), 100) FROM lines WHERE contains(text, 'The') ORDER BY path, line LIMIT 20)""", "files", "located", "lines"), lambda x: lookup.universal(x.files, x.located, x.lines, "The", extensions=("txt",)))

# --- references and inheritance ---
add("references", sql("SELECT r.name, r.line, r.context, f.path FROM refs r JOIN files f ON r.file_id = f.id WHERE r.name = 'The' ORDER BY f.path, r.line, r.context LIMIT 50", "refs", "files"), lambda x: lookup.references(x.refs_to("The"), x.files, "The", 50))
add("references_scoped", sql("SELECT r.name, r.line, r.context, f.path FROM refs r JOIN files f ON r.file_id = f.id WHERE r.name = 'Of' AND f.path ILIKE 'en/src1/%' ORDER BY f.path, r.line, r.context LIMIT 50", "refs", "files"), lambda x: lookup.references(x.refs_to("Of"), x.files, "Of", 50, module="en/src1/"))
add("reference_counts", sql("SELECT name, count(*) AS n FROM refs GROUP BY name", "refs"), lambda x: lookup.reference_counts(x.refs))
add("ref_extraction", sql("SELECT file_id, name, line, count(*) AS n FROM refs GROUP BY ALL", "refs"), lambda x: x.refs.groupBy("file_id", "name", "line").agg(F.count("*").alias("n")))
add("cross_references", sql("""SELECT * FROM (SELECT 'definition' AS section, name, path, line, '' AS text FROM located WHERE name = 'cold widget' ORDER BY length(name), path, line, name, symbol_id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'usage', r.name, f.path, r.line, r.context FROM refs r JOIN files f ON r.file_id = f.id WHERE r.name = 'cold widget' ORDER BY f.path, r.line, r.context LIMIT 20)""", "located", "refs", "files"), lambda x: lookup.cross_references(x.located, x.refs, x.files, "cold widget"))
add("implementations_ranked", sql("""SELECT s.name, s.kind, s.line, s.signature, s.path FROM inheritance i JOIN located s ON i.child_id = s.symbol_id WHERE i.parent_name ILIKE '%widget%'
  ORDER BY CASE WHEN i.parent_name = 'widget' THEN 0 WHEN i.parent_name ILIKE '%.widget' THEN 1 ELSE 2 END, s.name, s.path, s.line, s.symbol_id LIMIT 30""", "inheritance", "located"), lambda x: lookup.implementations(x.inheritance, x.located, "widget", 30))
add("hierarchy_parents", sql("SELECT DISTINCT i.parent_name, i.kind FROM inheritance i JOIN symbols s ON i.child_id = s.id WHERE s.name = 'cold widget'", "inheritance", "symbols"), lambda x: lookup.parents(x.inheritance, x.symbols, "cold widget"))
add("hierarchy_children", sql("""SELECT 'parent' AS direction, parent_name AS name, kind, NULL AS path FROM (SELECT DISTINCT i.parent_name, i.kind FROM inheritance i JOIN symbols s ON i.child_id = s.id WHERE s.name = 'bolt')
  UNION ALL SELECT * FROM (SELECT 'child', s.name, s.kind, s.path FROM inheritance i JOIN located s ON i.child_id = s.symbol_id WHERE i.parent_name ILIKE '%bolt%'
  ORDER BY CASE WHEN i.parent_name = 'bolt' THEN 0 WHEN i.parent_name ILIKE '%.bolt' THEN 1 ELSE 2 END, s.name, s.path, s.line, s.symbol_id LIMIT 20)""", "inheritance", "symbols", "located"), lambda x: lookup.hierarchy(x.inheritance, x.symbols, x.located, "bolt"))
add("parents_by_name", sql("SELECT name, string_agg(DISTINCT parent_name, ',' ORDER BY parent_name) AS parents FROM inheritance i JOIN symbols s ON i.child_id = s.id GROUP BY name", "inheritance", "symbols"), lambda x: insight.parents_by_name(x.inheritance, x.symbols).select("name", F.array_join("parents", ",").alias("parents")))

# --- modules ---
add("module_search", sql("SELECT name, path FROM modules WHERE name ILIKE '%asia.nation_1%' OR path ILIKE '%asia.nation_1%' ORDER BY name LIMIT 20", "modules"), lambda x: lookup.modules_matching(x.modules, "asia.nation_1").select("name", "path"))
_deps = "SELECT b.name, b.path, d.dep_kind FROM module_deps d JOIN modules a ON d.{0} = a.id JOIN modules b ON d.{1} = b.id WHERE a.name = '{2}' OR a.path = '{2}'"
add("module_deps", sql(_deps.format("module_id", "dep_module_id", "africa.nation_0"), "module_deps"), lambda x: graph.dependencies(x.module_deps, x.modules, "africa.nation_0"))
add("module_dependents", sql(_deps.format("dep_module_id", "module_id", "africa.nation_0"), "module_deps"), lambda x: graph.dependencies(x.module_deps, x.modules, "africa.nation_0", True))
add("deps_by_kind", sql("SELECT CASE WHEN dep_kind IN ('api', 'implementation') THEN dep_kind ELSE 'other' END AS dep_group, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM module_deps d JOIN modules m ON d.dep_module_id = m.id WHERE d.module_id BETWEEN 100 AND 110 GROUP BY ALL", "module_deps"),
    lambda x: graph.by_kind(x.module_deps.filter("module_id BETWEEN 100 AND 110").join(x.modules.select(F.col("id").alias("dep_module_id"), "name"), "dep_module_id")).select("dep_group", F.size("names").cast("bigint").alias("n"), F.array_join("names", ",").alias("names")))
_closure = """WITH walk AS (
    SELECT d.module_id AS a, d.dep_module_id AS b, d.dep_kind AS k, d.dep_module_id AS node, 1 AS depth, m.name || ' -> ' || n.name AS path, [d.dep_module_id] AS seen FROM module_deps d JOIN modules m ON d.module_id = m.id JOIN modules n ON d.dep_module_id = n.id
    UNION ALL SELECT w.a, w.b, w.k, d.dep_module_id, w.depth + 1, w.path || ' -> ' || n.name, list_append(w.seen, d.dep_module_id) FROM walk w JOIN module_deps d ON d.module_id = w.node AND d.dep_kind = 'api' JOIN modules n ON d.dep_module_id = n.id
      WHERE w.depth < 5 AND NOT list_contains(w.seen, d.dep_module_id)),
  best AS (SELECT a AS module_id, node AS dependency_id, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY a, b, k, node ORDER BY depth, path) AS r FROM walk) WHERE r = 1) """
add("transitive_closure", sql(_closure + "SELECT module_id, dependency_id, depth, path FROM best", "module_deps", "modules", recursive=True), lambda x: graph.closure(x.module_deps, x.modules))
add("shortest_dep_path", sql(_closure + "SELECT module_id, dependency_id, depth, path, string_split(path, ' -> ')[2] AS via FROM (SELECT *, row_number() OVER (PARTITION BY module_id, dependency_id ORDER BY depth, path) AS r FROM best WHERE depth > 1) WHERE r = 1", "module_deps", "modules", recursive=True), lambda x: graph.shortest_paths(graph.closure(x.module_deps, x.modules)))
_mods = "(SELECT DISTINCT string_split(path, '/')[1] AS path FROM files UNION SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM files WHERE path LIKE 'en/%')"


def _prefix_modules(x: TableIndex) -> DataFrame:
    p = F.split("path", "/")
    one, two = x.files.select(F.get(p, F.lit(0)).alias("path")), x.files.filter(F.startswith("path", F.lit("en/"))).select(F.array_join(F.slice(p, 1, 2), "/").alias("path"))
    return one.unionByName(two).distinct().withColumn("name", F.replace("path", F.lit("/"), F.lit(".")))


add("longest_prefix_module", sql(f"SELECT path, replace(m, '/', '.') AS module FROM (SELECT f.path, max(m.path) AS m FROM files f JOIN {_mods} m ON starts_with(f.path, m.path || '/') GROUP BY f.path)", "files"), lambda x: graph.longest_prefix(x.files, _prefix_modules(x)))
add("maven_segment_join", sql("SELECT m.name, a AS artifact FROM modules m JOIN (SELECT DISTINCT lower(n_name) AS a FROM nation) ON string_split(m.name, '.')[-1] = a", "modules"), lambda x: graph.segment_join(x.modules, x.table("nation").select(F.lower("n_name").alias("artifact")).distinct()))
add("module_extract", sql("SELECT DISTINCT string_split(path, '/')[1] || '.' || string_split(path, '/')[2] AS name, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS path FROM files", "files"), lambda x: extract.gradle_modules(x.files.select(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"), F.lit("/build.gradle.kts")).alias("path"))))
add("build_file_choice", sql("SELECT string_split(path, '/')[1] AS dir, min(CASE WHEN id % 2 = 0 THEN string_split(path, '/')[1] || '/build.gradle.kts' ELSE string_split(path, '/')[1] || '/pom.xml' END) AS build_file FROM files GROUP BY ALL", "files"),
    lambda x: extract.build_files(x.files.select(F.concat(F.get(F.split("path", "/"), F.lit(0)), F.when(F.col("id") % 2 == 0, "/build.gradle.kts").otherwise("/pom.xml")).alias("path"))))

# --- usage of dependencies and resources ---
_srefs = "(SELECT DISTINCT string_split(f.path, '/')[1] || '.' || string_split(f.path, '/')[2] AS module, r.name FROM refs r JOIN files f ON r.file_id = f.id)"


def _refs_by_module(x: TableIndex) -> DataFrame:
    """Written once: what follows reads it several times."""
    if "refs_by_module" not in x.__dict__:
        named = x.refs.join(x.files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), ".").alias("module"), "name")
        x.__dict__["refs_by_module"] = written(named.distinct(), "refs-by-module")
    return x.__dict__["refs_by_module"]


def _defs_by_module(x: TableIndex) -> DataFrame:
    """A name is defined where it is first used."""
    first = _refs_by_module(x).groupBy("name").agg(F.min("module").alias("module"))
    return first.select("module", "name")


_defs = f"(SELECT name, min(module) AS module FROM {_srefs} GROUP BY name)"
add("dep_symbol_usage", sql(f"SELECT count(*) AS n_used, array_to_string(list_slice(list_sort(list(d.name)), 1, 3), ',') AS names FROM {_defs} d JOIN {_srefs} r ON d.name = r.name WHERE d.module = 'de.src0' AND r.module = 'en.src1'", "refs", "files"),
    lambda x: insight.dependency_symbols(_defs_by_module(x), _refs_by_module(x), "en.src1", "de.src0").select("n_used", F.array_join("names", ",").alias("names")))


def _usage(x: TableIndex) -> DataFrame:
    mods = _refs_by_module(x).select("module").distinct()
    deps = mods.select("module", F.explode(F.array(*[F.lit(f"de.src{k}") for k in range(4)], *[F.lit(f"en.src{k}") for k in range(4)])).alias("dependency")).filter("module <> dependency").withColumn("dep_kind", F.when(F.endswith("module", F.lit("1")), "api").otherwise("implementation"))
    none = deps.limit(0).select("module", "dependency", F.lit(0).alias("depth"), F.lit("").alias("via"))
    return insight.dependency_usage(deps, _defs_by_module(x), _refs_by_module(x), none)


add("unused_deps", sql(f"""WITH m AS (SELECT DISTINCT module FROM {_srefs}), deps AS (SELECT module, dependency, CASE WHEN module LIKE '%1' THEN 'api' ELSE 'implementation' END AS dep_kind FROM (SELECT module, unnest(['de.src0', 'de.src1', 'de.src2', 'de.src3', 'en.src0', 'en.src1', 'en.src2', 'en.src3']) AS dependency FROM m) WHERE module <> dependency),
  u AS (SELECT r.module, d.module AS dependency, count(DISTINCT r.name) AS n FROM {_srefs} r JOIN {_defs} d ON r.name = d.name GROUP BY ALL)
  SELECT deps.*, coalesce(n, 0)::BIGINT AS n_direct, CASE WHEN n > 0 THEN 'used_direct' WHEN dep_kind = 'api' THEN 'exported' ELSE 'unused' END AS verdict FROM deps LEFT JOIN u USING (module, dependency)""", "refs", "files"), _usage)
add("unused_symbols", sql("SELECT name, kind, line, path FROM located WHERE kind IN ('class', 'interface', 'object', 'enum', 'function') AND string_split(name, ' ')[2] NOT IN (SELECT lower(word) FROM words) ORDER BY path, line, name LIMIT 50", "located", "words"),
    lambda x: insight.unused_symbols(x.located.withColumn("second", F.get(F.split("name", " "), F.lit(1))), x.words.select(F.lower("word").alias("name")), *[x.spark.createDataFrame([], "class_name string")] * 2, exported_only=False, key="second"))
add("unused_resources", sql("SELECT type, name FROM resources WHERE name NOT IN (SELECT word FROM words)", "resources", "words"), lambda x: resources.unused(x.resources, x.words.join(x.resources.select("id", "name"), F.col("word") == F.col("name")).select("id").withColumnRenamed("id", "resource_id"), "resource_id").select("type", "name"))
add("resource_lookup", sql("SELECT w.path AS usage_file, w.line AS usage_line, 'word' AS usage_type FROM words w JOIN resources r ON w.word = r.name WHERE r.type = 'string' AND r.name = 'and' ORDER BY w.path, w.line LIMIT 100", "words", "resources"), lambda x: resources.usages_of_resource(x.words.join(x.resources.select(F.col("id").alias("resource_id"), "name"), F.col("word") == F.col("name")).select("resource_id", F.col("path").alias("usage_file"), F.col("line").alias("usage_line"), F.lit("word").alias("usage_type")), x.resources, "@string/and"))
add("asset_usages", sql("SELECT r.name, w.path AS usage_file, count(*) AS n FROM words w JOIN resources r ON w.word = r.name WHERE r.name ILIKE '%tion%' GROUP BY ALL", "words", "resources"), lambda x: resources.matching_assets(x.words.join(x.resources.select(F.col("id").alias("asset_id"), "name"), F.col("word") == F.col("name")).select("asset_id", F.col("path").alias("usage_file"), F.col("line").alias("usage_line"), F.lit("").alias("usage_type")), x.resources, "tion").groupBy("name", "usage_file").agg(F.count("*").alias("n")))
add("tag_usages", sql("SELECT path, line, regexp_extract(m, '<([a-z][a-z0-9]*)', 1) AS tag FROM (SELECT path, line, unnest(regexp_extract_all(text, '<[a-z][a-z0-9]*')) AS m FROM page_lines)", "page_lines"), lambda x: resources.each_match(x.page_lines, r"<([a-z][a-z0-9]*)", {"tag": 1}))

# --- scans ---
add("regex_scan_limited", sql(r"SELECT path, line, rtrim(text, ' ') AS content FROM lines WHERE regexp_matches(text, 'tion[a-z]* of') ORDER BY path, line LIMIT 50", "lines"), lambda x: scan.scan(x.lines, r"tion[a-z]* of", ("txt",), limit=50))
add("regex_scan_full", sql(r"SELECT path, line, left(trim(text, ' '), 80) AS content FROM lines WHERE regexp_matches(text, '[0-9]{3}')", "lines"), lambda x: scan.scan(x.lines, r"[0-9]{3}", ("txt",), width=80))
add("comment_scan_grouped", sql("SELECT category, path, line, n FROM (SELECT path, line, category, row_number() OVER (PARTITION BY category ORDER BY path, line)::INTEGER AS n FROM (SELECT path, line, CASE WHEN contains(upper(left(rtrim(text, ' '), 80)), 'TODO') THEN 'TODO' WHEN contains(upper(left(rtrim(text, ' '), 80)), 'FIXME') THEN 'FIXME' WHEN contains(upper(left(rtrim(text, ' '), 80)), 'HACK') THEN 'HACK' ELSE 'OTHER' END AS category FROM page_lines WHERE regexp_matches(text, '(?://|#).*(?:example|ad|TODO)'))) WHERE n <= 20", "page_lines"), lambda x: scan.todo(x.page_lines, "example|ad|TODO", ("html",)).select("category", "path", "line", "n"))
add("annotation_scan", sql("SELECT path, line, rtrim(text, ' ') AS content FROM page_lines WHERE contains(text, '@') ORDER BY path, line LIMIT 50", "page_lines"), lambda x: scan.annotations(x.page_lines, "@", ("html",)))
add("scan_minus_definitions", sql(r"SELECT path, line FROM words WHERE word = 'The' AND (path, line) NOT IN (SELECT path, line FROM lines WHERE regexp_matches(text, '(?:class|interface|object|fun|val|var|typealias) The')) GROUP BY ALL", "words"), lambda x: scan.usages(x.lines, "The", ("txt",), None).select("path", "line"))
add("changed_symbols", sql("SELECT path, line, n FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line)::INTEGER AS n FROM lines WHERE path IN (SELECT path FROM files WHERE id % 7 = 0) AND regexp_matches(text, '^[A-Z]')) WHERE n <= 10", "lines", "files"),
    lambda x: scan.scan(x.lines.join(x.files.filter("id % 7 = 0").select("path"), "path", "left_semi"), "^[A-Z]").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).filter("n <= 10").select("path", "line", "n"))

# --- surroundings: events in order ---


def _events(x: TableIndex) -> DataFrame:
    return x.table("events")


def _as_of(x: TableIndex) -> DataFrame:
    e = _events(x).select("user_id", "event_id", "event_type")
    marks = e.filter("event_type = 'purchase'").select("user_id", "event_id")
    defs = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("signup_id"))
    return scan.as_of(marks, defs, ["user_id"], "event_id", "signup_id")


add("enclosing_definition_asof", "SELECT p.user_id, p.event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.event_id <= p.event_id) AS signup_id FROM events p WHERE p.event_type = 'purchase'", _as_of)
add("annotation_forward_join", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), h AS (SELECT a.user_id, a.event_id, a.k, min(b.k) AS hit FROM n a JOIN n b ON a.user_id = b.user_id AND b.k BETWEEN a.k + 1 AND a.k + 5 WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY ALL)
  SELECT user_id, event_id, (hit - k)::INTEGER AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hit ORDER BY k) AS r FROM h) WHERE r = 1""", lambda x: scan.forward_within(F.col("event_type") == "signup", F.col("event_type") == "purchase", _events(x), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "gap"))
add("context_window", sql("SELECT path, line, array_to_string(list(text) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS context FROM lines", "lines"), lambda x: scan.context_lines(x.lines).select("path", "line", "context"))
add("call_tree", "SELECT (8 - turn)::INTEGER AS depth, 't' || turn AS callee, 't' || (turn - 1) AS caller, role AS path, false AS recursive FROM (SELECT DISTINCT turn, role FROM conversations WHERE turn BETWEEN 4 AND 7)", lambda x: graph.call_tree(_turns(x), "t7", 4))


def _turns(x: TableIndex) -> DataFrame:
    c = x.table("conversations")
    name = lambda d: F.concat(F.lit("t"), d.cast("string"))
    return c.filter("turn > 0").select(name(F.col("turn") - 1).alias("caller"), name(F.col("turn")).alias("callee"), F.col("role").alias("path")).distinct()


# --- reports ---
_suf = ("widget", "bolt", "gear", "nut", "valve", "cog", "rod", "pin")
add("suffix_conventions", sql("SELECT s AS suffix, count(*) AS n FROM symbols JOIN (SELECT unnest([" + ", ".join(f"'{s}'" for s in _suf) + "]) AS s) ON name ILIKE '%' || s WHERE kind IN ('class', 'interface', 'enum', 'object') GROUP BY s HAVING count(*) >= 3", "symbols"), lambda x: insight.suffix_counts(x.symbols, _suf))
add("import_union_counts", sql("SELECT name, count(*) AS n FROM (SELECT name FROM refs WHERE context ILIKE 'in%' UNION ALL SELECT name FROM symbols WHERE kind = 'property') GROUP BY name", "refs", "symbols"), lambda x: insight.import_counts(x.refs.withColumn("context", F.when(tx.like(F.col("context"), "in%"), F.lit("import"))), x.symbols.withColumn("kind", F.when(F.col("kind") == "property", "import"))))
_rules = [("org/de", "lang", "German"), ("example.org", "host", "Org"), ("example.net", "host", "Net"), ("example", "host", "Other"), ("http", "scheme", "Web")]
add("framework_rules", "SELECT category, label, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{c}'" for p, c, _ in _rules) + " END AS category, CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{t}'" for p, _, t in _rules) + " END AS label FROM pages) WHERE category IS NOT NULL GROUP BY ALL", lambda x: insight.first_rule(x.table("pages").select("url", F.lit(1).cast("bigint").alias("n")), _rules, "url"))
add("architecture_markers", sql("SELECT 'multilingual' AS label FROM files HAVING bool_or(path LIKE 'en/%') AND bool_or(path LIKE 'de/%') UNION ALL SELECT 'hot source' FROM files HAVING bool_or(contains(path, '/src0/'))", "files"), lambda x: insight.architecture(x.files, [("multilingual", ["/en/", "/de/"]), ("hot source", ["/src0/"]), ("absent", ["/en/", "/nowhere/"])]))
add("stats", sql(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("files", "symbols", "refs", "inheritance", "modules", "module_deps", "resources")), "files", "symbols", "refs", "inheritance", "modules", "module_deps", "resources"), lambda x: insight.stats(x.tables()))


# --- SQL ---
def _sql(text: str) -> Callable[[TableIndex], DataFrame]:
    def make(x: TableIndex) -> DataFrame:
        plain_sql.register(x.tables())
        return plain_sql.query(x.spark, text, 1_000_000)

    return make


_hot = "SELECT f.path, count(*) AS n FROM symbols s JOIN files f ON s.file_id = f.id GROUP BY f.id, f.path ORDER BY n DESC, f.path LIMIT 20"
add("sql_hotspots", sql(_hot, "symbols", "files"), _sql(_hot))
_not = "SELECT s.name, s.kind FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.kind IN ('class', 'interface') AND s.name NOT IN (SELECT name FROM refs) AND s.name NOT IN (SELECT parent_name FROM inheritance)"
add("sql_not_in", sql(_not, "symbols", "files", "refs", "inheritance"), _sql(_not))
_chain = "chain AS (SELECT dep_module_id AS id, 1 AS depth FROM module_deps WHERE module_id = 1000 UNION ALL SELECT d.dep_module_id, c.depth + 1 FROM chain c JOIN module_deps d ON d.module_id = c.id WHERE c.depth < 4) SELECT DISTINCT m.name, c.depth FROM chain c JOIN modules m ON c.id = m.id"
add("sql_recursive_chain", sql(f"WITH {_chain}", "module_deps", "modules", recursive=True), _sql(f"WITH RECURSIVE {_chain}"))
_win = "SELECT kind, name, n FROM (SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS r FROM symbols GROUP BY kind, name) WHERE r <= 3"
add("sql_window", sql(_win, "symbols"), _sql(_win))

# --- keeping an index ---


def _diff(x: TableIndex) -> DataFrame:
    now = x.files.filter("id % 5 <> 0").select("path", (F.col("mtime") + F.when(F.col("id") % 3 == 0, 10).otherwise(0)).alias("mtime"))
    changed, deleted = build.differences(now, x.files.filter("id % 4 <> 0"))
    return changed.select("path", F.lit("changed").alias("state")).unionByName(deleted.select("path", F.lit("deleted").alias("state")))


add("incremental_diff", sql("SELECT path, CASE WHEN id % 5 = 0 THEN 'deleted' ELSE 'changed' END AS state FROM files WHERE (id % 5 <> 0 AND (id % 4 = 0 OR id % 3 = 0)) OR (id % 5 = 0 AND id % 4 <> 0)", "files"), _diff)
add("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'", lambda x: build.latest(x.table("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_id", "event_type"))


def _watch(x: TableIndex) -> DataFrame:
    """A file stream of events run to its end; of the changes that its batches hand on, the last of each user counts."""
    from ..streaming.watch import watch

    schema, kept = x.table("events").schema, new_path(x.spark, "watched")
    stream = x.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(x.sf_dir)
    changes = stream.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("mtime"), "event_type")
    q = watch(changes, lambda batch, n: batch.write.mode("overwrite").parquet(f"{kept}/batch={n}"), new_path(x.spark, "watch-checkpoint"), once=True)
    q.awaitTermination()
    last = build.latest(x.spark.read.parquet(kept).drop("batch"), "path", ["mtime"], "false")
    return last.select(F.col("path").cast("bigint").alias("user_id"), F.col("mtime").alias("event_id"), "event_type")


add("watch_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id", _watch)

#: Columns and types of two relations, as they are fixed by the index's schema.
_SCHEMA = {"inheritance": [("child_id", "bigint"), ("parent_name", "string"), ("kind", "string")], "module_deps": [("module_id", "bigint"), ("dep_module_id", "bigint"), ("dep_kind", "string")]}
add("schema", sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS type, {i} AS position, (SELECT count(*) FROM {t}) AS n_rows" for t, cs in _SCHEMA.items() for i, (c, k) in enumerate(cs)), "inheritance", "module_deps"), lambda x: plain_sql.schema(x.spark, {t: x.tables()[t] for t in _SCHEMA}))

QUERIES |= code_queries.QUERIES
ORACLE |= code_queries.ORACLE
