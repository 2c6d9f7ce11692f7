"""Look-ups over symbols, files, references and inheritance. Every limit follows a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cut_to, extension, like, parse_search, phrase_match
from ..schema import CLASS_LIKE

SYMBOL = ("name", "kind", "line", "signature", "path")


def located(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path."""
    return symbols.withColumnRenamed("id", "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def ordered(df: DataFrame, limit: int | None, *first: Column) -> DataFrame:
    keys = [*first, *[F.col(c) for c in ("path", "line", "name", "symbol_id") if c in df.columns]]
    return df.orderBy(*keys).limit(limit) if limit is not None else df


def scope(path: Column, directory: str | None = None, in_file: str | None = None, module: str | None = None) -> Column:
    """Paths below a directory, ending in a file name, below a module's path."""
    out = F.lit(True)
    for pattern in ([f"{directory}%"] if directory else []) + ([f"%{in_file}"] if in_file else []) + ([f"{module}%"] if module else []):
        out = out & like(path, pattern)
    return out


def by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    df = symbols.filter(F.col("name") == name)
    return df.filter(F.col("kind") == kind) if kind else df


def exact_or_prefix(located_symbols: DataFrame, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Exact matches, and only if there are none, those that begin with the name, shortest first. One pass: the best rank wins."""
    rank = F.when(F.col("name") == name, 0).when(like(F.col("name"), f"{name}%"), 1)
    df = located_symbols.withColumn("rank", rank).filter("rank IS NOT NULL")
    df = df.filter(F.col("kind") == kind) if kind else df
    best = df.agg(F.min("rank").alias("rank"))  # one row
    return ordered(df.join(F.broadcast(best), "rank"), limit, F.length("name")).select(*SYMBOL)


def class_like(located_symbols: DataFrame, name: str, limit: int = 20, **where) -> DataFrame:
    df = located_symbols.filter((F.col("name") == name) & F.col("kind").isin(*CLASS_LIKE) & scope(F.col("path"), **where))
    return ordered(df, limit).select(*SYMBOL)


def files_containing(files: DataFrame, text: str, limit: int | None = 20) -> DataFrame:
    df = files.filter(like(F.col("path"), f"%{text}%")).select("path")
    return df.orderBy("path").limit(limit) if limit is not None else df


def fuzzy(located_symbols: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names that contain the text: exact (case counts), then prefixes, then the rest, each by length."""
    rank = F.when(F.col("name") == text, 0).when(like(F.col("name"), f"{text}%"), 1).otherwise(2)
    return ordered(located_symbols.filter(like(F.col("name"), f"%{text}%")), limit, rank, F.length("name")).select(*SYMBOL)


def full_text(located_symbols: DataFrame, query: str, limit: int | None = 20, **where) -> DataFrame:
    phrase, prefix = parse_search(query)
    df = located_symbols.filter((phrase_match(F.col("name"), phrase, prefix) | phrase_match(F.col("signature"), phrase, prefix)) & scope(F.col("path"), **where))
    return ordered(df, limit).select(*SYMBOL)


def scoped_by_name(located_symbols: DataFrame, name: str, kind: str | None = None, limit: int = 20, **where) -> DataFrame:
    """Exact names within a scope; no prefixes here."""
    return ordered(by_name(located_symbols, name, kind).filter(scope(F.col("path"), **where)), limit).select(*SYMBOL)


#: Files whose lines a search reads; fixed values.
SEARCHED = ("kt", "java", "swift", "m", "h", "py", "go", "rs", "cpp", "c", "proto")


def universal(files: DataFrame, located_symbols: DataFrame, lines: DataFrame, text: str, limit: int = 20, extensions: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Paths, symbols (by full text, as prefixes) and line contents that match, tagged by section."""
    paths = files_containing(files, text, limit).select(F.lit("file").alias("section"), "path", F.lit(0).alias("line"), F.col("path").alias("text"))
    found = full_text(located_symbols, text.rstrip("*") + "*", limit).select(F.lit("symbol").alias("section"), "path", "line", F.col("name").alias("text"))
    content = lines.filter(F.contains("text", F.lit(text)) & extension(F.col("path")).isin(*extensions)).orderBy("path", "line").limit(limit)
    content = content.select(F.lit("content").alias("section"), "path", "line", cut_to(F.col("text"), 100).alias("text"))
    return paths.unionByName(found).unionByName(content)


def references(refs: DataFrame, files: DataFrame, name: str, limit: int | None = 20, **where) -> DataFrame:
    df = refs.filter(F.col("name") == name).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").filter(scope(F.col("path"), **where))
    df = df.select("name", "line", "context", "path")
    return df.orderBy("path", "line", "context").limit(limit) if limit is not None else df


def implementations(inheritance: DataFrame, located_symbols: DataFrame, parent: str, limit: int = 20) -> DataFrame:
    """Children of a parent: exact, then qualified by it, then containing it."""
    p = F.col("parent_name")
    rank = F.when(p == parent, 0).when(like(p, f"%.{parent}"), 1).otherwise(2)
    hits = inheritance.filter((p == parent) | like(p, f"%.{parent}") | like(p, f"%{parent}%")).select(F.col("child_id").alias("symbol_id"), "parent_name", rank.alias("rank"))
    return ordered(hits.join(located_symbols, "symbol_id"), limit, F.col("rank"), F.col("name")).select(*SYMBOL)


def parents(inheritance: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    own = symbols.filter(F.col("name") == name).select(F.col("id").alias("child_id"))
    return inheritance.join(own, "child_id").select("parent_name", "kind").distinct()


def hierarchy(inheritance: DataFrame, symbols: DataFrame, located_symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """One level up and one down, tagged by direction."""
    up = parents(inheritance, symbols, name).select(F.lit("parent").alias("direction"), F.col("parent_name").alias("name"), "kind", F.lit(None).cast("string").alias("path"))
    down = implementations(inheritance, located_symbols, name, limit).select(F.lit("child").alias("direction"), "name", "kind", "path")
    return up.unionByName(down)


def cross_references(located_symbols: DataFrame, refs: DataFrame, files: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Definitions (with prefixes if there is no exact one), imports and usages of a name, each limited."""
    empty = F.lit("").alias("text")
    out = []
    for section, df in (("definition", located_symbols.filter("kind <> 'import'")), ("import", by_name(located_symbols, name, "import"))):
        found = exact_or_prefix(df, name, None, limit) if section == "definition" else ordered(df, limit).select(*SYMBOL)
        out.append(found.select(F.lit(section).alias("section"), "name", "path", "line", empty))
    out.append(references(refs, files, name, limit).select(F.lit("usage").alias("section"), "name", "path", "line", F.col("context").alias("text")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def reference_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("name").agg(F.count("*").alias("n"))


def modules_matching(modules: DataFrame, text: str, limit: int = 20) -> DataFrame:
    df = modules.filter(like(F.col("name"), f"%{text}%") | like(F.col("path"), f"%{text}%"))
    return df.orderBy("name").limit(limit)


def top_of_each(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the rank's limit is applied before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
