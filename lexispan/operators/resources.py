"""Layouts, resources, storyboards and assets: extraction from lines, and the questions asked of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, like
from ..shared import shuffled

NAMED = ("drawable", "mipmap", "layout")
VALUES = ("string", "color", "dimen", "style")


def each_match(lines: DataFrame, pattern: str, names: dict[str, int], *keep: str) -> DataFrame:
    """One row for each match of a pattern in a line, with its groups and what is kept of the line."""
    found = lines.withColumn("_m", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)))
    return found.select("path", "line", *keep, *[F.regexp_extract("_m", pattern, g).alias(c) for c, g in names.items()])


def xml_usages(lines: DataFrame) -> DataFrame:
    """Classes that layouts name: as tags with dots, in class attributes, as fragments."""
    ident = F.regexp_extract("text", r"""android:id="@\+?id/(\w+)\"""", 1)
    xml = lines.filter(extension(F.col("path")) == "xml").withColumn("element_id", F.nullif(ident, F.lit("")))
    tags = each_match(xml, r"<([a-z][\w]*(?:\.\w+)+)", {"class_name": 1}, "element_id").withColumn("usage_type", F.lit("view_tag"))
    attrs = each_match(xml, r"""\b(class|android:name)="([\w.]+)\"""", {"attr": 1, "class_name": 2}, "element_id").filter(F.contains("class_name", F.lit(".")))
    attrs = attrs.withColumn("usage_type", F.when(F.col("attr") == "class", "view_class_attr").otherwise("fragment")).drop("attr")
    return tags.unionByName(attrs)


def resource_definitions(files: DataFrame, lines: DataFrame) -> DataFrame:
    """type, name, path, line: files by their stem, and the first value of each line of values files."""
    stem = F.regexp_extract("path", r"/([^/]+?)(?:\.9)?\.[^./]+$", 1)
    kind = F.regexp_extract("path", r"/res/(drawable|mipmap|layout)[^/]*/[^/]+$", 1)
    by_file = files.select(kind.alias("type"), stem.alias("name"), "path", F.lit(None).cast("int").alias("line")).filter("type <> ''")
    p = r"""<(string|color|dimen|style)\s+name="([^"]+)\""""
    values = lines.filter(F.col("path").rlike(r"/res/values[^/]*/[^/]+\.xml$") & F.col("text").rlike(p))
    return by_file.unionByName(values.select(F.regexp_extract("text", p, 1).alias("type"), F.regexp_extract("text", p, 2).alias("name"), "path", "line"))


def resource_usages(lines: DataFrame, resources: DataFrame, extensions: tuple[str, ...] = ("kt", "java", "xml")) -> DataFrame:
    """Uses of known resources: R.type.name in code, @type/name elsewhere; of several resources of one name the last id counts."""
    code = each_match(lines.filter(extension(F.col("path")).isin("kt", "java")), r"\bR\.(\w+)\.(\w+)", {"type": 1, "name": 2}).withColumn("usage_type", F.lit("code"))
    xml = each_match(lines.filter(extension(F.col("path")).isin(*extensions)), r"@(?:\+)?(\w+)/([\w.]+)", {"type": 1, "name": 2}).withColumn("usage_type", F.lit("xml"))
    known = resources.groupBy("type", "name").agg(F.max("id").alias("resource_id"))
    return code.unionByName(xml).join(shuffled(known), ["type", "name"]).select("resource_id", F.col("path").alias("usage_file"), F.col("line").alias("usage_line"), "usage_type")


def parse_resource(text: str) -> tuple[str, str]:
    """(type, name) of what a user writes for a resource."""
    if m := re.fullmatch(r"@(?:\+)?(\w+)/([\w.]+)", text) or re.fullmatch(r"R\.(\w+)\.(\w+)", text):
        return m[1], m[2]
    for start, kind in (("ic_", "drawable"), ("img_", "drawable"), ("color_", "color")):
        if text.startswith(start):
            return kind, text
    return "string", text


def usages_of_resource(usages: DataFrame, resources: DataFrame, text: str, module: str | None = None, limit: int = 100) -> DataFrame:
    kind, name = parse_resource(text)
    own = resources.filter((F.col("type") == kind) & (F.col("name") == name)).select(F.col("id").alias("resource_id"))
    df = usages.join(own, "resource_id").filter(like(F.col("usage_file"), f"%{module}%") if module else F.lit(True))
    return df.select("usage_file", "usage_line", "usage_type").orderBy("usage_file", "usage_line", "usage_type").limit(limit)


def unused(things: DataFrame, usages: DataFrame, key: str) -> DataFrame:
    """Things (resources, assets) without a use."""
    return things.join(usages.select(F.col(key).alias("id")), "id", "left_anti")


def with_module(usages: DataFrame, modules: DataFrame, module: str | None = None, limit: int = 100) -> DataFrame:
    """Usages with their module's name; those without a module are left out. The limit holds only when no module is named."""
    df = usages.join(modules.select(F.col("id").alias("module_id"), F.col("name").alias("module")), "module_id")
    if module:
        return df.filter(F.col("module") == module)
    return df.orderBy("module", "file_path", "line", "class_name").limit(limit)


def storyboard_usages(lines: DataFrame) -> DataFrame:
    p = r"""customClass="([^"]+)\""""
    kind = F.lit("other")
    for part, name in (("view", "view"), ("cell", "cell"), ("viewController", "viewController")):
        kind = F.when(F.contains(F.lower("text"), F.lit(part.lower())), name).otherwise(kind)
    df = lines.filter(extension(F.col("path")).isin("storyboard", "xib") & F.col("text").rlike(p))
    return df.select("path", "line", F.regexp_extract("text", p, 1).alias("class_name"), kind.alias("usage_type"), F.nullif(F.regexp_extract("text", r"""\bid="([^"]+)\"""", 1), F.lit("")).alias("storyboard_id"))


def ios_assets(paths: DataFrame) -> DataFrame:
    p = r"([^/]+)\.(imageset|colorset|appiconset|launchimage|dataset)(?:/|$)"
    return paths.filter(F.col("path").rlike(p)).select(F.regexp_extract("path", p, 2).alias("type"), F.regexp_extract("path", p, 1).alias("name"), F.regexp_extract("path", r"^(.*?\.(?:imageset|colorset|appiconset|launchimage|dataset))(?:/|$)", 1).alias("path")).distinct()


def asset_usages(lines: DataFrame, assets: DataFrame) -> DataFrame:
    p = r"""\b(UIImage|UIColor|Image|Color)\(\s*(?:named:\s*)?"([^"]+)\""""
    found = each_match(lines.filter(extension(F.col("path")) == "swift"), p, {"usage_type": 1, "name": 2})
    return found.join(assets.groupBy("name").agg(F.max("id").alias("asset_id")), "name").select("asset_id", F.col("path").alias("usage_file"), F.col("line").alias("usage_line"), "usage_type")


def matching_assets(usages: DataFrame, assets: DataFrame, name: str) -> DataFrame:
    own = assets.filter(like(F.col("name"), f"%{name}%")).select(F.col("id").alias("asset_id"), "name", "type")
    return usages.join(own, "asset_id").select("name", "type", "usage_file", "usage_line", "usage_type")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
