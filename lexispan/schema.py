"""Relations of a code index."""

from __future__ import annotations

TABLES = {
    "files": "id BIGINT, path STRING, mtime BIGINT, size BIGINT",
    "symbols": "id BIGINT, file_id BIGINT, name STRING, kind STRING, line INT, parent_id BIGINT, signature STRING",
    "refs": "id BIGINT, file_id BIGINT, name STRING, line INT, context STRING",
    "inheritance": "id BIGINT, child_id BIGINT, parent_name STRING, kind STRING",
    "modules": "id BIGINT, name STRING, path STRING, kind STRING",
    "module_deps": "id BIGINT, module_id BIGINT, dep_module_id BIGINT, dep_kind STRING",
    "transitive_deps": "id BIGINT, module_id BIGINT, dependency_id BIGINT, depth INT, path STRING",
    "xml_usages": "id BIGINT, module_id BIGINT, file_path STRING, line INT, class_name STRING, usage_type STRING, element_id STRING",
    "resources": "id BIGINT, module_id BIGINT, type STRING, name STRING, file_path STRING, line INT",
    "resource_usages": "id BIGINT, resource_id BIGINT, usage_file STRING, usage_line INT, usage_type STRING",
    "storyboard_usages": "id BIGINT, module_id BIGINT, file_path STRING, line INT, class_name STRING, usage_type STRING, storyboard_id STRING",
    "ios_assets": "id BIGINT, module_id BIGINT, type STRING, name STRING, file_path STRING",
    "ios_asset_usages": "id BIGINT, asset_id BIGINT, usage_file STRING, usage_line INT, usage_type STRING",
    "metadata": "key STRING, value STRING",
}
KINDS = ("class", "interface", "object", "enum", "function", "property", "typealias", "package", "constant", "import", "annotation")
CLASS_LIKE = ("class", "interface", "object", "enum", "protocol", "struct", "actor", "package")
LINES = "path STRING, line INT, text STRING"
PARSED = "name STRING, kind STRING, line INT, signature STRING, parents ARRAY<STRUCT<name: STRING, kind: STRING>>"
