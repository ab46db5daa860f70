"""Schemas of the catalog's tables, the value sets they draw on, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TYPES = ("FUNCTION", "CLASS", "METHOD", "ARROW_FUNCTION", "MODULE", "INTERFACE", "ENUM", "TYPE_ALIAS", "STRUCT", "TRAIT", "IMPL_BLOCK")
PATTERN_TYPES = ("API_ENDPOINT", "API_CALL", "DATABASE_READ", "DATABASE_WRITE", "EXTERNAL_SERVICE", "ENV_VARIABLE", "IMPORT", "EXPORT")
IMPORT_TYPES = ("NAMED", "DEFAULT", "NAMESPACE", "DYNAMIC", "PACKAGE", "MODULE", "WILDCARD")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: Units with a body that runs, and units with fields.
CALLABLE_TYPES = ("FUNCTION", "ARROW_FUNCTION", "METHOD")
FIELD_TYPES = ("CLASS", "INTERFACE", "TYPE_ALIAS", "STRUCT", "ENUM")

COMPLEXITY = (
    "struct<conditionals:int,loops:int,max_nesting_depth:int,try_catch_blocks:int,"
    "async_patterns:int,callback_depth:int,parameter_count:int,line_count:int>"
)
ACCESS = "struct<read:array<string>,write:array<string>>"

#: Catalog tables as DDL strings.
TABLES = {
    "files": "file_path string, content string, seq long, sha256 string, language string",
    "code_units": "id string, file_path string, name string, unit_type string, line_start int, line_end int, parent_unit_id string, "
    f"signature string, is_async boolean, is_exported boolean, language string, complexity {COMPLEXITY}, complexity_score double, seq long",
    "code_unit_patterns": f"id string, code_unit_id string, pattern_type string, pattern_value string, line_number int, column_access {ACCESS}, seq long",
    "module_patterns": "id string, file_path string, pattern_type string, pattern_value string, line_number int, seq long",
    "file_dependencies": "id string, source_file string, target_file string, import_type string, imported_names array<string>, seq long",
    "env_variables": "id string, name string, description string, has_default boolean, line_number int",
    "file_hashes": "file_path string, hash string, last_analyzed timestamp",
    "analysis_results": "id long, success boolean, error string, files_processed long, code_units long, patterns long, dependencies long, duration long, created_at timestamp",
    "function_calls": "id string, caller_unit_id string, callee_name string, callee_file_path string, callee_unit_id string, line_number int, is_async boolean, seq long",
    "type_fields": "id string, parent_unit_id string, name string, field_type string, is_optional boolean, is_readonly boolean, line_number int",
    "event_flows": "id string, code_unit_id string, event_name string, direction string, framework string, line_number int",
    "guard_clauses": "id string, code_unit_id string, guard_type string, condition string, line_number int",
    "schema_models": "id string, name string, file_path string, framework string, table_name string",
    "schema_model_fields": "id string, model_id string, name string, field_type string, is_primary_key boolean, is_required boolean, is_unique boolean, has_default boolean, relation_target string",
    "file_clusters": "id string, name string, cohesion double, internal_edges long, external_edges long",
    "file_cluster_members": "cluster_id string, file_path string, is_entry_point boolean",
    "pattern_templates": "id string, name string, description string, pattern_types array<string>, template_unit_id string, template_file_path string, follower_count long, conventions array<string>",
    "pattern_template_followers": "template_id string, file_path string, unit_name string",
}

#: Child tables and the column that points at a code unit.
UNIT_CHILDREN = {
    "code_unit_patterns": "code_unit_id",
    "function_calls": "caller_unit_id",
    "type_fields": "parent_unit_id",
    "event_flows": "code_unit_id",
    "guard_clauses": "code_unit_id",
    "pattern_templates": "template_unit_id",
}

#: Upsert keys: the last row by ``seq`` wins.
UPSERT_KEYS = {"file_dependencies": ("source_file", "target_file"), "env_variables": ("name",), "file_hashes": ("file_path",)}


def stable_id(*parts: str | Column) -> Column:
    """An id that a retried task computes again: a digest of what identifies the row."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
