"""The property graph's schema: node and edge types, their columns, and fixed tables."""

from __future__ import annotations

from pyspark.sql import types as T

# File extension -> language, and the keywords of the query language -> node type.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".md": "markdown", ".mdx": "markdown",
}
NODE_KEYWORDS = {
    "function": "Function", "method": "Method", "class": "Class", "file": "File", "interface": "Interface",
    "type": "TypeAlias", "endpoint": "ApiEndpoint", "model": "DbModel", "test": "Test", "config": "ConfigFile",
    "directory": "Directory",
}
NODE_TYPES = (
    "File", "Directory", "Class", "Function", "Method", "Interface", "TypeAlias", "ApiEndpoint", "DbModel", "Test", "ConfigFile",
)
SYMBOL_TYPES = ("Method", "Function", "Test", "ApiEndpoint", "DbModel", "Class", "Interface", "TypeAlias")

_CALLABLE = ("Function", "Method")
# Which (source type, target type) pairs an edge type admits.
ALLOWED_PAIRS = (
    [("CONTAINS", "Directory", d) for d in ("File", "Directory")]
    + [("CONTAINS", "File", d) for d in ("Class", "Function", "Interface", "TypeAlias", "DbModel", "Test", "ConfigFile")]
    + [("CONTAINS", "Class", "Method"), ("IMPORTS", "File", "File"), ("INHERITS", "Class", "Class"), ("IMPLEMENTS", "Class", "Interface")]
    + [("CALLS", s, d) for s in _CALLABLE for d in _CALLABLE]
    + [(e, s, "DbModel") for e in ("READS_FROM", "WRITES_TO") for s in _CALLABLE]
    + [("TESTED_BY", s, "Test") for s in (*_CALLABLE, "Class")]
    + [("EXPOSES_ENDPOINT", s, "ApiEndpoint") for s in _CALLABLE]
    + [("DEFINES", "File", d) for d in ("Function", "Class", "Interface", "TypeAlias")]
)
SCHEMA_VERSION = 3

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
_TYPES |= {"array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(columns: str) -> T.StructType:
    """'name type, ..' as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


FILES = struct(
    "repo_id string, rel_path string, language string, extension string, size_bytes bigint, content binary, content_hash string, modified_ns bigint"
)
#: What a listing tells of a file, and what the store remembers of one that was indexed.
LISTED = T.StructType([f for f in FILES if f.name not in ("content", "content_hash")])
INDEXED_FILES = struct("repo_id string, file_path string, size_bytes bigint, modified_ns bigint, content_hash string")
NODES = struct(
    "repo_id string, node_id string, node_type string, name string, fqn string, language string, docstring string, tags array<string>,"
    "change_frequency double, centrality_score double, importance_score double, last_modified_commit string,"
    "file_path string, start_line int, end_line int, extension string, size_bytes bigint, content_hash string, dir_path string,"
    "is_abstract boolean, decorator_names array<string>, bases array<string>, signature string, is_async boolean, is_generator boolean,"
    "return_type string, parameter_names array<string>, class_fqn string, is_static boolean, is_classmethod boolean, is_property boolean,"
    "extends array<string>, type_expression string, http_method string, path_pattern string, framework string, table_name string,"
    "orm_framework string, fields array<string>, test_framework string, is_parametrized boolean, targets array<string>, format string,"
    "file_ord string, node_ord int"
)
RAW_EDGES = struct(
    "repo_id string, edge_id string, edge_type string, src_id string, dst_ref string, confidence double, imported_names array<string>,"
    "is_dynamic boolean, is_conditional boolean, is_mixin boolean, access_pattern string, file_path string, edge_ord int"
)
EDGES = T.StructType([f for f in RAW_EDGES if f.name not in ("dst_ref", "edge_ord")] + [T.StructField("dst_id", T.StringType())])
#: Who defines a text (role id, fqn, name or path) and whose edges refer to one (role ref or base).
KEYS = struct("repo_id string, key string, role string, file_path string, node_id string, node_type string, file_ord string, node_ord int")
#: The trigrams of nodes' names and fqns.
GRAMS = struct("repo_id string, gram string, file_path string, node_id string")
EMBEDDINGS = struct(
    "repo_id string, node_id string, embedding array<float>, document string, node_type string, fqn string, file_path string, language string, importance_score double"
)
