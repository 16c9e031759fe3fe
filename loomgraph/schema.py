"""Schemas of the relations that operators work on."""

NODES = (
    "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, source_code string, docstring string, "
    "signature string, hash string, metadata string, summary string, role string, side_effects array<string>, semantic_inputs array<string>, "
    "semantic_outputs array<string>, annotation_hash string, metrics struct<method_count:int,lines:int,public_methods:int,private_methods:int,"
    "dependency_count:int,dependencies:array<string>,internal_calls:int,method_prefixes:map<string,int>,percentile_rank:double>"
)
EDGES = "seq bigint, id string, from_node string, to_node string, type string, line_number int, column int, confidence string, source string, untracked_reason string, metadata string"
CHANGES = (
    "id bigint, timestamp timestamp, node_id string, action string, old_source string, new_source string, old_hash string, new_hash string, "
    "affected_nodes array<string>, description string, reasoning string, file_path string"
)
NOTES = "key string, value string, updated_at timestamp"
RULES = "id string, type string, description string, from_pattern string, to_pattern string, pattern string, threshold int"
TRACE = "edges array<struct<`from`:string,`to`:string,count:bigint>>, total_calls bigint, unique_edges bigint"
FILES = "path string, mtime double, size bigint"
COVERAGE = "files map<string,struct<executed_lines:array<int>>>"
