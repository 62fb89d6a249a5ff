"""Fixed schemas of the stored tables."""

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
TEXT_MAP = T.MapType(T.StringType(), T.StringType())

FRAMES = T.StructType([
    T.StructField("frame_id", T.LongType()), T.StructField("ts_ms", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("metadata", TEXT_MAP), T.StructField("tags", T.ArrayType(TAG)),
    T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("supersedes", T.LongType()), T.StructField("superseded_by", T.LongType()),
])
MUTATIONS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("other_id", T.LongType()),
    T.StructField("ts_ms", T.LongType()), T.StructField("text", T.StringType()), T.StructField("metadata", TEXT_MAP), T.StructField("vector", T.ArrayType(T.FloatType())),
])
FACT_OPS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("attribute", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("metadata", TEXT_MAP), T.StructField("id", T.LongType()), T.StructField("supersedes", T.LongType()),
    T.StructField("ts_ms", T.LongType()), T.StructField("pinned", T.BooleanType()),
])
CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("relative_path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("token_estimate", T.IntegerType()), T.StructField("content_hash", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("text", T.StringType()),
])
_PIN = T.StructType([T.StructField(n, T.StringType()) for n in "pin_id name direction type_cat type_sub type_obj default_value default_object default_text".split()] + [T.StructField("is_array", T.BooleanType())])
_REF = T.StructType([T.StructField(n, T.StringType()) for n in "member_name member_parent member_guid".split()])
_NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in "node_guid class_path title comment".split()]
    + [T.StructField("pos_x", T.IntegerType()), T.StructField("pos_y", T.IntegerType()), T.StructField("function", _REF), T.StructField("event_ref", _REF)]
    + [T.StructField("variable_ref", T.StringType()), T.StructField("macro_ref", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in "custom_function_name var_name cast_target".split()]
    + [T.StructField("pins", T.ArrayType(_PIN))]
)
_LINK = T.StructType([T.StructField(n, T.StringType()) for n in "from_node_guid from_pin_id from_pin_name to_node_guid to_pin_id to_pin_name".split()])
_GRAPH = T.StructType([T.StructField(n, T.StringType()) for n in "name graph_guid schema_class".split()] + [T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("links", T.ArrayType(_LINK))])
_VARIABLE = T.StructType([T.StructField(n, T.StringType()) for n in "var_name var_guid default_value".split()] + [T.StructField("var_type", T.StructType([T.StructField("category", T.StringType()), T.StructField("sub_category", T.StringType())]))])
#: Graph documents; ``variable_ref`` and ``macro_ref`` stay JSON or plain text, since exports differ.
GRAPH_DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in "blueprint asset_path asset_name asset_class asset_kind".split()] + [T.StructField("graphs", T.ArrayType(_GRAPH)), T.StructField("variables", T.ArrayType(_VARIABLE))])
