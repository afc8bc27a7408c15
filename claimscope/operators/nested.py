"""Deeply nested JSON as related flat tables.

Texts become VARIANT values in the JVM. A record is walked inside its row, level by level: each step replaces the open
containers by their child containers and adds the objects met to those found, so that scalars and finished objects
are touched once and nothing is copied between rows. One explode at the end gives every object with its path, the
path of the object around it, and its ordinals in the arrays between the two. The merged schema (every structural path,
array positions replaced by [], with the kinds of value met there) decides which flat tables there are and which
columns they have: one table per structural path, each with the surrogate keys of row and parent and the ordinals.

Defined results: null, empty, cut-off or otherwise unreadable JSON gives no rows; a JSON string that holds JSON
counts as the JSON it holds, however often it was wrapped; empty objects are rows, empty arrays are not; a top-level
array or scalar has no objects of its own but its objects hang on `$`. Repeated records count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "struct<path:string,parent_path:string,ordinals:array<int>,v:variant>"
_FOUND = "struct<path:string,parent_path:string,ordinals:array<int>>"


def opened(text: Column) -> Column:
    """The JSON text itself, or the one that a JSON string holds, null where such a string can't be read. Each wrapping
    doubles the escapes, so the logarithm of the length bounds their number."""
    wrapped = lambda t: t.rlike(r'^[ \t\r\n]*"')
    times = F.sequence(F.lit(1), F.ceil(F.log2(F.char_length(text) + 1)).cast("int") + 1)
    inner = F.aggregate(times, text, lambda t, _: F.when(wrapped(t), F.try_variant_get(F.try_parse_json(t), "$", "string")).otherwise(t))
    return F.when(wrapped(text), inner).otherwise(text)


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text, null where it can't be read; strings that hold JSON are opened."""
    return F.try_parse_json(opened(text))


def with_object(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text is a JSON object, opened."""
    return df.withColumn(text, opened(F.col(text))).filter(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"))


def documents(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., v, containers): the readable JSON of each record, repeats once; containers: at most so many levels."""
    # parsing costs far more than its bytes show, so the number of partitions is stated: adaptive execution would merge
    # them by size. Every later removal of repeats by these keys needs no shuffle of its own.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = df.select(*keys, F.col(text).alias("_json")).filter(F.col("_json").isNotNull()).repartition(parts, *keys).distinct()
    plain = unique.select(*keys, opened(F.col("_json")).alias("_json"))
    n = F.char_length("_json") - F.char_length(F.translate("_json", "{[", ""))
    return plain.select(*keys, F.try_parse_json("_json").alias("v"), n.alias("containers")).filter(F.col("v").isNotNull() & ~F.is_variant_null("v"))


def _walk(carry: bool) -> str:
    """The objects of `v` as an array, by an aggregate over the levels. carry: with their values."""
    own, kind = ("e.path, e.parent_path, e.ordinals" + (", e.v" if carry else "")), (_NODE if carry else _FOUND)
    return f"""aggregate(
        sequence(0, containers),
        CAST(struct(array(struct('$', CAST(NULL AS string), CAST(array() AS array<int>), v)), array()) AS struct<open:array<{_NODE}>,found:array<{kind}>>),
        (acc, level) -> CASE WHEN size(acc.open) = 0 THEN acc ELSE aggregate(array(0),
            struct(transform(acc.open, n -> struct(n.path AS path, n.parent_path AS parent_path, n.ordinals AS ordinals, n.v AS v,
                try_variant_get(n.v, '$', 'map<string,variant>') AS o, try_variant_get(n.v, '$', 'array<variant>') AS a)) AS nodes,
                CAST(NULL AS struct<open:array<{_NODE}>,found:array<{kind}>>) AS next),
            (s, one) -> struct(s.nodes AS nodes, CAST(struct(
                flatten(transform(s.nodes, e -> CASE
                    WHEN e.o IS NOT NULL THEN transform(map_entries(e.o), x -> CAST(struct(concat(e.path, '.', x.key), e.path, array(), x.value) AS {_NODE}))
                    WHEN e.a IS NOT NULL THEN transform(e.a, (x, i) -> CAST(struct(concat(e.path, '[', CAST(i AS string), ']'), CASE WHEN e.path = '$' THEN e.path ELSE e.parent_path END, concat(e.ordinals, array(i)), x) AS {_NODE}))
                    ELSE CAST(array() AS array<{_NODE}>) END)),
                concat(acc.found, transform(filter(s.nodes, e -> e.o IS NOT NULL), e -> CAST(struct({own}) AS {kind})))
            ) AS struct<open:array<{_NODE}>,found:array<{kind}>>) AS next),
            s -> s.next) END,
        acc -> acc.found)"""


def objects(docs: DataFrame, keys: list[str], values: bool = True) -> DataFrame:
    """One row per JSON object of `documents`: keys..., path, parent_path (null for the top level), ordinals in the
    arrays between parent and object, outermost first, the last one as ordinal (null outside arrays), and v."""
    found = docs.select(*keys, F.explode(F.expr(_walk(values))).alias("n"))
    last = F.when(F.size("n.ordinals") > 0, F.element_at("n.ordinals", -1))
    return found.select(*keys, "n.path", "n.parent_path", "n.ordinals", last.alias("ordinal"), *(["n.v"] if values else []))


def pattern(path: Column) -> Column:
    """The structural path: array positions become []."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def surrogate(source: Column, key: Column, path: Column) -> Column:
    """A stable 128-bit key of an object in its record, null where it has no path."""
    return F.md5(F.concat(source, F.lit("|"), key.cast("string"), F.lit("|"), path))


def merged_schema(nodes: DataFrame) -> DataFrame:
    """(pattern, field, kind, n): what each structural path holds over all records, optional fields by their counts."""
    fields = nodes.select(pattern(F.col("path")).alias("pattern"), F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("field", "value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^(\w+)", 1)
    kind = F.when(kind.startswith("DECIMAL"), "DECIMAL").otherwise(kind)
    return fields.select("pattern", "field", kind.alias("kind")).groupBy("pattern", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


def child_table(nodes: DataFrame, source: str, key: Column, at: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of all objects at one structural path: own and parent surrogate key, ordinal, typed scalars.
    A column whose value has another type, or is missing, is null."""
    rows = nodes.filter(pattern(F.col("path")) == at)
    return rows.select(
        surrogate(F.lit(source), key, F.col("path")).alias("row_id"), surrogate(F.lit(source), key, F.col("parent_path")).alias("parent_id"), key.cast("string").alias("record_key"), "ordinal",
        *[F.try_variant_get("v", f'$["{c}"]', t).alias(c) for c, t in columns.items()],
    )


_SCALARS = {"STRING": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "FLOAT": "double", "DECIMAL": "double"}


def _values(v: Column) -> Column:
    """The fields of an object that are no rows themselves, as text: scalars, and arrays unless all they hold is objects."""
    own = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: ~F.schema_of_variant(x).rlike("^(ARRAY<)*OBJECT"))
    return F.transform_values(own, lambda _, x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.to_json(x)).otherwise(F.try_variant_get(x, "$", "string")))


def rows(nodes: DataFrame, source: Column, key: Column) -> DataFrame:
    """Every object as a row of the table of its structural path: source_table, record_key, pattern, path, row_id,
    parent_id (null for the top-level object), its ordinals in the arrays below the parent, the values by field as text."""
    at = lambda p: surrogate(source, key, p)
    return nodes.select(
        source.alias("source_table"), key.cast("string").alias("record_key"), pattern(F.col("path")).alias("pattern"), "path",
        at(F.col("path")).alias("row_id"), at(F.col("parent_path")).alias("parent_id"), "ordinals", "ordinal", _values(F.col("v")).alias("values"),
    )


def table_columns(nodes: DataFrame) -> dict[str, dict[str, str]]:
    """The table of each structural path, from the merged schema: its columns with their types. Integers and other
    numbers together are double, other mixtures and arrays text; fields that only hold objects are tables. One row
    per structural path, field and kind reaches the driver."""
    tables: dict[str, dict[str, set[str]]] = {r["p"]: {} for r in nodes.select(pattern(F.col("path")).alias("p")).distinct().collect()}
    for r in merged_schema(nodes).collect():
        tables[r["pattern"]].setdefault(r["field"], set()).add(r["kind"])

    def kind(kinds: set[str]) -> str:
        types = {_SCALARS.get(x, "string") for x in kinds - {"VOID"}} or {"string"}
        return types.pop() if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"

    return {p: {f: kind(k - {"OBJECT"}) for f, k in sorted(fields.items()) if k - {"VOID"} != {"OBJECT"}} for p, fields in sorted(tables.items())}


def child_tables(nodes: DataFrame, source: Column, key: Column) -> dict[str, DataFrame]:
    """The flat table of each structural path that occurs, with the columns of `table_columns` beside the keys."""
    every = rows(nodes, source, key)
    cell = lambda f, t: F.col("values")[F.lit(f)].try_cast(t).alias(f"value.{f}")
    return {p: every.filter(F.col("pattern") == p).select("source_table", "record_key", "row_id", "parent_id", "ordinals", "ordinal", *[cell(f, t) for f, t in fields.items()]) for p, fields in table_columns(nodes).items()}
