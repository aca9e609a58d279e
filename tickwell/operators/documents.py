"""JSON documents as a table of nodes: contracts checked by a table of rules, JSON pointers resolved by a join.

A node's ``path`` is its JSON pointer; its ``shape`` is the pointer with ``~i`` for every place in a list (no key is written so,
as a key's ``~`` is escaped). A document is taken apart level by level inside one pass over its row; nothing is shuffled for it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ITEM = "~i"
_NODE = "struct<path: string, parent: string, shape: string, name: string, place: int, depth: int, value: variant>"
_OBJECT, _LIST = "try_variant_get({}, '$', 'map<string,variant>')", "try_variant_get({}, '$', 'array<variant>')"
#: Fixed value: levels that are taken apart a row at a time; what is below a node of that depth is taken apart at once.
_STEPS = 3
#: Fixed value: an instant of RFC 3339, with its offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
_RULE = (
    "contract string, shape string, types array<string>, const string, enum array<string>, min_length int, pattern string, format string, minimum double, maximum double, "
    "above double, below double, required array<string>, properties array<string>, closed boolean, min_items int, unique_items boolean"
)


def nodes(documents: DataFrame, value: str = "value", keep: Sequence[str] = ("doc",), most: int = 16) -> DataFrame:
    """A row for each node of the JSON texts in ``value``: the columns ``keep``, then path, parent, shape, name, place, depth, value (variant), kind, size, keys, text, number.

    kind: object, array, string, integer, number, boolean, null, or invalid for a text that is no JSON (a document's only
    node then). ``text`` is a string's own text, else JSON with sorted keys. A document nested deeper than ``most`` raises.
    """
    root = F.struct(
        F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("shape"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("int").alias("place"), F.lit(0).alias("depth"), F.try_parse_json(F.col(value)).alias("value"),
    ).cast(_NODE)
    out = documents.select(*keep, root.alias("n"))

    def below(n: str, d: int) -> str:
        child = f"named_struct('path', {n}.path || '/' || {{step}}, 'parent', {n}.path, 'shape', {n}.shape || '/' || {{shape}}, 'name', {{name}}, 'place', {{place}}, 'depth', {n}.depth + 1, 'value', {{value}})"
        escaped = f"replace(replace(e{d}.key, '~', '~0'), '/', '~1')"
        of_object = child.format(step=escaped, shape=escaped, name=f"e{d}.key", place="cast(null as int)", value=f"e{d}.value")
        of_list = child.format(step=f"i{d}", shape=f"'{_ITEM}'", name="cast(null as string)", place=f"i{d}", value=f"x{d}")
        both = f"coalesce(transform(map_entries({_OBJECT.format(f'{n}.value')}), e{d} -> {of_object}), transform({_LIST.format(f'{n}.value')}, (x{d}, i{d}) -> {of_list}), array())"
        return f"cast({both} as array<{_NODE}>)"

    def tree(n: str, d: int) -> str:
        return f"concat(array({n}), flatten(transform({below(n, d)}, n{d} -> {tree(f'n{d}', d + 1)})))" if d < most else f"array({n})"

    steps = min(_STEPS, most)
    for depth in range(steps):
        out = out.select(*keep, F.explode(F.expr(f"if(n.depth = {depth}, concat(array(n), {below('n', depth)}), array(n))")).alias("n"))
    out = out.select(*keep, F.explode(F.expr(f"if(n.depth = {steps}, {tree('n', steps)}, array(n))")).alias("n"))
    out = out.select(*keep, "n.*").withColumns({"__o": F.expr(_OBJECT.format("value")), "__l": F.expr(_LIST.format("value"))})
    kind = F.when(F.col("value").isNull(), "invalid").when(F.col("__o").isNotNull(), "object").when(F.col("__l").isNotNull(), "array").otherwise(_plain_kind(F.expr("schema_of_variant(value)")))
    size = F.coalesce(F.size(F.map_keys("__o")), F.size("__l"))
    deep = (F.col("depth") == most) & (size > 0)
    out = out.withColumn("kind", F.when(deep, F.raise_error(F.lit(f"a document is nested deeper than {most}"))).otherwise(kind))
    told = [_told(F.col("value"), F.col("kind"), n).alias(n) for n in ("text", "number")]
    return out.select(*keep, "path", "parent", "shape", "name", "place", "depth", "value", "kind", size.alias("size"), F.map_keys("__o").alias("keys"), *told)


def _plain_kind(schema: Column) -> Column:
    is_integer = (schema == "BIGINT") | schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return F.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(is_integer, "integer").otherwise("number")


def _told(value: Column, kind: Column, what: str) -> Column:
    if what == "number":
        return F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
    return F.when(kind == "string", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def members(found: DataFrame, fields: Mapping[str, tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and, for each of ``fields`` (name: steps, what), the kind, text or number, as ``nodes`` tells them, of the node ``steps`` (plain
    names with / between them; none: itself) below the column value of a node; null where there is none. Each value is looked up once."""
    own = {s: f"__v{i}" for i, s in enumerate(dict.fromkeys(s for s, _ in fields.values()))}
    rows = found.select(*keep, *[(F.try_variant_get("value", F.lit("$." + s.replace("/", ".")), "variant") if s else F.col("value")).alias(v) for s, v in own.items()])
    rows = rows.select(*keep, *own.values(), *[F.schema_of_variant(v).alias(f"{v}_is") for v in own.values()])

    def told(steps: str, what: str) -> Column:
        value, schema = F.col(own[steps]), F.col(f"{own[steps]}_is")
        if what == "text":
            return F.when(schema == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        kind = F.when(schema.startswith("OBJECT<"), "object").when(schema.startswith("ARRAY<"), "array").otherwise(_plain_kind(schema))
        return F.when(value.isNotNull(), kind if what == "kind" else _told(value, kind, what))

    return rows.select(*keep, *[told(*f).alias(n) for n, f in fields.items()])


def rules(contract: str, schema: Mapping) -> list[tuple]:
    """Rows of the rule table from a JSON schema (type, const, enum, minLength, pattern, format date-time, minimum, maximum and their exclusive
    forms, required, properties, additionalProperties false, minItems, uniqueItems, items), one for each shape that it names."""
    out, open_ = [], [("", schema)]
    while open_:
        shape, s = open_.pop()
        types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
        canonical = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        bounds = [None if s.get(k) is None else float(s[k]) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")]
        properties = s.get("properties", {})
        out.append((
            contract, shape, types, canonical(s["const"]) if "const" in s else None, [canonical(v) for v in s["enum"]] if "enum" in s else None, s.get("minLength"), s.get("pattern"), s.get("format"),
            *bounds, s.get("required", []), list(properties), s.get("additionalProperties") is False, s.get("minItems"), bool(s.get("uniqueItems")),
        ))
        open_ += [(f"{shape}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in properties.items()]
        if s.get("items"):
            open_.append((f"{shape}/{_ITEM}", s["items"]))
    return out


def rule_table(spark: SparkSession, contracts: Mapping[str, Mapping]) -> DataFrame:
    """The rules of named contracts; as many rows as the schemas have nodes."""
    return spark.createDataFrame([r for name, schema in contracts.items() for r in rules(name, schema)], _RULE)


def validate(found: DataFrame, rules: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, path, rule): a row for each rule of its contract that a node breaks. ``found``: ``nodes`` with the columns doc and contract.

    A node of a wrong type breaks ``type`` and nothing else, and no rule reaches below it; a missing or additional property is told by its own path.
    A text that is no JSON breaks ``json``; a document of a contract without rules breaks ``contract``.
    """
    c = F.col
    rows = found.join(rules.withColumnRenamed("contract", "__contract"), (c("contract") == c("__contract")) & (found["shape"] == rules["shape"]), "left").drop(rules["shape"])
    typed = c("types").isNull() | F.array_contains("types", c("kind")) | ((c("kind") == "integer") & F.array_contains("types", F.lit("number")))
    own = F.to_json("value")
    same = lambda x: (own == x) | (c("number") == F.try_variant_get(F.try_parse_json(x), "$", "double"))
    one_of = F.exists("enum", lambda x: F.coalesce(same(x), F.lit(False)))
    is_text, is_number, is_object, is_list = c("kind") == "string", c("kind").isin("integer", "number"), c("kind") == "object", c("kind") == "array"
    instant = F.coalesce(c("text").rlike(RFC3339) & F.try_to_timestamp("text").isNotNull(), F.lit(False))
    repeated = F.expr(f"size(array_distinct(transform({_LIST.format('value')}, x -> to_json(x)))) < size")
    broken = {
        "const": c("const").isNotNull() & ~F.coalesce(same(c("const")), F.lit(False)),
        "enum": c("enum").isNotNull() & ~one_of,
        "minLength": is_text & (F.length("text") < c("min_length")),
        "pattern": is_text & ~F.expr("text rlike pattern"),
        "format": is_text & (c("format") == "date-time") & ~instant,
        "minimum": is_number & (c("number") < c("minimum")),
        "maximum": is_number & (c("number") > c("maximum")),
        "exclusiveMinimum": is_number & (c("number") <= c("above")),
        "exclusiveMaximum": is_number & (c("number") >= c("below")),
        "minItems": is_list & (c("size") < c("min_items")),
        "uniqueItems": is_list & c("unique_items") & repeated,
    }
    told = lambda rule, path=c("path"): F.struct(path.alias("path"), F.lit(rule).alias("rule"))
    at = lambda key: F.concat("path", F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    empty = F.array().cast("array<struct<path: string, rule: string>>")
    keys = lambda rule, names: F.transform(names, lambda k: told(rule, at(k)))
    values = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), told(rule)) for rule, b in broken.items()]))
    under = F.when(is_object, F.concat(keys("required", F.array_except("required", "keys")), F.when(c("closed"), keys("additional", F.array_except("keys", "properties"))).otherwise(empty))).otherwise(empty)
    errors = (
        F.when(c("kind") == "invalid", F.array(told("json")))
        .when(c("__contract").isNull(), F.when(c("depth") == 0, F.array(told("contract"))).otherwise(empty))
        .when(~typed, F.array(told("type"))).otherwise(F.concat(values, under))
    )
    return rows.select(doc, F.explode(errors).alias("e")).select(doc, "e.*")


def pointer_steps(pointer: Column) -> Column:
    """Steps of a JSON pointer as they are written; none for the whole document."""
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(pointer, "/"), 2, F.length(pointer)))


def resolve(found: DataFrame, pointers: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """(keys, pointer, status, kind, text, number) for each distinct row (keys, pointer) of ``pointers``, pointers being data.

    ``found``: nodes with the columns ``keys``. status: resolved; malformed (does not start with /); invalid_escape; invalid_index (a step into
    a list that is no number, or has a leading zero); out_of_range; missing_key; through_scalar; no_document. The first fault on the way counts.
    Every prefix of a pointer is joined with the node table by its path, and the longest that exists decides.
    """
    c = F.col
    asked = pointers.select(*keys, "pointer").where("pointer IS NOT NULL").distinct()
    well = (c("pointer") == "") | c("pointer").startswith("/")
    steps = F.when(well, pointer_steps(c("pointer"))).otherwise(F.array().cast("array<string>"))
    asked = asked.withColumn("steps", steps)
    prefix = F.expr("transform(sequence(0, size(steps)), k -> struct(k as reached, concat_ws('', transform(slice(steps, 1, k), s -> '/' || s)) as path))")
    asked = asked.select(*keys, "pointer", "steps", F.explode(prefix).alias("p")).select(*keys, "pointer", "steps", "p.*")
    held = found.select(*keys, "path", "kind", "size", "text", "number")
    rows = asked.join(held, [*keys, "path"], "left")
    whole = c("path") == c("pointer")  # the text of an object that is only passed through is not carried further
    rows = rows.withColumns({"text": F.when(whole, c("text")), "number": F.when(whole, c("number"))})
    deepest = F.max_by(F.struct("reached", "kind", "size", "text", "number"), F.when(c("kind").isNotNull(), c("reached")))
    rows = rows.groupBy(*keys, "pointer").agg(F.first("steps").alias("steps"), deepest.alias("at"))
    step = F.try_element_at("steps", c("at.reached") + 1)
    index = step.rlike(r"^(0|[1-9][0-9]*)\z")
    status = (
        F.when(~well, "malformed").when(c("at.kind").isNull() | (c("at.kind") == "invalid"), "no_document").when(c("at.reached") == F.size("steps"), "resolved")
        .when(step.rlike("~([^01]|$)"), "invalid_escape").when(c("at.kind") == "object", "missing_key")
        .when((c("at.kind") == "array") & index, "out_of_range").when(c("at.kind") == "array", "invalid_index").otherwise("through_scalar")
    )
    rows = rows.withColumn("status", status)
    shown = [F.when(c("status") == "resolved", c(f"at.{n}")).alias(n) for n in ("kind", "text", "number")]
    return rows.select(*keys, "pointer", "status", *shown)


def pointer_of(steps: Sequence[Column]) -> Column:
    """A JSON pointer from plain names."""
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(s.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for s in steps])


def contract_of(found: DataFrame, at: str = "/artifact_type", keys: Sequence[str] = ("doc",)) -> DataFrame:
    """``found`` with the column contract: the text of each document's node ``at``, carried over its nodes without a join."""
    own = F.max(F.when(F.col("path") == at, F.col("text"))).over(Window.partitionBy(*keys))
    return found.withColumn("contract", F.coalesce(own, F.lit("")))
