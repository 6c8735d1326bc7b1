"""Element attributes: Column expressions on the attrs map, and joins with the declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dtd import first_attdefs, first_declared

ATTRS = "attrs"


def get(name: str | Column) -> Column:
    return F.try_element_at(F.col(ATTRS), F.lit(name) if isinstance(name, str) else name)


def has(name: str) -> Column:
    return F.coalesce(F.map_contains_key(ATTRS, name), F.lit(False))


def put(name: str, value: Column | str) -> Column:
    """attrs with a value set; its place stays, a new one comes last."""
    value = F.lit(value) if isinstance(value, str) else value
    now = F.coalesce(F.col(ATTRS), F.create_map().cast("map<string,string>"))
    changed = F.transform_values(now, lambda k, v: F.when(k == name, value).otherwise(v))
    return F.when(F.map_contains_key(now, name), changed).otherwise(F.map_concat(F.map_filter(now, lambda k, _: k != name), F.create_map(F.lit(name), value)))


def drop(name: str) -> Column:
    return F.map_filter(ATTRS, lambda k, _: k != name)


def entries() -> Column:
    return F.map_entries(ATTRS)


def exploded(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, element, name, value) of every attribute."""
    return nodes.where("kind = '#element'").select("doc_id", "node_id", F.col("name").alias("element"), F.explode(ATTRS).alias("name", "value"))


def normalise_cdata(column: Column) -> Column:
    return F.translate(column, "\t\n\r", "   ")


def normalise_token(column: Column) -> Column:
    """Tokenised types: also trimmed and runs of blanks collapsed."""
    return F.regexp_replace(F.trim(normalise_cdata(column)), " {2,}", " ")


def token_set(column: Column) -> Column:
    """Tokens of a list-typed value; empty if one stands twice or the value is empty."""
    tokens = F.filter(F.split(column, r"[\n\r\t ]+"), lambda x: x != "")
    return F.when(F.size(tokens) == F.size(F.array_distinct(tokens)), tokens).otherwise(F.array().cast("array<string>"))


def typed(nodes: DataFrame, docs: DataFrame, attdef: DataFrame) -> DataFrame:
    """exploded() with the declared type (null if undeclared) and dtd_id."""
    rows = exploded(nodes).join(docs.select("doc_id", "dtd_id"), "doc_id")
    kinds = first_attdefs(attdef).select("dtd_id", "element", "name", "type", "enumeration", "default_value", "fixed", "required")
    return rows.join(kinds, ["dtd_id", "element", "name"], "left")


def with_defaults(nodes: DataFrame, docs: DataFrame, attdef: DataFrame, fixed: bool = False) -> DataFrame:
    """Elements with absent attributes that have a default provided; fixed ones only on demand."""
    have = first_attdefs(attdef).where("default_value IS NOT NULL" + ("" if fixed else " AND NOT fixed"))
    maps = have.groupBy("dtd_id", F.col("element").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name").alias("k"), F.col("default_value").alias("v"))))).alias("_given"))
    rows = nodes.join(docs.select("doc_id", "dtd_id"), "doc_id", "left").join(maps, ["dtd_id", "name"], "left")
    now = F.coalesce(F.col(ATTRS), F.create_map().cast("map<string,string>"))
    filled = F.map_concat(now, F.map_filter("_given", lambda k, _: ~F.map_contains_key(now, k)))
    return rows.withColumn(ATTRS, F.when(F.col("_given").isNotNull() & (F.col("kind") == "#element"), filled).otherwise(F.col(ATTRS))).select(*nodes.columns)


def reset(nodes: DataFrame, docs: DataFrame, attdef: DataFrame, name: str) -> DataFrame:
    """Elements with the attribute back at its declared default; undeclared attributes and those without one stay."""
    have = first_attdefs(attdef).where((F.col("name") == name) & F.col("default_value").isNotNull()).select("dtd_id", F.col("element").alias("name"), F.col("default_value").alias("_v"))
    rows = nodes.join(docs.select("doc_id", "dtd_id"), "doc_id", "left").join(have, ["dtd_id", "name"], "left")
    return rows.withColumn(ATTRS, F.when(F.col("_v").isNotNull() & (F.col("kind") == "#element"), put(name, F.col("_v"))).otherwise(F.col(ATTRS))).select(*nodes.columns)


def id_of(nodes: DataFrame, docs: DataFrame, attdef: DataFrame) -> DataFrame:
    """(doc_id, node_id, id) by the ID-typed attribute."""
    from .nav import id_index

    return id_index(nodes, docs, attdef).withColumnRenamed("value", "id")


def definition(nodes: DataFrame, docs: DataFrame, elem_decl: DataFrame) -> DataFrame:
    """Elements with their declaration's content, spec, pattern, allowed and mixed (null if undeclared)."""
    decl = first_declared(elem_decl).select("dtd_id", "name", "content", "spec", "pattern", "allowed", "mixed")
    return nodes.where("kind = '#element'").join(docs.select("doc_id", "dtd_id"), "doc_id").join(decl, ["dtd_id", "name"], "left")


def references(nodes: DataFrame, docs: DataFrame, attdef: DataFrame, ids: DataFrame, entity: DataFrame, notation: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, type, targets) of every reference attribute.

    targets: node ids of IDREF and IDREFS, names of unparsed entities or notations, as text.  A list with a
    token that is invalid, repeated or unresolved is empty, as a whole."""
    rows = typed(nodes, docs, attdef).where(F.col("type").isin("IDREF", "IDREFS", "ENTITY", "ENTITIES", "NOTATION"))
    several = F.col("type").isin("IDREFS", "ENTITIES")
    tokens = F.when(several, token_set(F.col("value"))).otherwise(F.array("value"))
    rows = rows.withColumn("_t", tokens)
    each = rows.select("doc_id", "dtd_id", "node_id", "name", "type", F.size("_t").alias("_n"), "enumeration", F.posexplode_outer("_t").alias("_k", "_v"))
    first = ids.groupBy("doc_id", F.col("value").alias("_v")).agg(F.min("node_id").cast("string").alias("_id"))
    open_ = first_declared(entity.where("type <> 'PARAMETER'")).where("type = 'UNPARSED'").select("dtd_id", F.col("name").alias("_v"), F.col("name").alias("_e"))
    known = first_declared(notation).select("dtd_id", F.col("name").alias("_v"), F.col("name").alias("_m"))
    each = each.join(first, ["doc_id", "_v"], "left").join(open_, ["dtd_id", "_v"], "left").join(known, ["dtd_id", "_v"], "left")
    target = F.when(F.col("type").isin("IDREF", "IDREFS"), F.col("_id")).when(F.col("type") == "NOTATION", F.when(F.array_contains("enumeration", F.col("_v")), F.col("_m"))).otherwise(F.col("_e"))
    grouped = each.withColumn("_x", target).groupBy("doc_id", "node_id", "name", "type").agg(F.array_sort(F.collect_list(F.struct("_k", "_x"))).alias("_all"), F.count("_x").alias("_ok"), F.first("_n").alias("_n"))
    full = F.transform("_all", lambda s: s["_x"])
    return grouped.select("doc_id", "node_id", "name", "type", F.when((F.col("_ok") == F.col("_n")) & (F.col("_n") > 0), full).otherwise(F.array().cast("array<string>")).alias("targets"))
