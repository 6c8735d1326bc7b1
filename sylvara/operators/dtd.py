"""Declarations as tables: lookups, content matching, predicates on attribute declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import sound_unions

# Sets of attribute types.
REFERENCE = ("ENTITY", "ENTITIES", "IDREF", "IDREFS", "NOTATION")
TOKENIZED = (*REFERENCE, "ENUMERATION", "ID", "NMTOKEN", "NMTOKENS")
LISTS = ("ENTITIES", "IDREFS", "NMTOKENS")
NAMES = (*REFERENCE, "ID")
ENUMERATED = ("ENUMERATION", "NOTATION")


def first_declared(table: DataFrame, *keys: str) -> DataFrame:
    """The first declaration of each name (or of the given keys) of a document type."""
    w = Window.partitionBy("dtd_id", *(keys or ("name",))).orderBy("decl_ord")
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_attdefs(attdef: DataFrame) -> DataFrame:
    return first_declared(attdef, "element", "name")


def all_declarations(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Internal declarations, then external ones."""
    top = internal.groupBy("dtd_id").agg((F.max("decl_ord") + 1).alias("_m"))
    moved = external.join(top, "dtd_id", "left").withColumn("decl_ord", F.col("decl_ord") + F.coalesce("_m", F.lit(0))).drop("_m")
    return sound_unions(internal.unionByName(moved))


def allows_text(content: str = "content") -> Column:
    return F.col(content).isin("MIXED", "ANY")


def has_default() -> Column:
    return F.col("default_value").isNotNull()


def is_list() -> Column:
    return F.col("type").isin(*LISTS)


def is_name_type() -> Column:
    return F.col("type").isin(*NAMES)


def is_reference() -> Column:
    return F.col("type").isin(*REFERENCE)


def is_tokenized() -> Column:
    return F.col("type").isin(*TOKENIZED)


def child_image(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, image): " a b c" of each element's child elements, "" without any."""
    elements = nodes.where("kind = '#element'")
    inner = elements.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: F.concat(F.lit(" "), x["name"])), "").alias("image"))
    return elements.select("doc_id", "node_id").join(inner, ["doc_id", "node_id"], "left").fillna("", ["image"])


def matches_content(image: Column, content: Column, pattern: Column, allowed: Column) -> Column:
    """Whether child elements fit the declaration; text is not looked at."""
    names = F.filter(F.split(image, " "), lambda x: x != "")
    return F.when(content == "ANY", True).when(content == "EMPTY", image == "").when(content == "MIXED", F.size(F.array_except(names, allowed)) == 0).otherwise(F.rlike(image, pattern))


def may_become(image: Column, content: Column, partial: Column, allowed: Column) -> Column:
    """Whether more child elements could make these fit the declaration: an early answer, no verdict."""
    names = F.filter(F.split(image, " "), lambda x: x != "")
    return F.when(content == "ANY", True).when(content == "EMPTY", image == "").when(content == "MIXED", F.size(F.array_except(names, allowed)) == 0).otherwise(F.rlike(image, partial))


def value_fits(value: Column, kind: Column, enumeration: Column, names: str = "4e") -> Column:
    """Whether a normalised value fits its type by grammar: tokens, names, membership."""
    from ..functions.chars import is_name, is_nmtoken
    from .attrs import token_set

    tokens = token_set(value)
    some = F.size(tokens) > 0
    return (
        F.when(kind.isin("ID", "IDREF", "ENTITY"), is_name(value, names))
        .when(kind == "NMTOKEN", is_nmtoken(value, names))
        .when(kind.isin("IDREFS", "ENTITIES"), some & F.forall(tokens, lambda t: is_name(t, names)))
        .when(kind == "NMTOKENS", some & F.forall(tokens, lambda t: is_nmtoken(t, names)))
        .when(kind.isin(*ENUMERATED), F.coalesce(F.array_contains(enumeration, value), F.lit(False)))
        .otherwise(True)
    )
