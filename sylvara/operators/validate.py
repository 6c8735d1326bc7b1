"""Validity as relational rules: each gives violations (doc_id, node_id, rule, detail).

validate() gives all of them, most in one pass over the nodes; a document is valid that parses and has none.  Rules about declarations
give node_id null and are reported for every document of the document type.  Where a document has no
document type declaration, no rule about declarations applies to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import all_chars, is_name, is_nmtoken
from ..session import held
from ..sources.xml import XmlTables
from . import attrs, dtd
from .groups import sound_unions

COLUMNS = ("doc_id", "node_id", "rule", "detail")


@dataclass
class Tables:
    """Node and declaration tables under one document key, doc_id."""

    nodes: DataFrame
    docs: DataFrame
    elem_decl: DataFrame
    attdef: DataFrame
    entity: DataFrame
    notation: DataFrame
    names: str = "4e"
    few_types: bool = False  # declarations are small enough to be sent to every executor

    @classmethod
    def of(cls, x: XmlTables, names: str = "4e") -> Tables:
        key = x.doc_id
        return cls(x.nodes.withColumnRenamed(key, "doc_id"), x.docs.withColumnRenamed(key, "doc_id"), x.elem_decl, x.attdef, x.entity, x.notation, names, x.few_types)

    @property
    def elements(self) -> DataFrame:
        """Elements of documents with a document type, with dtd_id."""
        typed = self.docs.where("dtd_id IS NOT NULL").select("doc_id", "dtd_id")
        return self.nodes.where("kind = '#element'").join(typed, "doc_id")

    def near(self, rows: DataFrame) -> DataFrame:
        """rows of declarations, for a join by dtd_id."""
        return F.broadcast(rows) if self.few_types else rows

    def per_doc(self, rows: DataFrame, detail: Column, rule: str) -> DataFrame:
        """Violations of declarations, for each document of the type."""
        found = self.near(rows.select("dtd_id", detail.alias("detail")).distinct())
        return self.docs.select("doc_id", "dtd_id").join(found, "dtd_id").select("doc_id", F.lit(None).cast("int").alias("node_id"), F.lit(rule).alias("rule"), "detail")


def _as(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("doc_id", "node_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def root_type(t: Tables) -> DataFrame:
    """The root element is not what the document type names."""
    roots = t.elements.where("depth = 1").join(t.docs.select("doc_id", "doctype_name"), "doc_id")
    return _as(roots.where("name <> doctype_name"), "root_type", F.col("name"))


def element_declared(t: Tables) -> DataFrame:
    return _as(t.elements.join(t.elem_decl.select("dtd_id", "name"), ["dtd_id", "name"], "left_anti"), "element_declared", F.col("name"))


def element_content(t: Tables) -> DataFrame:
    """Children that do not fit the declaration, text in element content, anything in EMPTY."""
    decl = dtd.first_declared(t.elem_decl).select("dtd_id", "name", "content", "pattern", "allowed")
    rows = t.elements.join(decl, ["dtd_id", "name"])
    text = t.nodes.where("kind = '#text'").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_text", F.lit(True))
    rows = rows.join(text, ["doc_id", "node_id"], "left")
    fits = dtd.matches_content(F.col("child_names"), F.col("content"), F.col("pattern"), F.col("allowed"))
    return _as(rows.where(_bad_content(fits, F.col("content"))), "element_content", F.concat_ws("", "name", F.lit(":"), "child_names"))


def _bad_content(fits: Column, content: Column) -> Column:
    return (~fits) | ((content == "EMPTY") & F.col("any_content")) | ((content == "MODEL") & F.coalesce("_text", F.lit(False)))


def attribute_declared(t: Tables) -> DataFrame:
    rows = t.elements.select("doc_id", "dtd_id", "node_id", F.col("name").alias("element"), F.explode(F.map_keys("attrs")).alias("name"))
    known = t.elem_decl.select("dtd_id", F.col("name").alias("element")).distinct()
    return _as(rows.join(known, ["dtd_id", "element"], "left_semi").join(t.attdef.select("dtd_id", "element", "name"), ["dtd_id", "element", "name"], "left_anti"), "attribute_declared", F.concat_ws("@", "element", "name"))


def _typed(t: Tables) -> DataFrame:
    return attrs.typed(t.nodes, t.docs.where("dtd_id IS NOT NULL"), t.attdef).where("type IS NOT NULL")


def attribute_value(t: Tables) -> DataFrame:
    """Names, name tokens, and enumerations by grammar; tokens of lists must differ."""
    fits = dtd.value_fits(F.col("value"), F.col("type"), F.col("enumeration"), t.names)
    return _as(_typed(t).where(~fits), "attribute_value", F.concat_ws("", "name", F.lit("="), "value"))


def id_unique(t: Tables) -> DataFrame:
    ids = _typed(t).where("type = 'ID'")
    twice = ids.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("node_id").alias("_first")).where("n > 1").drop("n")
    return _as(ids.join(twice, ["doc_id", "value"]).where("node_id <> _first"), "id_unique", F.col("value"))


def idref_resolves(t: Tables) -> DataFrame:
    rows = _typed(t)
    ids = rows.where("type = 'ID'").select("doc_id", "value")
    refs = rows.where("type IN ('IDREF', 'IDREFS')").select("doc_id", "node_id", F.explode(F.filter(F.split("value", " "), lambda x: x != "")).alias("value"))
    return _as(refs.join(ids, ["doc_id", "value"], "left_anti"), "idref_resolves", F.col("value"))


def entity_name(t: Tables) -> DataFrame:
    """ENTITY and ENTITIES values name unparsed entities."""
    refs = _typed(t).where("type IN ('ENTITY', 'ENTITIES')").select("doc_id", "dtd_id", "node_id", F.explode(F.filter(F.split("value", " "), lambda x: x != "")).alias("name"))
    known = dtd.first_declared(t.entity.where("type <> 'PARAMETER'")).where("type = 'UNPARSED'").select("dtd_id", "name")
    return _as(refs.join(known, ["dtd_id", "name"], "left_anti"), "entity_name", F.col("name"))


def required(t: Tables) -> DataFrame:
    """Required and fixed attributes are written on every element of their type."""
    need = dtd.first_attdefs(t.attdef).where("required OR fixed").select("dtd_id", F.col("element").alias("name"), F.col("name").alias("_a"))
    rows = t.elements.join(need, ["dtd_id", "name"])
    return _as(rows.where(~F.map_contains_key("attrs", F.col("_a"))), "required", F.concat_ws("@", "name", "_a"))


def fixed_value(t: Tables) -> DataFrame:
    return _as(_typed(t).where("fixed AND value <> default_value"), "fixed_value", F.concat_ws("", "name", F.lit("="), "value"))


def element_unique(t: Tables) -> DataFrame:
    return t.per_doc(t.elem_decl.groupBy("dtd_id", "name").count().where("count > 1"), F.col("name"), "element_unique")


def mixed_unique(t: Tables) -> DataFrame:
    return t.per_doc(t.elem_decl.where("mixed").where(F.size("allowed") != F.size(F.array_distinct("allowed"))), F.col("name"), "mixed_unique")


def _one(t: Tables, kind: str, rule: str) -> DataFrame:
    many = dtd.first_attdefs(t.attdef).where(F.col("type") == kind).groupBy("dtd_id", "element").count().where("count > 1")
    return t.per_doc(many, F.col("element"), rule)


def one_id(t: Tables) -> DataFrame:
    return _one(t, "ID", "one_id")


def one_notation(t: Tables) -> DataFrame:
    return _one(t, "NOTATION", "one_notation")


def id_default(t: Tables) -> DataFrame:
    return t.per_doc(t.attdef.where("type = 'ID' AND default_value IS NOT NULL"), F.concat_ws("@", "element", "name"), "id_default")


def notation_on_empty(t: Tables) -> DataFrame:
    empty = dtd.first_declared(t.elem_decl).where("content = 'EMPTY'").select("dtd_id", F.col("name").alias("element"))
    return t.per_doc(t.attdef.where("type = 'NOTATION'").join(empty, ["dtd_id", "element"]), F.concat_ws("@", "element", "name"), "notation_on_empty")


def notation_attribute(t: Tables) -> DataFrame:
    """Notations of an attribute's choices are declared, and before it."""
    first = t.notation.groupBy("dtd_id", F.col("name").alias("_v")).agg(F.min("decl_ord").alias("_o"))
    rows = t.attdef.where("type = 'NOTATION'").withColumn("_v", F.explode("enumeration")).join(first, ["dtd_id", "_v"], "left")
    return t.per_doc(rows.where("_o IS NULL OR _o > decl_ord"), F.col("_v"), "notation_attribute")


def notation_entity(t: Tables) -> DataFrame:
    """The notation of an unparsed entity is declared, and before it."""
    first = t.notation.groupBy("dtd_id", F.col("name").alias("notation_name")).agg(F.min("decl_ord").alias("_o"))
    rows = t.entity.where("type = 'UNPARSED'").join(first, ["dtd_id", "notation_name"], "left")
    return t.per_doc(rows.where("_o IS NULL OR _o > decl_ord"), F.concat_ws(":", "name", "notation_name"), "notation_entity")


def notation_unique(t: Tables) -> DataFrame:
    return t.per_doc(t.notation.groupBy("dtd_id", "name").count().where("count > 1"), F.col("name"), "notation_unique")


def choices_unique(t: Tables) -> DataFrame:
    return t.per_doc(t.attdef.where(F.size("enumeration") != F.size(F.array_distinct("enumeration"))), F.concat_ws("@", "element", "name"), "choices_unique")


def default_value(t: Tables) -> DataFrame:
    fits = dtd.value_fits(F.col("default_value"), F.col("type"), F.col("enumeration"), t.names)
    return t.per_doc(t.attdef.where(F.col("default_value").isNotNull() & ~fits), F.concat_ws("@", "element", "name"), "default_value")


def deterministic(t: Tables) -> DataFrame:
    return t.per_doc(t.elem_decl.where("ambiguous"), F.col("name"), "deterministic")


# Shapes that the parser cannot produce, but that edited or built tables can have.


def document_shape(t: Tables) -> DataFrame:
    """One root element, at most one document type and before it, and only allowed kinds of children."""
    top = t.nodes.where("parent_id = 0")
    counts = t.nodes.where("node_id = 0").select("doc_id").join(top, "doc_id", "left").groupBy("doc_id").agg(F.count_if(F.col("kind") == "#element").alias("roots"), F.count_if(F.col("kind") == "#doctypeDecl").alias("types"), F.min(F.when(F.col("kind") == "#element", F.col("ord"))).alias("_r"), F.max(F.when(F.col("kind") == "#doctypeDecl", F.col("ord"))).alias("_t"))
    bad = counts.where("roots <> 1 OR types > 1 OR _t > _r").select("doc_id", F.lit(0).alias("node_id"), F.concat_ws(" ", F.col("roots").cast("string"), F.col("types").cast("string")).alias("_d"))
    odd = top.where(~F.col("kind").isin("#element", "#doctypeDecl", "#comment", "#pi")).select("doc_id", "node_id", F.col("kind").alias("_d"))
    return _as(sound_unions(bad.unionByName(odd)), "document_shape", F.col("_d"))


def element_children(t: Tables) -> DataFrame:
    inner = t.nodes.where(~F.col("kind").isin("#element", "#text", "#comment", "#pi"))
    outer = t.nodes.where("kind = '#element'").select("doc_id", F.col("node_id").alias("parent_id"))
    return _as(inner.join(outer, ["doc_id", "parent_id"], "left_semi"), "element_children", F.col("kind"))


def _bad_text() -> Column:
    return F.col("text").isNull() | ~all_chars(F.col("text"), "xml_char") | ((F.col("text") == "") & ~F.coalesce("section", F.lit(False))) | (F.coalesce("section", F.lit(False)) & F.contains("text", F.lit("]]>")))


def text_shape(t: Tables) -> DataFrame:
    """Text is legal, not empty outside of sections, and a section holds no ]]>."""
    return _as(t.nodes.where((F.col("kind") == "#text") & _bad_text()), "text_shape", F.substring("text", 1, 30))


def _bad_comment() -> Column:
    return F.contains("text", F.lit("--")) | F.endswith("text", F.lit("-")) | ~all_chars(F.col("text"), "xml_char")


def comment_shape(t: Tables) -> DataFrame:
    return _as(t.nodes.where((F.col("kind") == "#comment") & _bad_comment()), "comment_shape", F.substring("text", 1, 30))


def _bad_pi(names: str) -> Column:
    return F.col("target").isNull() | ~is_name(F.col("target"), names) | (F.lower("target") == "xml") | F.coalesce(F.contains("text", F.lit("?>")) | ~all_chars(F.col("text"), "xml_char"), F.lit(False))


def pi_shape(t: Tables) -> DataFrame:
    return _as(t.nodes.where((F.col("kind") == "#pi") & _bad_pi(t.names)), "pi_shape", F.col("target"))


def _bad_names(names: str) -> Column:
    every = F.array_append(F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")), F.col("name"))
    return ~F.coalesce(F.forall(every, lambda n: is_name(n, names)), F.lit(False))


def element_names(t: Tables) -> DataFrame:
    return _as(t.nodes.where((F.col("kind") == "#element") & _bad_names(t.names)), "element_names", F.col("name"))


def _bad_ids(public_needs_system: bool) -> Column:
    public = F.coalesce(~all_chars(F.col("public_id"), "public_id_char_dbl"), F.lit(False))
    both = F.contains("system_id", F.lit("'")) & F.contains("system_id", F.lit('"'))
    alone = F.col("public_id").isNotNull() & F.col("system_id").isNull() if public_needs_system else F.lit(False)
    return public | F.coalesce(both, F.lit(False)) | alone


def external_ids(t: Tables) -> DataFrame:
    """Public identifiers of legal characters, system identifiers without both quotes, and a system
    identifier beside each public one but for notations, which need either."""
    rows = t.entity.where(_bad_ids(True)).select("dtd_id", "name").unionByName(t.notation.where(_bad_ids(False) | (F.col("public_id").isNull() & F.col("system_id").isNull())).select("dtd_id", "name"))
    out = t.per_doc(rows, F.col("name"), "external_ids")
    own = t.docs.where(_bad_ids(True)).select("doc_id", F.lit(None).cast("int").alias("node_id"), F.lit("external_ids").alias("rule"), F.col("doctype_name").alias("detail"))
    return sound_unions(out.unionByName(own))


def entity_shape(t: Tables) -> DataFrame:
    """A known type, a value or a system identifier and not both, legal text, a notation just for unparsed ones."""
    value, system = F.col("value").isNotNull(), F.col("system_id").isNotNull()
    bad = ~F.col("type").isin("GENERAL", "PARAMETER", "UNPARSED") | (value == system) | ((F.col("type") == "UNPARSED") != F.col("notation_name").isNotNull()) | F.coalesce(~all_chars(F.col("value"), "xml_char"), F.lit(False))
    return t.per_doc(t.entity.where(bad), F.col("name"), "entity_shape")


def declaration_names(t: Tables) -> DataFrame:
    """Declared names are names, choices are name tokens (names, for notations)."""
    named = [x.where(~is_name(F.col(c), t.names)).select("dtd_id", F.col(c).alias("_d")) for x, c in ((t.elem_decl, "name"), (t.attdef, "name"), (t.attdef, "element"), (t.entity, "name"), (t.notation, "name"))]
    choice = t.attdef.where("enumeration IS NOT NULL").select("dtd_id", "type", F.explode("enumeration").alias("_d"))
    bad = choice.where(F.when(F.col("type") == "NOTATION", ~is_name(F.col("_d"), t.names)).otherwise(~is_nmtoken(F.col("_d"), t.names))).select("dtd_id", "_d")
    for rows in named:
        bad = bad.unionByName(rows)
    return t.per_doc(sound_unions(bad), F.col("_d"), "declaration_names")


def mixed_shape(t: Tables) -> DataFrame:
    """Mixed content with element names is a starred choice; other kinds carry no allow-list of text."""
    bad = (F.col("mixed") != (F.col("content") == "MIXED")) | (F.col("mixed") & (F.size("allowed") > 0) & ~F.endswith("spec", F.lit(")*")))
    return t.per_doc(t.elem_decl.where(bad), F.col("name"), "mixed_shape")


RULES: tuple[Callable[[Tables], DataFrame], ...] = (
    root_type, element_declared, element_content, attribute_declared, attribute_value, id_unique, idref_resolves, entity_name, required, fixed_value,
    element_unique, mixed_unique, one_id, one_notation, id_default, notation_on_empty, notation_attribute, notation_entity, notation_unique, choices_unique, default_value, deterministic,
    document_shape, element_children, text_shape, comment_shape, pi_shape, element_names, external_ids, entity_shape, declaration_names, mixed_shape,
)


#: Rules that a node settles with its declaration at hand.
NODE_RULES = (root_type, element_declared, element_content, attribute_declared, attribute_value, required, fixed_value, text_shape, comment_shape, pi_shape, element_names)
#: Rules of declarations alone.
TYPE_RULES = (element_unique, mixed_unique, one_id, one_notation, id_default, notation_on_empty, notation_attribute, notation_entity, notation_unique, choices_unique, default_value, deterministic, entity_shape, declaration_names, mixed_shape)


def _declared(t: Tables) -> tuple[DataFrame, DataFrame]:
    """By element name of a document type: its first declaration, and its attributes' first definitions by name."""
    first = dtd.first_declared(t.elem_decl).select("dtd_id", "name", F.struct("content", "pattern", "allowed").alias("_decl"))
    fields = ("name", "type", "enumeration", "default_value", "fixed", "required")
    defs = dtd.first_attdefs(t.attdef).groupBy("dtd_id", F.col("element").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("name").alias("k"), F.struct(*fields).alias("v")))).alias("_defs"))
    return first, defs


def node_violations(t: Tables, rules: tuple[Callable[[Tables], DataFrame], ...] = NODE_RULES) -> DataFrame:
    """What the given NODE_RULES give, by one join of the nodes with their documents and two with the declarations."""
    about = t.docs.where("dtd_id IS NOT NULL").select("doc_id", "dtd_id", "doctype_name")
    rows = t.nodes.where(F.col("kind").isin("#element", "#text", "#comment", "#pi")).join(about, "doc_id", "left")
    for declared in _declared(t):
        rows = rows.join(declared, ["dtd_id", "name"], "left")
    if element_content in rules:
        text = t.nodes.where("kind = '#text'").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_text", F.lit(True))
        rows = rows.join(text, ["doc_id", "node_id"], "left")
    element, decl = (F.col("kind") == "#element") & F.col("dtd_id").isNotNull(), F.col("_decl")
    given = F.coalesce(F.map_entries("attrs"), F.array().cast("array<struct<key:string,value:string>>"))
    defs = F.coalesce(F.col("_defs"), F.create_map().cast("map<string,struct<name:string,type:string,enumeration:array<string>,default_value:string,fixed:boolean,required:boolean>>"))
    known = F.transform(given, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.try_element_at(defs, e["key"]).alias("d")))
    pair = lambda e: F.concat_ws("", e["key"], F.lit("="), e["value"])
    fits = dtd.matches_content(F.col("child_names"), decl["content"], decl["pattern"], decl["allowed"])

    def one(test: Column, detail: Column) -> Column:
        return F.when(test, F.array(detail))

    def each(test: Column, entries: Column, detail: Callable[[Column], Column]) -> Column:
        return F.when(test, F.transform(entries, detail))

    found: dict[Callable, Column] = {
        root_type: one(element & (F.col("depth") == 1) & (F.col("name") != F.col("doctype_name")), F.col("name")),
        element_declared: one(element & decl.isNull(), F.col("name")),
        attribute_declared: each(element & decl.isNotNull(), F.filter(known, lambda e: e["d"].isNull()), lambda e: F.concat_ws("@", "name", e["key"])),
        attribute_value: each(element, F.filter(known, lambda e: e["d"].isNotNull() & ~dtd.value_fits(e["value"], e["d"]["type"], e["d"]["enumeration"], t.names)), pair),
        fixed_value: each(element, F.filter(known, lambda e: e["d"]["fixed"] & (e["value"] != e["d"]["default_value"])), pair),
        required: each(element, F.filter(F.map_values(defs), lambda d: (d["required"] | d["fixed"]) & ~F.array_contains(F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")), d["name"])), lambda d: F.concat_ws("@", "name", d["name"])),
        text_shape: one((F.col("kind") == "#text") & _bad_text(), F.substring("text", 1, 30)),
        comment_shape: one((F.col("kind") == "#comment") & _bad_comment(), F.substring("text", 1, 30)),
        pi_shape: one((F.col("kind") == "#pi") & _bad_pi(t.names), F.col("target")),
        element_names: one((F.col("kind") == "#element") & _bad_names(t.names), F.col("name")),
    }
    if element_content in rules:
        found[element_content] = one(element & _bad_content(fits, decl["content"]), F.concat_ws("", "name", F.lit(":"), "child_names"))

    def named(rule: Callable) -> Column:
        return F.transform(found[rule], lambda d: F.struct(F.lit(rule.__name__).alias("rule"), d.alias("detail")))

    all_of = F.flatten(F.filter(F.array(*map(named, rules)), lambda x: x.isNotNull()))
    return rows.select("doc_id", "node_id", F.inline(all_of))


class _Types(Tables):
    """Tables whose declarations' violations stay by document type."""

    def per_doc(self, rows: DataFrame, detail: Column, rule: str) -> DataFrame:
        return rows.select("dtd_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def type_violations(t: Tables, rules: tuple[Callable[[Tables], DataFrame], ...] = TYPE_RULES) -> DataFrame:
    """What the given TYPE_RULES give, by one join with the documents.

    The rules are judged at once and held, as a plan of all of them beside those of nodes takes the driver's memory."""
    types, out = _Types(**vars(t)), None
    for rule in rules:
        rows = rule(types)
        out = rows if out is None else out.unionByName(rows)
    return t.docs.select("doc_id", "dtd_id").join(t.near(held(sound_unions(out).distinct())), "dtd_id").select("doc_id", F.lit(None).cast("int").alias("node_id"), "rule", "detail")


def validate(t: Tables, rules: tuple[Callable[[Tables], DataFrame], ...] = RULES) -> DataFrame:
    """All violations (doc_id, node_id, rule, detail) of the given rules: those of nodes in one pass, those of
    declarations by document type, the others each for itself."""
    parts = [rule(t) for rule in rules if rule not in NODE_RULES and rule not in TYPE_RULES]
    for kind, together in ((NODE_RULES, node_violations), (TYPE_RULES, type_violations)):
        some = tuple(rule for rule in rules if rule in kind)
        if some:
            parts.append(together(t, some))
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return sound_unions(out)


def valid(t: Tables) -> DataFrame:
    """doc_id of the documents that parse and violate nothing."""
    return t.docs.where("error IS NULL").select("doc_id").join(validate(t).select("doc_id"), "doc_id", "left_anti")


def first_bad_child(t: Tables) -> DataFrame:
    """(doc_id, node_id, name, first_bad) of elements whose children do not fit a model: the place of the first child
    after which nothing can make them fit, or their number if only more are missing.

    The longest prefix that can still fit is found by halving, with the model's partial pattern; the verdict is
    element_content's."""
    decl = dtd.first_declared(t.elem_decl).where("content = 'MODEL'").select("dtd_id", "name", "pattern", "partial")
    rows = t.elements.join(decl, ["dtd_id", "name"]).where(~F.rlike("child_names", F.col("pattern")))
    names = F.filter(F.split("child_names", " "), lambda x: x != "")
    rows = rows.select("doc_id", "node_id", "name", "partial", names.alias("_n"))
    count = F.size("_n")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        image = F.array_join(F.transform(F.slice("_n", 1, middle), lambda x: F.concat(F.lit(" "), x)), "")
        fits = F.rlike(image, F.col("partial"))
        done = state["high"] - state["low"] <= 1
        return F.when(done, state).when(fits, F.struct(middle.alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), (count + 1).alias("high"))
    return rows.select("doc_id", "node_id", "name", F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve)["low"].alias("first_bad"))
