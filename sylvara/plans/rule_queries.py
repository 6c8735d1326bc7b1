"""A registered query for each rule of validity: documents made from the part table of which those of odd size break the rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edit, validate
from ..operators.validate import Tables
from ..sources.xml import parse_xml
from .queries import QUERIES, SQL, _c, _s, _t

BAD = "p_size % 2 = 1"


def _tables(spark: SparkSession, sf_dir: str, good: Column, bad: Column) -> Tables:
    parts = _t(spark, sf_dir, "part")
    return Tables.of(parse_xml(parts.select(F.col("p_partkey").alias("doc_id"), F.when(F.expr(BAD), bad).otherwise(good).alias("content"))).kept())


def _register(name: str, made: Callable[[SparkSession, str], Tables], rule: Callable[[Tables], DataFrame], detail: str, where: str = BAD) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule(made(spark, sf_dir)).select("doc_id", "rule", "detail")

    query.__name__, query.__doc__ = name, f"Violations of {rule.__name__}."
    QUERIES[name] = query
    SQL[name] = f"SELECT p_partkey AS doc_id, '{rule.__name__}' AS rule, {detail} AS detail FROM part WHERE {where}"


def _of(good: Callable[[], Column] | str, bad: Callable[[], Column] | str) -> Callable[[SparkSession, str], Tables]:
    """Documents of either content; columns are made when the query runs, as they need a session."""
    return lambda spark, sf_dir: _tables(spark, sf_dir, *(F.lit(x) if isinstance(x, str) else x() for x in (good, bad)))


def _typed(declarations: str, body: str = "<a/>") -> str:
    return f"<!DOCTYPE a [<!ELEMENT a ANY>{declarations}]>{body}"


_N = "<!NOTATION n SYSTEM 'n'>"
# Rules of declarations: rule, declarations that keep it, declarations that break it, detail.
for _rule, _good, _bad, _detail in (
    (validate.element_unique, "<!ELEMENT b ANY>", "<!ELEMENT b ANY><!ELEMENT b EMPTY>", "b"),
    (validate.mixed_unique, "<!ELEMENT b (#PCDATA|a|c)*>", "<!ELEMENT b (#PCDATA|a|c|a)*>", "b"),
    (validate.one_id, "<!ATTLIST a i ID #IMPLIED>", "<!ATTLIST a i ID #IMPLIED j ID #IMPLIED>", "a"),
    (validate.id_default, "<!ATTLIST a i ID #REQUIRED>", "<!ATTLIST b i ID 'x'>", "b@i"),
    (validate.one_notation, f"{_N}<!ATTLIST a i NOTATION (n) #IMPLIED>", f"{_N}<!ATTLIST a i NOTATION (n) #IMPLIED j NOTATION (n) #IMPLIED>", "a"),
    (validate.notation_on_empty, f"<!ELEMENT b ANY>{_N}<!ATTLIST b i NOTATION (n) #IMPLIED>", f"<!ELEMENT b EMPTY>{_N}<!ATTLIST b i NOTATION (n) #IMPLIED>", "b@i"),
    (validate.notation_attribute, f"{_N}<!ATTLIST a i NOTATION (n) #IMPLIED>", f"{_N}<!ATTLIST a i NOTATION (n|late) #IMPLIED><!NOTATION late SYSTEM 'l'>", "late"),
    (validate.notation_entity, f"{_N}<!ENTITY u SYSTEM 'u' NDATA n>", "<!ENTITY u SYSTEM 'u' NDATA none>", "u:none"),
    (validate.notation_unique, f"{_N}<!NOTATION m PUBLIC 'm'>", f"{_N}<!NOTATION n PUBLIC 'm'>", "n"),
    (validate.choices_unique, "<!ATTLIST a k (x|y) #IMPLIED>", "<!ATTLIST a k (x|y|x) #IMPLIED>", "a@k"),
    (validate.default_value, "<!ATTLIST b k (x|y) 'y'>", "<!ATTLIST b k (x|y) 'z'>", "b@k"),
    (validate.deterministic, "<!ELEMENT b (c?, d)>", "<!ELEMENT b ((c, d)|(c, e))>", "b"),
):
    _register(f"rule_{_rule.__name__}", _of(_typed(_good), _typed(_bad)), _rule, f"'{_detail}'")

# Rules of elements and attributes, with values of the table.
def _brand() -> Column:
    return F.regexp_replace("p_brand", "#", "-")


_ATTRIBUTE = "<!DOCTYPE a [<!ELEMENT a ANY><!NOTATION n SYSTEM 'n'><!ENTITY u SYSTEM 'u' NDATA n><!ENTITY g 'text'><!ATTLIST a id ID #IMPLIED t NMTOKEN #IMPLIED ts NMTOKENS #IMPLIED r IDREF #IMPLIED e ENTITY #IMPLIED es ENTITIES #IMPLIED f CDATA #FIXED 'fixed' q CDATA #IMPLIED>]>"


def _with(name: str, good: Callable[[], Column], bad: Callable[[], Column]) -> Callable[[SparkSession, str], Tables]:
    """Documents of one element whose attribute has either value."""
    return _of(*[lambda x=x: _s(f'{_ATTRIBUTE}<a f="fixed" {name}="', x(), '"/>') for x in (good, bad)])


_register("rule_root_type", _of(lambda: _s("<!DOCTYPE b", _c("p_partkey"), " [<!ELEMENT a ANY>]><b", _c("p_partkey"), "/>"), lambda: _s("<!DOCTYPE b [<!ELEMENT a ANY>]><b", _c("p_partkey"), "/>")), validate.root_type, "'b' || p_partkey")
_register("rule_element_content", _of(lambda: _s("<!DOCTYPE a [<!ELEMENT a (n, s?, e*)><!ELEMENT n (#PCDATA)><!ELEMENT s EMPTY><!ELEMENT e EMPTY>]><a> <n>", F.col("p_name"), "</n>", F.repeat(F.lit("<e/>"), F.col("p_size") % 5), "</a>"), lambda: _s("<!DOCTYPE a [<!ELEMENT a (n, s?, e*)><!ELEMENT n (#PCDATA)><!ELEMENT s EMPTY><!ELEMENT e EMPTY>]><a><s/><n>", F.col("p_name"), "</n>", F.repeat(F.lit("<e/>"), F.col("p_size") % 5), "</a>")), validate.element_content, "'a: s n' || repeat(' e', p_size % 5)")
_register("rule_text_in_element_content", _of(lambda: _s("<!DOCTYPE a [<!ELEMENT a (b*)><!ELEMENT b EMPTY>]><a>\n <b/> </a>"), lambda: _s("<!DOCTYPE a [<!ELEMENT a (b*)><!ELEMENT b EMPTY>]><a><b/>", F.col("p_name"), "</a>")), validate.element_content, "'a: b'")
_register("rule_empty_content", _of(lambda: _s("<!DOCTYPE a [<!ELEMENT a EMPTY>]><a></a>"), lambda: _s("<!DOCTYPE a [<!ELEMENT a EMPTY>]><a><!--", F.col("p_name"), "--></a>")), validate.element_content, "'a:'")
_register("rule_nmtoken", _with("t", lambda: _brand(), lambda: F.col("p_brand")), validate.attribute_value, "'t=' || p_brand")
_register("rule_nmtokens_differ", _with("ts", lambda: _s(_brand(), " ", F.col("p_type")), lambda: _s(_brand(), " ", F.col("p_type"), "  ", _brand())), validate.attribute_value, "'ts=' || replace(p_brand, '#', '-') || ' ' || p_type || ' ' || replace(p_brand, '#', '-')")
_register("rule_id_is_name", _with("id", lambda: _s("p", _c("p_partkey")), lambda: _c("p_partkey")), validate.attribute_value, "'id=' || p_partkey")
_register("rule_entity_name", _with("e", lambda: F.lit("u"), lambda: F.lit("g")), validate.entity_name, "'g'")
_register("rule_entity_names", _with("es", lambda: F.lit("u"), lambda: _s("u x", _c("p_partkey"))), validate.entity_name, "'x' || p_partkey")
_register("rule_fixed_present", _of(lambda: _s(_ATTRIBUTE, '<a f="fixed"/>'), lambda: _s(_ATTRIBUTE, '<a q="', F.col("p_name"), '"/>')), validate.required, "'a@f'")
_register("rule_idref_elsewhere", _of(lambda: _s(_ATTRIBUTE, '<a f="fixed" id="p', _c("p_partkey"), '"><a f="fixed" r="p', _c("p_partkey"), '"/></a>'), lambda: _s(_ATTRIBUTE, '<a f="fixed" id="p', _c("p_partkey"), '"><a f="fixed" r="q', _c("p_partkey"), '"/></a>')), validate.idref_resolves, "'q' || p_partkey")


# Rules of shape: tables that were edited after parsing, as the parser gives none that break them.
def _odd() -> Column:
    return F.col("doc_id") % 2 == 1


_KEY = "p_partkey % 2 = 1"


def _shaped(change: Callable[[Tables], Tables]) -> Callable[[SparkSession, str], Tables]:
    def made(spark: SparkSession, sf_dir: str) -> Tables:
        name = F.col("p_name")
        head = _s("<!DOCTYPE a [<!ELEMENT a ANY><!ELEMENT b (#PCDATA|a)*><!ENTITY e", (F.col("p_partkey") % 2).cast("string"), " PUBLIC 'p' 's'><!NOTATION n PUBLIC 'n'>]>")
        docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _s(head, "<a k='v'>", name, "<!--", name, "--><?t ", name, "?><b/></a>").alias("content"))
        return change(Tables.of(parse_xml(docs).kept()))

    return made


def _edited(of: str, **values: Callable[[], Column]) -> Callable[[Tables], Tables]:
    def change(t: Tables) -> Tables:
        t.nodes = edit.update(t.nodes, (F.col("kind") == of) & _odd(), **{k: v() for k, v in values.items()})
        return t

    return change


def _second_root(t: Tables) -> Tables:
    root = t.nodes.where((F.col("depth") == 1) & (F.col("kind") == "#element") & _odd())
    t.nodes = validate.sound_unions(t.nodes.unionByName(root.withColumns({"node_id": F.lit(999), "last_desc": F.lit(999), "ord": F.lit(9)})))
    return t


def _odd_type(table: str, bad: Callable[[DataFrame], DataFrame]) -> Callable[[Tables], Tables]:
    """Declarations changed in the document type of odd keys, the one with an entity e1."""

    def change(t: Tables) -> Tables:
        types = t.entity.where("name = 'e1'").select("dtd_id").distinct()
        rows = getattr(t, table)
        odd = bad(rows.join(types, "dtd_id", "left_semi")).select(*rows.columns)
        setattr(t, table, validate.sound_unions(rows.join(types, "dtd_id", "left_anti").select(*rows.columns).unionByName(odd)))
        return t

    return change


_register("rule_document_shape", _shaped(_second_root), validate.document_shape, "'2 1'", _KEY)
_register("rule_element_children", _shaped(_edited("#comment", kind=lambda: F.lit("#attdef"))), validate.element_children, "'#attdef'", _KEY)
_register("rule_text_shape", _shaped(_edited("#text", text=lambda: F.concat("text", F.lit("]]>")), section=lambda: F.lit(True))), validate.text_shape, "substring(p_name || ']]>', 1, 30)", _KEY)
_register("rule_comment_shape", _shaped(_edited("#comment", text=lambda: F.concat("text", F.lit("--")))), validate.comment_shape, "substring(p_name || '--', 1, 30)", _KEY)
_register("rule_pi_shape", _shaped(_edited("#pi", target=lambda: F.lit("XML"))), validate.pi_shape, "'XML'", _KEY)
_register("rule_element_names", _shaped(_edited("#element", name=lambda: F.concat(F.lit("1"), "name"))), validate.element_names, "n", _KEY)
SQL["rule_element_names"] = "SELECT p_partkey AS doc_id, 'element_names' AS rule, n AS detail FROM part, (VALUES ('1a'), ('1b')) AS v(n) WHERE p_partkey % 2 = 1"
_register("rule_external_ids", _shaped(_odd_type("entity", lambda rows: rows.withColumn("public_id", F.lit("{")))), validate.external_ids, "'e1'", _KEY)
_register("rule_entity_shape", _shaped(_odd_type("entity", lambda rows: rows.withColumn("value", F.lit("both")))), validate.entity_shape, "'e1'", _KEY)
_register("rule_declaration_names", _shaped(_odd_type("notation", lambda rows: rows.withColumn("name", F.lit("1n")))), validate.declaration_names, "'1n'", _KEY)
_register("rule_mixed_shape", _shaped(_odd_type("elem_decl", lambda rows: rows.withColumn("mixed", F.lit(True)).where("name = 'a'"))), validate.mixed_shape, "'a'", _KEY)
