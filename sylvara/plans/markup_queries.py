"""Registered queries over markup, document types, encodings, edits and layout, with values of the tables in the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, encoding, strings
from ..operators import attrs, dtd, edit, nav, writer
from ..session import dealt
from ..sources.parser import Options
from ..sources.xml import XmlTables, parse_dtd, parse_xml
from .queries import _c, _joined, _query, _s, _t

# -- markup


def _safe(text: Column) -> Column:
    """Text that may stand in a comment, a processing instruction and a section alike."""
    out = F.translate(F.coalesce(text, F.lit("")), "\r", "")
    for old, new in (("--", "- -"), ("?>", "? >"), ("]]>", "]] >")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


_SAFE = "replace(replace(replace(replace(coalesce(text, ''), chr(13), ''), '--', '- -'), '?>', '? >'), ']]>', ']] >')"


@_query(f"SELECT doc_id, {_SAFE} || ' ' AS comment, nullif(ltrim({_SAFE}, ' ' || chr(9) || chr(10)) , '') AS instruction, {_SAFE} AS section, lang AS target FROM documents")
def comments_instructions_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(_safe(F.col("text")), "--", "- -")
    docs = _t(spark, sf_dir, "documents").select("doc_id", _s("<d><!--", t, " --><?", F.col("lang"), " ", t, "?><![CDATA[", t, "]]></d>").alias("content"))
    nodes = parse_xml(docs).nodes

    def of(kind: str, column: str = "text") -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    return nodes.groupBy("doc_id").agg(of("#comment").alias("comment"), of("#pi").alias("instruction"), F.max(F.when((F.col("kind") == "#text") & F.col("section"), F.col("text"))).alias("section"), of("#pi", "target").alias("target"))


@_query("SELECT p_partkey AS doc_id, '1.' || p_size AS version, ['utf_8', 'ISO-8859-1', 'windows-1251'][1 + p_partkey % 3] AS encoding, p_size % 2 = 1 AS standalone FROM part")
def xml_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit(""), F.lit(" encoding='ISO-8859-1'"), F.lit(' encoding="windows-1251"')), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = _s("<?xml version='1.", _c("p_size"), "'", name, F.when(F.col("p_size") % 2 == 1, " standalone='yes'").otherwise(""), "?><p/>")
    docs = dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.encode(text, "UTF-8").alias("content"))
    return parse_xml(docs).docs.select("doc_id", "version", "encoding", "standalone")


_FAULTS = (
    ("</wrong>", "TYPE_MATCH", 8), ("<a k='1' k='2'/>", "UNIQUE_ATT", None), ("&nothing;", "ENTITY_DECLARED", None), ("<!--x--y-->", "COMMENT", None), ("<?xml x?>", "PI", None), ("]]>", "CONTENT", None), ("<b k='<'/>", "NO_LT", None), ("&#0;", "LEGAL_CHARACTER", None),
)


@_query("SELECT p_partkey AS doc_id, [" + ", ".join(f"'{code}'" for _, code, _ in _FAULTS) + f"][1 + p_partkey % {len(_FAULTS)}] AS code, CAST(p_size % 7 + 1 AS INTEGER) AS line FROM part WHERE p_size % 3 <> 0")
def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents in three have a fault, on a line that depends on the part."""
    fault = F.element_at(F.array(*[F.lit(x) for x, _, _ in _FAULTS]), (F.col("p_partkey") % len(_FAULTS) + 1).cast("int"))
    body = _s("<p>", F.repeat(F.lit("\n"), F.col("p_size") % 7), F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(fault), "</p>")
    return parse_xml(dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), body.alias("content"))).errors.select("doc_id", "code", "line")


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'BAD_CHAR' ELSE 'UNCLOSED' END AS code FROM documents")
def illegal_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null character ends a document; without it the missing end tag is the fault."""
    text = _s("<d>", strings.escape_cdata(F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 2 == 0, F.lit("\0")).otherwise(""))
    return parse_xml(_t(spark, sf_dir, "documents").select("doc_id", text.alias("content"))).errors.select("doc_id", "code")


# -- entities and external resources

_PLACES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _by_region(spark: SparkSession, sf_dir: str, content: str, resource: Column, name: str) -> DataFrame:
    """Documents of customers, all alike, in a folder of their region; each folder has a resource of its own."""
    people = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = people.select(F.col("c_custkey").alias("doc_id"), F.lit(content).alias("content"), _s("http://h/", _c("n_regionkey"), "/doc.xml").alias("base"))
    resources = _t(spark, sf_dir, "region").select(_s("http://h/", _c("r_regionkey"), f"/{name}").alias("path"), resource.alias("content"))
    return parse_xml(docs, path=F.col("base"), resources=resources)


@_query(f"SELECT c_custkey AS doc_id, r_name AS region FROM {_PLACES}")
def external_dtd_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document type declaration, and the external subset of each document's own folder."""
    x = _by_region(spark, sf_dir, "<!DOCTYPE r SYSTEM 'r.dtd'><r/>", _s("<!ATTLIST r region CDATA '", F.col("r_name"), "'>"), "r.dtd")
    return nav.root(x.nodes).select("doc_id", attrs.get("region").alias("region"))


@_query(f"SELECT c_custkey AS doc_id, 'in ' || r_name || ' 1' AS text FROM {_PLACES}")
def conditional_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = _s("<?xml encoding='utf-8'?><!ENTITY % on 'INCLUDE'><!ENTITY % off 'IGNORE'><![%off;[<!ENTITY e 'ignored'> <![ nested ' ]]> ]]><![ %on; [<![INCLUDE[<!ENTITY e 'in ", F.col("r_name"), " '>]]>]]><!ENTITY e 'too late'>")
    x = _by_region(spark, sf_dir, "<!DOCTYPE r SYSTEM 's.dtd' [<!ENTITY n '1'>]><r>&e;&n;</r>", subset, "s.dtd")
    return x.nodes.where("kind = '#text'").select("doc_id", "text")


@_query(f"SELECT c_custkey AS doc_id, r_name AS name, 'text of ' || r_name AS text FROM {_PLACES}")
def external_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed entity in the document's folder, with a text declaration, and markup in it."""
    x = _by_region(spark, sf_dir, "<!DOCTYPE r [<!ENTITY e SYSTEM 'e.xml'>]><r>&e;</r>", _s("<?xml version='1.0' encoding='utf-8'?><part name='", F.col("r_name"), "'>text of ", F.col("r_name"), "</part>"), "e.xml")
    part = x.nodes.where("name = 'part'").select("doc_id", "node_id", attrs.get("name").alias("name"))
    return part.join(x.nodes.where("kind = '#text'").select("doc_id", F.col("parent_id").alias("node_id"), "text"), ["doc_id", "node_id"]).select("doc_id", "name", "text")


@_query("SELECT p_partkey AS doc_id, p_name || '/' || p_brand AS text FROM part")
def parameter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations out of parameter entities, and their text in an entity's value."""
    head = _s("<!DOCTYPE p [<!ENTITY % name '", F.col("p_name"), "'><!ENTITY % more '<!ENTITY brand \"", F.col("p_brand"), "\">'>%more;<!ENTITY all '%name;/&brand;'>]>")
    return parse_xml(dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), _s(head, "<p>&all;</p>").alias("content"))).nodes.where("kind = '#text'").select("doc_id", "text")


@_query("SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'NO_RECURSION' WHEN 1 THEN 'EXPANSION_COUNT' WHEN 2 THEN 'EXPANSION_SIZE' ELSE 'BOUNDARY' END AS code FROM part")
def expansion_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    kinds = [_s("<!DOCTYPE p [<!ENTITY a '", name, "&b;'><!ENTITY b '&a;'>]><p>&a;</p>"), _s("<!DOCTYPE p [<!ENTITY a '", name, "'>]><p>", F.repeat(F.lit("&a;"), 41), "</p>"), _s("<!DOCTYPE p [<!ENTITY a '", F.repeat(name, 400), "'>]><p>&a;</p>"), _s("<!DOCTYPE p [<!ENTITY a '<b>", name, "'>]><p>&a;</b></p>")]
    content = F.element_at(F.array(*kinds), (F.col("p_size") % 4 + 1).cast("int"))
    docs = dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), content.alias("content"))
    return parse_xml(docs, options=Options(max_expansion_count=40, max_expansion_size=1500)).errors.select("doc_id", "code")


@_query("SELECT name, type, count(*) AS n, max(system_id) AS system_id, max(notation) AS notation FROM (SELECT 'u' AS name, 'UNPARSED' AS type, 'u.png' AS system_id, 'png' AS notation FROM nation UNION ALL SELECT 'i', 'GENERAL', NULL, NULL FROM nation UNION ALL SELECT 'p', 'PARAMETER', 'p.ent', NULL FROM nation) GROUP BY name, type")
def entity_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s("<!DOCTYPE n [<!NOTATION png SYSTEM 'png'><!ENTITY u SYSTEM 'u.png' NDATA png><!ENTITY i '", F.col("n_name"), "'><!ENTITY % p SYSTEM 'p.ent'>]><n/>").alias("content"))
    return parse_xml(docs).entity.groupBy("name", "type").agg(F.count("*").alias("n"), F.max("system_id").alias("system_id"), F.max("notation_name").alias("notation"))


@_query("SELECT 'n' || n_nationkey AS name, CASE WHEN n_regionkey = 0 THEN n_name END AS public_id, CASE WHEN n_regionkey <> 0 THEN n_name END AS system_id FROM nation")
def notation_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _s("<!NOTATION n", _c("n_nationkey"), F.when(F.col("n_regionkey") == 0, " PUBLIC '").otherwise(" SYSTEM '"), F.col("n_name"), "'>")
    docs = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(_s("<!DOCTYPE d [", _joined(row, "n_nationkey"), "]><d/>").alias("content"))
    return parse_xml(docs).notation.select("name", "public_id", "system_id")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'd' AS doctype_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS public_id, n_name || '.dtd' AS system_id FROM nation")
def external_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers of document types, whose subsets come from a table."""
    name = F.col("n_name")
    rows = _t(spark, sf_dir, "nation")
    docs = rows.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, _s("<!DOCTYPE d PUBLIC '", name, "' '", name, ".dtd'><d/>")).otherwise(_s("<!DOCTYPE d SYSTEM '", name, ".dtd'><d/>")).alias("content"))
    x = parse_xml(docs, resources=rows.select(_s(name, ".dtd").alias("path"), F.lit("<!ELEMENT d EMPTY>").alias("content")))
    return x.docs.select("doc_id", "doctype_name", "public_id", "system_id")


@_query("SELECT 'r' || r_regionkey || '.dtd' AS path, 'n' || n_nationkey AS name, '(#PCDATA|x' || n_nationkey || ')*' AS spec, 'MIXED' AS content FROM nation JOIN region ON n_regionkey = r_regionkey")
def external_subsets_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types parsed without a document; the path is the key."""
    row = _s("<!ELEMENT n", _c("n_nationkey"), " ( #PCDATA | x", _c("n_nationkey"), " )*>")
    files = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(_s("<?xml encoding='utf-8'?>", _joined(row, "n_nationkey")).alias("content")).select(_s("r", _c("n_regionkey"), ".dtd").alias("path"), "content")
    x = parse_dtd(files).kept()
    return x.docs.select("path", "dtd_id").join(x.elem_decl, "dtd_id").select("path", "name", "spec", "content")


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '<?xml version=\"2\"?>' || coalesce(text, '') END AS text FROM documents WHERE doc_id % 2 = 0")
def external_entity_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an external parsed entity behind its text declaration; an unsound declaration is an error."""
    head = F.when(F.col("doc_id") % 2 == 0, "<?xml encoding='utf-8'?>").otherwise('<?xml version="2"?>')
    docs = _t(spark, sf_dir, "documents").select("doc_id", _s(head, F.translate(F.coalesce("text", F.lit("")), "\r", "")).alias("content"))
    return parse_xml(docs, options=Options(root="extEntity")).nodes.where("kind = '#text'").select("doc_id", "text")


# -- declarations


@_query("""SELECT type, count(*) AS n, bool_or(is_list) AS is_list, bool_or(is_reference) AS is_reference, bool_or(is_name) AS is_name, bool_or(is_tokenized) AS is_tokenized, bool_or(has_default) AS has_default
FROM nation, (VALUES ('CDATA', false, false, false, false, true), ('ID', false, false, true, true, false), ('IDREFS', true, true, true, true, false), ('NMTOKENS', true, false, false, true, true), ('ENTITY', false, true, true, true, false), ('ENUMERATION', false, false, false, true, true)) AS v(type, is_list, is_reference, is_name, is_tokenized, has_default) GROUP BY type""")
def attdef_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s("<!DOCTYPE n [<!ATTLIST n c CDATA '", name, "' i ID #IMPLIED r IDREFS #IMPLIED t NMTOKENS 'a b' e ENTITY #REQUIRED k (x|y) 'x'>]><n e='u'/>").alias("content"))
    rows = parse_xml(docs).attdef
    made = {"is_list": dtd.is_list(), "is_reference": dtd.is_reference(), "is_name": dtd.is_name_type(), "is_tokenized": dtd.is_tokenized(), "has_default": dtd.has_default()}
    return rows.groupBy("type").agg(F.count("*").alias("n"), *[F.bool_or(v).alias(k) for k, v in made.items()])


@_query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'n' AS name, '(a' || n_nationkey || ', (b|c)*, d?)' AS spec, 'MODEL' AS content, false AS allows_text, ['a' || n_nationkey, 'b', 'c', 'd'] AS entries, false AS ambiguous FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'm', '(#PCDATA|x' || n_nationkey || ')*', 'MIXED', true, ['x' || n_nationkey], false FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'o', '((x, y)|(x, z' || n_nationkey || '))', 'MODEL', false, ['x', 'y', 'z' || n_nationkey], true FROM nation")
def element_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models as written, the names in them in order of first use, and whether they are ambiguous."""
    k = _c("n_nationkey")
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s("<!DOCTYPE n [<!ELEMENT n ( a", k, " , ( b | c )* , d? )><!ELEMENT m (#PCDATA | x", k, ")*><!ELEMENT o ((x,y)|(x,z", k, "))>]><n/>").alias("content"))
    x = parse_xml(docs).kept()
    spec = x.content_spec.where("type = 'ELEMENT'").groupBy("dtd_id", "element", "name").agg(F.min("spec_id").alias("at"))
    names = spec.groupBy("dtd_id", F.col("element").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("name").alias("x")))), lambda s: s["x"]).alias("found"))
    rows = x.docs.select("doc_id", "dtd_id").join(x.elem_decl, "dtd_id").join(names, ["dtd_id", "name"], "left")
    return rows.select("doc_id", "name", "spec", "content", dtd.allows_text().alias("allows_text"), F.coalesce(F.when(F.col("mixed"), F.col("allowed")), F.col("found")).alias("entries"), "ambiguous")


_LAID = "'<!DOCTYPE p [' || chr(10) || '  <!ELEMENT p (#PCDATA|q)*>' || chr(10) || '  <!-- ' || p_name || ' -->' || chr(10) || '  <?do it?>' || chr(10) || '  <!ATTLIST p' || chr(10) || '    kind (x|y)             \"y\"' || chr(10) || '    size NMTOKEN #REQUIRED>' || chr(10) || '  <!NOTATION gif PUBLIC \"' || p_type || '\">' || chr(10) || '  <!ENTITY pic SYSTEM \"' || p_partkey || '.gif\" NDATA gif>' || chr(10) || '  <!ENTITY % par \"&#x3c;' || p_name || '>\">' || chr(10) || ']>' || chr(10) || chr(10)"


@_query(f"SELECT p_partkey AS doc_id, {_LAID} || '<p' || chr(10) || '  kind=\"y\"' || chr(10) || '  size=\"' || p_size || '\"/>' AS xml FROM part")
def to_xml_with_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their document types, laid out."""
    head = _s("<!DOCTYPE p [<!ELEMENT p (#PCDATA | q)*><!--", F.col("p_name"), "--><?do it?><!ATTLIST p size NMTOKEN #REQUIRED kind (x|y) 'y'><!NOTATION gif PUBLIC '", F.col("p_type"), "'><!ENTITY pic SYSTEM '", _c("p_partkey"), ".gif' NDATA gif><!ENTITY % par '&#60;", F.col("p_name"), "&#62;'>]>")
    docs = dealt(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), _s(head, '<p size="', _c("p_size"), '"/>').alias("content"))
    x = parse_xml(docs).kept()
    return writer.to_xml(x.nodes, x.docs, {k: x.table(k) for k in ("elem_decl", "attdef", "entity", "notation")}, xml_decl=False)


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{"nodeType": "#document", "children": [{"nodeType": "#doctypeDecl", "children": [{"nodeType": "#attlistDecl", "children": [{"nodeType": "#attdef", "defaultValue": "' || n_name || '", "enumeration": null, "fixed": false, "name": "k", "required": false, "type": "CDATA"}], "elementName": "n"}], "external": null, "name": "n", "publicID": null, "systemID": null}, {"nodeType": "#comment", "content": "' || n_name || '"}, {"nodeType": "#element", "children": [], "attr": {"k": "' || n_name || '"}, "name": "n"}], "standalone": false}' AS json FROM nation""")
def to_json_with_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _s("<!DOCTYPE n [<!ATTLIST n k CDATA '", name, "'>]><!--", name, "--><n/>").alias("content"))
    x = parse_xml(docs).kept()
    return writer.to_json(x.nodes, x.docs, {"attdef": x.attdef})


# -- encodings

_LOW = "abcdefghijklmnopqrstuvwxyz"


def _ascii_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\n -~]|[\\~]", "?")


_ASCII_ONLY = r"regexp_replace(coalesce(text, ''), '[^\n -~]|[\\~]', '?', 'g')"


def _moved(first: int) -> str:
    return "".join(chr(first + k) for k in range(26))


@_query(f"SELECT doc_id, translate({_ASCII_ONLY}, '{_LOW}', '{_moved(0xFF71)}') AS text, 'shift_jisx0213' AS encoding FROM documents")
def decode_shift_jis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters as the single bytes of half-width katakana."""
    raw = F.encode(F.translate(_ascii_only(F.col("text")), _LOW, _moved(0xB1)), "ISO-8859-1")
    return _t(spark, sf_dir, "documents").select("doc_id", encoding.decode_content(raw, "Shift_JIS").alias("d")).select("doc_id", "d.text", "d.encoding")


_PAGES = (("windows-1251", 0xC0, 0x410), ("iso-8859-5", 0xB0, 0x410), ("cp1252", 0xC0, 0xC0), ("ISO_8859-1", 0xE0, 0xE0))


@_query(f"SELECT doc_id, CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN translate({_ASCII_ONLY}, '{_LOW}', '{_moved(to)}')" for k, (_, _, to) in enumerate(_PAGES)) + " END AS text FROM documents")
def decode_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-byte encodings by label, a label per row."""
    k, text = F.col("doc_id") % 4, _ascii_only(F.col("text"))
    raw, label = None, None
    for n, (name, first, _) in enumerate(_PAGES):
        moved = F.translate(text, _LOW, _moved(first))
        raw = F.when(k == n, moved) if raw is None else raw.when(k == n, moved)
        label = F.when(k == n, name) if label is None else label.when(k == n, name)
    return _t(spark, sf_dir, "documents").select("doc_id", encoding.decode_content(F.encode(raw, "ISO-8859-1"), label)["text"].alias("text"))


@_query(f"SELECT doc_id, translate({_ASCII_ONLY}, '{_LOW}', '{_moved(0x430)}') AS text FROM documents WHERE coalesce(text, '') <> ''")
def declared_encoding_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes whose own declaration names the encoding of the rest."""
    text = _s("<?xml version='1.0' encoding='windows-1251'?><D><![CDATA[", F.translate(F.replace(_ascii_only(F.col("text")), F.lit("]]>"), F.lit("]] >")), _LOW, _moved(0xE0)), "]]></D>")
    return parse_xml(_t(spark, sf_dir, "documents").select("doc_id", F.encode(text, "ISO-8859-1").alias("content"))).nodes.where("kind = '#text' AND text <> ''").select("doc_id", "text")


@_query("SELECT label, count(*) AS n FROM documents, (VALUES ('unknown label'), ('cut short'), ('malformed'), ('contradiction')) AS v(label) WHERE doc_id % 4 = (CASE label WHEN 'unknown label' THEN 0 WHEN 'cut short' THEN 1 WHEN 'malformed' THEN 2 ELSE 3 END) GROUP BY label")
def decode_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are rejected: an unknown label, half a character at the end, a byte that cannot stand, a mark against the label."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    raw = F.when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"), F.unhex(F.lit("00")))).when(k == 2, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("C328")))).when(k == 3, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    label = F.when(k == 0, "klingon").when(k == 3, "utf-16be")
    got = _t(spark, sf_dir, "documents").select(k.alias("k"), encoding.decode_content(raw, label).alias("d")).where("d.problem IS NOT NULL AND d.text IS NULL")
    names = F.element_at(F.array(F.lit("unknown label"), F.lit("cut short"), F.lit("malformed"), F.lit("contradiction")), (F.col("k") + 1).cast("int"))
    return got.groupBy(names.alias("label")).agg(F.count("*").alias("n"))


@_query("SELECT p_partkey AS doc_id, upper(regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9]', '', 'g')) AS key, p_brand AS declared FROM part")
def encoding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _s("<?xml version='1.0' encoding='", F.replace("p_brand", F.lit("#"), F.lit("_")), "'?><p/>")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), encoding.encoding_key(_s(F.col("p_brand"), "-", F.col("p_type"))).alias("key"), F.replace(encoding.declared_encoding(head), F.lit("_"), F.lit("#")).alias("declared"))


# -- characters and strings

_MORE = {
    "xml_char": "true", "cdata_section_char": "c <> ']'", "proc_inst_value_char": "c <> '?'", "att_value_char_dbl": "c NOT IN ('&', '<', '\"')", "att_value_char_sng": "c NOT IN ('&', '<', '''')",
    "public_id_char_sng": r"regexp_full_match(c, '[-\n\r a-zA-Z0-9()+,./:=?;!*#@$_%]')", "system_id_char_dbl": "c <> '\"'", "system_id_char_sng": "c <> ''''",
}


@_query("SELECT c, count(*) AS n, " + ", ".join(f"{v} AS {k}" for k, v in _MORE.items()) + " FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def character_classes_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return each.select("c", "n", *[chars.is_char(F.col("c"), k).alias(k) for k in _MORE])


@_query(r"""SELECT doc_id, NOT contains(text, '?>') AS no_question_end, NOT contains(text, ']]>') AS no_section_end, lower(lang) <> 'xml' AS not_xml, regexp_full_match(text, '[-\n\r a-zA-Z0-9''()+,./:=?;!*#@$_%]*') AS is_public_id, true AS is_xml_string,
'PUBLIC "' || source || '" "' || lang || '"' AS public, 'SYSTEM "' || lang || '"' AS system, repeat(' ', CAST(2 * (doc_id % 5) AS INTEGER)) AS indent, replace(replace(replace(replace(replace(text, '&#', '&#x26;#'), '<', '&#x3c;'), '%', '&#x25;'), '''', '&#x27;'), '"', '&#x22;') AS ref_out FROM documents""")
def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, none = F.col("text"), F.lit(None).cast("string")
    return _t(spark, sf_dir, "documents").select(
        "doc_id", strings.no_question_end(t).alias("no_question_end"), strings.no_section_end(t).alias("no_section_end"), strings.not_xml(F.col("lang")).alias("not_xml"), strings.is_public_id(t).alias("is_public_id"), strings.is_xml_string(t).alias("is_xml_string"),
        strings.ext_id(F.col("source"), F.col("lang")).alias("public"), strings.ext_id(none, F.col("lang")).alias("system"), strings.indent((F.col("doc_id") % 5).cast("int")).alias("indent"), strings.ref_out(t).alias("ref_out"),
    )


# -- navigation and attributes


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer: orders with values, some with a note."""
    note = F.when(F.col("o_orderstatus") == "O", _s("<note>", F.col("o_orderpriority"), "</note>")).otherwise("")
    o = _s('<o key="', _c("o_orderkey"), '" status="', F.col("o_orderstatus"), '">', note, "</o>")
    return dealt(_t(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(_s("<?first?><!DOCTYPE c [<!ATTLIST o status CDATA 'N' level CDATA 'low'>]><c>", _joined(o, "o_orderkey"), "</c>").alias("content"))


def _people_tables(spark: SparkSession, sf_dir: str) -> XmlTables:
    return parse_xml(_people(spark, sf_dir)).kept()


@_query("SELECT o_custkey AS doc_id, CAST(2 + count(*) FILTER (o_orderstatus = 'O') AS BIGINT) + count(*) AS n_deep, CAST(3 AS BIGINT) AS n_top, CAST(1 AS BIGINT) AS n_types FROM orders GROUP BY o_custkey")
def document_and_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands below the document outside of its document type, at its top, and how many document types."""
    nodes = _people_tables(spark, sf_dir).nodes
    kind = nodes.where("kind IN ('#element', '#pi')").groupBy("doc_id").agg(F.count("*").alias("n_deep"))
    top = nav.children(nodes, nav.document(nodes)).groupBy("doc_id").agg(F.count("*").alias("n_top"))
    types = nav.doctype(nodes).groupBy("doc_id").agg(F.count("*").alias("n_types"))
    return kind.join(top, "doc_id").join(types, "doc_id").select("doc_id", "n_deep", "n_top", "n_types")


@_query("SELECT o_custkey AS doc_id, o_orderkey AS key, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_after FROM orders QUALIFY n_after > 0")
def following_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _people_tables(spark, sf_dir).nodes.where("name = 'o' AND kind = '#element'")
    found = nav.following(o, o).groupBy("doc_id", "ctx_id").agg(F.count("*").alias("n_after"))
    key = o.select("doc_id", F.col("node_id").alias("ctx_id"), attrs.get("key").cast("long").alias("key"))
    return found.join(key, ["doc_id", "ctx_id"]).select("doc_id", "key", "n_after")


@_query("SELECT o_custkey AS doc_id, bool_or(o_orderstatus = 'F') AS any_failed, bool_and(o_orderstatus = 'F') AS all_failed, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS filtered, list(o_orderkey ORDER BY o_orderkey DESC) AS reversed, CAST(min(o_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS found, CAST(sum(o_orderkey) AS BIGINT) AS reduced, string_agg(o_orderstatus, '-' ORDER BY o_orderkey) AS joined, list(o_orderkey ORDER BY o_orderkey)[2:3] AS sliced FROM orders GROUP BY o_custkey")
def child_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shallow work on the children of the root as an array: some, every, filter, reverse, find, reduce, join, slice."""
    nodes = _people_tables(spark, sf_dir).nodes.withColumn("key", attrs.get("key").cast("long")).withColumn("status", attrs.get("status"))
    kids = nav.child_array(nodes.where("kind IN ('#element') AND depth = 2"), "key", "status")
    c, failed = F.col("children"), lambda x: x["status"] == "F"
    keys = lambda a: F.transform(a, lambda x: x["key"])
    some = F.exists(c, failed)
    return kids.select(
        "doc_id", some.alias("any_failed"), F.forall(c, failed).alias("all_failed"), F.when(some, keys(F.filter(c, failed))).alias("filtered"), keys(F.reverse(c)).alias("reversed"), F.get(keys(F.filter(c, failed)), F.lit(0)).alias("found"),
        F.aggregate(keys(c), F.lit(0).cast("long"), lambda a, x: a + x).alias("reduced"), F.array_join(F.transform(c, lambda x: x["status"]), "-").alias("joined"), keys(F.slice(c, 2, 2)).alias("sliced"),
    )


@_query("SELECT o_orderkey AS key, 'N' AS status, 'high' AS level, false AS has_key, o_orderstatus || '/' || 'low' AS before, 'key,level,status' AS names FROM orders")
def attribute_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute reset to its default, one set, one deleted; and the names before."""
    x = _people_tables(spark, sf_dir)
    o = x.nodes.where("name = 'o' AND kind = '#element'").withColumn("before", F.concat_ws("/", attrs.get("status"), attrs.get("level"))).withColumn("key", attrs.get("key").cast("long")).withColumn("names", F.array_join(F.array_sort(F.transform(attrs.entries(), lambda e: e["key"])), ","))
    reset = attrs.reset(o, x.docs, x.attdef, "status")
    done = reset.withColumn("attrs", attrs.put("level", "high")).withColumn("attrs", attrs.drop("key"))
    return done.select("key", attrs.get("status").alias("status"), attrs.get("level").alias("level"), attrs.has("key").alias("has_key"), "before", "names")


# -- edits


def _orders_xml(content: str) -> str:
    return f"string_agg({content}, '' ORDER BY o_orderkey)"


_PLAIN = "'<o key=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\"' || CASE WHEN o_orderstatus = 'O' THEN '><note>' || o_orderpriority || '</note></o>' ELSE '/>' END"


def _edit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of _people without document type and instruction."""
    docs = _people(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"^.*?\]>", ""))
    return parse_xml(docs).kept().nodes


def _new(rows: DataFrame, name: Column | str, at: str = "node_id", place: int = 0, number: int = -2, text: Column | None = None) -> DataFrame:
    """A new element (or text, where given) below each row."""
    made = {"node_id": F.lit(number), "parent_id": F.col(at), "ord": F.lit(place), "depth": F.lit(0), "last_desc": F.lit(number), "kind": F.lit("#text" if text is not None else "#element"), "name": F.lit(name) if isinstance(name, str) else name, "text": text if text is not None else F.lit(None)}
    if text is None:
        made["attrs"] = F.create_map().cast("map<string,string>")
    types = {f.name: f.dataType for f in edit.NODE}
    return rows.select("doc_id", *[(made.get(c, F.lit(None))).cast(types[c]).alias(c) for c in edit.NODE.names])


@_query(f"SELECT o_custkey AS doc_id, '<c><head/>' || {_orders_xml(_PLAIN)} || '</c>' AS xml FROM orders GROUP BY o_custkey")
def edit_unshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.unshift(nodes, _new(nav.root(nodes), "head")))


@_query(f"SELECT o_custkey AS doc_id, '<c>' || {_orders_xml(_PLAIN)} || 'tail</c>' AS xml FROM orders GROUP BY o_custkey")
def edit_push_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.push(nodes, _new(nav.root(nodes), "", text=F.lit("tail"))))


@_query(f"SELECT doc_id, '<c>' || string_agg(CASE WHEN k = 1 THEN '<new/>' ELSE piece END, '' ORDER BY o_orderkey) || '</c>' AS xml FROM (SELECT o_custkey AS doc_id, o_orderkey, {_PLAIN} AS piece, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k <> 2 GROUP BY doc_id HAVING count(*) > 1")
def edit_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third child replaced by a new one, where there is a second."""
    nodes = _edit_nodes(spark, sf_dir)
    two = nodes.where("depth = 2 AND ord = 1 AND kind = '#element'").select("doc_id", "parent_id", F.lit(1).alias("start"), F.lit(2).alias("count"))
    mine = nodes.join(two.select("doc_id"), "doc_id", "left_semi")
    return writer.to_xml_compact(edit.splice(mine, two, _new(nav.root(mine), "new")))


@_query(f"SELECT o_custkey AS doc_id, '<c>' || coalesce(string_agg({_PLAIN}, '' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F') || '</c>', '') AS xml FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'F') > 0")
def edit_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    left = edit.remove(nodes, nodes.where((F.col("name") == "o") & (attrs.get("status") == "F")))
    return writer.to_xml_compact(left).where("xml <> '<c/>'")


@_query(f"SELECT doc_id, '<c>' || string_agg(piece, '' ORDER BY o_orderkey) || '</c>' AS xml FROM (SELECT o_custkey AS doc_id, o_orderkey, {_PLAIN} AS piece, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3 GROUP BY doc_id")
def edit_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.truncate(nodes, nav.root(nodes), 3))


@_query(f"SELECT doc_id, '<c>' || string_agg(piece, '' ORDER BY o_orderkey) || '</c>' AS xml FROM (SELECT o_custkey AS doc_id, o_orderkey, {_PLAIN} AS piece, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1 GROUP BY doc_id")
def edit_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.shift(nodes, nav.root(nodes))).where("xml <> '<c/>'")


@_query(f"SELECT doc_id, '<c>' || string_agg(CASE WHEN k = 1 THEN '<new/>' ELSE piece END, '' ORDER BY o_orderkey) || '</c>' AS xml FROM (SELECT o_custkey AS doc_id, o_orderkey, {_PLAIN} AS piece, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY doc_id")
def edit_replace_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    at = nav.root(nodes).select("doc_id", F.col("node_id").alias("parent_id"), F.lit(0).alias("ord"))
    return writer.to_xml_compact(edit.replace_child(nodes, at, _new(nav.root(nodes), "new")))


@_query(f"SELECT o_orderkey AS doc_id, {_PLAIN} AS xml FROM orders")
def edit_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of its own for each order."""
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.clone(nodes, nodes.where("name = 'o'"), attrs.get("key").cast("long")))


@_query("SELECT DISTINCT o_custkey AS doc_id, '<root/>' AS xml FROM orders")
def edit_set_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    return writer.to_xml_compact(edit.set_root(nodes, _new(nav.document(nodes), "root")))


@_query("SELECT o_custkey AS doc_id, CAST(1 AS INTEGER) AS place, CAST(2 AS INTEGER) AS root_place, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def edit_set_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document type replaced by one of another name; the instruction before it and the root behind it stay."""
    nodes = _people_tables(spark, sf_dir).nodes
    made = edit.set_doctype(nodes, _new(nav.document(nodes), "other").withColumn("kind", F.lit("#doctypeDecl")))
    return made.groupBy("doc_id").agg(F.max(F.when((F.col("kind") == "#doctypeDecl") & (F.col("name") == "other"), F.col("ord"))).alias("place"), F.max(F.when((F.col("kind") == "#element") & (F.col("depth") == 1), F.col("ord"))).alias("root_place"), F.count_if(F.col("name") == "o").alias("n"))


@_query("SELECT o_custkey AS doc_id, '<c>' || " + _orders_xml("CASE WHEN o_orderstatus = 'O' THEN '<open key=\"' || o_orderkey || '\" status=\"O\"><note>' || upper(o_orderpriority) || '!</note></open>' ELSE '<o key=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\"/>' END") + " || '</c>' AS xml FROM orders GROUP BY o_custkey")
def edit_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _edit_nodes(spark, sf_dir)
    named = edit.update(nodes, (F.col("name") == "o") & (attrs.get("status") == "O"), name=F.lit("open"))
    return writer.to_xml_compact(edit.update(named, F.col("kind") == "#text", text=F.concat(F.upper("text"), F.lit("!"))))
