"""The DataFrame side: tables, navigation, attributes, rules, edits, writers."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvara.functions import chars, encoding, strings
from sylvara.operators import attrs, dtd, edit, nav, validate, writer
from sylvara.operators.validate import Tables
from sylvara.plans.content_model import Automaton, Particle, ambiguous, first_names, image_pattern, nullable, partial_pattern, write
from sylvara.sources.parser import Options
from sylvara.sources.xml import parse_dtd, parse_xml, read_xml


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def col(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


HEAD = """<!DOCTYPE a [<!ELEMENT a (b|c)*><!ELEMENT b (#PCDATA|c)*><!ELEMENT c EMPTY>
<!ATTLIST b id ID #IMPLIED to IDREF #IMPLIED all IDREFS #IMPLIED n NOTATION (x|y) #IMPLIED e ENTITY #IMPLIED k (p|q) 'p'>
<!NOTATION x SYSTEM 'x'><!NOTATION y PUBLIC 'y'><!ENTITY u SYSTEM 'u' NDATA x><!ENTITY g 'text'>]>"""


@pytest.fixture(scope="module")
def one(spark):
    text = HEAD + "<a><b id='i1' to='i2' all='i1 i2' n='x' e='u'>t<c/></b><b id='i2' to='zz' all='i1 i1' e='g' k='q'/><c/></a>"
    return parse_xml(docs(spark, text)).kept()


def test_navigation(one):
    nodes = one.nodes
    ids = {r["attrs"]["id"]: r["node_id"] for r in nodes.where("name = 'b' AND kind = '#element'").collect()}
    b1, b2 = ids["i1"], ids["i2"]
    root = nav.root(nodes)
    assert col(nav.children(nodes, root), "name", "ord") == [("b", 0), ("b", 1), ("c", 2)]
    assert col(nav.descendants(nodes.where("kind = '#element'"), root), "node_id") == [(b1,), (b1 + 2,), (b2,), (b2 + 1,)]
    for width in (1, 2, 3):
        for step in (nav.descendants, nav.ancestors):
            assert col(step(nodes, nodes, width), "ctx_id", "node_id") == col(step(nodes, nodes), "ctx_id", "node_id")
    pairs = [(a["node_id"], b["node_id"]) for a in nodes.collect() for b in nodes.collect() if a["node_id"] < b["node_id"] <= a["last_desc"]]
    assert col(nav.descendants(nodes, nodes), "ctx_id", "node_id") == sorted(pairs) and col(nav.ancestors(nodes, nodes), "node_id", "ctx_id") == sorted(pairs)
    first = nodes.where(F.col("node_id") == b1)
    assert col(nav.ancestors(nodes, first), "kind") == [("#document",), ("#element",)]
    assert col(nav.following(nodes, first), "node_id") == [(b2,), (b2 + 1,)]
    assert col(nav.preceding(nodes.where("kind = '#element'"), nodes.where(F.col("node_id") == b2)), "node_id") == [(b1,), (b1 + 2,)]
    assert col(nav.parent(nodes, first), "name") == [("a",)]
    assert col(nav.find_deep(nodes, F.col("name") == "c", root), "node_id") == [(b1 + 2,)]
    assert col(nav.child_at(nodes, root, 1), "node_id") == [(b2,)] and col(nav.child_at(nodes, root, -1), "name") == [("c",)]
    assert col(nav.child_count(nodes).where(F.col("node_id") == b1), "length") == [(2,)]
    sibs = {r["node_id"]: (r["prev_sibling"], r["next_sibling"]) for r in nav.siblings(nodes).collect()}
    assert sibs[b1] == (None, b2) and sibs[b2] == (b1, b2 + 1) and sibs[0] == (None, None)
    kids = nav.child_array(nodes, "name").where(F.col("node_id") == root.first()["node_id"]).select(F.transform("children", lambda c: c["name"]).alias("x")).first()["x"]
    assert kids == ["b", "b", "c"]


def test_attributes_and_references(one):
    nodes = one.nodes.where("name = 'b' AND kind = '#element'")
    assert col(nodes, attrs.get("k").alias("k")) == [("p",), ("q",)] and col(nodes, attrs.has("n").alias("n")) == [(False,), (True,)]
    changed = nodes.select(attrs.put("k", "z").alias("attrs")).collect()
    assert all(r["attrs"]["k"] == "z" for r in changed)
    assert all("k" not in r["a"] for r in nodes.select(attrs.drop("k").alias("a")).collect())
    assert all(r["a"]["new"] == "1" for r in nodes.select(attrs.put("new", "1").alias("a")).collect())
    reset = attrs.reset(nodes.withColumn("attrs", attrs.put("k", "q")), one.docs, one.attdef, "k")
    assert {r["attrs"]["k"] for r in reset.collect()} == {"p"}
    ids = nav.id_index(one.nodes, one.docs, one.attdef)
    place = dict(col(ids, "value", "node_id"))
    got = {(r["node_id"], r["name"]): r["targets"] for r in attrs.references(one.nodes, one.docs, one.attdef, ids, one.entity, one.notation).collect()}
    b1, b2 = place["i1"], place["i2"]
    assert got == {(b1, "to"): [str(b2)], (b1, "all"): [str(b1), str(b2)], (b1, "n"): ["x"], (b1, "e"): ["u"], (b2, "to"): [], (b2, "all"): [], (b2, "e"): []}
    assert col(attrs.definition(one.nodes, one.docs, one.elem_decl), "name", "content") == [("a", "MODEL"), ("b", "MIXED"), ("b", "MIXED"), ("c", "EMPTY"), ("c", "EMPTY")]
    found = nav.find_by_id(one.nodes, ids, ids.select("doc_id", "value").where("value = 'i2'"))
    assert [r["node_id"] for r in found.collect()] == [b2]


RULES = [
    ("<!DOCTYPE b [<!ELEMENT a ANY>]><a/>", {"root_type"}), ("<!DOCTYPE a [<!ELEMENT a ANY>]><a><b/></a>", {"element_declared"}),
    ("<!DOCTYPE a [<!ELEMENT a EMPTY>]><a> </a>", {"element_content"}), ("<!DOCTYPE a [<!ELEMENT a EMPTY>]><a><!--x--></a>", {"element_content"}), ("<!DOCTYPE a [<!ELEMENT a EMPTY><!ENTITY e ''>]><a>&e;</a>", {"element_content"}), ("<!DOCTYPE a [<!ELEMENT a EMPTY>]><a></a>", set()),
    ("<!DOCTYPE a [<!ELEMENT a (b,c?)><!ELEMENT b EMPTY><!ELEMENT c EMPTY>]><a><c/></a>", {"element_content"}), ("<!DOCTYPE a [<!ELEMENT a (b,c?)><!ELEMENT b EMPTY><!ELEMENT c EMPTY>]><a> <b/> <!--x--> <c/> </a>", set()), ("<!DOCTYPE a [<!ELEMENT a (b)><!ELEMENT b EMPTY>]><a>&#32;<b/></a>", {"element_content"}), ("<!DOCTYPE a [<!ELEMENT a (b)><!ELEMENT b EMPTY>]><a><b/><![CDATA[ ]]></a>", {"element_content"}),
    ("<!DOCTYPE a [<!ELEMENT a ((b,c)|d)><!ELEMENT b EMPTY><!ELEMENT c EMPTY><!ELEMENT d EMPTY>]><a><b/><c/></a>", set()), ("<!DOCTYPE a [<!ELEMENT a (#PCDATA|b)*><!ELEMENT b EMPTY><!ELEMENT c EMPTY>]><a>x<b/><c/></a>", {"element_content"}), ("<!DOCTYPE a.b [<!ELEMENT a.b (x.y)><!ELEMENT x.y EMPTY><!ELEMENT xzy EMPTY>]><a.b><xzy/></a.b>", {"element_content"}),
    ("<!DOCTYPE a [<!ELEMENT a ANY>]><a b=''/>", {"attribute_declared"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k (x|y) #IMPLIED>]><a k='z'/>", {"attribute_value"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k NMTOKENS #IMPLIED>]><a k='x x'/>", {"attribute_value"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k NMTOKEN #IMPLIED>]><a k=''/>", {"attribute_value"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k ID #IMPLIED>]><a k='1'/>", {"attribute_value"}),
    ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k ID #IMPLIED>]><a k='x'><a k='x'/></a>", {"id_unique"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k IDREF #IMPLIED>]><a k='x'/>", {"idref_resolves"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a i ID #IMPLIED k IDREFS #IMPLIED>]><a k='x y' i='x'><a i='y'/></a>", set()),
    ("<!DOCTYPE a [<!ELEMENT a ANY><!ENTITY e 'x'><!ATTLIST a k ENTITY #IMPLIED>]><a k='e'/>", {"entity_name"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k CDATA #REQUIRED>]><a/>", {"required"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k CDATA #FIXED 'v'>]><a/>", {"required"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k CDATA #FIXED 'v'>]><a k='w'/>", {"fixed_value"}),
    ("<!DOCTYPE a [<!ELEMENT a ANY><!ELEMENT a EMPTY>]><a/>", {"element_unique"}), ("<!DOCTYPE a [<!ELEMENT a (#PCDATA|b|b)*><!ELEMENT b EMPTY>]><a/>", {"mixed_unique"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a i ID #IMPLIED j ID #IMPLIED>]><a/>", {"one_id"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a i ID 'x'>]><a/>", {"id_default"}),
    ("<!DOCTYPE a [<!ELEMENT a EMPTY><!NOTATION n SYSTEM 'n'><!ATTLIST a i NOTATION (n) #IMPLIED>]><a/>", {"notation_on_empty"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a i NOTATION (n) #IMPLIED><!NOTATION n SYSTEM 'n'>]><a/>", {"notation_attribute"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!NOTATION n SYSTEM 'n'><!ATTLIST a i NOTATION (n) #IMPLIED j NOTATION (n) #IMPLIED>]><a/>", {"one_notation"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ENTITY e SYSTEM 'e' NDATA n>]><a/>", {"notation_entity"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!NOTATION n SYSTEM 'n'><!NOTATION n SYSTEM 'm'>]><a/>", {"notation_unique"}),
    ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST a k (x|x) #IMPLIED>]><a/>", {"choices_unique"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST z k (x|y) 'z'>]><a/>", {"default_value"}), ("<!DOCTYPE a [<!ELEMENT a (b*,b)><!ELEMENT b EMPTY>]><a><b/></a>", {"deterministic"}), ("<!DOCTYPE a [<!ELEMENT a ANY><!ATTLIST zz><!ATTLIST a>]><a/>", set()), ("<a><anything goes='1'/></a>", set()),
    ("<!DOCTYPE a [<!ELEMENT a ((c|b*|a),c+,(b|a)?)*><!ELEMENT b EMPTY><!ELEMENT c EMPTY>]><a><b/><b/><c/><c/><a/></a>", set()),
]


def test_rules(spark):
    x = parse_xml(docs(spark, *[text for text, _ in RULES])).kept()
    assert x.errors.collect() == []
    got = {k: set() for k in range(len(RULES))}
    for r in validate.validate(Tables.of(x)).collect():
        got[r["doc_id"]].add(r["rule"])
    assert got == {k: rules for k, (_, rules) in enumerate(RULES)}
    assert col(validate.valid(Tables.of(x)), "doc_id") == [(k,) for k, (_, rules) in enumerate(RULES) if not rules]


def test_rules_together_and_alone(spark):
    """What a pass over all rules gives is what each rule gives alone."""
    x = parse_xml(docs(spark, *[text for text, _ in RULES], "<!DOCTYPE a [<!ATTLIST a k CDATA #REQUIRED>]><a><b k='1' l='2'/></a>", HEAD + "<a><b id='1' n='z' k='r'/>text</a>")).kept()
    t = Tables.of(x)
    alone = sorted((str(tuple(r)) for rule in validate.RULES for r in rule(t).collect()))
    assert sorted(str(tuple(r)) for r in validate.validate(t).collect()) == alone and len(alone) > 40


def test_rules_of_built_tables(spark):
    x = parse_xml(docs(spark, "<a>x<!--c--><?p q?><b/></a>")).kept()
    n = x.nodes
    bad = edit.update(edit.update(edit.update(n, F.col("kind") == "#text", text=F.lit("a]]>"), section=F.lit(True)), F.col("kind") == "#comment", text=F.lit("x--y")), F.col("kind") == "#pi", target=F.lit("xml"))
    bad = edit.update(bad, F.col("name") == "b", name=F.lit("1b"))
    bad = bad.unionByName(n.where("depth = 1").withColumns({"node_id": F.lit(99), "ord": F.lit(5)}))
    t = Tables(bad, x.docs, x.elem_decl, x.attdef, x.entity, x.notation)
    assert {r["rule"] for r in validate.validate(t).collect()} == {"text_shape", "comment_shape", "pi_shape", "element_names", "document_shape"}


def xml_of(nodes):
    return {r["doc_id"]: r["xml"] for r in writer.to_xml_compact(nodes).collect()}


def test_edits(spark):
    nodes = parse_xml(docs(spark, "<a><b/>t<c><d/></c></a>")).kept().nodes
    root = nav.root(nodes)
    at = root.select("doc_id", F.col("node_id").alias("parent_id"))
    top = root.first()["node_id"]
    new = edit.fragment(spark, [(-2, top, 0, "#element", "x", None, None, None, {"k": "1"}), (-3, -2, 0, "#text", None, "in", False, None, None), (-4, top, 1, "#comment", None, "end", None, None, None)], 0)
    assert xml_of(edit.push(nodes, new)) == {0: '<a><b/>t<c><d/></c><x k="1">in</x><!--end--></a>'}
    assert xml_of(edit.unshift(nodes, new)) == {0: '<a><x k="1">in</x><!--end--><b/>t<c><d/></c></a>'}
    assert xml_of(edit.splice(nodes, at.withColumns({"start": F.lit(1), "count": F.lit(1)}), new)) == {0: '<a><b/><x k="1">in</x><!--end--><c><d/></c></a>'}
    assert xml_of(edit.replace_child(nodes, at.withColumn("ord", F.lit(2)), new)) == {0: '<a><b/>t<x k="1">in</x><!--end--></a>'}
    assert xml_of(edit.pop(nodes, root)) == {0: "<a><b/>t</a>"} and xml_of(edit.shift(nodes, root)) == {0: "<a>t<c><d/></c></a>"}
    assert xml_of(edit.truncate(nodes, root, 1)) == {0: "<a><b/></a>"} and xml_of(edit.truncate(nodes, root, 9)) == xml_of(nodes)
    assert xml_of(edit.remove(nodes, nodes.where("name = 'c'"))) == {0: "<a><b/>t</a>"}
    twice = edit.remove(edit.remove(nodes, nodes.where("name = 'c'")), nodes.where("name = 'none'"))
    assert xml_of(twice) == {0: "<a><b/>t</a>"}
    assert xml_of(edit.clone(nodes, nodes.where("name = 'c'"), F.lit(7).cast("long"))) == {7: "<c><d/></c>"}
    leaf = edit.fragment(spark, [(-2, nodes.where("kind = '#text'").first()["node_id"], 0, "#element", "x", None, None, None, {})], 0)
    assert xml_of(edit.push(nodes, leaf)) == xml_of(nodes)
    root_new = edit.fragment(spark, [(-2, 0, 0, "#element", "z", None, None, None, {})], 0)
    assert xml_of(edit.set_root(nodes, root_new)) == {0: "<z/>"}
    pushed = edit.push(nodes, new)
    again = parse_xml(spark.createDataFrame([(0, xml_of(pushed)[0])], "doc_id long, content string")).nodes
    keep = ["node_id", "parent_id", "ord", "depth", "last_desc", "kind", "child_names"]
    assert col(pushed.fillna(""), *keep) == col(again.fillna(""), *keep)
    assert col(edit.reindex_sql(nodes), "node_id", "new_id", "new_last") == col(nodes, "node_id", F.col("node_id").alias("n"), "last_desc")


def test_round_trip(spark):
    texts = ["<a x=\"1&amp;&lt;&quot;&#9;\">t &lt; ]]&gt;<b/><![CDATA[<&]]><!--c--><?p q?></a>", "<r><r><r>deep</r></r></r>", "<e></e>", "<m>é🙂<n k='v'/>tail</m>"]
    x = parse_xml(docs(spark, *texts)).kept()
    keep = [c for c in x.nodes.columns if c not in ("attrs", "specified")] + [F.map_entries("attrs").alias("attrs")]
    for written in (writer.to_xml_compact(x.nodes), writer.to_xml(x.nodes, x.docs, xml_decl=False, format_cdata=False, format_comment=False)):
        again = parse_xml(written.withColumnRenamed("xml", "content")).nodes
        assert sorted(map(str, again.select(*keep).collect())) == sorted(map(str, x.nodes.select(*keep).collect()))


def laid_out(spark, text, **options):
    x = parse_xml(docs(spark, text)).kept()
    tables = {k: x.table(k) for k in ("elem_decl", "attdef", "entity", "notation")}
    return writer.to_xml(x.nodes, x.docs, tables, **options).first()["xml"]


def attribute_lines(xml):
    """(lines of the first attribute list after its head, cells of each by runs of blanks)."""
    inner = xml.split("<!ATTLIST ", 1)[1].split(">\n", 1)[0].split("\n")[1:]
    return inner, [line.split(None, 2) for line in inner]


def test_attribute_columns(spark):
    """Names, types and defaults of an attribute list each begin where the longest cell before them ends."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        names = rng.sample([f"{'q' * n}{n}" for n in range(1, 12)], rng.randint(2, 6))
        kinds = [(n, rng.choice(["ID", "IDREF", "CDATA", "ENTITIES", "NMTOKEN"]), rng.choice(["#IMPLIED", "#REQUIRED"])) for n in names]
        texts.append("<!DOCTYPE w [<!ATTLIST w " + " ".join(" ".join(k) for k in kinds) + ">]><w/>")
    x = parse_xml(docs(spark, *texts)).kept()
    written = writer.to_xml(x.nodes, x.docs, {"attdef": x.attdef}, xml_decl=False).orderBy("doc_id").collect()
    for text, row in zip(texts, written, strict=True):
        lines, cells = attribute_lines(row["xml"])
        want = text.split("<!ATTLIST w ")[1].split(">")[0].split()
        assert sorted(map(tuple, cells)) == sorted(zip(want[::3], want[1::3], want[2::3], strict=True))
        at = 4 + max(len(c[0]) for c in cells) + 1
        assert all(line[:4].isspace() and line.index(c[1], 4 + len(c[0])) == at for line, c in zip(lines, cells, strict=True))
        last = at + max(len(c[1]) for c in cells) + 1
        assert all(line.rindex("#") == last for line in lines)


DECLARED = [
    ("<!ENTITY logo PUBLIC 'a b' 'l.png' NDATA png>", '<!ENTITY logo PUBLIC "a b" "l.png" NDATA png>'),
    ("<!ENTITY  greeting  'say &quot;hi&quot; %%'>".replace("%%", "now"), None),
    ("<!NOTATION png SYSTEM 'image/png'>", '<!NOTATION png SYSTEM "image/png">'),
    ("<!ELEMENT list ( item , ( note | item )* , end? )>", "<!ELEMENT list (item, (note|item)*, end?)>"),
    ("<!ELEMENT item ANY>", "<!ELEMENT item ANY>"),
    ("<!ELEMENT end EMPTY>", "<!ELEMENT end EMPTY>"),
    ("<!ELEMENT para ( #PCDATA )>", "<!ELEMENT para (#PCDATA)>"),
]


def test_declarations_laid_out(spark):
    """Each declaration is one line in the order of the source, and reading what was written gives the same tables."""
    source = "<!DOCTYPE list [" + "".join(text for text, _ in DECLARED) + "]><list/>"
    written = laid_out(spark, source, xml_decl=False)
    lines = [line.strip() for line in written.split("]>")[0].split("\n")[1:-1]]
    assert len(lines) == len(DECLARED)
    for line, (_, want) in zip(lines, DECLARED, strict=True):
        assert want is None or line == want
    first, again = (parse_xml(docs(spark, text)).kept() for text in (source, written))
    for name in ("elem_decl", "entity", "notation"):
        keep = [c for c in first.table(name).columns if c != "dtd_id"]
        assert col(first.table(name).fillna(""), *keep) == col(again.table(name).fillna(""), *keep)


def test_layout_options(spark):
    text = "<?xml version='1.0' standalone='yes'?><!--top--><m k='1' j='2'>some<n/></m>"
    assert laid_out(spark, text) == '<?xml version="1.0" standalone="yes"?>\n\n<!-- top -->\n\n<m\n  j="2"\n  k="1">\n  some\n  <n/>\n</m>'
    assert laid_out(spark, text, comments=False, xml_decl=False, format_cdata=False, attr_inline_max=2) == '<m j="2" k="1">some<n/></m>'
    assert laid_out(spark, "<!DOCTYPE m [<!ELEMENT m ANY>]><m/>", xml_decl=False, dtd=False) == "<m/>"
    assert laid_out(spark, "<a b='x'/>", xml_decl=False, self_close=False) == '<a b="x">\n</a>' and laid_out(spark, "<a/>", xml_decl=False, self_close=False) == "<a></a>"
    assert laid_out(spark, "<a b='1\"'/>", xml_decl=False, prefer_single=True) == "<a b='1\"'/>"
    preserved = laid_out(spark, "<a xml:space='preserve'> x <b> <c/></b></a>", xml_decl=False)
    assert preserved == '<a xml:space="preserve"> x <b> <c/></b></a>'


@pytest.mark.parametrize("column", [34, 47, 90])
def test_wrapped_comment(spark, column):
    """Words stay in order, no line but one of a single word goes beyond its room, and none could take the next word."""
    words = [("ab" * 9)[: 1 + k * 7 % 11] for k in range(40)]
    got = laid_out(spark, f"<!--{' '.join(words)}--><a/>", xml_decl=False, wrap_column=column, min_width=20).split("\n\n")[0]
    assert got.startswith("<!-- ") and got.endswith(" -->") and got[5:-4].split() == words
    lines = got.split("\n")
    assert all(line.startswith("  ") and not line.startswith("   ") for line in lines[1:])
    for line, after in zip(lines, lines[1:], strict=False):
        assert len(line) <= column + 2 and len(line) + 1 + len(after.split()[0]) > column - 2


def test_json(spark):
    x = parse_xml(docs(spark, "<!DOCTYPE a [<!ATTLIST a k (p|q) 'p'>]><a><b/>x<!--c--><?t i?></a>")).kept()
    got = json.loads(writer.to_json(x.nodes, x.docs, {"attdef": x.attdef}).first()["json"])
    a = got["children"][1]
    assert got["nodeType"] == "#document" and a["attr"] == {"k": "p"} and [c["nodeType"] for c in a["children"]] == ["#element", "#text", "#comment", "#pi"]
    assert got["children"][0]["children"][0]["children"][0] == {"nodeType": "#attdef", "defaultValue": "p", "enumeration": ["p", "q"], "fixed": False, "name": "k", "required": False, "type": "ENUMERATION"}


def test_strings(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first()["x"]

    assert value(strings.wrap(F.lit("aaa bbb ccc ddd"), 7, 0)) == "aaa bbb\nccc ddd" and value(strings.wrap(F.lit("aa bb"), 4, 0, depth=1, hanging=True)) == "  aa\n    bb"
    assert value(strings.ext_id(F.lit("p"), F.lit('s"'))) == "PUBLIC \"p\" 's\"'" and value(strings.ext_id(F.lit(None).cast("string"), F.lit("s"))) == 'SYSTEM "s"'
    assert value(strings.quote(F.lit('a"b'), may_escape=True)) == '"a&quot;b"' and value(strings.quote(F.lit("a"), prefer_single=True)) == "'a'"
    assert value(strings.ref_out(F.lit("a&#1;<%\"'&x;"))) == "a&#x26;#1;&#x3c;&#x25;&#x22;&#x27;&x;"
    assert value(strings.char_refs(F.lit("&#x1F642;"))) == "🙂" and value(strings.char_refs(F.lit("&#0;"))) is None and value(strings.char_refs(F.lit("&#x110000;"))) is None
    assert value(F.array(*[strings.not_xml(F.lit(x)) for x in ("XmL", "xmlx")])) == [False, True]
    assert value(strings.indent(F.lit(3))) == " " * 6 and value(strings.is_public_id(F.lit("a{"))) is False and value(strings.is_xml_string(F.lit("a\x01"))) is False
    for text, name, token in (("a.b-1", True, True), ("1a", False, True), (":x", True, True), ("", False, False), ("é", True, True), ("a b", False, False), ("Ⰰ", False, False)):
        assert value(F.array(chars.is_name(F.lit(text)), chars.is_nmtoken(F.lit(text)))) == [name, token], text
    assert value(chars.is_name(F.lit("Ⰰ"), "5e")) is True
    assert value(F.array(*[chars.is_char(F.lit("'"), k) for k in ("public_id_char_dbl", "public_id_char_sng", "att_value_char_sng", "att_value_char_dbl")])) == [True, False, False, True]
    assert value(encoding.declared_encoding(F.lit("<?xml version='1.0' encoding=\"x-1\"?>"))) == "x-1" and value(encoding.encoding_key(F.lit("iso_8859-1"))) == "ISO88591"


def test_content_models():
    b, c, d = (Particle("ELEMENT", n) for n in "bcd")
    model = Particle("SEQUENCE", "", "", (Particle("ELEMENT", "b", "*"), Particle("CHOICE", "", "+", (c, d))))
    import re

    for image, fits in ((" c", True), (" b b d c", True), (" b", False), ("", False), (" c b", False)):
        assert bool(re.search(image_pattern(model), image)) == fits
        assert (Automaton(model).first_bad(image.split()) is None) == fits
    assert write(model) == "(b*, (c|d)+)" and first_names(model) == ["b", "c", "d"] and not ambiguous(model)
    assert Automaton(model).first_bad(["b", "c", "b", "c"]) == 2
    assert ambiguous(Particle("CHOICE", "", "", (b, Particle("SEQUENCE", "", "", (b, c))))) and ambiguous(Particle("SEQUENCE", "", "", (Particle("ELEMENT", "b", "?"), b)))


def random_model(rng, depth):
    kind = rng.choice(["ELEMENT", "SEQUENCE", "CHOICE"]) if depth else "ELEMENT"
    if kind == "ELEMENT":
        return Particle(kind, rng.choice(["a", "b", "a.c", "ab"]), rng.choice(["", "", "?", "*", "+"]))
    members = tuple(random_model(rng, depth - 1) for _ in range(rng.randint(1, 3)))
    loops = not nullable(Particle(kind, "", "", members))  # a loop over what may be empty takes a backtracking matcher very long
    return Particle(kind, "", rng.choice(["", "?", "*", "+"]) if loops else "", members)


def test_partial_patterns():
    """A partial pattern fits just the images that the model's automaton has not ruled out."""
    import re

    rng = random.Random(21)
    for _ in range(300):
        model = random_model(rng, 2)
        machine = Automaton(model)
        for _ in range(12):
            children = rng.choices(["a", "b", "a.c", "ab", "x"], [5, 5, 3, 3, 1], k=rng.randint(0, 5))
            image, bad = "".join(" " + c for c in children), machine.first_bad(children)
            assert bool(re.search(partial_pattern(model), image)) == (bad is None or bad == len(children)), (write(model), image)
            assert bool(re.search(image_pattern(model), image)) == (bad is None)


def test_first_bad_child(spark):
    head = "<!DOCTYPE r [<!ELEMENT r (a, (b|c)+, d?)>" + "".join(f"<!ELEMENT {e} EMPTY>" for e in "abcd") + "]>"
    bodies = ["<a/><b/>", "<a/>", "<b/>", "<a/><b/><c/><d/><d/>", "", "<a/>" + "<c/>" * 900 + "<a/><b/>"]
    x = parse_xml(docs(spark, *[f"{head}<r>{b}</r>" for b in bodies])).kept()
    assert col(validate.first_bad_child(Tables.of(x)), "doc_id", "first_bad") == [(1, 1), (2, 0), (3, 4), (4, 0), (5, 901)]
    d = attrs.definition(nav.root(x.nodes), x.docs, x.elem_decl).join(x.elem_decl.select("name", "partial"), "name")
    assert col(d, "doc_id", dtd.may_become(F.col("child_names"), F.col("content"), F.col("partial"), F.col("allowed")).alias("may")) == [(0, True), (1, True), (2, False), (3, False), (4, True), (5, False)]


def test_new_nodes_are_checked():
    assert edit.node("#element", -2, 0, name="a", attrs={"k": "v"}) == (-2, 0, 0, "#element", "a", None, None, None, {"k": "v"})
    assert edit.node("#text", -2, 0, text="", section=True)[5:7] == ("", True) and edit.node("#pi", -2, 0, 3, target="t")[2] == 3
    wrong = [("#odd", {}), ("#element", {}), ("#element", {"name": "1a"}), ("#element", {"name": "a", "text": "t"}), ("#element", {"name": "a", "attrs": {"a b": ""}}), ("#text", {"text": ""}), ("#text", {"text": "]]>", "section": True}), ("#comment", {"text": "a--b"}), ("#comment", {"text": "-"}), ("#pi", {"target": "XML"}), ("#pi", {"target": "p", "text": "?>"}), ("#text", {"text": "\x01"}), ("#doctypeDecl", {}), ("#document", {"name": "a"})]
    for kind, fields in wrong:
        with pytest.raises(ValueError):
            edit.node(kind, -2, 0, **fields)


def test_sources(spark, tmp_path):
    (tmp_path / "one.xml").write_bytes("<?xml version='1.0' encoding='iso-8859-1'?><a>é</a>".encode("latin-1"))
    (tmp_path / "two.xml").write_bytes("﻿<a>ü</a>".encode("utf-16-le"))
    (tmp_path / "bad.xml").write_bytes(b"<a>\xff</a>")
    x = read_xml(spark, str(tmp_path / "*.xml")).kept()
    assert col(x.nodes.where("kind = '#text'"), "text") == [("é",), ("ü",)] and col(x.errors, "code") == [("DECODE",)]
    from sylvara.sources.udtf import register

    register(spark)
    got = spark.read.format("xmlnodes").load(str(tmp_path / "[ot]*.xml"))
    assert col(got.where("kind = '#text'"), "text") == [("é",), ("ü",)]
    assert col(spark.read.format("xmlnodes").load(str(tmp_path / "bad.xml")), "kind", "name") == [("#error", "DECODE")]
    assert col(spark.sql("SELECT name, kind FROM (SELECT '<a><b/></c>' AS x), LATERAL xml_nodes(x)"), "kind", "name") == [("#error", "TYPE_MATCH")]
    folders = [("a", "<!DOCTYPE r SYSTEM 'd'><r/>"), ("b", "<!DOCTYPE r SYSTEM 'd'><r/>"), ("a", "<!DOCTYPE r SYSTEM 'd'><r/>")]
    per_path = parse_xml(spark.createDataFrame(folders, "doc_id string, content string").coalesce(1), path=F.concat(F.lit("http://h/"), "doc_id", F.lit("/1.xml")), resources={f"http://h/{k}/d": f"<!ATTLIST r k CDATA '{k}'>" for k in "ab"})
    assert col(per_path.nodes.where("kind = '#element'"), "doc_id", attrs.get("k").alias("k")) == [("a", "a"), ("a", "a"), ("b", "b")]
    resources = spark.createDataFrame([("d.dtd", b"<!ENTITY e 'deep'>", None)], "path string, content binary, encoding string")
    x = parse_xml(docs(spark, "<!DOCTYPE a SYSTEM 'd.dtd'><a>&e;</a>", None), resources=resources)
    assert col(x.nodes.where("kind = '#text'"), "text") == [("deep",)] and col(x.errors, "code") == [("NO_CONTENT",)]
    assert col(parse_dtd(spark.createDataFrame([("d", "<!ELEMENT a (b)>")], "path string, content string")).elem_decl, "spec") == [("(b)",)]
    with pytest.raises(Exception, match="UNCLOSED"):
        parse_xml(docs(spark, "<a>"), fail_fast=True).nodes.collect()
    limited = parse_xml(docs(spark, "<!DOCTYPE a [<!ENTITY e 'xx'>]><a>&e;</a>"), options=Options(max_expansion_size=1))
    assert col(limited.errors, "code") == [("EXPANSION_SIZE",)]
    assert parse_xml(docs(spark)).nodes.collect() == []


def test_declarations(spark):
    x = parse_xml(docs(spark, "<!DOCTYPE a [<!ELEMENT a (b, (c|d)*)><!ATTLIST a k CDATA 'one' k CDATA 'two'>]><a/>")).kept()
    assert col(dtd.first_attdefs(x.attdef), "default_value") == [("one",)]
    assert col(x.content_spec, "spec_id", "parent_id", "type", "qualifier") == [(0, -1, "SEQUENCE", ""), (1, 0, "ELEMENT", ""), (2, 0, "CHOICE", "*"), (3, 2, "ELEMENT", ""), (4, 2, "ELEMENT", "")]
    both = dtd.all_declarations(x.attdef, x.attdef)
    assert both.count() == 4 and both.select(F.max("decl_ord")).first()[0] > x.attdef.select(F.max("decl_ord")).first()[0]


def test_batches_of_nodes_are_bounded(spark, monkeypatch):
    """Documents leave a task together up to a number of nodes, in their order and each with its own row."""
    from sylvara.sources import xml

    rows = docs(spark, *["<a>" + "<b/>" * k + "</a>" for k in range(40)]).coalesce(1)
    monkeypatch.setattr(xml, "BATCH_NODES", 50)
    made = []
    got = {}

    def plain(df):
        class Frame:
            schema, sparkSession = df.schema, spark

            def select(self, *_):
                return self

            def mapInArrow(self, work, schema):
                batch = pa.record_batch([pa.array(range(40)), pa.array(["<a>" + "<b/>" * k + "</a>" for k in range(40)]), pa.nulls(40, pa.string()), pa.array([""] * 40)], names=["doc_id", "c", "e", "p"])
                for out in work(iter([batch])):
                    made.append(sum(len(n) for n in out.column(2).to_pylist()))
                    got.update(zip(out.column(0).to_pylist(), (len(n) for n in out.column(2).to_pylist()), strict=True))
                return df

        return Frame()

    parse_xml(plain(rows))
    assert got == {k: k + 2 for k in range(40)} and len(made) > 10 and max(made) < 50 + 41
