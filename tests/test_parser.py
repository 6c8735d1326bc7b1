"""Documents in, nodes or the first error out; tables of small cases by theme."""

import random
from xml.parsers import expat

import pytest

from sylvara.sources.parser import Options, Parser


def parse(text, resources=None, **options):
    return Parser(Options(**options), {k: v if isinstance(v, tuple) else (v, None) for k, v in (resources or {}).items()}).parse(text)


def flat(got):
    """Nodes outside of the document type as short tuples."""
    assert got["error"] is None, got["error"]
    out = []
    for n in got["nodes"]:
        if n[5] == "#element":
            out.append((n[3], n[6], dict(n[10])))
        elif n[5] == "#text":
            out.append((n[3], "section" if n[8] else "text", n[7]))
        elif n[5] == "#comment":
            out.append((n[3], "comment", n[7]))
        elif n[5] == "#pi":
            out.append((n[3], "pi", n[9], n[7]))
    return out


GOOD = [
    ("<a></a>", [(1, "a", {})]),
    ("<a/>", [(1, "a", {})]),
    ("<a b='1' c=\"2'\" />", [(1, "a", {"b": "1", "c": "2'"})]),
    ("<?p one?><!--c--><a/><!--d--><?q?>", [(1, "pi", "p", "one"), (1, "comment", "c"), (1, "a", {}), (1, "comment", "d"), (1, "pi", "q", None)]),
    ("<a>x<b/>y<!--z-->w<?p?>v</a>", [(1, "a", {}), (2, "text", "x"), (2, "b", {}), (2, "text", "y"), (2, "comment", "z"), (2, "text", "w"), (2, "pi", "p", None), (2, "text", "v")]),
    ("<a>1&lt;2&amp;&#65;&#x42;&quot;&apos;&gt;</a>", [(1, "a", {}), (2, "text", "1<2&AB\"'>")]),
    ("<a>x<![CDATA[]<&]]]>y</a>", [(1, "a", {}), (2, "text", "x"), (2, "section", "]<&]"), (2, "text", "y")]),
    ("<a>\n <b/>\n</a>", [(1, "a", {}), (2, "text", "\n "), (2, "b", {}), (2, "text", "\n")]),
    ("<a><!--a-b - c--><?p ??x ? ??></a>", [(1, "a", {}), (2, "comment", "a-b - c"), (2, "pi", "p", "??x ? ?")]),
    ("<?xml version='1.7' encoding=\"utf-8\" standalone = 'yes' ?>\n<a/>", [(1, "a", {})]),
    ("<?xmlish?><a/>", [(1, "pi", "xmlish", None), (1, "a", {})]),
    ("<a x='a\tb\nc&#9;&#10;d]'/>", [(1, "a", {"x": "a b c\t\nd]"})]),
    # element content: literal blanks go, whether typed or from an entity
    ("<!DOCTYPE a [<!ELEMENT a (b*)><!ELEMENT b EMPTY><!ENTITY w '  '>]><a> <b/>&w;\n<b/></a>", [(1, "a", {}), (2, "b", {}), (2, "b", {})]),
    # attribute types and defaults
    ("<!DOCTYPE a [<!ATTLIST a n NMTOKENS #IMPLIED d CDATA 'x y' f CDATA #FIXED 'v'>]><a n='  p   q '/>", [(1, "a", {"n": "p q", "d": "x y"})]),
    ("<!DOCTYPE a [<!ATTLIST a k (x | y ) 'y'>]><a/>", [(1, "a", {"k": "y"})]),
    ("<!DOCTYPE a [<!ENTITY q '\"&#38;#38;&#39;'><!ATTLIST a d CDATA '&q;'>]><a c='<'/>".replace("c='<'", "c='&q;'"), [(1, "a", {"c": "\"&'", "d": "\"&'"})]),
    # entities: text is parsed as markup, references coalesce, redeclaration is ignored
    ("<!DOCTYPE a [<!ENTITY e '<b>x</b>&f;'><!ENTITY f 'y'><!ENTITY f 'z'>]><a>1&e;2</a>", [(1, "a", {}), (2, "text", "1"), (2, "b", {}), (3, "text", "x"), (2, "text", "y2")]),
    ("<!DOCTYPE a [<!ENTITY amp '&#38;#38;'><!ENTITY lt '&#38;#60;'>]><a>&amp;&lt;</a>", [(1, "a", {}), (2, "text", "&<")]),
    # general and parameter entities have names of their own
    ("<!DOCTYPE a [<!ENTITY % e '<!ENTITY e \"g\">'>%e;]><a>&e;</a>", [(1, "a", {}), (2, "text", "g")]),
    ("<!DOCTYPE a [<!ENTITY % p 'in'><!ENTITY e 'x%p;y'>]><a>&e;</a>", [(1, "a", {}), (2, "text", "xiny")]),
]


@pytest.mark.parametrize("text, want", GOOD, ids=range(len(GOOD)))
def test_good(text, want):
    assert flat(parse(text)) == want


BAD = [
    ("", "NO_ROOT"), ("   ", "NO_ROOT"), ("<!--x-->", "NO_ROOT"), ("x", "DOCUMENT"), ("<a/>x", "DOCUMENT"), ("<a/><b/>", "DOCUMENT"), (" <?xml version='1.0'?><a/>", "PI"),
    ("<a>", "UNCLOSED"), ("<a></b>", "TYPE_MATCH"), ("<a><b></a></b>", "TYPE_MATCH"), ("<a b='1' b='2'/>", "UNIQUE_ATT"), ("<a b=1/>", "ELEMENT"), ("<a b='1'c='2'/>", "ELEMENT"), ("<a b='<'/>", "NO_LT"), ("<1/>", "ELEMENT"), ("< a/>", "ELEMENT"), ("<a b/>", "ELEMENT"),
    ("<a>]]></a>", "CONTENT"), ("<a><!x></a>", "CONTENT"), ("<a><![CDATA[x]]</a>", "CDATA"), ("<a><!--x--y--></a>", "COMMENT"), ("<a><!--x--->", "COMMENT"), ("<!--x", "COMMENT"), ("<?xml?><a/>", "PI"), ("<?XmL x?><a/>", "PI"), ("<?p", "PI"), ("<?p*x?><a/>", "PI"),
    ("<a>&</a>", "REFERENCE"), ("<a>&x</a>", "REFERENCE"), ("<a>&x;</a>", "ENTITY_DECLARED"), ("<a>&#0;</a>", "LEGAL_CHARACTER"), ("<a>&#xFFFF;</a>", "LEGAL_CHARACTER"), ("<a>&#x110000;</a>", "LEGAL_CHARACTER"), ("<a>\x00</a>", "BAD_CHAR"), ("<a>\x0b</a>", "BAD_CHAR"), ("<a>￿</a>", "BAD_CHAR"),
    ("<?xml encoding='x' version='1.0'?><a/>", "XML_DECL"), ("<?xml encoding='x'?><a/>", "XML_DECL"), ("<?xml version='2.0'?><a/>", "XML_DECL"), ("<?xml version='1.0' standalone='maybe'?><a/>", "XML_DECL"),
    ("<!DOCTYPE a><!DOCTYPE a><a/>", "DOCTYPE"), ("<a/><!DOCTYPE a>", "DOCTYPE"), ("<!DOCTYPE a [<!ELEMENT a (b,c|d)>]><a/>", "DTD"), ("<!DOCTYPE a [<!ELEMENT a (#PCDATA|b)>]><a/>", "DTD"), ("<!DOCTYPE a [<!ELEMENT a b>]><a/>", "DTD"), ("<!DOCTYPE a [<!ATTLIST a b FOO #IMPLIED>]><a/>", "DTD"), ("<!DOCTYPE a [<!ATTLIST a b CDATA>]><a/>", "DTD"), ("<!DOCTYPE a [<![INCLUDE[]]>]><a/>", "DTD"), ("<!DOCTYPE a PUBLIC '{' 'x'><a/>", "PUBLIC_ID"), ("<!DOCTYPE a PUBLIC 'x'><a/>", "DTD"), ("<!DOCTYPE a [", "DTD"),
    ("<!DOCTYPE a [<!ENTITY e '&e;'>]><a>&e;</a>", "NO_RECURSION"), ("<!DOCTYPE a [<!ENTITY e '&f;'><!ENTITY f '&e;'>]><a b='&e;'/>", "NO_RECURSION"), ("<!DOCTYPE a [<!ENTITY e '<b>'>]><a>&e;</b></a>", "BOUNDARY"), ("<!DOCTYPE a [<!ENTITY e '</a>'>]><a>&e;", "BOUNDARY"), ("<!DOCTYPE a [<!ENTITY e '<'>]><a b='&e;'/>", "NO_LT"), ("<!DOCTYPE a [<!NOTATION n SYSTEM 'n'><!ENTITY e SYSTEM 'x' NDATA n>]><a>&e;</a>", "PARSED_ENTITY"), ("<!DOCTYPE a [<!ENTITY e SYSTEM 'x'>]><a b='&e;'/>", "NO_EXTERNAL"), ("<!DOCTYPE a [<!ENTITY e SYSTEM 'x'>]><a>&e;</a>", "DEREFERENCE"), ("<!DOCTYPE a [%p;]><a/>", "ENTITY_DECLARED"), ("<!DOCTYPE a [<!ENTITY e '%'>]><a/>", "REFERENCE"), ("<!DOCTYPE a [<!ENTITY e '&'>]><a/>", "REFERENCE"),
]


@pytest.mark.parametrize("text, code", BAD, ids=range(len(BAD)))
def test_bad(text, code):
    error = parse(text)["error"]
    assert error and error["code"] == code, error


def test_place_of_error():
    error = parse("<a>\n  <b>\n</a>")["error"]
    assert (error["line"], error["code"]) == (3, "TYPE_MATCH") and error["context"].endswith("</a") and len(error["context"]) <= 30


def test_intervals():
    nodes = parse("<a><b><c/>x</b><d/></a>")["nodes"]
    assert [(n[0], n[1], n[2], n[3], n[4]) for n in nodes] == [(0, -1, 0, 0, 5), (1, 0, 0, 1, 5), (2, 1, 0, 2, 4), (3, 2, 0, 3, 3), (4, 2, 1, 3, 4), (5, 1, 1, 2, 5)]


@pytest.mark.parametrize("length, back", [(1, 0), (2, 0), (4, 0), (4, 2), (5, 4)])
def test_message_names_the_circle(length, back):
    """Entities e0, e1, ... each refer to the next, and the last to an earlier one: the message is the way round."""
    names = [f"e{k}" for k in range(length)]
    declared = "".join(f"<!ENTITY {n} 'x&{after};'>" for n, after in zip(names, [*names[1:], names[back]], strict=True))
    error = parse(f"<!DOCTYPE a [{declared}]><a>&e0;</a>")["error"]
    assert error["message"].split(" => ") == [*names[back:], names[back]]


@pytest.mark.parametrize("size, fine", [(20, True), (19, False)])
def test_size_limit(size, fine):
    assert (parse(f"<!DOCTYPE a [<!ENTITY e '{'x' * 20}'>]><a>&e;</a>", max_expansion_size=size)["error"] is None) == fine
    nested = "<!DOCTYPE a [<!ENTITY e '1234567890'><!ENTITY f '&e;6789012'>]><a>&f;</a>"
    assert (parse(nested, max_expansion_size=size)["error"] is None) == fine


def test_count_limit():
    text = "<!DOCTYPE a [<!ENTITY e 'x'>]><a>" + "&e;" * 5 + "&amp;" * 9 + "</a>"
    assert parse(text, max_expansion_count=5)["error"] is None
    assert parse(text, max_expansion_count=4)["error"]["code"] == "EXPANSION_COUNT"
    assert parse(text, max_expansion_count=13, count_predefined=True)["error"]["code"] == "EXPANSION_COUNT"
    laughs = "<!DOCTYPE a [<!ENTITY l0 'ha'>" + "".join(f"<!ENTITY l{k} '{f'&l{k - 1};' * 10}'>" for k in range(1, 12)) + "]><a>&l11;</a>"
    assert parse(laughs)["error"]["code"] in ("EXPANSION_COUNT", "EXPANSION_SIZE")


EXTERNAL = [
    ("<!ELEMENT a (b)><!ELEMENT b EMPTY>", "<a>\n<b/></a>", [(1, "a", {}), (2, "b", {})]),
    ("<?xml encoding='utf-8'?><!ENTITY e 'v'>", "<a>&e;</a>", [(1, "a", {}), (2, "text", "v")]),
    ("<![INCLUDE[<!ENTITY e '1'>]]><![ IGNORE [<!ENTITY e '2'> <![ junk ' ]]> ]]>", "<a>&e;</a>", [(1, "a", {}), (2, "text", "1")]),
    ("<!ENTITY % on 'INCLUDE'><!ENTITY % off 'IGNORE'><![%off;[<!ENTITY e '1'>]]><![ %on; [<![%on;[<!ENTITY e '2'>]]>]]>", "<a>&e;</a>", [(1, "a", {}), (2, "text", "2")]),
    ("<!ENTITY % n 'e'><!ENTITY % decl \"<!ENTITY %n; 'w'>\">%decl;", "<a>&e;</a>", [(1, "a", {}), (2, "text", "w")]),
    ("<!ENTITY % n 'k'><!ENTITY % t '(x|y)'><!ATTLIST a %n; %t; 'y'>", "<a/>", [(1, "a", {"k": "y"})]),
    ("<!ENTITY % c 'b*'><!ELEMENT a (%c;)><!-- %nothing; --><?p %nothing;?>", "<a> </a>", [(1, "a", {})]),
]


@pytest.mark.parametrize("dtd, body, want", EXTERNAL, ids=range(len(EXTERNAL)))
def test_external_subset(dtd, body, want):
    got = parse(f"<!DOCTYPE a SYSTEM 'a.dtd'>{body}", {"a.dtd": dtd})
    assert [x for x in flat(got) if x[0] < 3 and x[1] not in ("comment", "pi")] == want


BAD_EXTERNAL = [
    ("<!ENTITY % p '(b'><!ELEMENT a %p;)>", "BOUNDARY"), ("<!ENTITY % p '<!ELEMENT a'>%p; ANY>", "BOUNDARY"), ("<!ENTITY % p ']]>'><![INCLUDE[ %p;", "BOUNDARY"), ("<![INCLUDE[ ", "DTD"), ("<![IGNORE[ <![ ]]>", "DTD"), ("<![MAYBE[]]>", "DTD"), ("<!ENTITY % p '%q;'>", "ENTITY_DECLARED"), ("<?xml version='1.0'?>", "TEXT_DECL"), ("\x01", "BAD_CHAR"),
]


@pytest.mark.parametrize("dtd, code", BAD_EXTERNAL, ids=range(len(BAD_EXTERNAL)))
def test_bad_external_subset(dtd, code):
    assert parse("<!DOCTYPE a SYSTEM 'a.dtd'><a/>", {"a.dtd": dtd})["error"]["code"] == code


def test_paths_resolve_against_the_declaring_entity():
    resources = {"http://h/x/one.dtd": "<!ENTITY % two SYSTEM 'sub/two.dtd'>%two;", "http://h/x/sub/two.dtd": "<!ENTITY three SYSTEM '../three.xml'>", "http://h/x/three.xml": ("<?xml encoding='iso-8859-1'?><t>é</t>".encode("latin-1"), None)}
    got = parse("<!DOCTYPE a SYSTEM 'one.dtd'><a>&three;</a>", resources, path="http://h/x/doc.xml")
    assert flat(got) == [(1, "a", {}), (2, "t", {}), (3, "text", "é")]


def test_internal_declarations_win():
    got = parse("<!DOCTYPE a SYSTEM 'a.dtd' [<!ENTITY e 'in'>]><a>&e;</a>", {"a.dtd": "<!ENTITY e 'out'><!ATTLIST a k CDATA '&e;'>"})
    assert flat(got) == [(1, "a", {"k": "in"}), (2, "text", "in")]


def test_roots():
    assert parse("<!ELEMENT a (b|c)+>", root="extSubset")["dtd"].elements[0]["spec"] == "(b|c)+"
    assert parse("<?xml encoding='utf-8'?>x<y>", root="extEntity")["nodes"][1][7] == "x<y>"


def test_fixed_default_option():
    text = "<!DOCTYPE a [<!ATTLIST a f CDATA #FIXED 'v'>]><a/>"
    assert flat(parse(text)) == [(1, "a", {})] and flat(parse(text, fixed_default=True)) == [(1, "a", {"f": "v"})]


def test_recurring_doctypes_are_parsed_once():
    parser, head = Parser(), "<!DOCTYPE a [<!ENTITY e 'x'>]>"
    first, second = parser.parse(head + "<a>&e;</a>"), parser.parse(head + "<a>y&e;</a>")
    assert first["dtd"] is second["dtd"] and second["nodes"][-1][7] == "yx" and parser.parse("<a>&e;</a>")["error"]


FOLDERS = {f"http://h/{k}/x.dtd": f"<!ATTLIST r from CDATA '{k}'><!ENTITY inner SYSTEM 'e.xml'>" for k in "ab"} | {f"http://h/{k}/e.xml": f"<i>{k}</i>" for k in "ab"}


def test_recurring_doctype_in_several_folders():
    """One declaration in three folders: each document gets its own folder's resources, in any order."""
    parser, text = Parser(Options(), {k: (v, None) for k, v in FOLDERS.items()}), "<!DOCTYPE r SYSTEM 'x.dtd'><r>&inner;</r>"
    seen = {}
    for folder in "abcbaab":
        got = parser.parse(text, f"http://h/{folder}/doc.xml")
        if folder == "c":
            assert got["error"]["code"] == "DEREFERENCE"
            continue
        assert flat(got) == [(1, "r", {"from": folder}), (2, "i", {}), (3, "text", folder)]
        assert seen.setdefault(folder, got["dtd"]) is got["dtd"]
    assert seen["a"].id != seen["b"].id


def test_relative_entity_of_an_internal_subset():
    parser = Parser(Options(), {k: (v, None) for k, v in FOLDERS.items()})
    for folder in "abab":
        assert flat(parser.parse("<!DOCTYPE r [<!ENTITY e SYSTEM 'e.xml'>]><r>&e;</r>", f"http://h/{folder}/doc.xml"))[1:] == [(2, "i", {}), (3, "text", folder)]
    plain = "<!DOCTYPE r [<!ENTITY e 'v'>]><r>&e;</r>"
    assert parser.parse(plain, "http://h/a/1")["dtd"] is parser.parse(plain, "http://h/b/2")["dtd"]


def test_many_document_types():
    parser = Parser()
    for k in [*range(100), *range(100)]:
        assert flat(parser.parse(f"<!DOCTYPE a [<!ENTITY e '{k}'>]><a>&e;</a>"))[1] == (2, "text", str(k))
    assert len(parser.known) <= 32


def test_against_the_standard_library():
    """Random documents without a document type: same acceptance, same events."""
    rng = random.Random(11)
    bits = ["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "t", " ", "&amp;", "&#65;", "<!--k-->", "<?p q?>", "<![CDATA[z]]>", "]]>", "&", "<", "é"]
    for _ in range(4000):
        text = "<r>" + "".join(rng.choices(bits, k=rng.randint(0, 9))) + "</r>"
        events = []
        p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler = lambda name, attrs: events.append(("s", name, dict(attrs)))  # noqa: B023
        p.EndElementHandler = lambda name: events.append(("e", name))  # noqa: B023
        p.CommentHandler = lambda data: events.append(("c", data))  # noqa: B023
        p.ProcessingInstructionHandler = lambda target, data: events.append(("p", target, data))  # noqa: B023
        try:
            p.Parse(text, True)
            fine = True
        except expat.ExpatError:
            fine = False
        got = parse(text)
        assert (got["error"] is None) == fine, (text, got["error"])
        if fine:
            mine = [("s", n[6], n[10]) if n[5] == "#element" else ("c", n[7]) if n[5] == "#comment" else ("p", n[9], n[7] or "") for n in got["nodes"] if n[5] in ("#element", "#comment", "#pi")]
            assert mine == [e for e in events if e[0] != "e"]
