"""XML and JSON out.

to_xml_compact() is one ordered aggregation of open and close pieces, without Python.  to_xml() lays
documents out with all options, a document at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import escape_attr, escape_cdata
from ..sources.xml import TABLES
from .groups import by_document, sound_unions


@dataclass(frozen=True)
class Layout:
    attr_inline_max: int = 1
    attr_sort: bool = True
    comments: bool = True
    depth: int = 0
    dtd: bool = True
    format_cdata: bool = True
    format_comment: bool = True
    indent: int = 2
    min_width: int = 30
    pis: bool = True
    prefer_single: bool = False
    self_close: bool = True
    wrap_column: int = 80
    xml_decl: bool = True

    def pad(self, depth: int) -> str:
        return " " * (self.indent * depth)


# -- compact, in the JVM


def _pieces() -> tuple[Column, Column]:
    """(opening, closing) piece of each node; closing is empty but for elements with children."""
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_attr(e["value"]), F.lit('"'))), "")
    leaf = F.col("last_desc") == F.col("node_id")
    opened = (
        F.when(F.col("kind") == "#element", F.concat(F.lit("<"), F.col("name"), F.coalesce(attrs, F.lit("")), F.when(leaf, "/>").otherwise(">")))
        .when((F.col("kind") == "#text") & F.coalesce("section", F.lit(False)), F.concat(F.lit("<![CDATA["), F.col("text"), F.lit("]]>")))
        .when(F.col("kind") == "#text", F.replace(escape_cdata(F.col("text")), F.lit("\r"), F.lit("&#13;")))
        .when(F.col("kind") == "#comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .when(F.col("kind") == "#pi", F.concat(F.lit("<?"), F.concat_ws(" ", "target", "text"), F.lit("?>")))
        .otherwise("")
    )
    closed = F.when((F.col("kind") == "#element") & ~leaf, F.concat(F.lit("</"), F.col("name"), F.lit(">"))).otherwise("")
    return opened, closed


def to_xml_compact(nodes: DataFrame) -> DataFrame:
    """(doc_id, xml): elements, text, comments and processing instructions with no white space added and no DTD."""
    opened, closed = _pieces()
    rows = nodes.where(F.col("kind").isin("#element", "#text", "#comment", "#pi"))
    inside_dtd = nodes.where("kind = '#doctypeDecl'").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"))
    rows = rows.join(inside_dtd, (F.col("doc_id") == F.col("_d")) & F.col("node_id").between(F.col("_a"), F.col("_z")), "left_anti")
    event = F.array(F.struct(F.col("node_id").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("inner"), opened.alias("piece")), F.struct(F.col("last_desc").alias("at"), F.lit(1).alias("end"), (-F.col("node_id")).alias("inner"), closed.alias("piece")))
    events = rows.select("doc_id", F.explode(event).alias("e")).where("e.piece <> ''")
    return events.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["piece"]), "").alias("xml"))


def to_json_flat(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, json) with the fields that a node has."""
    return nodes.select("doc_id", "node_id", F.to_json(F.struct(F.col("kind").alias("nodeType"), "name", "text", "section", "target", F.col("attrs").alias("attr"))).alias("json"))


# -- laid out, a document at a time


def _quote(value: str, o: Layout, escape: bool = False) -> str:
    mark, other = ("'", '"') if o.prefer_single else ('"', "'")
    if escape:
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (mark, "&quot;" if mark == '"' else "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
            value = value.replace(old, new)
        return mark + value + mark
    return other + value + other if mark in value else mark + value + mark


def _wrap(text: str, o: Layout, depth: int, hanging: bool = False) -> str:
    lines, line, room = [], None, 0
    for word in text.split(" "):
        if line is not None and len(line) + 1 + len(word) <= room:
            line += " " + word
            continue
        if line is not None:
            lines.append(line)
        pad = o.pad(depth + (hanging and bool(lines)))
        line, room = pad + word, max(o.min_width, o.wrap_column - len(pad))
    return "\n".join([*lines, line or ""])


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("]]>", "]]&gt;").replace("\r", "&#13;")


def _ids(public: str | None, system: str | None, o: Layout) -> str:
    parts = [_quote(x, o) for x in (public, system) if x]
    return " ".join(["PUBLIC" if public else "SYSTEM", *parts])


class _Writer:
    def __init__(self, rows: list[dict], doc: dict, dtd: dict[str, list[dict]], o: Layout) -> None:
        self.rows = {r["node_id"]: r for r in rows}
        self.kids: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["ord"]):
            if r["ord"] >= 0 and r["parent_id"] >= 0:
                self.kids.setdefault(r["parent_id"], []).append(r)
        self.doc, self.o, self.dtd = doc, o, dtd
        self.declared = {k: {} for k in TABLES}
        for kind, key in (("elem_decl", "name"), ("entity", "name"), ("notation", "name")):
            for r in sorted(dtd.get(kind, []), key=lambda r: r["decl_ord"]):
                self.declared[kind].setdefault(r[key], []).append(r)
        self.attdefs: dict[tuple, list[dict]] = {}
        for r in sorted(dtd.get("attdef", []), key=lambda r: r["decl_ord"]):
            self.attdefs.setdefault((r["element"], r["name"]), []).append(r)

    def children(self, row: dict) -> list[dict]:
        hidden = {k for k, on in (("#comment", self.o.comments), ("#pi", self.o.pis), ("#doctypeDecl", self.o.dtd)) if not on}
        return [r for r in self.kids.get(row["node_id"], []) if r["kind"] not in hidden]

    def document(self, row: dict) -> str:
        parts = [self.node(r, self.o.depth, self.o.format_cdata) for r in self.children(row)]
        if self.o.xml_decl:
            alone = f" standalone={_quote('yes', self.o)}" if self.doc.get("standalone") else ""
            parts.insert(0, f"<?xml version={_quote('1.0', self.o)}{alone}?>")
        return "\n\n".join(parts)

    def node(self, row: dict, depth: int, wrap: bool) -> str:
        kind, pad = row["kind"], self.o.pad(depth)
        if kind == "#element":
            return self.element(row, depth, wrap)
        if kind == "#text":
            if row["section"]:
                return f"{pad if wrap else ''}<![CDATA[{row['text']}]]>"
            text = _escape(row["text"])
            return _wrap(" ".join(text.split()), self.o, depth) if wrap else text
        if kind == "#comment":
            if not self.o.format_comment or not wrap:
                return f"{pad if wrap else ''}<!--{row['text']}-->"
            whole = f"<!-- {' '.join(row['text'].split())} -->"
            return pad + whole if len(pad) + len(whole) <= self.o.wrap_column else _wrap(whole, self.o, depth, True)
        if kind == "#pi":
            return f"{pad if wrap else ''}<?{row['target']}{' ' + row['text'] if row['text'] else ''}?>"
        if kind == "#doctypeDecl":
            return self.doctype(row, depth)
        if kind == "#document":
            return self.document(row)
        return self.declaration(row, depth)

    def element(self, row: dict, depth: int, wrap: bool) -> str:
        o, name, pad = self.o, row["name"], self.o.pad(depth) if wrap else ""
        attrs = dict(row["attrs"] or {})
        kids = self.children(row)
        inner_wrap = {"preserve": False, "default": o.format_cdata}.get(attrs.get("xml:space"), wrap)
        decl = (self.declared["elem_decl"].get(name) or [{}])[0]
        has_text = decl.get("mixed") or any(r["kind"] == "#text" for r in kids)
        # Where text must stay as it is, nothing may be put between the children, however deep.
        tight = not wrap or (has_text and not inner_wrap) or attrs.get("xml:space") == "preserve"
        if tight:
            body = "".join(self.node(r, 0, False) for r in kids)
            end = f"</{name}>"
        else:
            body = "\n".join(self.node(r, depth + 1, inner_wrap) for r in kids)
            end = f"\n{pad}</{name}>"
            body = "\n" + body if body else body
        pairs = sorted(attrs.items(), key=lambda kv: (kv[0].casefold(), kv[0].swapcase())) if o.attr_sort else list(attrs.items())
        texts = [f"{k}={_quote(v, o, True)}" for k, v in pairs]
        head = pad + "<" + name
        inline = "".join(" " + t for t in texts)
        room = o.wrap_column - (1 if body or not o.self_close else 0)
        if not texts or (len(texts) <= o.attr_inline_max and len(head) + len(inline) <= room) or not wrap:
            head += inline
        else:
            head += "".join(f"\n{o.pad(depth + 1)}{t}" for t in texts)
        if body:
            return head + ">" + body + end
        if o.self_close:
            return head + "/>"
        fits = not texts and (decl.get("content") == "EMPTY" or tight or len(head) + len(name) + 4 <= o.wrap_column)
        return f"{head}></{name}>" if fits or tight else f"{head}>{end}"

    def doctype(self, row: dict, depth: int) -> str:
        d, pad = self.doc, self.o.pad(depth)
        head = f"{pad}<!DOCTYPE {row['name']}"
        if d.get("system_id"):
            head += " " + _ids(d.get("public_id"), d["system_id"], self.o)
        parts = [self.node(r, depth + 1, True) for r in self.children(row)]
        return head + (" [\n" + "\n".join(parts) + f"\n{pad}]>" if parts else ">")

    def _next(self, kind: str, name: str) -> dict:
        """The declarations of one name in the order in which they stand."""
        rows = self.declared[kind].get(name) or [{}]
        return rows.pop(0) if len(rows) > 1 else rows[0]

    def declaration(self, row: dict, depth: int) -> str:
        o, pad, name = self.o, self.o.pad(depth), row["name"]
        if row["kind"] == "#elemDecl":
            return f"{pad}<!ELEMENT {name} {self._next('elem_decl', name).get('spec')}>"
        if row["kind"] == "#notationDecl":
            n = self._next("notation", name)
            return f"{pad}<!NOTATION {name} {_ids(n.get('public_id'), n.get('system_id'), o)}>"
        if row["kind"] == "#entityDecl":
            e = self._next("entity", name)
            parts = ["%"] if e.get("type") == "PARAMETER" else []
            parts.append(name)
            if e.get("system_id") is not None:
                parts.append(_ids(e.get("public_id"), e["system_id"], o))
            else:
                value = e.get("value") or ""
                for old, new in (("&#", "&#x26;#"), ("<", "&#x3c;"), ("%", "&#x25;"), ("'", "&#x27;"), ('"', "&#x22;")):
                    value = value.replace(old, new)
                parts.append(_quote(value, o))
            if e.get("notation_name"):
                parts.append(f"NDATA {e['notation_name']}")
            return f"{pad}<!ENTITY {' '.join(parts)}>"
        if row["kind"] == "#attlistDecl":
            return self.attlist(row, depth)
        return ""

    def attlist(self, row: dict, depth: int) -> str:
        o, pad = self.o, self.o.pad(depth)
        rows = []
        for r in self.kids.get(row["node_id"], []):
            known = self.attdefs.get((row["name"], r["name"])) or [{}]
            rows.append(known.pop(0) if len(known) > 1 else known[0])
        head = f"{pad}<!ATTLIST {row['name']}"
        if not rows:
            return head + ">"
        cells = [self._cells(a) for a in rows]
        every = [self._cells(a) for group in self.attdefs.values() for a in group]
        lone = all(len(self.kids.get(r["node_id"], [])) < 2 for r in self.rows.values() if r["kind"] == "#attlistDecl")
        if lone:
            return head + " " + " ".join(x for x in cells[0] if x) + ">"
        width = [max([0, *(len(c[k]) for c in every if k != 1 or not c[1].endswith(")"))]) for k in range(3)]
        if o.attr_sort:
            cells.sort(key=lambda c: c[0].casefold())
        lines = []
        for *first, value in cells:
            line, end = "", -1
            for text, wide in zip(first, width, strict=True):
                end += 1 + wide
                line = f"{line} {text}".ljust(end + 1)
            lines.append(o.pad(depth + 1) + (f"{line[1:]} {value}" if value else line[1:].rstrip()))
        return head + "\n" + "\n".join(lines) + ">"

    def _cells(self, a: dict) -> list[str]:
        choices = "(" + "|".join(a.get("enumeration") or []) + ")" if a.get("enumeration") is not None else ""
        kind = a.get("type", "")
        what = f"NOTATION {choices}" if kind == "NOTATION" else choices or kind
        value = a.get("default_value")
        rule = "#FIXED" if a.get("fixed") else "#REQUIRED" if a.get("required") else "" if value is not None else "#IMPLIED"
        return [a.get("name", ""), what, rule, _quote(value, self.o, True) if value is not None else ""]

    def json(self, row: dict) -> dict:
        kind = row["kind"]
        out: dict = {"nodeType": kind}
        if kind not in ("#text", "#comment", "#pi", "#attdef", "#entityDecl", "#notationDecl", "#elemDecl"):
            out["children"] = [self.json(r) for r in self.kids.get(row["node_id"], [])]
        if kind == "#document":
            out["standalone"] = bool(self.doc.get("standalone"))
        elif kind == "#element":
            out.update(attr=dict(row["attrs"] or {}), name=row["name"])
        elif kind == "#text":
            out.update(section=bool(row["section"]), text=row["text"])
        elif kind == "#comment":
            out["content"] = row["text"]
        elif kind == "#pi":
            out.update(instruction=row["text"], target=row["target"])
        elif kind == "#doctypeDecl":
            outer = next((r for r in self.rows.values() if r["kind"] == "#extSubset"), None)
            out.update(external=outer and self.json(outer), name=row["name"], publicID=self.doc.get("public_id"), systemID=self.doc.get("system_id"))
        elif kind == "#elemDecl":
            e = self._next("elem_decl", row["name"])
            out.update(contentSpec=e.get("spec"), mixed=e.get("mixed"), name=row["name"])
        elif kind == "#attlistDecl":
            out["elementName"] = row["name"]
        elif kind == "#attdef":
            a = (self.attdefs.get((self.rows[row["parent_id"]]["name"], row["name"])) or [{}])[0]
            out.update(defaultValue=a.get("default_value"), enumeration=a.get("enumeration"), fixed=a.get("fixed"), name=row["name"], required=a.get("required"), type=a.get("type"))
        elif kind == "#entityDecl":
            e = self._next("entity", row["name"])
            out.update(name=row["name"], notationName=e.get("notation_name"), path=e.get("path"), publicID=e.get("public_id"), systemID=e.get("system_id"), type=e.get("type"), value=e.get("value"))
        elif kind == "#notationDecl":
            n = self._next("notation", row["name"])
            out.update(name=row["name"], publicID=n.get("public_id"), systemID=n.get("system_id"))
        return out


def write_rows(rows: list[dict], doc: dict | None = None, dtd: dict | None = None, layout: Layout = Layout(), as_json: bool = False) -> str:  # noqa: B008
    """Text of the node rows of one document or fragment, from its first node."""
    w = _Writer(rows, doc or {}, dtd or {}, layout)
    top = min(rows, key=lambda r: r["node_id"])
    if as_json:
        return json.dumps(w.json(top), ensure_ascii=False)
    return w.node(top, layout.depth, layout.format_cdata)


def _declarations(docs: DataFrame, tables: dict[str, DataFrame] | None) -> DataFrame:
    """(doc_id, _doc): each document's own columns and declarations as JSON."""
    rows = docs.select("doc_id", "dtd_id", F.struct("standalone", "public_id", "system_id").alias("doc"))
    for name, table in (tables or {}).items():
        fields = [f.name for f in TABLES[name]]
        rows = rows.join(table.groupBy("dtd_id").agg(F.collect_list(F.struct(*fields)).alias(name)), "dtd_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("doc", *(tables or {}))).alias("_doc"))


def _written(nodes: DataFrame, docs: DataFrame, tables: dict[str, DataFrame] | None, layout: Layout, as_json: bool) -> DataFrame:
    name = "json" if as_json else "xml"
    keep = ["doc_id", "node_id", "parent_id", "ord", "kind", "name", "text", "section", "target", "attrs"]
    # A row before each document's nodes brings its columns and declarations: no join, and one shuffle of the nodes.
    about = _declarations(docs, tables).withColumn("node_id", F.lit(-1))
    rows = sound_unions(nodes.select(*keep, F.lit(None).cast("string").alias("_doc")).unionByName(about, allowMissingColumns=True))

    def one(rows: list[dict]) -> list[tuple]:
        own = [r for r in rows if r["_doc"] is None]
        if not own:
            return []
        given = next((json.loads(r["_doc"]) for r in rows if r["_doc"]), {}) if own[0]["node_id"] == 0 else {}
        return [(own[0]["doc_id"], write_rows(own, given.get("doc"), given, layout, as_json))]

    return by_document(rows, T.StructType([nodes.schema["doc_id"], T.StructField(name, T.StringType())]), one)


def to_xml(nodes: DataFrame, docs: DataFrame, tables: dict[str, DataFrame] | None = None, layout: Layout = Layout(), **options) -> DataFrame:  # noqa: B008
    """(doc_id, xml) laid out; tables are the declaration tables that DTDs are written from."""
    return _written(nodes, docs, tables, replace(layout, **options), False)


def to_json(nodes: DataFrame, docs: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, json): the nested tree of each document."""
    return _written(nodes, docs, tables, Layout(), True)
