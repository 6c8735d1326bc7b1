"""A whole-document XML 1.0 processor in Python: decoded text in, flat rows out.

It checks well-formedness, expands entities and conditional sections, applies attribute types and
defaults, and numbers nodes in preorder, so that a subtree is the interval node_id..last_desc.  The
first violation of well-formedness ends a document with an error; validity is left to the relational
rules in operators.validate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urljoin

from ..functions.chars import name_classes
from ..functions.encoding import DecodeProblem, decode_bytes
from ..plans.content_model import Particle, ambiguous, image_pattern, names, partial_pattern, write

CONTEXT = 30
KNOWN = 32  # document types kept for documents to come, and variants of one by base path
S = " \t\n\r"
TOKENIZED = frozenset("ENTITY ENTITIES IDREF IDREFS NOTATION ENUMERATION ID NMTOKEN NMTOKENS".split())
# The predefined entities as declared text.
PREDEFINED = {"amp": "&#38;", "lt": "&#60;", "gt": ">", "apos": "'", "quot": '"'}

_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_PUBLIC = re.compile(r"[\n\r !#-%'-;=?-Z_a-z]*\Z")
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#x([0-9A-Fa-f]+)|([^;&<>\s]+));")
_XML_DECL = re.compile(r"<\?xml(?:[ \t\n]+version[ \t\n]*=[ \t\n]*(?P<v>'1\.[0-9]+'|\"1\.[0-9]+\"))?(?:[ \t\n]+encoding[ \t\n]*=[ \t\n]*(?P<e>'[A-Za-z][A-Za-z0-9._-]*'|\"[A-Za-z][A-Za-z0-9._-]*\"))?(?:[ \t\n]+standalone[ \t\n]*=[ \t\n]*(?P<s>'(?:yes|no)'|\"(?:yes|no)\"))?[ \t\n]*\?>")


class XmlError(Exception):
    """code, message, and the place in the document."""

    def __init__(self, code: str, message: str, at: int | None = None) -> None:
        super().__init__(message)
        self.code, self.message, self.at = code, message, at


@dataclass(frozen=True)
class Options:
    root: str = "document"  # or extSubset, extEntity
    max_expansion_count: int = 10_000
    max_expansion_size: int = 20_000
    names: str = "4e"
    fixed_default: bool = False
    count_predefined: bool = False
    path: str = ""
    swapped_utf16: bool = False


@dataclass
class Dtd:
    name: str = ""
    public_id: str | None = None
    system_id: str | None = None
    id: str = ""
    elements: list[dict] = field(default_factory=list)
    attdefs: list[dict] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)
    notations: list[dict] = field(default_factory=list)
    children: list[tuple] = field(default_factory=list)  # (external, kind, name, text, target, inner)
    content: dict[str, dict] = field(default_factory=dict)
    defaults: dict[str, dict[str, dict]] = field(default_factory=dict)
    general: dict[str, dict] = field(default_factory=dict)
    parameter: dict[str, dict] = field(default_factory=dict)
    expansions: int = 0
    order: int = 0

    def next(self) -> int:
        self.order += 1
        return self.order - 1


class _Frame:
    __slots__ = ("external", "held", "name", "path", "pos", "text")

    def __init__(self, text: str, name: str = "", path: str = "", external: bool = False) -> None:
        self.text, self.pos, self.name, self.path, self.external, self.held = text, 0, name, path, external, len(text)


class Parser:
    """Parses documents one after another; document type declarations that recur are parsed once."""

    def __init__(self, options: Options = Options(), resources: Mapping[str, tuple[bytes | str, str | None]] | None = None) -> None:  # noqa: B008
        self.o, self.resources = options, dict(resources or {})
        start, inner = name_classes(options.names, java=False)
        self.name = re.compile(f"[{start}][{inner}]*")
        self.name_char = re.compile(f"[{inner}]+")
        self.start_char = re.compile(f"[{start}]")
        self.attribute = re.compile(f"([ \\t\\n]*)([{start}][{inner}]*)[ \\t\\n]*=[ \\t\\n]*(?:\"([^\"]*)\"|'([^']*)')")
        # By the text of a declaration: what its relative identifiers resolved to, and the document type.
        self.known: dict[str, list[tuple[list[tuple[str, str]], Dtd]]] = {}
        self.relative: list[tuple[str, str]] = []

    # -- entry

    def parse(self, text: str, path: str | None = None) -> dict:
        """The document as {docs fields, nodes, dtd} or {error}."""
        self.text, self.path = text, self.o.path if path is None else path
        self.nodes: list[list] = []
        self.dtd: Dtd | None = None
        self.expansions, self.relative = 0, []
        self.frames = [_Frame(text, path=self.path)]
        self.info = {"encoding": None, "standalone": None, "version": None}
        bad = _ILLEGAL.search(text)
        try:
            try:
                if self.o.root == "extSubset":
                    self.dtd = Dtd()
                    self._external_text(text, self.path)
                    self._finish_dtd()
                elif self.o.root == "extEntity":
                    self._node("#document", -1, 0, 0)
                    self._node("#text", 0, 0, 1, text=self._strip_text_decl(text))
                    self.nodes[0][4] = 1
                else:
                    self._document()
            except XmlError as problem:
                if problem.at is None:
                    problem.at = self.frames[0].pos
                if bad is None or problem.at <= bad.start():
                    raise
            if bad is not None:
                raise XmlError("BAD_CHAR", f"the character U+{ord(bad[0]):04X} is not allowed", bad.start())
        except XmlError as problem:
            return {"error": self._error(problem), "dtd": None, "nodes": [], **self.info}
        except RecursionError:
            return {"error": self._error(XmlError("DEPTH", "entities or groups are nested too deeply", 0)), "dtd": None, "nodes": [], **self.info}
        return {"error": None, "dtd": self.dtd, "nodes": self.nodes, **self.info}

    def _error(self, problem: XmlError) -> dict:
        at = min(problem.at or 0, len(self.text))
        line = self.text.count("\n", 0, at) + 1
        column = at - (self.text.rfind("\n", 0, at) + 1) + 1
        return {"code": problem.code, "line": line, "column": column, "context": self.text[max(0, at - CONTEXT) : at], "message": problem.message}

    # -- nodes

    def _node(self, kind: str, parent: int, place: int, depth: int, name=None, text=None, section=None, target=None, attrs=None, specified=None) -> int:
        n = len(self.nodes)
        self.nodes.append([n, parent, place, depth, n, kind, name, text, section, target, attrs, specified, None, None, None])
        return n

    # -- document

    def _document(self) -> None:
        f, text = self.frames[0], self.text
        self._node("#document", -1, 0, 0)
        if text.startswith("<?xml") and text[5:6] in (" ", "\t", "\n", "\r"):
            m = _XML_DECL.match(text)
            if not m or not m["v"]:
                raise XmlError("XML_DECL", "expected version, encoding and standalone in this order, and ?>", 5)
            self.info.update(version=m["v"][1:-1], encoding=m["e"] and m["e"][1:-1], standalone=bool(m["s"]) and m["s"][1:-1] == "yes")
            f.pos = m.end()
        place, root, size = 0, None, len(text)
        while True:
            while f.pos < size and text[f.pos] in S:
                f.pos += 1
            if f.pos >= size:
                break
            if text.startswith("<!--", f.pos):
                self._comment(f, 0, place, 1)
            elif text.startswith("<?", f.pos):
                self._proc_inst(f, 0, place, 1)
            elif text.startswith("<!DOCTYPE", f.pos):
                if self.dtd is not None or root is not None:
                    raise XmlError("DOCTYPE", "a document type declaration may stand once, before the root element")
                self._doctype(f, place)
            elif text[f.pos] == "<" and root is None:
                root = self._content(f, place)
            else:
                raise XmlError("DOCUMENT", "expected a comment, a processing instruction or the root element" if root is None else "expected nothing but comments and processing instructions after the root element")
            place += 1
        if root is None:
            raise XmlError("NO_ROOT", "expected a root element before the input ends")
        self.nodes[0][4] = len(self.nodes) - 1
        for n in self.nodes:
            if n[1] == -1 and n[0]:
                n[1] = 0

    def _comment(self, f: _Frame, parent: int, place: int, depth: int) -> None:
        end = f.text.find("--", f.pos + 4)
        if end < 0 or f.text[end : end + 3] != "-->":
            f.pos = len(f.text) if end < 0 else end + 2
            raise XmlError("COMMENT", "expected --> and no other -- in a comment")
        self._node("#comment", parent, place, depth, text=f.text[f.pos + 4 : end])
        f.pos = end + 3

    def _proc_inst(self, f: _Frame, parent: int, place: int, depth: int) -> None:
        target, body = self._proc_inst_parts(f)
        self._node("#pi", parent, place, depth, target=target, text=body)

    def _proc_inst_parts(self, f: _Frame) -> tuple[str, str | None]:
        m = self.name.match(f.text, f.pos + 2)
        if not m:
            f.pos += 2
            raise XmlError("PI", "expected the name of a target")
        if m[0].lower() == "xml":
            raise XmlError("PI", "the target xml is reserved and its declaration stands only at the start")
        end = f.text.find("?>", m.end())
        if end < 0:
            f.pos = len(f.text)
            raise XmlError("PI", "expected ?> before the input ends")
        body = f.text[m.end() : end]
        if body and body[0] not in S:
            f.pos = m.end()
            raise XmlError("PI", "expected white space after the target")
        f.pos = end + 2
        return m[0], body.lstrip(S) or None

    # -- references

    def _char(self, decimal: str | None, hexa: str | None) -> str:
        point = int(decimal) if decimal else int(hexa or "0", 16)
        if point > 0x10FFFF or _ILLEGAL.match(chr(point)):
            raise XmlError("LEGAL_CHARACTER", f"the reference names the illegal character {point:#x}")
        return chr(point)

    def _entity(self, name: str) -> dict:
        if not self.name.fullmatch(name):
            raise XmlError("REFERENCE", f"expected a name, not {name[:20]!r}")
        found = self.dtd.general.get(name) if self.dtd else None
        if found is None and name in PREDEFINED:
            found = {"name": name, "value": PREDEFINED[name], "type": "GENERAL", "predefined": True, "system_id": None, "external_origin": False}
        if found is None:
            raise XmlError("ENTITY_DECLARED", f"the entity {name} is not declared")
        if found["type"] == "UNPARSED":
            raise XmlError("PARSED_ENTITY", f"the entity {name} is unparsed and has no text")
        return found

    def _enter(self, entity: dict, active: list[_Frame], pad: bool = False) -> _Frame:
        """A frame of the entity's replacement text, after all guards."""
        name = entity["name"]
        key = ("%" if entity["type"] == "PARAMETER" else "&") + name
        chain = [x.name for x in active if x.name]
        if key in chain:
            raise XmlError("NO_RECURSION", " => ".join(x[1:] for x in [*chain[chain.index(key) :], key]))
        if not entity.get("predefined") or self.o.count_predefined:
            self.expansions += 1
            if self.expansions > self.o.max_expansion_count:
                raise XmlError("EXPANSION_COUNT", f"more than {self.o.max_expansion_count} expansions")
        text, path, external = self._replacement(entity)
        for x in [*(a for a in active if a.name), None]:
            if x is not None:
                x.held += len(text)
            if (x.held if x else len(text)) > self.o.max_expansion_size:
                raise XmlError("EXPANSION_SIZE", f"the expansion of {x.name[1:] if x else name} exceeds {self.o.max_expansion_size} characters")
        return _Frame(f" {text} " if pad else text, key, path, external)

    def _replacement(self, entity: dict) -> tuple[str, str, bool]:
        if entity["value"] is None:
            path = entity["path"]
            if "loaded" not in entity:
                entity["loaded"] = self._strip_text_decl(self._resource(path, entity["public_id"], entity["system_id"]))
            return entity["loaded"], path, True
        return entity["value"], entity.get("base", self.path), bool(entity["external_origin"])

    def _resource(self, path: str, public_id: str | None, system_id: str | None) -> str:
        for key in (path, system_id, public_id):
            if key is not None and key in self.resources:
                content, encoding = self.resources[key]
                if isinstance(content, str):
                    return re.sub("\r\n?", "\n", content)
                try:
                    return decode_bytes(bytes(content), encoding, self.o.swapped_utf16)[0]
                except DecodeProblem as problem:
                    raise XmlError("DECODE", f"{path}: {problem}") from None
        raise XmlError("DEREFERENCE", f"no resource is given for {path}")

    def _strip_text_decl(self, text: str) -> str:
        if text.startswith("<?xml") and text[5:6] in (" ", "\t", "\n"):
            m = _XML_DECL.match(text)
            if not m or not m["e"] or m["s"]:
                raise XmlError("TEXT_DECL", "expected an encoding and no standalone in a text declaration")
            return text[m.end() :]
        return text

    def _value(self, raw: str, tokenized: bool, active: list[_Frame] | None = None) -> str:
        """Normalised attribute value of a literal."""
        active = list(self.frames) if active is None else active
        if "<" in raw:
            raise XmlError("NO_LT", "< may not stand in an attribute value")
        if "&" not in raw:
            out = raw.translate({9: 32, 10: 32, 13: 32})
        else:
            out = self._expand_value(raw, active)
        return " ".join(x for x in out.split(" ") if x) if tokenized else out

    def _expand_value(self, raw: str, active: list[_Frame]) -> str:
        out, at = [], 0
        while True:
            amp = raw.find("&", at)
            out.append(raw[at : len(raw) if amp < 0 else amp].translate({9: 32, 10: 32, 13: 32}))
            if amp < 0:
                return "".join(out)
            m = _REFERENCE.match(raw, amp)
            if not m:
                raise XmlError("REFERENCE", "expected a reference after &")
            if m[3] is None:
                out.append(self._char(m[1], m[2]))
            else:
                entity = self._entity(m[3])
                if entity["value"] is None:
                    raise XmlError("NO_EXTERNAL", f"the external entity {m[3]} may not be used in an attribute value")
                frame = self._enter(entity, active)
                if "<" in frame.text:
                    raise XmlError("NO_LT", f"< may not come into an attribute value by the entity {m[3]}")
                out.append(self._expand_value(frame.text, [*active, frame]))
            at = m.end()

    # -- content

    def _start_tag(self, f: _Frame, parent: int, place: int, depth: int) -> tuple[int, str, bool]:
        """Node, name and whether the element is closed already; f stands at <."""
        text, m = f.text, self.name.match(f.text, f.pos + 1)
        if not m:
            f.pos += 1
            raise XmlError("ELEMENT", "expected the name of an element")
        name, at, attrs, begin = m[0], m.end(), {}, f.pos
        types = self.dtd.defaults.get(name, {}) if self.dtd else {}
        while True:
            c = text[at : at + 1]
            if c == ">":
                closed, at = False, at + 1
                break
            if c == "/" and text[at + 1 : at + 2] == ">":
                closed, at = True, at + 2
                break
            m = self.attribute.match(text, at)
            if not m or not m[1]:
                f.pos = at
                while f.pos < len(text) and text[f.pos] in S:
                    f.pos += 1
                tail = text[f.pos : f.pos + 2]
                if tail[:1] == ">" or tail == "/>":
                    at = f.pos
                    continue
                raise XmlError("ELEMENT", "expected an attribute, > or />")
            key = m[2]
            if key in attrs:
                f.pos = m.end(2)
                raise XmlError("UNIQUE_ATT", f"the attribute {key} stands twice")
            raw = m[3] if m[3] is not None else m[4]
            kind = types[key]["type"] if key in types else "CDATA"
            f.pos = m.start(3) if m[3] is not None else m.start(4)
            attrs[key] = raw if kind == "CDATA" and raw.isalnum() else self._value(raw, kind in TOKENIZED)
            at = m.end()
        f.pos = at
        specified = list(attrs)
        for key, d in types.items():
            if key not in attrs and d["default_value"] is not None and (not d["fixed"] or self.o.fixed_default):
                attrs[key] = d["default_value"]
        node = self._node("#element", parent, place, depth, name=name, attrs=attrs, specified=specified)
        self.nodes[node][14] = begin if f is self.frames[0] else None
        return node, name, closed

    def _content(self, base: _Frame, place: int) -> int:
        """The root element, from its < to its end; gives its node."""
        nodes = self.nodes
        root, name, closed = self._start_tag(base, 0, place, 1)
        if closed:
            nodes[root][12], nodes[root][13] = "", False
            return root
        frames = self.frames
        content = self.dtd.content if self.dtd else {}
        # Open elements: node, name, frame, next place, child names, model, whether anything stands in it.
        stack = [[root, name, base, 0, [], content.get(name, {}).get("content"), False]]
        text: list[str] = []
        by_ref = False

        def flush() -> None:
            nonlocal by_ref
            if text:
                top, whole = stack[-1], "".join(text)
                text.clear()
                if whole:
                    if not (top[5] == "MODEL" and not by_ref and not whole.strip(S)):
                        n = self._node("#text", top[0], top[3], len(stack) + 1, text=whole, section=False)
                        nodes[n][13] = by_ref and not whole.strip(S)
                        top[3] += 1
            by_ref = False

        while stack:
            f = frames[-1]
            source, at = f.text, f.pos
            if at >= len(source):
                if f is base:
                    raise XmlError("UNCLOSED", f"expected </{stack[-1][1]}> before the input ends")
                if stack[-1][2] is f:
                    raise XmlError("BOUNDARY", f"the element {stack[-1][1]} begins in the entity {f.name[1:]} and does not end there")
                frames.pop()
                continue
            top = stack[-1]
            c = source[at]
            if c == "<":
                kind = source[at + 1 : at + 2]
                if kind == "/":
                    m = self.name.match(source, at + 2)
                    end = m.end() if m else at + 2
                    while end < len(source) and source[end] in S:
                        end += 1
                    if not m or m[0] != top[1] or source[end : end + 1] != ">":
                        f.pos = end
                        raise XmlError("TYPE_MATCH", f"expected </{top[1]}>")
                    if top[2] is not f:
                        raise XmlError("BOUNDARY", f"the element {top[1]} ends in another entity than it begins in")
                    flush()
                    f.pos = end + 1
                    row = nodes[top[0]]
                    row[4] = len(nodes) - 1
                    row[12] = "".join(" " + x for x in top[4])
                    row[13] = top[6]
                    stack.pop()
                elif kind == "!":
                    top[6] = True
                    if source.startswith("<!--", at):
                        flush()
                        self._comment(f, top[0], top[3], len(stack) + 1)
                        top[3] += 1
                    elif source.startswith("<![CDATA[", at):
                        flush()
                        end = source.find("]]>", at)
                        if end < 0:
                            f.pos = len(source)
                            raise XmlError("CDATA", "expected ]]> before the input ends")
                        self._node("#text", top[0], top[3], len(stack) + 1, text=source[at + 9 : end], section=True)
                        top[3] += 1
                        f.pos = end + 3
                    else:
                        raise XmlError("CONTENT", "expected a comment or a CDATA section after <!")
                elif kind == "?":
                    top[6] = True
                    flush()
                    self._proc_inst(f, top[0], top[3], len(stack) + 1)
                    top[3] += 1
                else:
                    top[6] = True
                    flush()
                    node, name, closed = self._start_tag(f, top[0], top[3], len(stack) + 1)
                    top[3] += 1
                    top[4].append(name)
                    if closed:
                        nodes[node][12], nodes[node][13] = "", False
                    else:
                        stack.append([node, name, f, 0, [], content.get(name, {}).get("content"), False])
            elif c == "&":
                top[6] = True
                m = _REFERENCE.match(source, at)
                if not m:
                    raise XmlError("REFERENCE", "expected a reference after &")
                if m[3] is None:
                    text.append(self._char(m[1], m[2]))
                    by_ref = True
                    f.pos = m.end()
                else:
                    entity = self._entity(m[3])
                    if entity.get("predefined"):
                        self._enter(entity, [])
                        text.append({"amp": "&", "lt": "<"}.get(m[3]) or entity["value"])
                        by_ref = True
                        f.pos = m.end()
                    else:
                        frame = self._enter(entity, frames)
                        f.pos = m.end()
                        frames.append(frame)
            else:
                top[6] = True
                end = len(source)
                for mark in ("<", "&"):
                    k = source.find(mark, at, end)
                    end = k if k >= 0 else end
                run = source[at:end]
                bad = run.find("]]>")
                if bad >= 0:
                    f.pos = at + bad
                    raise XmlError("CONTENT", "]]> may not stand in text")
                text.append(run)
                f.pos = end
        return root

    # -- document type declarations

    def _doctype(self, f: _Frame, place: int) -> None:
        begin = f.pos
        found = self._known(f.text, begin)
        if found:
            raw, self.dtd = found
            self.expansions += self.dtd.expansions
            f.pos = begin + len(raw)
            self._doctype_nodes(place)
            return
        before, self.relative = self.expansions, []
        self.dtd = Dtd()
        f.pos += 9
        self._space("after <!DOCTYPE")
        self.dtd.name = self._name("of the root element")
        spaced = self._skip()
        if self._ahead("SYSTEM") or self._ahead("PUBLIC"):
            if not spaced:
                raise XmlError("DOCTYPE", "expected white space before the external identifier")
            self.dtd.public_id, self.dtd.system_id = self._external_id(False)
            self._skip()
        if self._peek() == "[":
            self._take("[")
            self._subset("]")
            self._take("]")
            self._skip()
        self._take(">")
        if self.dtd.system_id is not None:
            path = self._resolve(self.path, self.dtd.system_id)
            saved, self.frames = self.frames, []
            try:
                self._external_text(self._resource(path, self.dtd.public_id, self.dtd.system_id), path)
            except XmlError as problem:
                problem.at = begin
                raise
            finally:
                self.frames = saved
        self._finish_dtd(f.text[begin : f.pos])
        self.dtd.expansions = self.expansions - before
        if f.pos - begin < 1 << 20:
            variants = self.known.setdefault(f.text[begin : f.pos], [])
            variants.append((self.relative, self.dtd))
            for kept in (variants, self.known):
                if len(kept) > KNOWN:  # the oldest goes
                    del kept[next(iter(kept)) if kept is self.known else 0]
        self._doctype_nodes(place)

    def _known(self, text: str, begin: int) -> tuple[str, Dtd] | None:
        """A declaration that stands here and was parsed before, with identifiers that resolve to the same places now."""
        for raw, variants in self.known.items():
            if text.startswith(raw, begin):
                for relative, dtd in variants:
                    if all(urljoin(self.path, system_id) == path for system_id, path in relative):
                        return raw, dtd
        return None

    def _resolve(self, base: str, system_id: str) -> str:
        path = urljoin(base, system_id)
        if base == self.path:
            self.relative.append((system_id, path))
        return path

    def _external_text(self, text: str, path: str) -> None:
        bad = _ILLEGAL.search(text)
        if bad:
            raise XmlError("BAD_CHAR", f"{path}: the character U+{ord(bad[0]):04X} is not allowed")
        self.frames = [_Frame(self._strip_text_decl(text), path=path, external=True)]
        self._subset("")

    def _finish_dtd(self, raw: str = "") -> None:
        d = self.dtd
        for e in d.elements:
            d.content.setdefault(e["name"], e)
        for a in d.attdefs:
            d.defaults.setdefault(a["element"], {}).setdefault(a["name"], a)
        about = repr((raw or self.text, self.relative, [(e["name"], e["spec"]) for e in d.elements], [(a["element"], a["name"], a["type"], a["default_value"]) for a in d.attdefs], [(e["name"], e["value"]) for e in d.entities]))
        d.id = hashlib.sha256(about.encode("utf-8", "surrogatepass")).hexdigest()[:32]

    def _doctype_nodes(self, place: int) -> None:
        d = self.dtd
        top = self._node("#doctypeDecl", 0, place, 1, name=d.name)
        outer = None
        counts = [0, 0]
        for external, kind, name, text, target, inner in d.children:
            if external and outer is None:
                outer = self._node("#extSubset", top, -1, 2)
            n = self._node(kind, outer if external else top, counts[external], 3 if external else 2, name=name, text=text, target=target)
            counts[external] += 1
            for k, attribute in enumerate(inner):
                self._node("#attdef", n, k, 4 if external else 3, name=attribute)
            self.nodes[n][4] = len(self.nodes) - 1
        for n in (top, outer):
            if n is not None:
                self.nodes[n][4] = len(self.nodes) - 1

    # Scanning in declarations: characters come from a stack of frames, and in external text parameter
    # references are replaced wherever they stand, unless suppressed.

    _suppressed = False

    def _outer(self) -> bool:
        return any(f.external for f in self.frames)

    def _peek(self) -> str:
        while True:
            f = self.frames[-1]
            if f.pos < len(f.text):
                c = f.text[f.pos]
                if c == "%" and not self._suppressed and self._outer() and self.start_char.match(f.text, f.pos + 1):
                    self._parameter(f, True)
                    continue
                return c
            if len(self.frames) == 1:
                return ""
            self.frames.pop()

    def _parameter(self, f: _Frame, pad: bool) -> None:
        m = self.name.match(f.text, f.pos + 1)
        if not m or f.text[m.end() : m.end() + 1] != ";":
            raise XmlError("REFERENCE", "expected a parameter reference that ends with ;")
        entity = self.dtd.parameter.get(m[0])
        if entity is None:
            raise XmlError("ENTITY_DECLARED", f"the parameter entity {m[0]} is not declared")
        frame = self._enter(entity, self.frames, pad)
        f.pos = m.end() + 1
        self.frames.append(frame)

    def _ahead(self, word: str) -> bool:
        self._peek()
        f = self.frames[-1]
        return f.text.startswith(word, f.pos)

    def _take(self, word: str) -> _Frame:
        if not self._ahead(word):
            raise XmlError("DTD", f"expected {word}")
        f = self.frames[-1]
        f.pos += len(word)
        return f

    def _skip(self) -> bool:
        some = False
        while (c := self._peek()) and c in S:
            self.frames[-1].pos += 1
            some = True
        return some

    def _space(self, where: str) -> None:
        if not self._skip():
            raise XmlError("DTD", f"expected white space {where}")

    def _name(self, what: str, pattern: re.Pattern | None = None) -> str:
        self._peek()
        f = self.frames[-1]
        m = (pattern or self.name).match(f.text, f.pos)
        if not m:
            raise XmlError("DTD", f"expected the name {what}")
        f.pos = m.end()
        return m[0]

    def _literal(self, what: str) -> tuple[str, str]:
        c = self._peek()
        if c not in ("'", '"') or not c:
            raise XmlError("DTD", f"expected {what} in quotes")
        f = self.frames[-1]
        end = f.text.find(c, f.pos + 1)
        if end < 0:
            f.pos = len(f.text)
            raise XmlError("DTD", f"expected {what} to end with {c}")
        raw = f.text[f.pos + 1 : end]
        f.pos = end + 1
        return raw, c

    def _external_id(self, alone: bool) -> tuple[str | None, str | None]:
        public = None
        if self._ahead("PUBLIC"):
            self._take("PUBLIC")
            self._space("after PUBLIC")
            public, _ = self._literal("a public identifier")
            if not _PUBLIC.match(public):
                raise XmlError("PUBLIC_ID", "a character is not allowed in a public identifier")
            public = " ".join(public.split())
            spaced = self._skip()
            if alone and self._peek() not in ("'", '"'):
                return public, None
            if not spaced:
                raise XmlError("DTD", "expected white space before the system identifier")
        else:
            self._take("SYSTEM")
            self._space("after SYSTEM")
        return public, self._literal("a system identifier")[0]

    def _add(self, kind: str, name: str | None = None, text: str | None = None, target: str | None = None, inner: tuple = ()) -> None:
        self.dtd.children.append((self._in_external(), kind, name, text, target, inner))

    def _in_external(self) -> bool:
        return self.frames[0].external

    def _subset(self, end: str) -> None:
        included: list[_Frame] = []
        while True:
            f = self.frames[-1]
            if f.pos < len(f.text) and f.text[f.pos] == "%" and not self._outer():
                self._parameter(f, True)
                continue
            c = self._peek()
            f = self.frames[-1]
            if not c:
                if end or included:
                    raise XmlError("DTD", f"expected {end or ']]>'} before the input ends")
                return
            if c in S:
                f.pos += 1
            elif c == end and not included:
                if len(self.frames) > 1:
                    raise XmlError("BOUNDARY", "the internal subset may not end in an entity")
                return
            elif f.text.startswith("]]>", f.pos) and included:
                if included.pop() is not f:
                    raise XmlError("BOUNDARY", "a conditional section ends in another entity than it begins in")
                f.pos += 3
            elif f.text.startswith("<!--", f.pos):
                stop = f.text.find("--", f.pos + 4)
                if stop < 0 or f.text[stop : stop + 3] != "-->":
                    f.pos = len(f.text) if stop < 0 else stop
                    raise XmlError("COMMENT", "expected --> and no other -- in a comment")
                self._add("#comment", text=f.text[f.pos + 4 : stop])
                f.pos = stop + 3
            elif f.text.startswith("<?", f.pos):
                target, body = self._proc_inst_parts(f)
                self._add("#pi", text=body, target=target)
            elif f.text.startswith("<![", f.pos):
                self._conditional(f, included)
            elif f.text.startswith("<!", f.pos):
                self._declaration(f)
            else:
                raise XmlError("DTD", "expected a declaration, a comment, a processing instruction or a reference")

    def _conditional(self, f: _Frame, included: list[_Frame]) -> None:
        if not self._outer():
            raise XmlError("DTD", "conditional sections may stand only in external text")
        f.pos += 3
        self._skip()
        word = self._name("INCLUDE or IGNORE")
        self._skip()
        self._take("[")
        if word == "INCLUDE":
            included.append(f)
            return
        if word != "IGNORE":
            raise XmlError("DTD", "expected INCLUDE or IGNORE")
        g, depth = self.frames[-1], 1
        for m in re.compile(r"<!\[|\]\]>").finditer(g.text, g.pos):
            depth += 1 if m[0] == "<![" else -1
            if not depth:
                g.pos = m.end()
                return
        g.pos = len(g.text)
        raise XmlError("DTD", "expected ]]> at the end of an ignored section")

    def _declaration(self, f: _Frame) -> None:
        for word, read in (("<!ELEMENT", self._element_decl), ("<!ATTLIST", self._attlist_decl), ("<!ENTITY", self._entity_decl), ("<!NOTATION", self._notation_decl)):
            if f.text.startswith(word, f.pos):
                f.pos += len(word)
                read()
                self._skip()
                if self._take(">") is not f:
                    raise XmlError("BOUNDARY", "a declaration ends in another entity than it begins in")
                return
        raise XmlError("DTD", "expected ELEMENT, ATTLIST, ENTITY or NOTATION after <!")

    def _element_decl(self) -> None:
        self._space("after <!ELEMENT")
        name = self._name("of an element")
        self._space("after the element's name")
        row = {"decl_ord": self.dtd.next(), "name": name, "mixed": False, "content": "MODEL", "pattern": None, "partial": None, "allowed": None, "spec": None, "ambiguous": False, "model": None}
        if self._peek() == "(":
            opened = self._take("(")
            self._skip()
            if self._ahead("#PCDATA"):
                self._take("#PCDATA")
                allowed = []
                while True:
                    self._skip()
                    if self._peek() != "|":
                        break
                    self._take("|")
                    self._skip()
                    allowed.append(self._name("of an element"))
                if self._take(")") is not opened:
                    raise XmlError("BOUNDARY", "a group ends in another entity than it begins in")
                f = self.frames[-1]
                star = f.text.startswith("*", f.pos)
                if star:
                    f.pos += 1
                elif allowed:
                    raise XmlError("DTD", "expected * after mixed content with elements")
                row.update(mixed=True, content="MIXED", allowed=allowed, spec="(" + "|".join(["#PCDATA", *allowed]) + ")" + ("*" if star or allowed else ""))
            else:
                model = self._group(opened)
                row.update(pattern=image_pattern(model), partial=partial_pattern(model), allowed=sorted(set(names(model))), spec=write(model), ambiguous=ambiguous(model), model=model)
        else:
            word = self._name("ANY or EMPTY")
            if word not in ("ANY", "EMPTY"):
                raise XmlError("DTD", "expected ANY, EMPTY or a group")
            row.update(content=word, spec=word)
        self.dtd.elements.append(row)
        self._add("#elemDecl", name=name)

    def _group(self, opened: _Frame) -> Particle:
        """A group whose ( has been read."""
        members, mark = [], ""
        while True:
            self._skip()
            if self._peek() == "(":
                members.append(self._group(self._take("(")))
            else:
                name = self._name("of an element or a group")
                members.append(Particle("ELEMENT", name, self._qualifier()))
            self._skip()
            c = self._peek()
            if c == ")":
                if self._take(")") is not opened:
                    raise XmlError("BOUNDARY", "a group ends in another entity than it begins in")
                return Particle("CHOICE" if mark == "|" else "SEQUENCE", "", self._qualifier(), tuple(members))
            if c not in ("|", ",") or (mark and c != mark):
                raise XmlError("DTD", f"expected {mark or '| or ,'} or )")
            mark = c
            self._take(c)

    def _qualifier(self) -> str:
        f = self.frames[-1]
        c = f.text[f.pos : f.pos + 1]
        if c and c in "?*+":
            f.pos += 1
            return c
        return ""

    def _attlist_decl(self) -> None:
        self._space("after <!ATTLIST")
        element = self._name("of an element")
        inner = []
        while True:
            spaced = self._skip()
            if self._peek() == ">":
                break
            if not spaced:
                raise XmlError("DTD", "expected white space or >")
            name = self._name("of an attribute")
            self._space("after the attribute's name")
            choices = None
            if self._peek() == "(":
                kind, choices = "ENUMERATION", self._choices(self.name_char)
            else:
                kind = self._name("of an attribute type")
                if kind not in ("CDATA", "ID", "IDREF", "IDREFS", "ENTITY", "ENTITIES", "NMTOKEN", "NMTOKENS", "NOTATION"):
                    raise XmlError("DTD", f"{kind} is no attribute type")
                if kind == "NOTATION":
                    self._space("after NOTATION")
                    if self._peek() != "(":
                        raise XmlError("DTD", "expected ( after NOTATION")
                    choices = self._choices(self.name)
            self._space("after the attribute's type")
            row = {"decl_ord": self.dtd.next(), "element": element, "name": name, "type": kind, "enumeration": choices, "default_value": None, "fixed": False, "required": False}
            if self._ahead("#REQUIRED"):
                self._take("#REQUIRED")
                row["required"] = True
            elif self._ahead("#IMPLIED"):
                self._take("#IMPLIED")
            else:
                if self._ahead("#FIXED"):
                    self._take("#FIXED")
                    self._space("after #FIXED")
                    row["fixed"] = True
                raw, _ = self._literal("a default value")
                row["default_value"] = self._value(raw, kind in TOKENIZED)
            self.dtd.attdefs.append(row)
            inner.append(name)
        self._add("#attlistDecl", name=element, inner=tuple(inner))

    def _choices(self, pattern: re.Pattern) -> list[str]:
        opened, out = self._take("("), []
        while True:
            self._skip()
            out.append(self._name("of a choice", pattern))
            self._skip()
            if self._peek() == ")":
                if self._take(")") is not opened:
                    raise XmlError("BOUNDARY", "a group ends in another entity than it begins in")
                return out
            self._take("|")

    def _entity_decl(self) -> None:
        self._space("after <!ENTITY")
        parameter = False
        f = self.frames[-1]
        if self._peek() == "%" and (f := self.frames[-1]).text[f.pos + 1 : f.pos + 2] in tuple(S):
            f.pos += 1
            self._space("after %")
            parameter = True
        elif self._peek() == "%" and not self._outer():
            raise XmlError("PE_IN_DECL", "parameter references may stand only between declarations here")
        name = self._name("of an entity")
        self._space("after the entity's name")
        row = {"decl_ord": self.dtd.next(), "name": name, "type": "PARAMETER" if parameter else "GENERAL", "value": None, "public_id": None, "system_id": None, "path": None, "notation_name": None, "external_origin": self._outer(), "base": self.frames[-1].path or self.path}
        if self._peek() in ("'", '"'):
            raw, _ = self._literal("an entity's value")
            row["value"] = self._entity_value(raw, list(self.frames))
        else:
            row["public_id"], row["system_id"] = self._external_id(False)
            row["path"] = self._resolve(next((x.path for x in reversed(self.frames) if x.path), self.path), row["system_id"])
            spaced = self._skip()
            if self._ahead("NDATA"):
                if parameter or not spaced:
                    raise XmlError("DTD", "NDATA may stand only after white space and in general entities")
                self._take("NDATA")
                self._space("after NDATA")
                row.update(notation_name=self._name("of a notation"), type="UNPARSED")
        self.dtd.entities.append(row)
        (self.dtd.parameter if parameter else self.dtd.general).setdefault(name, row)
        self._add("#entityDecl", name=name)

    def _entity_value(self, raw: str, active: list[_Frame]) -> str:
        """Character and parameter references are replaced, general references stay."""
        out, at = [], 0
        for m in re.compile("[&%]").finditer(raw):
            if m.start() < at:
                continue
            out.append(raw[at : m.start()])
            if m[0] == "&":
                r = _REFERENCE.match(raw, m.start())
                if not r or (r[3] is not None and not self.name.fullmatch(r[3])):
                    raise XmlError("REFERENCE", "expected a reference after & in an entity's value")
                out.append(r[0] if r[3] is not None else self._char(r[1], r[2]))
                at = r.end()
            else:
                r = self.name.match(raw, m.start() + 1)
                if not r or raw[r.end() : r.end() + 1] != ";":
                    raise XmlError("REFERENCE", "expected a parameter reference after % in an entity's value")
                entity = self.dtd.parameter.get(r[0])
                if entity is None:
                    raise XmlError("ENTITY_DECLARED", f"the parameter entity {r[0]} is not declared")
                frame = self._enter(entity, active)
                out.append(self._entity_value(frame.text, [*active, frame]))
                at = r.end() + 1
        out.append(raw[at:])
        return "".join(out)

    def _notation_decl(self) -> None:
        self._space("after <!NOTATION")
        name = self._name("of a notation")
        self._space("after the notation's name")
        public, system = self._external_id(True)
        self.dtd.notations.append({"decl_ord": self.dtd.next(), "name": name, "public_id": public, "system_id": system})
        self._add("#notationDecl", name=name)
