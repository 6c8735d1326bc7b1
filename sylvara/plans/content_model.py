"""Content models: a parsed declaration becomes a regular expression over child names, first sets and checks.

The image of an element's children is " a b c": a blank before each name.  A model's pattern matches
whole images with Java's and Python's regular expressions alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Particle:
    """type is ELEMENT, SEQUENCE or CHOICE; qualifier is '', '?', '*' or '+'."""

    type: str
    name: str = ""
    qualifier: str = ""
    members: tuple[Particle, ...] = field(default=())


def pattern(p: Particle) -> str:
    if p.type == "ELEMENT":
        body = "(?: " + re.sub(r"([^\w\s])", r"\\\1", p.name) + "(?![^ ]))"
    else:
        body = "(?:" + ("|" if p.type == "CHOICE" else "").join(pattern(m) for m in p.members) + ")"
    return body + p.qualifier


def image_pattern(p: Particle) -> str:
    return f"^{pattern(p)}$"


def prefix(p: Particle) -> str:
    """What can still become a match of pattern(p)."""
    if p.type == "ELEMENT":
        body = pattern(Particle("ELEMENT", p.name)) + "?"
    elif p.type == "CHOICE":
        body = "(?:" + "|".join(prefix(m) for m in p.members) + ")"
    else:
        body = prefix(p.members[-1])
        for m in p.members[-2::-1]:
            body = f"(?:{prefix(m)}|{pattern(m)}{body})"
    if p.qualifier in ("*", "+"):
        body = pattern(Particle(p.type, p.name, "*", p.members)) + body
    return body


def partial_pattern(p: Particle) -> str:
    """Matches the images of which more children can make a match of image_pattern(p)."""
    return f"^{prefix(p)}$"


def nullable(p: Particle) -> bool:
    if p.qualifier in ("?", "*"):
        return True
    if p.type == "ELEMENT":
        return False
    return (any if p.type == "CHOICE" else all)(nullable(m) for m in p.members)


def first_names(p: Particle) -> list[str]:
    """Names that can come first, in order of their places; one name may stand twice."""
    if p.type == "ELEMENT":
        return [p.name]
    out: list[str] = []
    for m in p.members:
        out += first_names(m)
        if p.type == "SEQUENCE" and not nullable(m):
            break
    return out


def ambiguous(p: Particle) -> bool:
    """A choice whose members begin alike, or a sequence with a qualified member that begins like the next."""
    if p.type == "ELEMENT":
        return False
    if p.type == "CHOICE":
        first = first_names(p)
        clash = len(first) != len(set(first))
    else:
        clash = any(m.qualifier and set(first_names(m)) & set(first_names(n)) for m, n in zip(p.members, p.members[1:], strict=False))
    return clash or any(ambiguous(m) for m in p.members)


def write(p: Particle) -> str:
    if p.type == "ELEMENT":
        return p.name + p.qualifier
    return "(" + ("|" if p.type == "CHOICE" else ", ").join(write(m) for m in p.members) + ")" + p.qualifier


def names(p: Particle) -> list[str]:
    return [p.name] if p.type == "ELEMENT" else [n for m in p.members for n in names(m)]


def rows(p: Particle) -> list[tuple[int, int, int, str, str | None, str]]:
    """(id, parent, ord, type, name, qualifier) in preorder, the whole model first with parent -1."""
    out: list = []

    def walk(q: Particle, parent: int, place: int) -> None:
        own = len(out)
        out.append((own, parent, place, q.type, q.name or None, q.qualifier))
        for k, m in enumerate(q.members):
            walk(m, own, k)

    walk(p, -1, 0)
    return out


class Automaton:
    """Position automaton of a model: which prefixes of child names can still become a match."""

    def __init__(self, p: Particle) -> None:
        self.symbols: list[str] = []
        self.after: list[set[int]] = []
        first, self.last, self.empty = self._build(p)
        self.start = first

    def _build(self, p: Particle) -> tuple[set[int], set[int], bool]:
        if p.type == "ELEMENT":
            here = len(self.symbols)
            self.symbols.append(p.name)
            self.after.append(set())
            first, last, empty = {here}, {here}, False
        elif p.type == "CHOICE":
            first, last, empty = set(), set(), False
            for m in p.members:
                f, e, n = self._build(m)
                first |= f
                last |= e
                empty |= n
        else:
            first, last, empty = set(), set(), True
            for m in p.members:
                f, e, n = self._build(m)
                for i in last:
                    self.after[i] |= f
                first |= f if empty else set()
                last = last | e if n else e
                empty &= n
        if p.qualifier in ("*", "+"):
            for i in last:
                self.after[i] |= first
        return first, last, empty or p.qualifier in ("?", "*")

    def first_bad(self, children: list[str]) -> int | None:
        """Place of the first child that no match can have there; len(children) if only more is missing; None if all fits."""
        now, at_end = set(self.start), self.empty
        for k, name in enumerate(children):
            hit = {i for i in now if self.symbols[i] == name}
            if not hit:
                return k
            now = set().union(*(self.after[i] for i in hit))
            at_end = bool(hit & self.last)
        return None if at_end else len(children)
