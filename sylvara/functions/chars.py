"""Character classes of XML 1.0 as regular-expression classes and Column predicates.

The name classes are those up to the fourth edition, which the standard library's XML parser
implements; their ranges are read off that parser, so no table is kept here.  ``names="5e"`` gives the
wider classes of the fifth edition.
"""

from __future__ import annotations

from functools import lru_cache
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

# Production 4 and 4a of XML 1.0, fifth edition.
_START_5E = ((0x3A, 0x3A), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF))
_MORE_5E = ((0x2D, 0x2E), (0x30, 0x39), (0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040))


def _parses(document: str) -> bool:
    try:
        expat.ParserCreate("utf-8").Parse(document.encode(), True)
    except expat.ExpatError:
        return False
    return True


def _ranges(points) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((a, b) for a, b in out)


@lru_cache(maxsize=4)
def name_ranges(names: str = "4e") -> tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]:
    """(start ranges, continue ranges) of code points in names."""
    if names == "5e":
        both = sorted(_START_5E + _MORE_5E)
        return _START_5E, tuple(both)
    if names != "4e":
        raise ValueError("names must be '4e' or '5e'")
    low = [p for p in range(0x21, 0x10000) if not 0xD800 <= p < 0xE000]
    inner = [p for p in low if _parses(f"<a{chr(p)}/>") and chr(p) != "/"]
    start = [p for p in inner if _parses(f"<{chr(p)}/>")]
    return _ranges(start), _ranges(inner)


def _class_body(ranges, java: bool) -> str:
    def one(p: int) -> str:
        if java:
            return f"\\x{{{p:X}}}"
        return f"\\U{p:08x}"

    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in ranges)


@lru_cache(maxsize=8)
def name_classes(names: str = "4e", java: bool = True) -> tuple[str, str]:
    """Bodies of the character classes of name starts and name characters, for Java or Python."""
    start, inner = name_ranges(names)
    return _class_body(start, java), _class_body(inner, java)


_X = r"\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
#: Java class of each single-character predicate.
CLASSES: dict[str, str] = {
    "xml_char": f"[{_X}]",
    "whitespace_char": r"[\t\n\r ]",
    "cdata_char": rf"[{_X}&&[^&<\]]]",
    "cdata_section_char": rf"[{_X}&&[^\]]]",
    "comment_char": rf"[{_X}&&[^-]]",
    "proc_inst_value_char": rf"[{_X}&&[^?]]",
    "att_value_char_dbl": rf'[{_X}&&[^&<"]]',
    "att_value_char_sng": rf"[{_X}&&[^&<']]",
    "public_id_char_dbl": r"[\n\r !#-%'-;=?-Z_a-z]",
    "public_id_char_sng": r"[\n\r !#-%(-;=?-Z_a-z]",
    "system_id_char_dbl": rf'[{_X}&&[^"]]',
    "system_id_char_sng": rf"[{_X}&&[^']]",
    "dec_char": "[0-9]",
    "hex_char": "[0-9A-Fa-f]",
    "enc_start_char": "[A-Za-z]",
    "enc_continue_char": "[A-Za-z0-9._-]",
}


def char_class(name: str, names: str = "4e") -> str:
    """Java regular expression of one character of the class; also name_start_char and name_continue_char."""
    if name == "name_start_char":
        return f"[{name_classes(names)[0]}]"
    if name == "name_continue_char":
        return f"[{name_classes(names)[1]}]"
    return CLASSES[name]


def is_char(column: Column, name: str, names: str = "4e") -> Column:
    """Whether the text is exactly one character of the class."""
    return column.rlike(f"^{char_class(name, names)}\\z")


def all_chars(column: Column, name: str, names: str = "4e") -> Column:
    """Whether every character of the text is of the class; true of empty text."""
    return column.rlike(f"^{char_class(name, names)}*+\\z")


def is_name(column: Column, names: str = "4e") -> Column:
    start, inner = name_classes(names)
    return column.rlike(f"^[{start}][{inner}]*+\\z")


def is_nmtoken(column: Column, names: str = "4e") -> Column:
    """One or more name characters."""
    return column.rlike(f"^[{name_classes(names)[1]}]++\\z")
