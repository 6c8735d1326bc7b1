"""String helpers of the writers and validators, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import all_chars, is_name, is_nmtoken

__all__ = ["all_chars", "char_refs", "collapse_ws", "compare_key", "escape_attr", "escape_cdata", "ext_id", "indent", "is_name", "is_nmtoken", "is_public_id", "is_xml_string", "no_double_hyphen", "no_question_end", "no_section_end", "not_xml", "one_quote_only", "quote", "ref_out", "wrap"]


def _put(column: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape_cdata(column: Column) -> Column:
    return _put(column, ("&", "&amp;"), ("<", "&lt;"), ("]]>", "]]&gt;"))


def escape_attr(column: Column, single: bool = False) -> Column:
    """Attribute value between the given quotes: white space other than blanks as character references."""
    quotes = ("'", "&apos;") if single else ('"', "&quot;")
    return _put(column, ("&", "&amp;"), ("<", "&lt;"), quotes, ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))


def quote(column: Column, prefer_single: bool = False, may_escape: bool = False) -> Column:
    """Quoted text: with may_escape the preferred quotes and references within, else whichever quotes do not occur."""
    first, other = ("'", '"') if prefer_single else ('"', "'")
    name = "&apos;" if prefer_single else "&quot;"
    if may_escape:
        return F.concat(F.lit(first), _put(column, (first, name)), F.lit(first))
    return F.when(F.contains(column, F.lit(first)), F.concat(F.lit(other), column, F.lit(other))).otherwise(F.concat(F.lit(first), column, F.lit(first)))


def ext_id(public_id: Column, system_id: Column, prefer_single: bool = False) -> Column:
    """PUBLIC "p" "s" or SYSTEM "s"; empty and null parts are left out."""
    public = F.when(public_id != "", quote(public_id, prefer_single))
    system = F.when(system_id != "", quote(system_id, prefer_single))
    return F.concat_ws(" ", F.when(public.isNotNull(), "PUBLIC").otherwise("SYSTEM"), public, system)


def indent(depth: Column, size: int = 2) -> Column:
    return F.repeat(F.lit(" "), depth * size)


def wrap(column: Column, width: int = 80, min_width: int = 30, depth: int = 0, size: int = 2, hanging: bool = False) -> Column:
    """Greedy word wrap of blank-separated words; a line holds its indentation too."""
    head, rest = " " * (depth * size), " " * ((depth + hanging) * size)

    def line_room(prefix: str) -> int:
        return max(min_width, width - len(prefix))

    words = F.split(column, " ")
    start = F.struct(F.lit("").alias("done"), F.concat(F.lit(head), words[0]).alias("line"), F.lit(line_room(head)).alias("room"))

    def step(state: Column, word: Column) -> Column:
        fits = F.length(state["line"]) + F.length(word) + 1 <= state["room"]
        return F.when(fits, F.struct(state["done"].alias("done"), F.concat(state["line"], F.lit(" "), word).alias("line"), state["room"].alias("room"))).otherwise(
            F.struct(F.concat(state["done"], state["line"], F.lit("\n")).alias("done"), F.concat(F.lit(rest), word).alias("line"), F.lit(line_room(rest)).alias("room"))
        )

    return F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), start, step, lambda s: F.concat(s["done"], s["line"]))


def compare_key(column: Column) -> Column:
    """Sort key of the alphabetical order of attributes: by the root Unicode collation."""
    return F.collate(column, "UNICODE")


def is_public_id(column: Column) -> Column:
    return all_chars(column, "public_id_char_dbl")


def is_xml_string(column: Column) -> Column:
    return all_chars(column, "xml_char")


def no_double_hyphen(column: Column) -> Column:
    return ~F.contains(column, F.lit("--"))


def no_question_end(column: Column) -> Column:
    return ~F.contains(column, F.lit("?>"))


def no_section_end(column: Column) -> Column:
    return ~F.contains(column, F.lit("]]>"))


def not_xml(column: Column) -> Column:
    return F.lower(column) != "xml"


def one_quote_only(column: Column) -> Column:
    return ~(F.contains(column, F.lit("'")) & F.contains(column, F.lit('"')))


def ref_out(column: Column) -> Column:
    """Entity text as it may stand in a declaration: < % ' " and the & of character references as references."""
    return _put(column, ("&#", "&#x26;#"), ("<", "&#x3c;"), ("%", "&#x25;"), ("'", "&#x27;"), ('"', "&#x22;"))


def collapse_ws(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def char_refs(column: Column) -> Column:
    """The character of a single reference like &#10; or &#xA;; null for anything else or an illegal character."""
    decimal = F.regexp_extract(column, r"^&#([0-9]{1,9});$", 1)
    hexa = F.regexp_extract(column, r"^&#x([0-9A-Fa-f]{1,8});$", 1)
    point = F.when(decimal != "", decimal.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
    legal = point.isin(9, 10, 13) | point.between(0x20, 0xD7FF) | point.between(0xE000, 0xFFFD) | point.between(0x10000, 0x10FFFF)
    return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
