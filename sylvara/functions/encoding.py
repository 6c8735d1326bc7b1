"""Encodings: labels, sniffing, decoding, newline normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by family, upper case and stripped of all but letters and digits, and the codec of each.
_LABELS = {
    "ascii": "ANSIX341968 ANSIX341986 ASCII CP367 CSASCII IBM367 ISO646IRV1991 ISO646US ISOIR6 US USASCII",
    "iso8859_1": "CP819 CSISOLATIN1 IBM819 ISO88591 ISOIR100 L1 LATIN1",
    "iso8859_2": "CSISOLATIN2 ISO88592 ISOIR101 L2 LATIN2",
    "iso8859_3": "CSISOLATIN3 ISO88593 ISOIR109 L3 LATIN3",
    "iso8859_4": "CSISOLATIN4 ISO88594 ISOIR110 L4 LATIN4",
    "iso8859_5": "CSISOLATINCYRILLIC CYRILLIC ISO88595 ISOIR144",
    "iso8859_6": "ARABIC ARABIC8 ASMO708 CSISOLATINARABIC ECMA114 ISO88596 ISOIR127",
    "iso8859_7": "CSISOLATINGREEK ECMA118 ELOT928 GREEK GREEK8 ISO88597 ISOIR126",
    "iso8859_8": "CSISOLATINHEBREW HEBREW HEBREW8 ISO88598 ISOIR138",
    "iso8859_9": "CSISOLATIN5 ISO88599 ISOIR148 L5 LATIN5 TURKISH TURKISH8",
    "iso8859_10": "CSISOLATIN6 ISO885910 ISO8859101992 ISOIR157 L6 LATIN6",
    "iso8859_11": "CSTIS620 ISO885911 THAI THAI8 TIS620 TIS62025291 TIS62025330",
    "iso8859_13": "CSISO885913 ISO885913",
    "iso8859_14": "CELTIC CELTIC8 CSISO885914 ISO885914 ISO8859141998 ISOCELTIC ISOIR199 L8 LATIN8",
    "iso8859_15": "CSISO885915 ISO885915 LATIN9",
    "iso8859_16": "CSISO885916 ISO885916 ISO8859162001 ISOIR226 L10 LATIN10",
    **{f"cp125{n}": f"CP125{n} CSWINDOWS125{n} WINDOWS125{n}" for n in range(9)},
    "shift_jisx0213": "CSSHIFTJIS MSKANJI SHIFTJIS",
    "utf_8": "CSUTF8 UTF8",
    "utf_16": "CSUTF16 UTF16",
    "utf_16_be": "CSUTF16BE UTF16BE",
    "utf_16_le": "CSUTF16LE UTF16LE",
    "ucs_2": "CSUNICODE ISO10646UCS2 UCS2",
    "utf_32": "CSUCS4 CSUTF32 ISO10646UCS4 UCS4 UTF32",
    "utf_32_be": "CSUTF32BE UTF32BE",
    "utf_32_le": "CSUTF32LE UTF32LE",
}
#: Codec of each label.
ENCODINGS = {label: codec for codec, labels in _LABELS.items() for label in labels.split()}
# Byte order marks, then what "<" and "<?" look like; the flipped orders swap bytes in pairs.
BOMS = (("0000FEFF", "UTF32BE"), ("FFFE0000", "UTF32LE"), ("0000FFFE", "UTF32BE_FLIPPED"), ("FEFF0000", "UTF32LE_FLIPPED"), ("FEFF", "UTF16BE"), ("FFFE", "UTF16LE"), ("EFBBBF", "UTF8"))
SIGNALS = (("0000003C", "UTF32BE"), ("3C000000", "UTF32LE"), ("00003C00", "UTF32BE_FLIPPED"), ("003C0000", "UTF32LE_FLIPPED"), ("003C003F", "UTF16BE"), ("3C003F00", "UTF16LE"))


class DecodeProblem(ValueError):
    pass


def encoding_key(column: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(column), "[^A-Z0-9]", "")


def sniff(content: Column, swapped_utf16: bool = False) -> Column:
    """Encoding that the first bytes show: a byte order mark, else "<" or "<?", else UTF-8.

    swapped_utf16 names the two UTF-16 marks the other way round."""
    head = F.hex(F.substring(content, 1, 4))
    swap = {"UTF16BE": "UTF16LE", "UTF16LE": "UTF16BE"} if swapped_utf16 else {}
    out = None
    for marks, names in ((BOMS, swap), (SIGNALS, {})):
        for mark, name in marks:
            test = F.startswith(head, F.lit(mark))
            out = F.when(test, names.get(name, name)) if out is None else out.when(test, names.get(name, name))
    return out.otherwise("UTF8")


def bom_length(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for mark, _ in BOMS:
        test = F.startswith(head, F.lit(mark))
        out = F.when(test, len(mark) // 2) if out is None else out.when(test, len(mark) // 2)
    return out.otherwise(0)


def normalise_newlines(column: Column) -> Column:
    return F.regexp_replace(column, "\r\n?", "\n")


def declared_encoding(head: Column) -> Column:
    """The encoding that an XML or text declaration at the very start names, else null."""
    found = F.regexp_extract(head, "^<\\?xml[ \\t\\r\\n][^>]*?encoding[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']", 1)
    return F.nullif(found, F.lit(""))


_DECLARED = re.compile(r"<\?xml[ \t\r\n][^>]*?encoding[ \t\r\n]*=[ \t\r\n]*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']")


def _sniff(data: bytes, swapped_utf16: bool) -> tuple[str, int, bool]:
    """(encoding, bytes of its mark, whether anything was found)."""
    head = data[:4].hex().upper()
    for marks in (BOMS, SIGNALS):
        for mark, name in marks:
            if head.startswith(mark):
                if marks is BOMS:
                    if swapped_utf16 and name.startswith("UTF16"):
                        name = "UTF16LE" if name == "UTF16BE" else "UTF16BE"
                    return name, len(mark) // 2, True
                return name, 0, True
    return "UTF8", 0, False


def _unflip(data: bytes) -> bytes:
    out = bytearray(len(data))
    out[0::2], out[1::2] = data[1::2], data[0::2]
    return bytes(out)


def _codec(label: str) -> str:
    codec = ENCODINGS.get(re.sub("[^A-Z0-9]", "", label.upper()))
    if codec is None:
        raise DecodeProblem(f"the encoding {label} is not known")
    return codec


def _family(codec: str) -> str:
    if codec.startswith(("utf_16", "ucs_2")):
        return "16"
    if codec.startswith("utf_32"):
        return "32"
    return "utf8" if codec == "utf_8" else "bytes"


def decode_bytes(data: bytes, encoding: str | None = None, swapped_utf16: bool = False) -> tuple[str, str]:
    """(text, codec): sniffed, switched to the given and then to the declared encoding, newlines normalised.

    DecodeProblem if bytes are malformed, a label is unknown or a switch is impossible: to another unit
    width, another byte order, another code page, or from a byte order mark to a code page."""
    found, skip, seen = _sniff(data, swapped_utf16)
    flipped = found.endswith("_FLIPPED")
    codec = ENCODINGS[found.removesuffix("_FLIPPED")]
    ucs = False
    given = False

    def switch(label: str) -> None:
        nonlocal codec, ucs, given
        new = _codec(label)
        kind, old = _family(new), _family(codec)
        clash = f"the encoding {label} contradicts {codec}"
        if kind != old and (("16" in (kind, old) or "32" in (kind, old)) and (seen or given)):
            raise DecodeProblem(clash)
        if kind == "bytes" and (skip or (given and old == "bytes" and new != codec)):
            raise DecodeProblem(clash)
        if new.endswith(("_be", "_le")) and codec.endswith(("_be", "_le")) and kind == old and new != codec:
            raise DecodeProblem(clash)
        ucs = ucs or new == "ucs_2"
        if kind in ("16", "32") and not new.endswith(("_be", "_le")):
            new = codec if kind == old and codec.endswith(("_be", "_le")) else f"utf_{kind}_be"
        codec, given = new, True

    if encoding:
        switch(encoding)
    body = data[skip:]
    if flipped:
        body = _unflip(body + b"\0" * (len(body) % 2))

    def text_of() -> str:
        try:
            text = body.decode(codec)
        except UnicodeDecodeError as problem:
            what = "ended abruptly" if problem.end >= len(body) and "truncated" in problem.reason or "unexpected end" in problem.reason else f"malformed byte 0x{body[problem.start]:02X} at {problem.start + skip}"
            raise DecodeProblem(f"input in {codec}: {what}") from None
        if ucs and any(ord(c) > 0xFFFF for c in text):
            raise DecodeProblem("input in ucs_2: surrogates are not allowed")
        return text

    head = _DECLARED.match(body[:400].decode("latin-1") if _family(codec) not in ("16", "32") else body[:1600].decode(codec, "ignore"))
    if head and _codec(head[1]) != codec:
        plain = body[: head.end()].isascii()
        if not plain and _family(_codec(head[1])) == "bytes" and _family(codec) == "utf8":
            raise DecodeProblem(f"the encoding {head[1]} contradicts {codec}")
        switch(head[1])
    return re.sub("\r\n?", "\n", text_of()), codec


PIECE_ROWS, PIECE_BYTES = 500, 1 << 20  # rows that are decoded together; one of more bytes is decoded alone


def _pieces(data: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and number of rows of each piece of a batch."""
    begin = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(data), 0).to_pylist()):
        if at > begin and (at - begin >= PIECE_ROWS or held + size > PIECE_BYTES):
            yield begin, at - begin
            begin, held = at, 0
        held += size
    if len(data) > begin:
        yield begin, len(data) - begin


def decode_content(content: Column, encoding: Column | str | None = None, swapped_utf16: bool = False) -> Column:
    """struct(text, encoding, problem) of a binary column; the JVM cannot decode most of these encodings."""

    @F.arrow_udf("text string, encoding string, problem string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for at, n in _pieces(whole[0]):
                rows: list[tuple[str | None, str | None, str | None]] = []
                for raw, name in zip(*(c.slice(at, n).to_pylist() for c in whole), strict=True):
                    if raw is None:
                        rows.append((None, None, "no content"))
                        continue
                    try:
                        rows.append((*decode_bytes(raw, name or None, swapped_utf16), None))
                    except DecodeProblem as problem:
                        rows.append((None, None, str(problem)))
                yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["text", "encoding", "problem"])

    label = encoding if isinstance(encoding, Column) else F.lit(encoding).cast("string")
    return run(content, label)
