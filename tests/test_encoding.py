import pyarrow as pa
import pytest

from sylvara.functions import encoding
from sylvara.functions.encoding import ENCODINGS, DecodeProblem, decode_bytes

GOOD = [
    ([0x61, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82], None, "aé€🙂"),
    (list("﻿<a/>".encode("utf-16-le")), None, "<a/>"), (list("﻿<a/>".encode("utf-16-be")), None, "<a/>"), (list("<?x 🙂?><a/>".encode("utf-16-le")), None, "<?x 🙂?><a/>"), (list("<?x?><a/>".encode("utf-16-be")), "utf-16", "<?x?><a/>"),
    (list("﻿<🙂".encode("utf-32-le")), None, "<🙂"), (list("<a/>".encode("utf-32-be")), None, "<a/>"), ([0, 0, 0x3C, 0, 0, 0, 0x61, 0], None, "<a"), ([0xFE, 0xFF, 0, 0, 0, 0x3C, 0, 0], None, "<"),
    (list("<?xml encoding='windows-1251' version='1.0'?>яж".encode("cp1251")), None, "<?xml encoding='windows-1251' version='1.0'?>яж"), (list("ก".encode("iso8859_11")), "TIS-620", "ก"), (list("é".encode("latin-1")), "ISO_8859-1", "é"),
    ([0x83, 0x65, 0xB1, 0x5C, 0x0A], "shift_jis", "テｱ¥\n"), ([0xEF, 0xBB, 0xBF, 0x61], None, "a"), ([0x61, 0x0D, 0x0A, 0x62, 0x0D, 0x63, 0x0A, 0x0D], None, "a\nb\nc\n\n"), ([], None, ""), ([0x61], None, "a"),
]
BAD = [
    ([0xC3, 0x28], None), ([0xC0, 0xAF], None), ([0xF0, 0x9F, 0x99], None), ([0xED, 0xA0, 0x80], None), ([0x80], "us-ascii"), (list("﻿a".encode("utf-16-le")) + [0], None), ([0xFE, 0xFF, 0xD8, 0x00, 0x00, 0x41], None), (list("﻿🙂".encode("utf-16-be")), "ucs-2"), (list(b"a"), "klingon"),
    (list("﻿a".encode("utf-16-le")), "utf-16be"), (list("﻿a".encode("utf-16-le")), "latin1"), (list("﻿a".encode("utf-8")), "latin1"), (list("﻿<?xml version='1.0' encoding='utf-8'?>".encode("utf-16-le")), None), (list(b"<?xml version='1.0' encoding='cp1251'?>"), "cp1250"), (list(b"<?xml version='1.0' encoding='none-such'?>"), None),
]


@pytest.mark.parametrize("data, label, want", GOOD, ids=range(len(GOOD)))
def test_decodes(data, label, want):
    assert decode_bytes(bytes(data), label)[0] == want


@pytest.mark.parametrize("data, label", BAD, ids=range(len(BAD)))
def test_rejects(data, label):
    with pytest.raises(DecodeProblem):
        decode_bytes(bytes(data), label)


def test_swapped_marks():
    assert decode_bytes("﻿<a/>".encode("utf-16-le"), swapped_utf16=True)[1] == "utf_16_be"


def test_labels():
    assert len(ENCODINGS) == 146
    for label, codec in ENCODINGS.items():
        text = "a" if codec != "utf_16" else "﻿a"
        python = {"utf_16": "utf-16-be", "ucs_2": "utf-16-be", "utf_32": "utf-32-be"}.get(codec, codec)
        assert decode_bytes(text.encode(python), label)[0] == "a", label


def test_pieces_of_a_batch_are_bounded():
    sizes = [10, 400_000, 0, 700_000, 3_000_000, *[1] * 1200]
    data = pa.array([None if k == 2 else b"x" * n for k, n in enumerate(sizes)], pa.binary())
    pieces = list(encoding._pieces(data))
    assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == len(sizes)
    assert all(n <= encoding.PIECE_ROWS and (n == 1 or sum(sizes[at : at + n]) <= encoding.PIECE_BYTES) for at, n in pieces)
