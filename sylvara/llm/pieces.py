"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text is normalised as the model says, cut where no piece of the vocabulary can join the two sides,
and each part is merged by a score-ordered agenda of adjacent symbol pairs: the pair of best score, the
leftmost among equals, is merged until none is left.  Short parts share one agenda table, a row per
part, which is merged row-wise; long parts have a heap each.  Symbols that are no piece fall back to
bytes.  In every Arrow batch the ids of each part that was not met before are held against the
sentencepiece library; as no merge crosses a cut, that checks the whole texts.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy_batches
from .pool import Pool

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SHORT = 24


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in fields if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models with identity normalisation that keep white space are supported")
        self.prefix = bool(normal.get(3, 1))
        pieces, self.byte_ids, self.unknown = {}, {}, 0
        score: list[float] = []
        for i, raw in enumerate(v for k, v in fields if k == 1):
            one = dict(_fields(raw))
            text, kind = one.get(1, b"").decode(), one.get(3, NORMAL)
            score.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            if kind in (NORMAL, USER, UNUSED):
                pieces[text] = i
            if kind in (USER, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
            if kind == UNKNOWN:
                self.unknown = i
        self.pieces, self.score = pieces, score
        # Symbols: the pieces, then characters that are only part of pieces.
        self.symbol = dict(pieces)
        count = len(score)
        for text in pieces:
            for c in text:
                if c not in self.symbol:
                    self.symbol[c] = count
                    count += 1
        self.count = count + 1  # the last is any other character
        ranks = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        pairs = []
        for text, i in pieces.items():
            for k in range(1, len(text)):
                a, b = self.symbol.get(text[:k]), self.symbol.get(text[k:])
                if a is not None and b is not None:
                    pairs.append((a * self.count + b, i, ranks[score[i]]))
        pairs.sort()
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.keys, self.merged, self.rank = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.pair = {k: (r, m) for k, m, r in pairs}
        joining = sorted({c for text in pieces if len(text) > 1 for c in text} - {SPACE})
        inside = any(re.search(f"[^{SPACE}]{SPACE}", text) for text in pieces)
        some = "[" + "".join(map(re.escape, joining)) + "]"
        self.guard = next(c for c in "\n\0\x01" if c not in joining)  # joins nothing
        self.part = re.compile(f"(?:{SPACE}|{some})+|." if inside else f"{SPACE}+{some}*|{some}+|.", re.S)

    def normalise(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.prefix else text

    def _finish(self, symbol: int, char: str) -> list[int]:
        """Ids of a symbol that is left over; char matters if it is no piece."""
        if symbol < len(self.score):
            return [symbol]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode()]

    def merge_heap(self, text: str) -> list[int]:
        """Ids of one part by an agenda kept in a heap; any length."""
        other, n = self.count - 1, len(text)
        symbols = [self.symbol.get(c, other) for c in text]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def propose(i: int, j: int) -> None:
            found = self.pair.get(symbols[i] * self.count + symbols[j])
            if found:
                heapq.heappush(agenda, (found[0], i, symbols[i], j, symbols[j], found[1]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, left, j, right, whole = heapq.heappop(agenda)
            if symbols[i] != left or symbols[j] != right or after[i] != j:
                continue  # an end of the pair has been merged since
            symbols[i], symbols[j] = whole, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                propose(i, after[j])
            if before[i] >= 0:
                propose(before[i], i)
        return [x for s, c in zip(symbols, text, strict=True) if s >= 0 for x in self._finish(s, c)]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], 1 << 40), np.where(hit, self.merged[at], -1)

    def _merge_rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of parts of equal length, -1 where merged away."""
        n, wide = len(texts), len(texts[0])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        chars, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.symbol.get(chr(c), self.count - 1) for c in chars.tolist()], np.int64)
        symbols = known[inverse].reshape(n, wide)
        if wide > 1:
            rank = np.full((n, wide), 1 << 40, np.int64)
            whole = np.full((n, wide), -1, np.int64)
            rank[:, :-1], whole[:, :-1] = self._look(symbols[:, :-1], symbols[:, 1:])
            after = np.tile(np.arange(1, wide + 1), (n, 1))
            before = np.tile(np.arange(-1, wide - 1), (n, 1))
            rows = np.arange(n)
            while True:
                best = rank[rows].argmin(1)
                live = rank[rows, best] < 1 << 40
                rows, i = rows[live], best[live]
                if not len(rows):
                    break
                j = after[rows, i]
                symbols[rows, i] = whole[rows, i]
                symbols[rows, j] = -1
                rank[rows, j] = 1 << 40
                k = after[rows, i] = after[rows, j]
                inner = k < wide
                before[rows[inner], k[inner]] = i[inner]
                right = np.where(inner, symbols[rows, np.minimum(k, wide - 1)], -1)
                rank[rows, i], whole[rows, i] = self._look(symbols[rows, i], right)
                h = before[rows, i]
                some = h >= 0
                r, h, i = rows[some], h[some], i[some]
                rank[r, h], whole[r, h] = self._look(symbols[r, h], symbols[r, i])
        return symbols, points.reshape(n, wide)

    def merge_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        out: list = [None] * len(parts)
        by = np.argsort(size, kind="stable")
        cut = np.searchsorted(size[by], np.arange(1, _SHORT + 2))
        for k in range(_SHORT):
            for lo in range(cut[k], cut[k + 1], 20_000):
                mine = by[lo : min(lo + 20_000, cut[k + 1])]
                symbols, points = self._merge_rows([parts[i] for i in mine.tolist()])
                odd = (symbols >= len(self.score)).any(1).tolist()
                keep = symbols >= 0
                flat, ends = symbols[keep], np.cumsum(keep.sum(1)).tolist()
                at = 0
                for row, (i, end) in enumerate(zip(mine.tolist(), ends, strict=True)):
                    out[i] = flat[at:end] if not odd[row] else np.array([x for s, c in zip(symbols[row].tolist(), points[row].tolist(), strict=True) if s >= 0 for x in self._finish(s, chr(c))], np.int64)
                    at = end
        for i in by[cut[_SHORT] :].tolist():
            out[i] = np.array(self.merge_heap(parts[i]), np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.fromiter(map(len, out), np.int64, len(out))


class Encoder:
    """Encodes texts; parts that were met before are looked up."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000, library=None) -> None:
        self.vocabulary, self.library, self.pool = vocabulary, library, Pool(self._merge, limit)

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.vocabulary.merge_many(parts)
        if self.library is not None:
            guard = self.vocabulary.guard
            skip = len(self.library.encode(guard))
            known = [x[skip:] for x in self.library.encode([guard + part for part in parts], num_threads=1)]
            if [len(x) for x in known] != sizes.tolist() or [i for x in known for i in x] != ids.tolist():
                raise ValueError("ids differ from the library's")
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end and n+1 offsets."""
        parts, ends = [], [0]
        find, normalise = self.vocabulary.part.findall, self.vocabulary.normalise
        for text in texts:
            parts += find(normalise(text))
            ends.append(len(parts))
        ids, sizes = self.pool.lookup(parts)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[ends]


_open: dict = {}


def _models(path: str, check: str):
    """The encoder and the library's processor of a model, kept while the Python worker lives."""
    if (path, check) not in _open:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        _open[path, check] = (Encoder(Vocabulary(path), library=library if check == "parts" else None), library)
    return _open[path, check]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_column(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = (), check: str = "parts") -> DataFrame:
    """(id_col, carry..., ids array<int>, decoded string) of every row.

    Null and empty text has no ids and decodes to the empty string.  With check="parts" the library encodes each
    part of a batch that is new to the worker, with "texts" every text; a difference is an error.  Rows may repeat; an empty table gives no rows; the model
    must be readable at ``model_path`` on every executor.
    """
    names = [id_col, *carry]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = _models(model_path, check)
        for batch in batches:
            for part in slices(batch, len(names)):
                texts = [x or "" for x in part.column(len(names)).to_pylist()]
                ids, cut = encoder.encode(texts)
                lists = [x.tolist() for x in np.split(ids, cut[1:-1])] if texts else []
                if check == "texts" and lists != library.encode(texts, num_threads=1):
                    bad = next(k for k, x in enumerate(texts) if lists[k] != library.encode(x))
                    raise ValueError(f"ids differ from the library's for a text that begins {texts[bad][:40]!r}")
                decoded = library.decode(lists, num_threads=1)
                yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], F.col(text_col).cast("string").alias("t")).mapInArrow(tidy_batches(work), schema)
