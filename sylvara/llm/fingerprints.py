"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (split at line feeds).  A paragraph becomes a wide vector:
EXACT lanes modulo 2**64 expanded from a keyed BLAKE2b digest of its bytes, and LIKE lanes modulo
2**32 that hold a count sketch of its word pairs.  A fingerprint is the sum of the vectors, so it does
not depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector.  The exact lanes tell multisets apart; the cosine of the like lanes estimates how much of
two multisets is shared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout, words

EXACT, LIKE = 8, 256
_STEP = 0x9E3779B97F4A7C15
RANGES = 4  # ranges of ids for each task


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed (exact, like) lanes of texts given as UTF-8 bytes and offsets."""
    n = len(offsets) - 1
    exact, like = np.zeros((n, EXACT), np.uint64), np.zeros((n, LIKE), np.int64)
    if not n:
        return exact, like
    lines = np.flatnonzero(data == 10) + 1
    # A text begins at each offset; a line feed that is a text's last byte begins one more, empty paragraph of that text.
    feeds = np.bincount(np.searchsorted(offsets, lines - 1, "right") - 1, minlength=n)
    of = np.repeat(np.arange(n), feeds + 1)
    first = np.concatenate(([0], np.cumsum(feeds + 1)))
    starts = np.empty(len(of), np.int64)
    starts[first[:-1]] = offsets[:-1]
    rest = np.ones(len(of), bool)
    rest[first[:-1]] = False
    starts[rest] = lines
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    raw = data.tobytes()
    digest = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    h = np.frombuffer(digest, "<u8").reshape(-1, 2)
    for k in range(EXACT):
        lane = words.mix(h[:, 0] + np.uint64(k * _STEP & (1 << 64) - 1)) ^ words.mix(h[:, 1] ^ words.mix(np.full(1, k + 1, np.uint64)))
        exact[:, k] = np.add.reduceat(lane, first[:-1])
    # starts may repeat for empty paragraphs, which hold no words.
    w, bounds = words.hash_words(data, np.concatenate((starts, [len(data)])))
    pairs = words.fixed_windows(bounds, 2)
    lone = bounds[:-1][np.diff(bounds) == 1]
    at = np.sort(np.concatenate((pairs, lone)))
    end = at + 2
    end[np.isin(at, lone, assume_unique=True)] -= 1
    text = of[np.searchsorted(bounds, at, "right") - 1]
    g = words.hash_windows(w, at, end)
    cell = (g % np.uint64(LIKE)).astype(np.int64)
    sign = ((g >> np.uint64(63)).astype(np.int64) * 2 - 1).astype(np.float64)
    like += np.bincount(text * LIKE + cell, weights=sign, minlength=n * LIKE).astype(np.int64).reshape(n, LIKE)
    return exact, like


def write(exact: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as base64 text."""
    body = np.concatenate((exact.astype("<u8").view(np.uint8), (like & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(len(like), -1)), axis=1) if len(exact) else np.zeros((0, 0), np.uint8)
    return [base64.b64encode(x.tobytes()).decode() for x in body]


def read(prints: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(b"".join(base64.b64decode(x) for x in prints), np.uint8).reshape(-1, 8 * EXACT + 4 * LIKE)
    return body[:, : 8 * EXACT].copy().view("<u8"), body[:, 8 * EXACT :].copy().view("<i4").astype(np.int64)


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return write(*vectors(data, np.array([0, len(data)])))[0]


def change(old: str, insert: Iterable[str] = (), delete: Iterable[str] = ()) -> str:
    """The fingerprint after some paragraphs were inserted or deleted."""
    exact, like = read([old])
    for sign, group in ((1, insert), (-1, delete)):
        for paragraph in group:
            data = np.frombuffer(paragraph.encode(), np.uint8)
            e, s = vectors(data, np.array([0, len(data)]))
            exact = exact + e if sign > 0 else exact - e
            like = like + sign * s
    return write(exact, like)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of the like lanes, row by row, held to 0..1; 1 for equal fingerprints, 0 if just one has no words."""
    x, y = (np.where(v[1] & (1 << 31), (v[1] & 0xFFFFFFFF) - (1 << 32), v[1] & 0xFFFFFFFF).astype(np.float64) for v in (a, b))
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a[0] == b[0]).all(1) & (x == y).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(p, o, id, t) sorted in each partition: within a value of p, each row's next document follows it; rows
    of o = 1 only serve as such.  Texts move once, by ranges of the id; the first text of a range also goes to the range before."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"))
    parts = layout.shuffle_partitions(spark)
    ranges = RANGES * parts  # several to a task, as they are dealt by a hash and meet at random
    cuts = ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def range_of(column: pa.Array) -> pa.Array:
        got = np.searchsorted(cuts, column.to_numpy(zero_copy_only=False), "right").astype(np.int32)
        return pa.array(got.reshape(-1, 1).tolist(), pa.list_(pa.int32()))

    first = {r[0]: r[1] for r in ids.select(range_of("id")[0].alias("p"), "id").groupBy("p").agg(F.min("id")).collect()}  # a row per range
    order = sorted(first)
    before = {first[p]: order[k - 1] for k, p in enumerate(order)}
    heads = np.array(sorted(before), np.int64)
    goes = np.array([before[x] for x in heads.tolist()], np.int32)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ranges_of(column: pa.Array) -> pa.Array:
        value = column.to_numpy(zero_copy_only=False)
        own = np.searchsorted(cuts, value, "right")
        at = np.minimum(np.searchsorted(heads, value), max(0, len(heads) - 1))
        extra = heads[at] == value if len(heads) else np.zeros(len(value), bool)
        return pa.array([[a, int(goes[b])] if x else [a] for a, b, x in zip(own.tolist(), at.tolist(), extra.tolist(), strict=True)], pa.list_(pa.int32()))

    rows = docs.select(F.col(id_col).cast("long").alias("real"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    dealt = rows.withColumn("ps", ranges_of("id")).select("real", "id", "t", F.posexplode("ps").alias("o", "p"))
    return dealt.repartition(parts, "p").sortWithinPartitions("p", "o", "id", "t").select("p", "o", "real", "t")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document by ascending id, the first following the last.  Null text counts as empty.  Rows that
    repeat an id follow one another in order of their texts; null ids come first.  A single row is its own
    next document.  An empty table gives no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, with its next one still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
                rows = ([held] if held else []) + rows
                held = rows[-1]
                # Of the copies behind a range only the first is a next document.
                open_rows = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[1] == 0 and x[0] == y[0]]
                if open_rows:
                    yield _judge(open_rows)

    out = f"`{id_col}` long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(work, out).toDF(id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _judge(rows: list[tuple]) -> pa.RecordBatch:
    texts = [x[3] for x, _ in rows] + [rows[-1][1][3]]
    edited = []
    for x, y in rows:
        cut = len(x[3]) // 4
        edited.append(x[3][: len(x[3]) - cut] + y[3][:cut])
    both = vectors(*words.text_buffers(pa.array(texts + edited, pa.large_string())))
    n = len(rows)
    follows = [k + 1 if k + 1 < n and rows[k + 1][0] is rows[k][1] else None for k in range(n)]
    stray = [k for k in range(n) if follows[k] is None and k < n - 1]
    own = tuple(v[:n] for v in both)
    new = tuple(v[n + 1 :] for v in both)
    after = tuple(v[1 : n + 1].copy() for v in both)
    if stray:  # a range ends inside this group: its last row is followed by a copy
        odd = vectors(*words.text_buffers(pa.array([rows[k][1][3] for k in stray], pa.large_string())))
        for a, b in zip(after, odd, strict=True):
            a[stray] = b
    return pa.record_batch(
        [
            pa.array([x[2] for x, _ in rows], pa.int64()),
            pa.array([len(x[3]) for x, _ in rows], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array(write(*own), pa.string()),
            pa.array(write(*new), pa.string()),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ],
        names=["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
