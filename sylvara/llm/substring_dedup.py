"""Removal of long passages that occur more than once.

Every window of ``width`` consecutive words is hashed by Rabin-Karp.  Texts are dealt
once into blocks.  A block sends its distinct window hashes, sorted and packed by hash
range, to the bucket of that range; a window that a block holds a thousand times is one
entry there, so a hot passage costs a bucket no more than one entry per block.  The
bucket counts each hash over the whole corpus and answers with a bit per hash.  The
block then marks its repeated windows and merges them into maximal intervals of words.
Both uses of the blocks read the same exchange.

Windows are told apart by 96 bits: their hash and 32 bits of another polynomial.  Two different windows of a
corpus of n meet with a chance of about n*n/2**97, which is 0.002 for the 2e13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout, words
from .memory import tidy_groups

WIDTH = 35


def _windows(table: pa.Table, width: int):
    data, offsets = words.text_buffers(table.column("t"))
    hashes, bounds = words.hash_words(data, offsets)
    starts = words.fixed_windows(bounds, width)
    return data, offsets, bounds, starts, words.hash_windows(hashes, starts, starts + width), words.check_windows(hashes, starts, starts + width)


def _send(width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = table.column("b")[0].as_py()
        found, checks, _, _ = words.distinct_pairs(*_windows(table, width)[-2:])
        to = np.searchsorted(words.bucket_of(found, buckets), np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(to))
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "b": pa.array(np.full(len(used), block), pa.int32()),
                "hashes": pa.array([words.pack_sorted(found[to[k] : to[k + 1]]) for k in used], pa.binary()),
                "checks": pa.array([checks[to[k] : to[k + 1]].astype("<u4").tobytes() for k in used], pa.binary()),
            }
        )

    return send


_AT_ONCE = 1 << 19  # hashes of a bucket that are sorted at a time


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: which windows came from two blocks or more."""
    hashes = [words.unpack_sorted(x.as_buffer().to_pybytes()) for x in table.column("hashes")]
    checks = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("checks")]
    hits = [np.zeros(len(x), bool) for x in hashes]
    for part in words.value_ranges(hashes, _AT_ONCE):
        _, _, which, times = words.distinct_pairs(np.concatenate([x[p] for x, p in zip(hashes, part, strict=True)]), np.concatenate([x[p] for x, p in zip(checks, part, strict=True)]))
        again, at = times[which] > 1, 0
        for hit, p in zip(hits, part, strict=True):
            n = p.stop - p.start
            hit[p] = again[at : at + n]
            at += n
    some = [k for k, x in enumerate(hits) if x.any()]
    blocks, bucket = table.column("b").to_pylist(), table.column("bucket")[0].as_py()
    return pa.table({"b": pa.array([blocks[k] for k in some], pa.int32()), "bucket": pa.array([bucket] * len(some), pa.int32()), "bits": pa.array([np.packbits(hits[k]).tobytes() for k in some], pa.binary())})


def _remove(width: int, buckets: int, schema: pa.Schema, carried: list[str]):
    """carried: the columns of the table that come first in the schema."""

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets, bounds, starts, hashes, checks = _windows(table, width)
        found, _, inverse, times = words.distinct_pairs(hashes, checks)
        repeated = times > 1
        to = np.searchsorted(words.bucket_of(found, buckets), np.arange(buckets + 1))
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits"), strict=True):
            lo, hi = to[bucket], to[bucket + 1]
            repeated[lo:hi] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo).astype(bool)
        step = np.zeros(int(bounds[-1]) + 1, dtype=np.int32)
        hit = starts[repeated[inverse]]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        raw, texts, spans, removed = data.tobytes(), [], [], []
        for k in range(len(offsets) - 1):
            mine = gone[bounds[k] : bounds[k + 1]]
            cut = int(mine.sum())
            own = raw[offsets[k] : offsets[k + 1]].split()
            if cut:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                spans.append(edge.tolist())
                own = [w for w, x in zip(own, mine.tolist(), strict=True) if not x]
            else:
                spans.append([])
            texts.append(b" ".join(own))
            removed.append(cut)
        made = {
            "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "removed_spans": pa.array(spans, pa.list_(pa.int64())),
        }
        given = [table.column(c).cast(f.type) for c, f in zip(carried, schema, strict=False)]
        return pa.table([*given, *(made[f.name] for f in list(schema)[len(carried) :])], schema=schema)

    return remove


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: Iterable[str] = ()) -> DataFrame:
    """Remove each word covered by a ``width``-word window that also starts somewhere else.

    Returns id_col, the columns named in ``carry``, n_words, n_removed, kept_text (kept words joined
    by one space) and removed_spans (begin, end, begin, end ... in words, end exclusive, maximal).
    One output row per input row, repeated ids included.  Null or empty text: no words, empty
    kept_text.  A text shorter than ``width`` words is kept whole.  An empty table gives no rows.
    Other columns of the input are ignored, whatever they are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [id_col, *carry]
    docs = layout.stable(docs.select(*dict.fromkeys([*names, text_col])))
    division = layout.divide(docs.select(text_col), 4 << 20)
    buckets = division.buckets
    out = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.LongType()))])
    carried = ["t" if c == text_col else f"c{k}" for k, c in enumerate(names)]  # a carried text moves once
    dealt = docs.select(
        layout.block_of(F.col(id_col), division.blocks).alias("b"), F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(x) for c, x in zip(names, carried, strict=True) if x != "t"]
    ).repartition(layout.shuffle_partitions(docs.sparkSession), "b")
    sent = dealt.groupBy("b").applyInArrow(tidy_groups(_send(width, buckets)), "bucket int, b int, hashes binary, checks binary")
    answers = sent.groupBy("bucket").applyInArrow(tidy_groups(_count), "b int, bucket int, bits binary")
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(tidy_groups(_remove(width, buckets, to_arrow_schema(out), carried)), out)
