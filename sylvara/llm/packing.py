"""Packing of token sequences as a cutting-stock problem.

A document's tokens are cut into pieces of at most ``capacity``; full pieces fill a sequence each, and
the rest are the order lengths of a cutting-stock problem.  Its histogram is in classes: exact up to EXACT
tokens, then of widths that double up to ``grain``.  It has a bounded size whatever the corpus, so the driver
solves it: a linear program over patterns, which begins with the patterns of a best fit and gets further
columns from a knapsack dynamic program.  Each pattern is used as often as the program says, rounded down,
then once more in order of the fractions while all of its pieces are left; what remains of the demand is
packed by best fit.  Spark then ranks the pieces of each class and deals ranks to slots.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout
from .memory import tidy_batches
from .pieces import slices
from .pool import Pool

CAPACITY, GRAIN, END_ID = 4096, 4, 2
EXACT = 64  # tokens up to which a class is one length


def _knapsack(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best total value of items of the given sizes and values, any number of each, and how many of each."""
    best, took = np.zeros(room + 1), []
    for i in np.argsort(-value / sizes, kind="stable").tolist():
        if value[i] <= 0:
            break
        times = 1
        while times * sizes[i] <= room:  # 1, 2, 4, ... of it make up any number
            wide = times * int(sizes[i])
            more = best[: room + 1 - wide] + times * value[i]
            better = more > best[wide:] + 1e-12
            if better.any():
                best[wide:] = np.where(better, more, best[wide:])
                took.append((i, times, wide, better))
            times *= 2
    items, left = np.zeros(len(sizes), np.int64), room
    for i, times, wide, better in reversed(took):
        if left >= wide and better[left - wide]:
            items[i] += times
            left -= wide
    return float(best[room]), items


def program(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-5, rounds: int = 4000) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Patterns {place in sizes: count} of a basis, how often each is used, and a lower bound of the sequences.

    A revised simplex over patterns that hold the demand exactly.  Its first columns are those of a best fit; when
    none of them prices out, the knapsack makes one.  It ends when no pattern prices out, when the value is within
    ``gap`` of the bound, or after ``rounds`` steps; the patterns hold the demand in any case."""
    m, need = len(sizes), demand.astype(float)
    place = {int(s): k for k, s in enumerate(sizes)}
    columns = [{k: int(f)} for k, f in enumerate(room // sizes)]
    columns += [{place[s]: c for s, c in pattern.items()} for _, pattern in _best_fit({int(s): int(n) for s, n in zip(sizes, demand, strict=True)}, room)]
    table = np.zeros((len(columns), m))
    for j, pattern in enumerate(columns):
        table[j, list(pattern)] = list(pattern.values())
    inverse, basis = np.diag(1.0 / table[range(m), range(m)]), list(range(m))
    x, bound = inverse @ need, need @ sizes / room
    for _ in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(0)
        worth = table @ price
        j = int(worth.argmax())
        if worth[j] <= 1 + 1e-7:
            most, items = _knapsack(sizes, price, room)
            bound = max(bound, need @ price / max(most, 1.0))
            if most <= 1 + 1e-7:
                break
            table, j = np.vstack((table, items.astype(float))), len(table)
            columns.append({k: int(items[k]) for k in np.flatnonzero(items).tolist()})
        way = inverse @ table[j]
        ratio = np.where(way > 1e-7, x / np.where(way > 1e-7, way, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(np.where(ratio <= ratio.min() + 1e-9, way, 0).argmax())  # of ties the largest, for the inverse's sake
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        basis[out] = j
    return [columns[j] for j in basis], x, bound


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns [(times, {size: count})] that hold demand[k] items of sizes[k] <= room each."""
    demand = np.asarray(demand, np.int64)
    sizes, demand = np.asarray(sizes, np.int64)[demand > 0], demand[demand > 0]
    if not len(sizes):
        return []
    columns, x, _ = program(sizes, demand, room)
    whole, left, patterns = np.floor(x + 1e-9), demand.copy(), []

    def use(k: int, most: int) -> None:
        times = min([most, *(int(left[i]) // c for i, c in columns[k].items())])
        if times > 0:
            patterns.append((times, {int(sizes[i]): c for i, c in columns[k].items()}))
            for i, c in columns[k].items():
                left[i] -= times * c

    for k in range(len(columns)):
        use(k, int(whole[k]))
    for k in np.argsort(whole - x, kind="stable").tolist():
        if x[k] - whole[k] > 1e-6:
            use(k, 1)
    return patterns + _best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, room)


def _best_fit(items: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing.  Bins with the same contents are one group, and groups take items together, so the
    work depends on the sizes and not on how many items there are."""
    free: list[dict[tuple, int]] = [{} for _ in range(room + 1)]  # by room left: contents -> bins

    def put(left: int, contents: tuple, bins: int) -> None:
        free[left][contents] = free[left].get(contents, 0) + bins

    for size in sorted(items, reverse=True):
        n = items[size]
        for left in range(size, room):
            while n and free[left]:
                contents, bins = free[left].popitem()
                each = min(left // size, n)
                fill = min(bins, n // each)
                if bins > fill:
                    put(left, contents, bins - fill)
                put(left - each * size, (*contents, (size, each)), fill)
                n -= fill * each
        each = room // size
        if n >= each:
            put(room - each * size, ((size, each),), n // each)
        if n % each:
            put(room - n % each * size, ((size, n % each),), 1)
    return [(bins, dict(contents)) for group in free for contents, bins in sorted(group.items())]


def _widths(grain: int) -> list[tuple[int, int]]:
    """(length up to which, width of classes): 1 up to EXACT, doubling with the length up to grain."""
    out, width = [], 1
    while width < grain:
        out.append((EXACT * width, width))
        width *= 2
    return [*out, (1 << 62, grain)]


def class_sizes(capacity: int, grain: int) -> np.ndarray:
    """The largest length of each class, ascending."""
    out, low = [], 0
    for top, width in _widths(grain):
        out += range(low + width, min(top, capacity) + 1, width)
        low = min(top, capacity)
    return np.unique([*out, capacity])


def class_of(length, capacity: int, grain: int):
    """The size of a length's class, as a Column."""
    out = None
    for top, width in _widths(grain):
        size = F.least(F.ceil(length / width) * width, F.lit(capacity)).cast("long")
        out = F.when(length <= top, size) if out is None else out.when(length <= top, size)
    return out


class Slots:
    """Which sequence and slot the item of a size class with a given rank has."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]) -> None:
        used: dict[int, int] = {}
        rows, base = [], 0
        for times, pattern in patterns:
            slot = 0
            for size, count in sorted(pattern.items(), reverse=True):
                rows.append((size, used.get(size, 0), count, base, slot))
                used[size] = used.get(size, 0) + times * count
                slot += count
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.rank, self.count, self.base, self.slot = (table[:, k].copy() for k in range(1, 5))

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (size << 48) + rank, "right") - 1
        j = rank - self.rank[at]
        return self.base[at] + j // self.count[at], self.slot[at] + j % self.count[at]


_open: dict = {}


def _encoder(path: str):
    """Ids of words (UTF-8) by the tokenizers library, kept while the Python worker lives.

    Units of words are kept too, so that a word is not encoded again for its capital or the marks after it."""
    if path not in _open:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        closes = np.zeros(tokenizer.get_vocab_size(), bool)
        for piece, i in tokenizer.get_vocab().items():
            closes[i] = piece.endswith("</w>")

        def apart(words: list[str]) -> tuple[list[int], list[int]]:
            ids, sizes = [], []
            for at in range(0, len(words), 20_000):
                for e in tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False):
                    one = e.ids
                    ids += one
                    sizes.append(len(one))
            return ids, sizes

        def together(words: list[str], ends: list[int]) -> tuple[list[int], list[int]]:
            """Words that end in as many closing pieces as given, many to a text, which costs less a word."""
            ids, sizes = [], []
            lines = [" ".join(words[at : at + 128]) for at in range(0, len(words), 128)]
            for k, e in enumerate(tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                one, some = e.ids, slice(128 * k, 128 * k + 128)
                last = np.flatnonzero(closes[one])
                if len(last) == sum(ends[some]):
                    ids += one
                    sizes += np.diff(last[np.cumsum(ends[some]) - 1], prepend=-1).tolist()
                else:
                    own = apart(words[some])
                    ids += own[0]
                    sizes += own[1]
            return ids, sizes

        def whole(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = together(units, [1] * len(units))
            return np.array(ids, np.int32), np.array(sizes, np.int64)

        units, marks = Pool(whole), "".join(c for c in string.punctuation if c != "'")  # an apostrophe may open a unit of its own

        def many(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain, count, parts, other, rest = [], [], [], [], []
            for k, w in enumerate(raw):
                w = w.decode()
                core = w.rstrip(marks)
                tail = w[len(core) :]
                # Letters alone are one unit of the model, and marks after them are another; ASCII ones are lower-cased by it.
                if core.isascii() and core.isalpha():
                    parts.append(core.lower())
                elif core.isalpha() and (low := core.lower()).isalpha() and len(low) == len(core):
                    parts.append(core)
                else:
                    other.append(k)
                    rest.append(w)
                    continue
                plain.append(k)
                count.append(1 + (tail != ""))
                if tail:
                    parts.append(tail)
            ids, of_part = units.lookup(parts)
            upto = np.concatenate(([0], np.cumsum(of_part)))[np.concatenate(([0], np.cumsum(count, dtype=np.int64)))]
            second = apart(rest)
            size = np.concatenate((np.diff(upto), np.array(second[1], np.int64)))
            begin = np.cumsum(size) - size
            order = np.argsort(np.array(plain + other, np.int64))
            size, begin = size[order], begin[order]
            flat = np.concatenate((ids, np.array(second[0], np.int32)))
            return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))], size

        _open[path] = Pool(many)
    return _open[path]


def tokenize(texts: list[str], path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts end to end, each closed by end_id, and n+1 offsets.

    The model drops white space and joins nothing across it, so words are encoded apart and only once."""
    words, ends = [], [0]
    for text in texts:
        words += text.encode().split()  # bytes are split at ASCII white space alone
        ends.append(len(words))
    ids, sizes = _encoder(path).lookup(words)
    plain = np.concatenate(([0], np.cumsum(sizes)))[ends]
    bounds = plain + np.arange(len(texts) + 1)
    out = np.full(int(bounds[-1]), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy) of every piece; copy tells rows of one id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = tokenize([x or "" for x in part.column(1).to_pylist()], tokenizer_path, end_id)
                ids = ids.astype("<u4")
                total = np.diff(bounds)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, total[row] - start)
                first = bounds[:-1][row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidy_batches(work), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Null and empty text is the end id alone.  Rows that repeat an id are packed each for itself, null ids too;
    an empty table gives no rows.  No token is dropped: every document is packed whole.
    """
    spark = docs.sparkSession
    salts = 4 * layout.shuffle_partitions(spark)
    cut = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    cut = cut.withColumn("size", class_of(F.col("length"), capacity, grain)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    cut = layout.cut_lineage(cut)
    counts = {r[0]: r[1] for r in cut.groupBy("size").count().collect()}  # one row per size class
    sizes = class_sizes(capacity, grain)
    slots = Slots(solve(sizes, np.array([counts.get(int(x), 0) for x in sizes], np.int64), capacity))

    # Ranks within a size class: within (class, salt), then the salts one after another.  What stands before a salt
    # is summed in two steps, within and over runs of salts, so that a class of many salts is not one task's.
    run = isqrt(salts) + 1
    of_salt = cut.groupBy("size", "salt").count().withColumn("run", F.floor(F.col("salt") / run))
    within = of_salt.withColumn("inside", F.sum("count").over(Window.partitionBy("size", "run").orderBy("salt")) - F.col("count"))
    runs = of_salt.groupBy("size", "run").agg(F.sum("count").alias("total"))
    runs = runs.select("size", "run", (F.sum("total").over(Window.partitionBy("size").orderBy("run")) - F.col("total")).alias("outside"))
    before = within.join(runs, ["size", "run"]).select("size", "salt", (F.col("inside") + F.col("outside")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1
    ranked = cut.withColumn("inner", inner).join(before, ["size", "salt"]).withColumn("rank", F.col("inner") + F.col("before"))

    @F.arrow_udf(T.StructType([T.StructField("s", T.LongType()), T.StructField("k", T.LongType())]))
    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        s, k = slots.of(size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(s), pa.array(k)], names=["s", "k"])

    dealt = ranked.withColumn("at", place("size", "rank"))
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("at.s").orderBy("at.k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("at.s").alias("sequence_id"), offset.alias("offset"))
