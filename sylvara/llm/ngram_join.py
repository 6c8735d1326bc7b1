"""Jaccard join of documents on word n-grams by vertical partitioning.

1. Every text becomes its set of n-gram hashes.  Batches send (hash, document) pairs, packed by hash
   range, to buckets; a bucket counts, over the whole corpus, in how many different sets each n-gram
   occurs, and sends back only n-grams that occur in two sets or more.
2. The global order is by ascending frequency class, then by hash; n-grams of a single set come first.
   A set that keeps too few shared n-grams can have no partner.  The others post the first
   n - ceil(t*n) + 1 n-grams of the order: two sets that link share one of these.
3. Candidates are the sets of a posting list against the list's cleanest member, then all members that
   are not yet known to be connected.  Both are held against an exact lower bound of the difference (a
   parity bitmap and the n-grams that occur nowhere else) inside the join, so a group of copies does not
   become rows of all its pairs.
4. The order is cut into fragments.  The overlap of a candidate pair is counted in each fragment
   separately and summed per pair; a pair links when the sum reaches the threshold.
Equal sets are one class throughout, told by their size and 128 bits.  N-grams are told apart by 64 bits: two
different ones that meet would change the overlap of the pairs of documents that hold just these by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout, words
from .components import connected_components
from .memory import tidy_batches, tidy_groups

PERCENT = 85
WIDTH = 4
PIVOTS = (2, 3, 5, 17)  # frequency classes at which a new fragment begins
_K1, _K2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_LANES = 4


def _sets(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-gram hashes of each text, end to end, and the n+1 offsets."""
    hashes, bounds = words.hash_words(*words.text_buffers(column), lower=True)
    size = np.diff(bounds)
    starts = words.fixed_windows(bounds, width)
    ends = starts + width
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        starts, ends = np.concatenate((starts, bounds[short])), np.concatenate((ends, bounds[short + 1]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    grams = words.hash_windows(hashes, starts, ends)
    cut = np.searchsorted(starts, bounds)
    each = [np.unique(grams[cut[k] : cut[k + 1]]) for k in range(len(size))]
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64))).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


_AT_ONCE = 1 << 19  # n-grams of a bucket that are sorted at a time
_BLOCK_ROWS = 60_000  # documents of a block are numbered in 16 bits
_SENT = "bucket long, block long, doc binary, hashes binary, id array<long>, n array<long>, f1 array<long>, f2 array<long>, rep array<int>"


def _send(width: int, buckets: int, block_bytes: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of about block_bytes of text, however the batches are cut."""
        held, room, rows = [], block_bytes, _BLOCK_ROWS
        for batch in batches:
            table, at = pa.table(batch), 0
            _, offsets = words.text_buffers(table.column("t"))
            while at < table.num_rows:
                stop = min(at + rows, int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1)
                stop = max(stop, at + (not held))  # a text beyond the size is a table of its own
                if stop > at:
                    held.append(table.slice(at, stop - at))
                    room -= int(offsets[stop] - offsets[at])
                    rows -= stop - at
                if stop < table.num_rows:
                    yield pa.concat_tables(held)
                    held, room, rows = [], block_bytes, _BLOCK_ROWS
                at = stop
        if held:
            yield pa.concat_tables(held)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for serial, table in enumerate(pieces(batches)):
            block = (part << 32) | serial
            grams, bounds = _sets(table.column("t"), width)
            n = np.diff(bounds)
            f1, f2 = _sums(words.mix(grams ^ _K1), bounds), _sums(words.mix(grams ^ _K2), bounds)
            first: dict[tuple, int] = {}
            rep = np.fromiter((first.setdefault(x, k) for k, x in enumerate(zip(n.tolist(), f1.tolist(), f2.tolist(), strict=True))), np.int32, len(n))
            doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            own = np.repeat(rep == np.arange(len(n)), n)
            grams, doc = grams[own], doc[own]
            order = np.argsort(grams, kind="stable")
            grams, doc = grams[order], doc[order]
            to = np.searchsorted(words.bucket_of(grams, buckets), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(to)).tolist()
            rows = len(used)
            keys, f1, f2 = [table.column("id").to_pylist()], f1.view(np.int64), f2.view(np.int64)
            tags = []
            for k in used:
                mine = np.unique(doc[to[k] : to[k + 1]])
                tags.append(mine.astype("<u2").tobytes() + f1[mine].astype("<i8").tobytes())
            docs = [len(t).to_bytes(4, "little") + t + doc[to[k] : to[k + 1]].astype("<u2").tobytes() for k, t in zip(used, tags, strict=True)]
            none = [None] * rows
            yield from pa.table(
                {
                    "bucket": pa.array([*used, -1 - block], pa.int64()),
                    "block": pa.array([block] * (rows + 1), pa.int64()),
                    "doc": pa.array([*docs, None], pa.binary()),
                    "hashes": pa.array([*(words.pack_sorted(grams[to[k] : to[k + 1]]) for k in used), None], pa.binary()),
                    "id": pa.array(none + keys, pa.list_(pa.int64())),
                    "n": pa.array([*none, n], pa.list_(pa.int64())),
                    "f1": pa.array([*none, f1], pa.list_(pa.int64())),
                    "f2": pa.array([*none, f2], pa.list_(pa.int64())),
                    "rep": pa.array([*none, rep], pa.list_(pa.int32())),
                }
            ).to_batches()

    return send


def _level(df: np.ndarray) -> np.ndarray:
    """Frequency class in one byte: the frequency up to 128, then its logarithm."""
    return np.where(df <= 128, df, np.minimum(255, 128 + 4 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: the n-grams of two sets or more, each with its frequency class, by block."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    grams, docs, known, tags = [], [], [], []
    for hashes, doc in zip(table.column("hashes"), table.column("doc"), strict=True):
        raw = doc.as_buffer().to_pybytes()
        head = int.from_bytes(raw[:4], "little")
        grams.append(words.unpack_sorted(hashes.as_buffer().to_pybytes()))
        docs.append(np.frombuffer(raw, "<u2", offset=4 + head))
        known.append(np.frombuffer(raw, "<u2", head // 10, 4))
        tags.append(np.frombuffer(raw, "<i8", head // 10, 4 + 2 * (head // 10)))
    found: list[list[tuple]] = [[] for _ in grams]  # by row: documents, n-grams, levels
    for part in words.value_ranges(grams, _AT_ONCE):
        sizes = [p.stop - p.start for p in part]
        h, d = (np.concatenate([x[p] for x, p in zip(column, part, strict=True)]) for column in (grams, docs))
        s = np.concatenate([t[np.searchsorted(k, x[p])] for t, k, x, p in zip(tags, known, docs, part, strict=True)])
        from_row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        often = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if not len(often):
            continue
        often = often[np.lexsort((s[often], h[often]))]
        hh, ss = h[often], s[often]
        new = np.concatenate(([True], hh[1:] != hh[:-1]))
        fresh = new | np.concatenate(([True], ss[1:] != ss[:-1]))
        run = np.cumsum(new) - 1
        df = np.bincount(run, weights=fresh).astype(np.int64)[run]
        often, df = often[df > 1], df[df > 1]
        by = np.argsort(from_row[often], kind="stable")
        often, level = often[by], _level(df[by])
        cut = np.searchsorted(from_row[often], np.arange(len(sizes) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            pick = often[cut[k] : cut[k + 1]]
            found[k].append((d[pick], h[pick], level[cut[k] : cut[k + 1]]))
    rows = [k for k, x in enumerate(found) if x]
    blocks = table.column("block").to_pylist()
    made = {
        "bucket": pa.array([0] * len(rows), pa.int64()),
        "block": pa.array([blocks[k] for k in rows], pa.int64()),
        "doc": pa.array([b"".join(d.astype("<u2").tobytes() for d, _, _ in found[k]) for k in rows], pa.binary()),
        "hashes": pa.array([b"".join(h.astype("<u8").tobytes() for _, h, _ in found[k]) + b"".join(x.tobytes() for _, _, x in found[k]) for k in rows], pa.binary()),
    }
    return pa.table([made.get(f.name, pa.nulls(len(rows), f.type)) for f in table.schema], schema=table.schema)


def _gather(percent: int):
    def gather(table: pa.Table) -> pa.Table:
        """Of one block: a row per document; a set that may have partners has its shared n-grams in global order."""
        about = next(k for k, x in enumerate(table.column("id")) if x.is_valid)
        ids, n, f1, f2, rep = (table.column(c)[about].as_py() for c in ("id", "n", "f1", "f2", "rep"))
        doc, grams, level = [], [], []
        for x, y in zip(table.column("doc"), table.column("hashes"), strict=True):
            if x.is_valid:
                doc.append(np.frombuffer(x.as_buffer(), "<u2"))
                raw = y.as_buffer().to_pybytes()
                grams.append(np.frombuffer(raw, "<u8", len(doc[-1])))
                level.append(np.frombuffer(raw, np.uint8, offset=8 * len(doc[-1])))
        shared: list[bytes | None] = [None] * len(ids)
        if doc:
            doc, grams, level = np.concatenate(doc), np.concatenate(grams), np.concatenate(level)
            m = np.bincount(doc, minlength=len(ids))
            fit = 100 * m >= percent * np.asarray(n)
            keep = fit[doc]
            doc, grams, level = doc[keep], grams[keep], level[keep]
            order = np.lexsort((grams, level, doc))
            doc, grams, level = doc[order], grams[order], level[order]
            cut = np.searchsorted(doc, np.arange(len(ids) + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                shared[k] = grams[cut[k] : cut[k + 1]].tobytes() + level[cut[k] : cut[k + 1]].tobytes()
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "shared": pa.array(shared, pa.binary())})

    return gather


def _open(raw: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    data = raw.as_buffer().to_pybytes()
    m = len(data) // 9
    return np.frombuffer(data, "<u8", m), np.frombuffer(data, np.uint8, offset=8 * m)


def _post(percent: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, row, lone, sketch = [], [], [], []
            for k, (n, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("shared"), strict=True)):
                grams, _ = _open(raw)
                single = n - len(grams)
                take = n + (-percent * n // 100) + 1 - single  # n - ceil(t * n) + 1, without those of one set only
                bits = np.bincount((words.mix(grams) % np.uint64(64 * _LANES)).astype(np.int64), minlength=64 * _LANES) & 1
                gram.append(grams[:take].view(np.int64))
                row.append(np.full(min(take, len(grams)), k))
                lone.append(single)
                sketch.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            if not gram:
                continue
            at, sketch = np.concatenate(row), np.stack(sketch)
            yield pa.record_batch(
                [pa.array(np.concatenate(gram)), batch.column("cid").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(np.asarray(lone, np.int64)[at]), *(pa.array(np.ascontiguousarray(sketch[at, k])) for k in range(_LANES))],
                names=["gram", "cid", "n", "lone", *(f"k{k}" for k in range(_LANES))],
            )

    return post


def _segment(pivots: tuple[int, ...]):
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, size, part, grams = [], [], [], []
            for c, n, raw in zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), strict=True):
                g, level = _open(raw)
                cut = [*np.searchsorted(level, pivots).tolist(), len(g)]
                for k in range(len(pivots)):
                    if cut[k + 1] > cut[k]:
                        cid.append(c), size.append(n), part.append(k), grams.append(g[cut[k] : cut[k + 1]].view(np.int64))
            yield pa.record_batch([pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["cid", "n", "fragment", "grams"])

    return segment


def _may_link(a: str, b: str, percent: int):
    """True of every pair that links: the difference has at least the n-grams that only one of them has and
    a set bit's worth of each odd cell of the bitmaps."""
    differ = F.col(f"{a}.lone") + F.col(f"{b}.lone")
    for k in range(_LANES):
        differ += F.bit_count(F.col(f"{a}.k{k}").bitwiseXOR(F.col(f"{b}.k{k}")))
    return F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted by fragment and summed, reach the threshold."""
    left = segments.select(F.col("cid").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = segments.select(F.col("cid").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
    total = part.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, pivots: tuple[int, ...] = PIVOTS, block_bytes: int = 6 << 20) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id) for every row of docs.

    A-Z are lower-cased.  A text's set is its distinct ``width``-word n-grams; a text of fewer words has
    its whole word sequence as one; null, empty or blank text has the empty set and links with nothing.
    Two rows link when 100 * |A & B| >= percent * |A | B|.  class_id is the smallest id with an equal set,
    component_id the smallest id reachable by links.  Rows that repeat an id are one node with all their
    links; a row with a null id links with nothing and has null class_id and component_id.  An empty table
    gives no rows.  Other columns are ignored.

    Documents are numbered by their place in the input; an input that is no scan or checkpoint is written to the
    checkpoint folder first, so that a lost task finds the same places again.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = layout.stable(texts)
    division = layout.divide(texts.select("t"), 4 << 20)
    counted = texts.mapInArrow(tidy_batches(_send(width, division.buckets, max(block_bytes, division.block_bytes))), _SENT).groupBy("bucket").applyInArrow(tidy_groups(_count), _SENT)
    sets = layout.cut_lineage(counted.groupBy("block").applyInArrow(tidy_groups(_gather(percent)), "id long, n long, f1 long, f2 long, shared binary"))
    key = ["n", "f1", "f2"]
    known = sets.where("n > 0 AND id IS NOT NULL")
    classes = known.groupBy(*key).agg(F.min("id").alias("cid"))
    some = layout.cut_lineage(known.where("shared IS NOT NULL").groupBy(*key).agg(F.max("shared").alias("shared")).join(classes, key).select("cid", "n", "shared"))

    lanes = ", ".join(f"k{k} long" for k in range(_LANES))
    posted = some.mapInArrow(tidy_batches(_post(percent)), f"gram long, cid long, n long, lone long, {lanes}")
    segments = some.mapInArrow(tidy_batches(_segment(tuple(pivots))), "cid long, n long, fragment int, grams array<long>")
    row = F.struct("lone", "n", "cid", *(f"k{k}" for k in range(_LANES)))
    leaders = posted.groupBy("gram").agg(F.min(row).alias("l"), F.count("*").alias("size")).where("size > 1")
    lead = posted.select("gram", row.alias("x")).join(leaders, "gram").where((F.col("l.cid") != F.col("x.cid")) & _may_link("x", "l", percent))
    first = layout.cut_lineage(_links(lead.select(F.col("x.cid").alias("a"), F.col("l.cid").alias("b")).distinct(), segments, percent))

    label = connected_components(first).select(F.col("node").alias("cid"), "component")
    named = posted.join(label, "cid", "left").select("gram", F.struct("lone", "n", "cid", *(f"k{k}" for k in range(_LANES)), F.coalesce("component", "cid").alias("component")).alias("x"))
    split = named.groupBy("gram").agg(F.min("x").alias("l"), F.min("x.component").alias("lo"), F.max("x.component").alias("hi")).where("lo <> hi").select("gram", F.col("l.component").alias("main"))
    open_lists = named.join(split, "gram")
    rest = open_lists.where(F.col("x.component") != F.col("main")).select("gram", F.col("x").alias("p"))
    other = open_lists.select("gram", "x", "main")
    across = rest.join(other, "gram").where((F.col("p.component") != F.col("x.component")) & ((F.col("x.component") == F.col("main")) | (F.col("p.cid") < F.col("x.cid"))) & _may_link("p", "x", percent))
    second = _links(across.select(F.col("p.cid").alias("a"), F.col("x.cid").alias("b")).distinct(), segments, percent)
    # Each side gets new columns, so that the union is not taken as partitioned like its inputs.
    links = [x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for x in (first, second)]
    parts = connected_components(links[0].union(links[1])).select(F.col("node").alias("cid"), "component")
    layout.drop(first)
    layout.drop(some)

    found = classes.join(parts, "cid", "left").select(*key, "cid", F.coalesce("component", "cid").alias("component"))
    out = sets.select("id", *key).join(found, key, "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("cid")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))
