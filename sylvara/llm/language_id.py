"""Language identification by interpolated Kneser-Ney models of characters.

Text is folded to lower-case letters with one blank between runs of them.  A 4-gram's hash packs four
16-bit symbols, so it is exact and its prefixes and suffixes are shifts and masks.  Counts of all
training texts are summed in Spark; the models of all languages share sorted hash arrays, one per
order, with a row of log probabilities (a column per language) beside each hash.  The language of the
lowest cross-entropy per symbol is chosen.  One training text in FOLDS, by the hash of the text, is kept out of the
models; what cross-entropies these have, by language and length, calibrates the rejection: a text is rejected
beyond the value that a share of REJECT of them exceeds, plus SLACK.

A model of more than MODEL_ROWS rows is not sent around.  It is computed in Spark from all counts and lies
in shards by hash; texts are dealt into blocks, a block asks the shards for the distinct n-grams and
contexts that it has, and scores with the part of the model that comes back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout, words
from .memory import tidy_batches, tidy_groups
from .pieces import slices

ORDER = 4
MODEL_ROWS = 4_000_000  # 4-grams times languages of the largest model that is broadcast; larger ones stay in shards
SHORT = 16
FOLDS, REJECT = 10, 1e-3
SLACK, FEW = 0.35, 5  # nats a symbol; twice as much for a limit from FEW texts, and so on
_U = np.uint64
_BLANK, _OTHER = 32, 0xFFFF
_PIECE = 1 << 19
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Symbol of each code point: a lower-case letter or mark, 0xFFFF for letters beyond 16 bits, else a blank."""
    if not _fold:
        import unicodedata

        table = np.full(sys.maxunicode + 1, _BLANK, np.uint16)
        for c in range(sys.maxunicode + 1):
            char = chr(c)
            if unicodedata.category(char)[0] in "LM":
                low = char.lower()
                low = ord(low) if len(low) == 1 else c
                table[c] = low if low < _OTHER else _OTHER
        _fold.append(table)
    return _fold[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts end to end, each text between blanks, and n+1 offsets; a text without letters has none."""
    whole = (" ".join(texts) + " ").encode("utf-32-le", "surrogatepass")
    out = _folding()[np.frombuffer(whole, np.uint32)]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(size)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _BLANK) | (out[:-1] != _BLANK)
    if len(out):
        keep[0] = out[0] != _BLANK
    # A text's leading blanks go, as the text before it ends with one.
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], np.concatenate(([0], kept[ends]))


def hashes(line: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of the 4-gram that ends at each symbol; blanks stand before a text."""
    wide = line.astype(np.uint64)
    key = wide.copy()
    at = np.repeat(bounds[:-1], np.diff(bounds))
    since = np.arange(len(line)) - at
    for k in range(1, ORDER):
        before = np.full(len(line), _BLANK, np.uint64)
        before[k:] = wide[:-k]
        before[since < k] = _BLANK
        key |= before << _U(16 * k)
    return key


def count_grams(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(lang, gram, n) of all 4-grams of all rows with a label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                texts, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                for label in sorted(set(labels)):
                    line, bounds = symbols([t or "" for t, x in zip(texts, labels, strict=True) if x == label])
                    grams, n = np.unique(hashes(line, bounds), return_counts=True)
                    if label in total:
                        both = np.concatenate((total[label][0], grams))
                        grams, inverse = np.unique(both, return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate((total[label][1], n)), minlength=len(grams)).astype(np.int64)
                    total[label] = grams, n
        for label, (grams, n) in total.items():
            for at in range(0, len(grams), 50_000):
                g = grams[at : at + 50_000].view(np.int64)
                yield pa.record_batch([pa.array([label] * len(g)), pa.array(g), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])

    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("lang"))
    return rows.mapInArrow(tidy_batches(work), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per order: sorted hashes, log probabilities (rows: hashes), and log back-off weights of the contexts of that order."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    def scores(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last symbol in every language."""
        out = np.zeros((len(key), len(self.languages)), np.float32)
        rest = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            mine = key[rest] if n == ORDER else key[rest] & _U((1 << 16 * n) - 1)
            at = np.minimum(np.searchsorted(self.grams[n - 1], mine), len(self.grams[n - 1]) - 1)
            hit = self.grams[n - 1][at] == mine
            if n == ORDER and hit.all():
                return self.logp[n - 1][at]
            out[rest[hit]] += self.logp[n - 1][at[hit]]
            rest, mine = rest[~hit], mine[~hit]
            if not len(rest):
                return out
            if n > 1:
                context = mine >> _U(16)
                at = np.minimum(np.searchsorted(self.contexts[n - 1], context), len(self.contexts[n - 1]) - 1)
                known = self.contexts[n - 1][at] == context
                out[rest[known]] += self.backoff[n - 1][at[known]]
        out[rest] += self.backoff[0][0] + np.float32(self.floor)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (rows: texts, columns: languages) and the number of symbols."""
        line, bounds = symbols(texts)
        size = np.diff(bounds)
        total = np.zeros((len(texts), len(self.languages)))
        if len(line) and self.languages:
            key = hashes(line, bounds)
            for at in range(0, len(key), _PIECE):
                stop = min(len(key), at + _PIECE)
                got = self.scores(key[at:stop]).astype(np.float64)
                lo = int(np.searchsorted(bounds, at, "right")) - 1
                hi = int(np.searchsorted(bounds, stop))
                rows = lo + np.flatnonzero(size[lo:hi])
                total[rows] += np.add.reduceat(got, np.maximum(bounds[rows] - at, 0))
        return -total / np.maximum(size, 1)[:, None], size


def _kneser_ney(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """lang: the language's index of each row."""
    wide = len(languages)
    if not wide:
        return Model([], [], [], [], [], 0.0)
    grams, logp, contexts, backoff = [None] * ORDER, [None] * ORDER, [None] * ORDER, [None] * ORDER
    rows = {ORDER: (lang, gram, n.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # lower orders count in how many different contexts a gram occurs
        up_lang, up_gram, _ = rows[k + 1]
        low = up_gram & _U((1 << 16 * k) - 1)
        both, count = np.unique(np.stack((up_lang.astype(np.uint64), low)), axis=1, return_counts=True)
        rows[k] = both[0].astype(np.int64), both[1], count.astype(np.float64)
    p = np.full((1, wide), 1.0 / (len(np.unique(rows[1][1])) + 1))
    floor = float(np.log(p[0, 0]))
    for k in range(1, ORDER + 1):
        ids, own, c = rows[k]
        keys, at = np.unique(own, return_inverse=True)
        once, twice = (np.bincount(ids[c == x], minlength=wide) for x in (1, 2))
        discount = _discount(once, twice)
        held = np.zeros((len(keys), wide))
        held[at, ids] = np.maximum(c - discount[ids], 0)
        context, of = np.unique(keys >> _U(16) if k > 1 else np.zeros(len(keys), np.uint64), return_inverse=True)
        total, kinds = np.zeros((len(context), wide)), np.zeros((len(context), wide))
        np.add.at(total, (of[at], ids), c)
        np.add.at(kinds, (of[at], ids), 1)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        low = p[np.searchsorted(grams[k - 2], keys & _U((1 << 16 * (k - 1)) - 1))] if k > 1 else p
        p = held / np.maximum(total[of], 1) + weight[of] * low
        grams[k - 1], logp[k - 1] = keys, np.log(p).astype(np.float32)
        contexts[k - 1], backoff[k - 1] = context, np.log(weight).astype(np.float32)
    return Model(languages, grams, logp, contexts, backoff, floor)


@dataclass
class Shards:
    """A model as a table (o, key, v): o is the order of a gram or _CONTEXT + that of a context, v has a value per language."""

    languages: list[str]
    table: DataFrame
    floor: float


_CONTEXT = 10


def _discount(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)


def _sharded(counts: DataFrame) -> Shards:
    """The same model as that of _kneser_ney, from any number of (lang, gram, n)."""
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    wide = len(languages)
    place = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int")
    rows = {ORDER: counts.select(place.alias("l"), "gram", F.col("n").cast("double").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        rows[k] = layout.cut_lineage(rows[k + 1].groupBy("l", low.alias("gram")).agg(F.count("*").cast("double").alias("c")))
    symbols_seen = rows[1].select("gram").distinct().count()
    each = F.sequence(F.lit(0), F.lit(wide - 1))
    tables, p = [], None
    for k in range(1, ORDER + 1):
        once, twice = np.zeros(wide), np.zeros(wide)
        for r in rows[k].groupBy("l").agg(F.count_if(F.col("c") == 1).alias("a"), F.count_if(F.col("c") == 2).alias("b")).collect():
            once[r["l"]], twice[r["l"]] = r["a"], r["b"]
        discount = F.array(*[F.lit(float(x)) for x in _discount(once, twice)])
        context = (F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")).alias("context")
        found = rows[k].groupBy("l", context).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        found = found.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("l", F.struct("total", "kinds")))).alias("t"))

        def weigh(i):
            t = F.try_element_at("t", i)
            return F.struct(F.coalesce(t["total"], F.lit(1.0)).alias("total"), F.coalesce(F.get(discount, i) * t["kinds"] / t["total"], F.lit(1.0)).alias("weight"))

        found = layout.cut_lineage(found.select("context", F.transform(each, weigh).alias("w")))
        own = rows[k].groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("m")).select("gram", "m", context)
        own = own.join(F.broadcast(found) if k == 1 else found, "context")
        if k == 1:
            own = own.withColumn("low", F.array_repeat(F.lit(1.0 / (symbols_seen + 1)), wide))
        else:
            own = own.withColumn("g", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(p.select(F.col("gram").alias("g"), F.col("p").alias("low")), "g")

        def chance(i):
            held = F.coalesce(F.greatest(F.try_element_at("m", i) - F.get(discount, i), F.lit(0.0)), F.lit(0.0))
            w = F.get("w", i)
            return held / w["total"] + w["weight"] * F.get("low", i)

        p = layout.cut_lineage(own.select("gram", F.transform(each, chance).alias("p")))
        tables.append(p.select(F.lit(k).alias("o"), F.col("gram").alias("key"), F.transform("p", lambda x: F.ln(x).cast("float")).alias("v")))
        tables.append(found.select(F.lit(_CONTEXT + k).alias("o"), F.col("context").alias("key"), F.transform("w", lambda x: F.ln(x["weight"]).cast("float")).alias("v")))
    table = tables[0]
    for one in tables[1:]:
        table = table.unionByName(one)
    return Shards(languages, table, -float(np.log(symbols_seen + 1)))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", model_rows: int = MODEL_ROWS) -> Model | Shards:
    """Models of all labels from all 4-grams of all texts; in shards if there are more than ``model_rows`` rows,
    the bound of what is sent to the driver and the executors.  Both kinds score alike."""
    counts = layout.cut_lineage(count_grams(docs, text_col, label_col))
    if counts.count() > model_rows:
        return _sharded(counts)
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {x: k for k, x in enumerate(languages)}
    lang = np.array([place[x] for x in names], np.int64)
    gram, n = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    order = np.lexsort((gram, lang))
    return _kneser_ney(languages, lang[order], gram[order].view(np.uint64), n[order])


def _judge(known: Model, part: pa.RecordBatch, at: int, kept: int, names: list[str]) -> pa.RecordBatch:
    """The first ``kept`` columns and the scores of the texts in column ``at``."""
    languages = np.array([*known.languages, "und"])
    texts = [x or "" for x in part.column(at).to_pylist()]
    nats, size = known.entropy(texts)
    letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    some = letters & (size > 0) & bool(known.languages)
    if known.languages:
        best = nats.argmin(1)
        least = nats[np.arange(len(nats)), best]
        sure = 1 / np.exp(-np.minimum(size, 64)[:, None] * (nats - least[:, None])).sum(1)
    else:
        best, least, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    pick = np.where(some, best, len(languages) - 1)
    return pa.record_batch([*part.columns[:kept], pa.array(languages[pick].tolist(), pa.string()), pa.array(np.where(some, sure, 0.0)), pa.array(least, mask=~some), pa.array(size)], names=names)


def score(docs: DataFrame, model: Model | Shards, text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """(carry..., lang_pred, score, nats, n_symbols): lang_pred is und without letters; nats is the best
    cross-entropy per symbol; score the posterior of the choice over at most 64 symbols' evidence."""
    names = list(carry)
    at = names.index(text_col) if text_col in names and docs.schema[text_col].dataType == T.StringType() else len(names)
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("nats", T.DoubleType()), T.StructField("n_symbols", T.LongType())])
    given = [F.col(c).alias(f"c{k}") for k, c in enumerate(names)] + [F.col(text_col).cast("string").alias("t")] * (at == len(names))
    if isinstance(model, Shards):
        return _score_by_shards(docs, model, text_col, names, given, at, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                yield _judge(known, part, at, len(names), schema.names)

    return docs.select(*given).mapInArrow(tidy_batches(work), schema)


def _parts(table: pa.Table, at: int) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch, at, 1 << 20)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return words.bucket_of(words.mix(keys), shards)


def _score_by_shards(docs: DataFrame, model: Shards, text_col: str, names: list[str], given: list, at: int, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, languages, floor, wide = docs.sparkSession, model.languages, model.floor, len(model.languages)
    docs = layout.stable(docs)
    division = layout.divide(docs.select(text_col), 4 << 20)
    shards = max(division.buckets, model.table.count() * wide // 4_000_000)
    arrow = to_arrow_schema(schema)
    dealt = docs.select(*given, layout.block_of(F.col((names or [text_col])[0]), division.blocks).alias("b")).repartition(layout.shuffle_partitions(spark), "b")

    def ask(table: pa.Table) -> pa.Table:
        """Of one block: the distinct n-grams and contexts of its texts, by shard."""
        keys = np.zeros(0, np.uint64)
        for part in _parts(table, at):
            keys = np.union1d(keys, hashes(*symbols([x or "" for x in part.column(at).to_pylist()])))
        rows = []
        for k in range(1, ORDER + 1):
            own = np.unique(keys & _U((1 << 16 * k) - 1))
            for o, want in ((k, own), (_CONTEXT + k, np.unique(own >> _U(16)) if k > 1 else np.zeros(1, np.uint64))):
                to = _shard_of(want, shards)
                by = np.argsort(to, kind="stable")
                for some in np.split(want[by], np.flatnonzero(np.diff(to[by])) + 1):
                    if len(some):
                        rows.append((o, int(_shard_of(some[:1], shards)[0]), words.pack_sorted(some)))
        b = table.column("b")[0].as_py()
        o, s, packed = zip(*rows, strict=True)
        return pa.table({"b": pa.array([b] * len(rows), pa.int32()), "o": pa.array(o, pa.int32()), "s": pa.array(s, pa.int32()), "keys": pa.array(packed, pa.binary())})

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(_shard_of(keys, shards).astype(np.int32))], names=["o", "key", "v", "s"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        """Of one shard: what it has of each block's n-grams."""
        keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        keys, values = keys[by], table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, wide)[by]
        b, o, packed, v = [], [], [], []
        for block, order, blob in zip(*(asked.column(c).to_pylist() for c in ("b", "o", "keys")), strict=True):
            want = words.unpack_sorted(blob)
            place = np.searchsorted(keys, want)
            hit = place < len(keys)
            hit[hit] = keys[place[hit]] == want[hit]
            if hit.any():
                b.append(block), o.append(order), packed.append(words.pack_sorted(want[hit])), v.append(values[place[hit]].tobytes())
        return pa.table({"b": pa.array(b, pa.int32()), "o": pa.array(o, pa.int32()), "keys": pa.array(packed, pa.binary()), "v": pa.array(v, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for o, blob, v in zip(*(answers.column(c).to_pylist() for c in ("o", "keys", "v")), strict=True):
            got.setdefault(o, []).append((words.unpack_sorted(blob), np.frombuffer(v, np.float32).reshape(-1, wide)))

        def piece(o: int) -> tuple[np.ndarray, np.ndarray]:
            if o not in got:  # no n-gram or context is 0 but the context of order 1, which is always known
                return np.zeros(1, np.uint64), np.zeros((1, wide), np.float32)
            keys, values = (np.concatenate(x) for x in zip(*got[o], strict=True))
            by = np.argsort(keys)
            return keys[by], values[by]

        grams, logp = zip(*(piece(k) for k in range(1, ORDER + 1)), strict=True)
        contexts, backoff = zip(*(piece(_CONTEXT + k) for k in range(1, ORDER + 1)), strict=True)
        known = Model(languages, list(grams), list(logp), list(contexts), list(backoff), floor)
        return pa.Table.from_batches([_judge(known, part, at, len(names), schema.names) for part in _parts(table, at)]).cast(arrow)

    asked = dealt.groupBy("b").applyInArrow(tidy_groups(ask), "b int, o int, s int, keys binary")
    held = model.table.mapInArrow(shard, "o int, key long, v array<float>, s int")
    answers = asked.groupBy("o", "s").cogroup(held.groupBy("o", "s")).applyInArrow(tidy_groups(answer), "b int, o int, keys binary, v binary")
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(tidy_groups(finish), schema)


def _length_class():
    return F.floor(F.log2(F.greatest(F.col("n_symbols"), F.lit(1)))).cast("int")


def limits(scored: DataFrame) -> dict[tuple[str, int], float]:
    """Largest accepted cross-entropy by (language, length class), from scored rows that the models did not learn
    from: a row per class.  The fewer rows a class has, the wider its limit; class -1 holds the language's over all
    lengths."""
    rows = scored.where("nats IS NOT NULL").select("lang_pred", "nats", F.explode(F.array(_length_class(), F.lit(-1))).alias("class"))
    found = rows.groupBy("lang_pred", "class").agg(F.percentile_approx("nats", 1 - REJECT, 20_000).alias("most"), F.count("*").alias("n")).collect()
    return {(r["lang_pred"], r["class"]): r["most"] + SLACK * (1 + FEW / r["n"]) for r in found}


def accepted(bounds: dict[tuple[str, int], float]):
    """Whether a scored row stands: it has letters and is not beyond its class's limit.  Where the class has
    none, texts of SHORT symbols or more are held to the language's limit and shorter ones accepted."""
    if not bounds:
        return F.col("lang_pred") != "und"
    keys = F.create_map(*[F.lit(x) for (lang, k), v in sorted(bounds.items()) for x in (f"{lang}\n{k}", v)])
    own = F.try_element_at(keys, F.concat_ws("\n", "lang_pred", _length_class().cast("string")))
    general = F.when(F.col("n_symbols") >= SHORT, F.try_element_at(keys, F.concat_ws("\n", "lang_pred", F.lit("-1"))))
    limit = F.coalesce(own, general)
    return (F.col("lang_pred") != "und") & (limit.isNull() | (F.col("nats") <= limit))


def identify(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", carry: Iterable[str] = (), model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id_col, carry..., lang_pred, score, nats, n_symbols, accepted) of every row.

    Models and rejection limits are learnt from the rows where ``training`` holds and the label is not null.
    Null text, text without letters, and any text if there is nothing to learn from is und, scored 0 and not
    accepted.  Rows may repeat; an empty table gives no rows; the label and other columns are no inputs of a
    prediction.
    """
    learn = docs.where(training & F.col(label_col).isNotNull())
    apart = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(FOLDS)) == 0
    model = fit(learn.where(~apart), text_col, label_col, model_rows)
    bounds = limits(score(learn.where(apart), model, text_col, [id_col]))
    return score(docs, model, text_col, [id_col, *carry]).withColumn("accepted", accepted(bounds))
