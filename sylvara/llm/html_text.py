"""Main text of web pages.

A page is cut into blocks of text.  Blocks of an article or main element are its core, but for parts that
are marked as something else (menus, notices, comments and so on).  The core's blocks go to the page's host
as one token each, and a suffix array over the pages' streams finds the blocks that stand in the cores of a
large share of the host's pages; they are the site's and go, the others stand as they are.  The
words of all blocks outside the core go to the page's host, where a suffix array over the concatenated
token streams of its pages finds the runs that are the site's: of LEAST_RUN words on a share of the host's
pages, or of LONG_RUN words on a few.  A page without a core keeps its unmarked blocks, less the words that
such runs cover.  Pages of equal streams count as one page, so that copies of a page on its host do not make
its own text the site's; what fewer than FEW different pages share stays.

Large hosts are split into groups of pages, each with an array of its own.  A group sends the hashes of
its distinct runs of the least length, with the number of its pages that have each, to the buckets of the
host's hash ranges; a bucket adds up the groups and answers with bits.  Before that the groups settle in
the same way which of them counts a stream that several have.  So runs are counted over the whole
host, and the size of groups does not change a text.  Across groups runs are told apart by 64-bit hashes:
two different ones of a host meet with a chance of about n*n/2**65 over its n runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout, words
from .memory import tidy_groups
from .url_filter import host_and_path

LEAST_RUN = 6  # words of a repeated run
LONG_RUN = 30  # words of a run that a few pages suffice for
FEW = 3  # different pages that what is the site's is on at least
SHARE = 0.1  # their share of the host's pages, for runs under LONG_RUN words
CORE_SHARE = 0.3  # their share of the host's pages with a core, for blocks of a core
GROUP_PAGES = 256
_HOT_HOSTS = 20_000  # broadcast the sizes of large hosts up to so many of them

# Fixed sets of HTML element names.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav footer aside form select textarea button menu dialog noscript template iframe object canvas svg audio video map datalist".split())
_RAW = frozenset("script style".split())
_CORE = frozenset("article main".split())
# Words of class, id and role that mark what is not the article: by what it says, and by where it stands.
_SAYS = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus promo promos promotion related replies reply respond share sharing social sponsor sponsored subscribe newsletter notice notices".split())
_STANDS = frozenset("alert banner breadcrumb breadcrumbs complementary contentinfo footer header masthead menu modal nav navbar navigation popup search sidebar toolbar widget widgets".split())
# Words that may stand beside them in a name; with any other word the name is about something else.
_BESIDE = frozenset("area bar block body bottom box button buttons center col column container content desktop entry form global google group inner item items left links list main message mobile node page panel post posts primary right row secondary section site slot small sticky text title toggle top unit wrap wrapper".split())
_WORD = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _marks(attributes: str, name: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, and whether its class, id or role marks it by what it says or by where it stands.

    A name counts as a whole: one of the marking words, alone or beside structural ones ("site-header", "comment-list"),
    but not "no-sidebar", "comments-closed" or an identifier made from a title."""
    hidden = says = stands = False
    if not attributes or attributes.isspace():
        return hidden, says, stands
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        if key in ("class", "id", "role") and name not in ("html", "body"):
            for token in value.split():
                parts = {x.lower() for x in _WORD.split(token) if x and not x.isdigit()}
                if parts <= _SAYS | _STANDS | _BESIDE:
                    says |= not parts.isdisjoint(_SAYS)
                    stands |= not parts.isdisjoint(_STANDS)
    return hidden, says, stands


@dataclass
class _Place:
    """What the open elements say of the text in them: counts of those that do, and of those when the core began."""

    core: int = 0
    hard: int = 0  # elements that hold no article, and hidden ones
    says: int = 0
    stands: int = 0
    before: tuple[int, int] = (0, 0)

    def marked(self) -> int:
        """0: none; 1: by names alone; 2: by an element or hidden.  Names on a core or around it do not mark it by where
        they stand, nor those on and around main by what they say."""
        return 2 if self.hard else int(self.says > self.before[0] or self.stands > self.before[1])

    def into(self, name: str, attributes: str) -> _Place:
        hidden, says, stands = _marks(attributes, name)
        hard = hidden or name in _DROP or (name == "header" and not self.core)
        core = name in _CORE
        out = _Place(self.core + core, self.hard + hard, self.says + says, self.stands + stands, self.before)
        if core and not self.core:
            out.before = (out.says if name == "main" else 0, out.stands)
        return out


def blocks(html: str) -> list[tuple[str, bool, int]]:
    """(text, in the core, how marked as something else) of each block in page order; no empty ones."""
    found: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, _Place]] = []  # element, and the place around it
    now, at = _Place(), 0
    text: list[str] = []

    def close() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                found.append((whole, now.core > 0, now.marked()))

    size, low = len(html), None
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS or name in _DROP:
            close()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    now = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            low = html.lower() if low is None else low
            end = low.find("</" + name, at)
            at = size if end < 0 else end
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if name in _PARAGRAPHS:  # an open paragraph ends where another begins
            while stack and stack[-1][0] in ("b", "i", "em", "strong", "a", "span", "u", "small", "font", "p") and any(s[0] == "p" for s in stack):
                now = stack.pop()[1]
        stack.append((name, now))
        now = now.into(name, m[3])
    if at < size:
        text.append(html[at:])
    close()
    return found


def parts(html: str) -> tuple[list[str] | None, list[tuple[str, bool]]]:
    """The core's blocks, null without any, and the others with whether each is marked.

    A page whose core is marked by names alone keeps that core, and one where names mark everything outside
    of menus, forms and so on counts as unmarked there."""
    found = blocks(html)
    for most in (0, 1):
        core = [t for t, inside, marked in found if inside and marked <= most]
        if core:
            return core, [(t, marked > 0) for t, inside, marked in found if not inside]
    least = 0 if any(marked == 0 for _, _, marked in found) else 1
    return None, [(t, marked > least) for t, _, marked in found]


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and, for each, the length it shares with the one before it (0 for the first), by prefix doubling.

    With a depth, order and lengths only regard that many tokens at least; longer lengths may come out shorter, not below it."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, k = [rank.astype(np.int64)], 1
    while k < (n if depth is None else min(n, depth)) and int(levels[-1].max()) < n - 1:
        now = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - k] = now[k:] + 1
        levels.append(np.unique(now * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        fits = (a + step <= n) & (b + step <= n)
        same = np.zeros(len(a), bool)
        same[fits] = levels[level][a[fits]] == levels[level][b[fits]]
        shared[1:][same] += step
        a[same] += step
        b[same] += step
    return order, shared


@dataclass
class Runs:
    """The runs of ``least`` tokens in the streams of some pages."""

    least: int
    bounds: np.ndarray  # where each page's tokens begin, and the end of all
    at: np.ndarray  # where a run begins
    of: np.ndarray  # which distinct run that is
    hashes: np.ndarray  # of the distinct runs, ascending
    pages: np.ndarray  # in how many pages that count each distinct run is
    counts: np.ndarray  # which pages count

    def cover(self, hit: np.ndarray, long: int = 0) -> np.ndarray:
        """Which tokens lie in one of the distinct runs that hit marks, where those join to ``long`` tokens or more."""
        step = np.zeros(int(self.bounds[-1]) + 1, np.int64)
        begin = self.at[hit[self.of]]
        if long > self.least and len(begin):
            chain = np.cumsum(np.concatenate(([True], np.diff(begin) != 1))) - 1
            begin = begin[np.bincount(chain)[chain] + self.least - 1 >= long]
        np.add.at(step, begin, 1)
        np.add.at(step, begin + self.least, -1)
        return np.cumsum(step[:-1]) > 0


def find_runs(tokens: np.ndarray, bounds: np.ndarray, least: int, counts: np.ndarray | None = None) -> Runs:
    """The runs of pages' token hashes, told apart by a suffix array over the streams; counts: which pages count, else all."""
    n, at = len(bounds) - 1, words.fixed_windows(bounds, least)
    counts = np.ones(n, bool) if counts is None else counts
    if not len(at):
        return Runs(least, bounds, at, at, np.zeros(0, np.uint64), at, counts)
    page = np.repeat(np.arange(n), np.diff(bounds))
    place = np.arange(len(tokens)) + page
    line = np.empty(len(tokens) + n, np.int64)
    line[place] = np.unique(tokens, return_inverse=True)[1]
    line[bounds[1:] + np.arange(n)] = -1 - np.arange(n)  # a page's end is like no other token
    order, shared = suffix_array(line, least)
    group = np.empty(len(line), np.int64)
    group[order] = np.cumsum(shared < least)  # neighbours that share the first tokens are one run
    _, first, of = np.unique(group[place[at]], return_index=True, return_inverse=True)
    hashes = words.hash_windows(tokens, at, at + least)[first]
    ranks = np.empty(len(first), np.int64)
    ranks[np.argsort(hashes, kind="stable")] = np.arange(len(first))
    of = ranks[of]
    pairs = np.unique((of * n + page[at])[counts[page[at]]])
    return Runs(least, bounds, at, of, np.sort(hashes), np.bincount(pairs // n, minlength=len(first)), counts)


def repeated(streams: list[list[str]], least: int = LEAST_RUN) -> list[np.ndarray]:
    """For each page's stream, which words lie in a run of ``least`` words or more that another page has too."""
    runs = find_runs(*_word_hashes([" ".join(x) for x in streams]), least)
    return np.split(runs.cover(runs.pages > 1), runs.bounds[1:-1])


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return words.hash_words(*words.text_buffers(pa.array(texts, pa.large_string())))


def _long_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """A block's covered words, less what a run over a block's edge leaves of fewer than ``least`` words in it."""
    if inside.all() or not inside.any():
        return inside
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    out = inside.copy()
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out[a:b] = b - a >= least
    return out


def _buckets(groups: int) -> int:
    """Hash ranges of a host: rows and sizes of buckets both grow slower than its groups."""
    return max(1, 2 * isqrt(groups))


def _tokens(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and bounds of the pages' words outside the core, and of their cores' blocks."""
    outer = _word_hashes([" ".join(row) for row in table.column("outer").to_pylist()])
    core = [row or () for row in table.column("core").to_pylist()]
    hashes, bounds = _word_hashes([b for row in core for b in row])
    return [outer, (words.hash_windows(hashes, bounds[:-1], bounds[1:]), np.cumsum([0, *map(len, core)]))]


def _different(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different streams, ascending, and the first page of each; empty ones are none."""
    some = np.flatnonzero(np.diff(bounds))
    prints, first = np.unique(words.hash_windows(tokens, bounds[some], bounds[some + 1]), return_index=True)
    return prints, some[first]


def _ranges(hashes: np.ndarray, groups: int) -> np.ndarray:
    buckets = _buckets(groups)
    return np.searchsorted(words.bucket_of(hashes, buckets), np.arange(buckets + 1))


def _streams(table: pa.Table) -> pa.Table:
    """Of one group: hashes of its different streams by hash range, none if it is the whole host."""
    host, part, groups = (table.column(c)[0].as_py() for c in ("host", "part", "groups"))
    rows = []
    for kind, one in enumerate(_tokens(table) if groups > 1 else ()):
        prints, _ = _different(*one)
        to = _ranges(prints, groups)
        rows += [(kind, k, words.pack_sorted(prints[to[k] : to[k + 1]])) for k in np.flatnonzero(np.diff(to)).tolist()]
    kind, bucket, prints = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"host": pa.array([host] * len(rows), pa.string()), "part": pa.array([part] * len(rows), pa.int32()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "prints": pa.array(prints, pa.binary())})


def _answer(table: pa.Table, marks: list[np.ndarray]) -> pa.Table:
    """Bits for the groups of one hash range of a host; no row for a group without any."""
    host, kind, bucket = (table.column(c)[0].as_py() for c in ("host", "kind", "bucket"))
    some = [k for k, x in enumerate(marks) if x.any()]
    parts = table.column("part").to_pylist()
    return pa.table({"host": pa.array([host] * len(some), pa.string()), "part": pa.array([parts[k] for k in some], pa.int32()), "kind": pa.array([kind] * len(some), pa.int32()), "bucket": pa.array([bucket] * len(some), pa.int32()), "bits": pa.array([np.packbits(marks[k]).tobytes() for k in some], pa.binary())})


def _elsewhere(table: pa.Table) -> pa.Table:
    """Of one hash range of a host: which streams of each group another group counts, that of the lowest number."""
    blobs = [words.unpack_sorted(x) for x in table.column("prints").to_pylist()]
    parts = np.array(table.column("part").to_pylist(), np.int64)
    every, size = np.concatenate(blobs), np.array([len(x) for x in blobs])
    part = np.repeat(parts, size)
    known, of = np.unique(every, return_inverse=True)
    lowest = np.full(len(known), parts.max())
    np.minimum.at(lowest, of, part)
    return _answer(table, np.split(part != lowest[of], np.cumsum(size)[:-1]))


def _bits(to: np.ndarray, kind: int, answers: pa.Table, out: np.ndarray) -> np.ndarray:
    """What the hash ranges answered for a kind; out has a row per bit of an entry."""
    for own, k, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
        if own == kind:
            lo, hi = to[k : k + 2].tolist()
            out[:, lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(out) * (hi - lo)).reshape(len(out), -1)
    return out


def _runs(table: pa.Table, least: int, elsewhere: pa.Table | None = None) -> list[Runs]:
    """Of the words outside the core, and of the core's blocks; equal streams count as one page."""
    found = []
    for kind, (tokens, bounds) in enumerate(_tokens(table)):
        prints, first = _different(tokens, bounds)
        if elsewhere is not None and elsewhere.num_rows:
            to = _ranges(prints, table.column("groups")[0].as_py())
            first = first[~_bits(to, kind, elsewhere, np.zeros((1, len(prints)), bool))[0]]
        counts = np.zeros(len(bounds) - 1, bool)
        counts[first] = True
        found.append(find_runs(tokens, bounds, least if kind == 0 else 1, counts))
    return found


def _site(kind: int, pages: np.ndarray, streams: int) -> np.ndarray:
    """Which runs are the site's, by how many of the host's different streams have them: on a share of them (first row), on a few (second)."""
    return np.stack((pages >= max(FEW, ceil((CORE_SHARE if kind else SHARE) * streams)), pages >= FEW))


def _send(least: int):
    def send(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
        """Of one group: its distinct runs by hash range, none if it is the whole host."""
        host, part, groups = (table.column(c)[0].as_py() for c in ("host", "part", "groups"))
        rows = []
        for kind, runs in enumerate(_runs(table, least, elsewhere) if groups > 1 else ()):
            to = _ranges(runs.hashes, groups)
            for k in range(len(to) - 1):  # each range, as the streams count everywhere
                pages = runs.pages[to[k] : to[k + 1]]
                odd = np.flatnonzero(pages != 1)
                rows.append((kind, k, int(runs.counts.sum()), words.pack_sorted(runs.hashes[to[k] : to[k + 1]]), odd.astype("<i4").tobytes(), pages[odd].astype("<i4").tobytes()))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([host] * len(rows), pa.string()), pa.array([part] * len(rows), pa.int32()), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["host", "part", "kind", "bucket", "streams", "hashes", "odd", "pages"])

    return send


_SENT = "host string, part int, kind int, bucket int, streams long, hashes binary, odd binary, pages binary"


def _count(table: pa.Table) -> pa.Table:
    """Of one hash range of a host: which runs of each group are the site's."""
    blobs = [words.unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    pages = []
    for blob, odd, n in zip(blobs, table.column("odd").to_pylist(), table.column("pages").to_pylist(), strict=True):
        pages.append(np.ones(len(blob), np.int64))
        pages[-1][np.frombuffer(odd, "<i4")] = np.frombuffer(n, "<i4")
    known, of = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(pages), minlength=len(known)).astype(np.int64)
    site = _site(table.column("kind")[0].as_py(), total, sum(table.column("streams").to_pylist()))
    return _answer(table, np.split(site[:, of], np.cumsum([len(x) for x in blobs])[:-1], axis=1))


_ANSWERS = "host string, part int, kind int, bucket int, bits binary"


def _gone(runs: list[Runs], groups: int, answers: pa.Table) -> list[list[np.ndarray]]:
    """Which words outside the core and which blocks of the core are the site's, page by page."""
    out = []
    for kind, x in enumerate(runs):
        if groups == 1:
            share, few = _site(kind, x.pages, int(x.counts.sum()))
        else:
            share, few = _bits(_ranges(x.hashes, groups), kind, answers, np.zeros((2, len(x.hashes)), bool))
        gone = x.cover(share)
        if kind == 0:
            gone |= x.cover(few, LONG_RUN)
        out.append(np.split(gone, x.bounds[1:-1]))
    return out


def _settle(least: int):
    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        core = table.column("core").to_pylist()
        outer = table.column("outer").to_pylist()
        marked = table.column("marked").to_pylist()
        gone = _gone(_runs(table, least), table.column("groups")[0].as_py(), answers)
        texts = []
        for own, row, off, words_gone, blocks_gone in zip(core, outer, marked, *gone, strict=True):
            if own is not None:
                texts.append("\n".join(b for b, x in zip(own, blocks_gone.tolist(), strict=True) if not x))
                continue
            kept, at = [], 0
            for block, odd in zip((b.split(" ") for b in row), off, strict=True):
                stay = _long_runs(words_gone[at : at + len(block)], least)
                at += len(block)
                if not odd and not stay.all():
                    kept.append(" ".join(w for w, x in zip(block, stay.tolist(), strict=True) if not x))
            texts.append("\n".join(kept))
        names = [c for c in table.column_names if c.startswith("c") and c[1:].isdigit()]
        return table.select(names).append_column("text", pa.array(texts, pa.string()))

    return settle


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: Iterable[str] = (), least: int = LEAST_RUN, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(id_col, url_col, carry..., text) of every page; blocks are joined by line feeds, empty if there are none.

    Null html is empty; a null or odd URL has the empty host.  Pages may repeat: a page's copy on the same
    host has a row of its own, but counts as one page with it.  An empty table gives no rows; other columns are ignored.
    """
    names = [id_col, url_col, *carry]
    spark = pages.sparkSession
    host = host_and_path(F.col(url_col).cast("string"))[0]
    schema = T.StructType([T.StructField(f"c{k}", pages.schema[c].dataType) for k, c in enumerate(names)] + [T.StructField("host", T.StringType()), T.StructField("spread", T.IntegerType()), T.StructField("core", T.ArrayType(T.StringType())), T.StructField("outer", T.ArrayType(T.StringType())), T.StructField("marked", T.ArrayType(T.BooleanType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, outer, marked = [], [], []
            for html in batch.column("html").to_pylist():
                inner, rest = parts(html or "")
                core.append(inner)
                outer.append([t for t, _ in rest])
                marked.append([b for _, b in rest])
            yield pa.record_batch([*batch.columns[:-1], pa.array(core, pa.list_(pa.string())), pa.array(outer, pa.list_(pa.string())), pa.array(marked, pa.list_(pa.bool_()))], names=schema.names)

    large = pages.select(host.alias("host")).groupBy("host").count().where(F.col("count") > group_pages).select("host", F.ceil(F.col("count") / group_pages).cast("int").alias("groups"))
    rows = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], host.alias("host"), F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(1 << 30)).cast("int").alias("spread"), F.col(html_col).cast("string").alias("html"))
    parsed = rows.mapInArrow(parse, schema)
    few = large.count() <= _HOT_HOSTS
    parsed = parsed.join(F.broadcast(large) if few else large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("part", F.pmod("spread", "groups")).drop("spread")
    out = T.StructType([T.StructField(f"c{k}", pages.schema[c].dataType) for k, c in enumerate(names)] + [T.StructField("text", T.StringType())])
    dealt = parsed.repartition(layout.shuffle_partitions(spark), "host", "part")
    streams = dealt.groupBy("host", "part").applyInArrow(tidy_groups(_streams), "host string, part int, kind int, bucket int, prints binary")
    elsewhere = streams.groupBy("host", "kind", "bucket").applyInArrow(tidy_groups(_elsewhere), _ANSWERS)
    sent = dealt.groupBy("host", "part").cogroup(elsewhere.groupBy("host", "part")).applyInArrow(tidy_groups(_send(least)), _SENT)
    answers = sent.groupBy("host", "kind", "bucket").applyInArrow(tidy_groups(_count), _ANSWERS)
    return dealt.groupBy("host", "part").cogroup(answers.groupBy("host", "part")).applyInArrow(tidy_groups(_settle(least)), out).toDF(*names, "text")
