"""Operators on pages, and the pipeline."""

import hashlib
import math
import os
import random
from html.parser import HTMLParser

import pytest

PAGES = "page_id long, url string, html string, host string, core string, c0 int, u string, v int"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash", "clash", 1, "clash", 2) for k, (u, h) in enumerate(rows)], PAGES)


def test_html_blocks():
    from sylvara.llm.html_text import blocks

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">cookies</div><!-- <p>gone</p> -->
    <article class="post"><h1>Head &amp; more</h1><p><b>One <i>two</i><br>three<p>four&nbsp;  five</p><ul><li>six<li>seven</ul>
    <aside>side</aside><form><p>mail</p></form><div class="ad">buy</div><section id="comments"><p>first!</p></section></article>
    <div class="sidebar"><p>links</p></div><footer>&copy; us</footer></body></html>"""
    kept = [t for t, core, marked in blocks(page) if core and not marked]
    assert kept == ["Head & more", "One two three", "four five", "six", "seven"]
    assert all(marked for t, core, marked in blocks(page) if not core)
    assert blocks("") == [] and blocks("plain &lt; text") == [("plain < text", False, False)]
    assert [t for t, *_ in blocks("<p>a<script>never closed <p>b")] == ["a"]
    assert [t for t, *_ in blocks("<p title='a>b'>c</p><p")] == ["c", "<p"]


STORY = "<p>The story is here.</p>"
NAMED = [
    (f"<article class='post no-sidebar has-comments'>{STORY}</article>", ["The story is here."]),
    (f"<article id='alert-systems-explained' class='comments-closed'>{STORY}</article>", ["The story is here."]),
    (f"<div class='sidebar widget'><article class='widget'>{STORY}<div class='siteHeader'>top</div></article></div>", ["The story is here."]),
    (f"<main class='comments'>{STORY}<div class='comment-list'><p>Nice!</p></div></main>", ["The story is here."]),
    (f"<article>{STORY}</article><div id='comments'><article class='comment-body'><p>Nice!</p></article></div>", ["The story is here."]),
    (f"<article>{STORY}<div class='ad-slot-2'>buy</div><aside>more</aside></article><div class='related'><article><p>other</p></article></div>", ["The story is here."]),
    (f"<article class='comment'>{STORY}</article>", ["The story is here."]),
    (f"<nav>menu</nav><div class='page-sidebar'>{STORY}</div>", None),
    ("<nav>menu</nav>", None),
]


@pytest.mark.parametrize("page, core", NAMED, ids=range(len(NAMED)))
def test_html_names(page, core):
    """Names mark as wholes, and never a whole page."""
    from sylvara.llm.html_text import parts

    got, rest = parts(page)
    assert got == core
    if core is None:
        assert [t for t, marked in rest if not marked] == (["The story is here."] if STORY in page else [])


def test_html_names_and_case(spark):
    """Very long pages, repeated rows and ties in one run."""
    from sylvara.llm.html_text import extract

    long = "<article>" + "".join(f"<p>line {k} of the long page</p>" for k in range(30_000)) + "</article>"
    rows = [("http://a.example/1", long)] * 3 + [("http://a.example/2", "<article><p>short</p></article>")] * 2
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got[0] == got[1] == got[2] == "\n".join(f"line {k} of the long page" for k in range(30_000)) and got[3] == got[4] == "short"


DATA = "/root/testdata/sf0.001"


class _Article(HTMLParser):
    """The text blocks of article elements by the standard library's parser, for pages whose articles hold no other parts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.depth, self.skip = [], [], 0, 0

    def _break(self):
        whole = " ".join("".join(self.now).split())
        self.now = []
        if whole:
            self.blocks.append(whole)

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "table", "tr", "td", "th", "pre", "blockquote", "article", "section"):
            self._break()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "table", "tr", "td", "th", "pre", "blockquote", "article", "section"):
            self._break()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now.append(data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_html_query_against_the_standard_library(spark):
    """Every row of the query: the article of the page as another parser reads it."""
    from sylvara.llm.queries import op2_html_text

    got = {r["page_id"]: r for r in op2_html_text(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        plain = _Article()
        plain.feed(r["html"] or "")
        plain.close()
        assert got[r["page_id"]]["text"] == "\n".join(plain.blocks) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_url_query_against_a_walk_of_the_trees(spark):
    """Every row of the query: features in Python, the fitted trees walked node by node, and the calibrated limit."""
    from pyspark.sql import functions as F

    from sylvara.llm import url_filter

    rows, limit = url_filter._scored(spark.read.parquet(f"{DATA}/pages.parquet"), "page_id", "url", url_filter.RULES)
    got = rows.select("u", "h", "p", "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "secure", "suffix_length", F.col("r.verdict").alias("v"), "fold", "s", "suffix_blocked", "margin").collect()
    stats = {}
    for r in got:
        if r["v"]:
            for k in range(url_filter.FOLDS - 1):
                if r["fold"] == k:
                    own = stats.setdefault((r["s"], k), [0, 0])
                    own[0] += r["v"] == "block"
                    own[1] += 1
    for r in got:
        u, h, p = r["u"], r["h"], r["p"]
        share = [u.count(c) / len(u) for c in set(u)]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u.split("#")[0] else ""
        want = (len(u), len(h), len(p), len([x for x in p.split("/") if x]), len(h.split(".")), sum(c.isdigit() for c in u) / len(u), -sum(x * math.log2(x) for x in share), len(query.split("&")) if query else 0, int("#" in u), u.count("-"), int(u.startswith("https:")), len(h.split(".")[-1]))
        assert [r[k] for k in ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "secure", "suffix_length")] == pytest.approx(want), u
        known = [stats[k] for k in stats if k[0] == r["s"] and not (r["v"] and r["fold"] == k[1])]
        assert r["suffix_blocked"] == pytest.approx((sum(b for b, _ in known) + url_filter.PRIOR_ROWS / 2) / (sum(n for _, n in known) + url_filter.PRIOR_ROWS))
    outer = sorted(r["margin"] for r in got if r["v"] == "allow" and r["fold"] == url_filter.FOLDS - 1)
    assert limit == pytest.approx(max(0.0, outer[math.ceil((1 - url_filter.FALSE_BLOCK) * len(outer)) - 1]))
    verdicts = {r["page_id"]: r for r in url_filter.judge(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for r in verdicts.values():
        assert r["rule"] is not None or (r["verdict"] == "block") == (r["margin"] > limit)


def test_suffix_array():
    import numpy as np

    from sylvara.llm.html_text import repeated, suffix_array

    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (50, 1), (60, 2), (200, 3), (120, 90)):
        line = rng.integers(0, kinds, n)
        order, shared = suffix_array(line)
        suffixes = [line[k:].tolist() for k in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda k: suffixes[k])
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rand = random.Random(4)
    for _ in range(30):
        streams = [[rand.choice("abc") for _ in range(rand.randint(0, 25))] for _ in range(rand.randint(1, 5))]
        got = repeated(streams, 4)
        seen = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - 3):
                seen.setdefault(tuple(s[i : i + 4]), set()).add(k)
        for s, own in zip(streams, got):
            want = [False] * len(s)
            for i in range(len(s) - 3):
                if len(seen[tuple(s[i : i + 4])]) > 1:
                    want[i : i + 4] = [True] * 4
            assert own.tolist() == want


def test_html_extraction(spark):
    from sylvara.llm.html_text import extract

    menu = "<div>Home News Sport Weather Contact Imprint Login</div>"
    rows = [(f"http://a.example/{k}", f"<body>{menu}<div>unique words of page {k} are here</div><div>{'shared tail of every page on host'}</div></body>") for k in range(9)]
    rows += [("http://b.example/1", f"<body>{menu}<div>alone on its host</div></body>"), (None, None), ("no scheme", ""), ("http://a.example/x", "<nav>menu</nav><article><h1>H</h1><p>shared tail of every page on host</p></article>")]
    for group in (256, 3):
        got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows), group_pages=group).collect()}
        assert len(got) == len(rows)
        assert got[9] == "Home News Sport Weather Contact Imprint Login\nalone on its host" and got[10] == got[11] == ""
        assert got[12] == "H\nshared tail of every page on host"
        if group == 256:
            assert [got[k] for k in range(9)] == [f"unique words of page {k} are here" for k in range(9)]
    assert extract(pages(spark, [])).collect() == []


def test_html_groups(spark):
    """Runs are counted over a whole host: the size of groups does not change a text."""
    from sylvara.llm.html_text import extract

    tail = "this line stands at the end of some pages"
    rows = [(f"http://a.example/{k}", f"<div>alone {k} on page {k} of host {k} with words {k}</div>" + (f"<div>{tail}</div>" if k % 8 == 0 else "")) for k in range(40)]
    want = {k: f"alone {k} on page {k} of host {k} with words {k}" for k in range(40)}
    for group in (256, 7, 2, 1):
        assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows), group_pages=group).collect()} == want


def test_html_core_boilerplate(spark):
    """Blocks in the cores of most pages of a host go, whatever the size of groups; those of a few stay."""
    from sylvara.llm.html_text import extract

    line = lambda k: "<p>Subscribe now</p>" * (k != 3) + "<p>shared by two</p>" * (k in (4, 5))
    rows = [(f"http://a.example/{k}", f"<article><p>story {k}</p>{line(k)}</article><nav>menu</nav>") for k in range(9)]
    rows += [("http://b.example/1", "<article><p>Subscribe now</p></article>")]
    want = {k: f"story {k}" + "\nshared by two" * (k in (4, 5)) for k in range(9)} | {9: "Subscribe now"}
    for group in (256, 4, 1):
        assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows), group_pages=group).collect()} == want


def test_html_copies(spark):
    """Copies of a page and what two pages share stay; long runs on a few pages and short ones on many go."""
    from sylvara.llm.html_text import extract

    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    twice, long, menu = "a phrase of seven words in both", " ".join(f"credit{i}" for i in range(35)), "Home News Sport Weather Contact Imprint Login"
    body = lambda k: f"<p>{own(k, 12)}</p>" + f"<p>{twice}</p>" * (k in (1, 2)) + f"<p>{long}</p>" * (k in (3, 4, 5)) + f"<div>{menu}</div>"
    rows = [(f"http://a.example/{k}", body(k)) for k in range(40)] + [(f"http://a.example/copy{k}", body(0)) for k in range(20)]
    rows += [(f"http://b.example/{k}", f"<p>{own(99, 50)}</p>") for k in range(12)]
    want = {k: own(k, 12) + f"\n{twice}" * (k in (1, 2)) for k in range(40)} | {k: own(0, 12) for k in range(40, 60)} | {k: own(99, 50) for k in range(60, 72)}
    for group in (256, 9, 1):
        assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows), group_pages=group).collect()} == want


def rule_of(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_url_filter(spark):
    from sylvara.llm.url_filter import RULES, judge

    urls = [None, "", "nothing", "http://", "HTTP://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/1?q=1", "http://notexample.com/en/", "http://com", "http://com/", "http://x.com?y=/en/", "http://x.com#z", "http://ÄB.net/es/1", "http://x.net/esx", "a://b://c.com/", "http://x.net/fr/é?a=1&b=2#c", "http://x.org/en/9"] * 2
    urls += [f"https://{'blog.' if k % 3 else ''}h{k % 17}.example.{('com', 'net', 'org')[k % 3]}/{('en', 'es', 'fr', 'de')[k % 4]}/{k * 37 % 1000}{'?page=2&ref=x' if k % 5 == 0 else ''}" for k in range(400)]
    got = {r["page_id"]: r for r in judge(pages(spark, [(u, None) for u in urls])).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, (rule, verdict) = rule_of(u, RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] in ("allow", "block") and (verdict is None or got[k]["verdict"] == verdict)
    plan = judge(pages(spark, [(u, None) for u in urls]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_trees_learn(spark):
    """Held-out accuracy: the trees tell the shapes of rule-labelled URLs apart."""
    from pyspark.sql import functions as F

    from sylvara.llm.url_filter import judge

    rng = random.Random(6)
    rules = (("good.test/", "allow"), ("bad.test/", "block"))
    rows = []
    for k in range(600):
        bad = k % 2
        tail = "".join(rng.choices("0123456789", k=20)) + "?a=1&b=2&c=3" if bad else "".join(rng.choices("abcdef", k=8))
        host = ("bad.test" if bad else "good.test") if k % 3 else "other.test"
        rows.append((f"https://{host}/{tail}", None))
    out = judge(pages(spark, rows), rules=rules).where("rule IS NULL").withColumn("bad", F.col("page_id") % 2 == 1)
    assert out.where((F.col("verdict") == "block") != F.col("bad")).count() == 0
    assert judge(pages(spark, [])).collect() == []
    assert {r["verdict"] for r in judge(pages(spark, rows), rules=()).collect()} == {"allow"}


def test_warc(spark):
    import gzip

    from sylvara.llm import warc

    rows = [("http://a/1", "<html><head><title>T</title><script>x</script></head><body><p>One &amp; two</p><p>three<br>four</body>"), (None, None), ("http://b/\r\nX-Evil: 1", "é"), ("http://a/1", "<p>again</p>")]
    files = warc.page_responses(pages(spark, rows))
    out = warc.derivatives(files).collect()
    assert len(out) == 2 * len(rows) and len({r["record_id"] for r in out}) == len(out)
    responses = {r["page_id"]: bytes(r["warc"]) for r in files.collect()}
    for r in out:
        ((headers, block),) = warc.read_records(bytes(r["record"]))
        of = dict(headers)
        ((source, body),) = warc.read_records(responses[r["page_id"]])
        about = dict(source)
        assert of["WARC-Type"] == r["record_type"] and of["WARC-Refers-To"] == about["WARC-Record-ID"] == r["source_id"] and "X-Evil" not in of
        assert of["WARC-Target-URI"] == about["WARC-Target-URI"] and of["WARC-Block-Digest"] == warc.digest(block) and int(of["Content-Length"]) == len(block)
        if r["record_type"] == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
            assert fields["source-payload-digest"] == about["WARC-Payload-Digest"] and fields["http-header-content-type"] == "text/html; charset=utf-8" and fields["source-warc-type"] == "response"
        elif r["page_id"] == 0:
            assert block.decode() == "T\nOne & two\nthree\nfour"
    whole = responses[0] + warc.record([("WARC-Type", "request")], b"GET /") + responses[3]
    odd = spark.createDataFrame([(1, gzip.compress(whole)), (2, None), (3, responses[0] + b"junk"), (4, b""), (5, responses[0][:-10])], "page_id long, warc binary")
    got = sorted((r["page_id"], r["record_type"] or "problem") for r in warc.derivatives(odd).collect())
    assert got == [(1, "conversion"), (1, "conversion"), (1, "metadata"), (1, "metadata"), (3, "conversion"), (3, "metadata"), (3, "problem"), (5, "problem")]
    assert warc.derivatives(warc.page_responses(pages(spark, []))).collect() == []


class _Whole(HTMLParser):
    """All text of a page, a line per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag not in ("a", "b", "i", "em", "strong", "span", "script", "style", "meta"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag not in ("a", "b", "i", "em", "strong", "span", "script", "style"):
            self.text.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data.replace("\n", " ").replace("\r", " "))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_warc_query_against_the_standard_library(spark):
    """Every record of the query, read as a message and compared with the page as another parser reads it."""
    import base64
    from email.parser import BytesParser

    from sylvara.llm import warc
    from sylvara.llm.queries import op6_warc

    table = spark.read.parquet(f"{DATA}/pages.parquet")
    pages_of = {r["page_id"]: r for r in table.collect()}
    rows = warc.derivatives(warc.page_responses(table)).collect()
    query = {(r["page_id"], r["record_type"]): r for r in op6_warc(spark, DATA).collect()}
    assert len(rows) == len(query) == 2 * len(pages_of)
    for r in rows:
        raw, page = bytes(r["record"]), pages_of[r["page_id"]]
        line, rest = raw.split(b"\r\n", 1)
        head, block = rest.split(b"\r\n\r\n", 1)
        of = BytesParser().parsebytes(head + b"\r\n\r\n", headersonly=True)
        assert line == b"WARC/1.1" and block.endswith(b"\r\n\r\n") and len(block) - 4 == int(of["Content-Length"])
        block = block[:-4]
        assert of["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and of["WARC-Target-URI"] == page["url"]
        got = query[r["page_id"], r["record_type"]]
        assert got["record_sha256"] == hashlib.sha256(raw).hexdigest() and got["n_bytes"] == len(raw) and got["record_id"] == of["WARC-Record-ID"] and got["source_id"] == of["WARC-Refers-To"]
        if r["record_type"] == "conversion":
            plain = _Whole()
            plain.feed(page["html"])
            plain.close()
            lines = (" ".join(x.split()) for x in "".join(plain.text).split("\n"))
            assert block.decode() == "\n".join(x for x in lines if x)
        else:
            assert f"source-payload-digest: sha1:{base64.b32encode(hashlib.sha1(page['html'].encode()).digest()).decode()}\r\n" in block.decode()


def test_warc_damage(spark):
    """Of damaged files, all records before the fault; nothing raises, whatever is cut off or flipped."""
    import gzip

    from sylvara.llm import warc

    pages_of = [warc.response(f"http://a/{k}", f"<p>page {k} {'x' * 40}</p>", str(k)) for k in range(6)]
    members = [gzip.compress(x) for x in pages_of]
    plain, packed = b"".join(pages_of), b"".join(members)
    ends = [sum(map(len, members[: k + 1])) for k in range(6)]
    rng, files = random.Random(3), []
    for cut in [*ends, *rng.sample(range(len(packed)), 30)]:
        files.append((packed[:cut], sum(e <= cut for e in ends)))
    for at in rng.sample(range(len(packed)), 40):
        files.append((packed[:at] + bytes([packed[at] ^ 0x55]) + packed[at + 1 :], sum(e <= at for e in ends)))
    for at in rng.sample(range(len(plain)), 30):
        files.append((plain[:at] + bytes([plain[at] ^ 0x55]) + plain[at + 1 :], 0))
    files.append((gzip.compress(plain)[:-4], 6))
    odd = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(files)], "page_id long, warc binary")
    found = {}
    for r in warc.derivatives(odd).collect():
        found.setdefault(r["page_id"], []).append(r["record_type"])
    for k, (_, least) in enumerate(files):
        assert found.get(k, []).count("conversion") >= least


def test_warc_bodies():
    """Transfer and content codings are undone, odd charsets replaced, unknown codings told."""
    import gzip
    import zlib

    from sylvara.llm import warc

    html = "<p>naïve text</p>" * 3

    def converted(body, *http, kind="text/html"):
        head = "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: {kind}", *http]).encode()
        made = warc.derive([("WARC-Record-ID", "<r>")], head + b"\r\n\r\n" + body)
        ((_, block),) = warc.read_records(dict((w, d) for w, _, d in made)["conversion"])
        return block.decode()

    raw, want = html.encode(), "\n".join(["naïve text"] * 3)
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(raw[k : k + 7]), raw[k : k + 7]) for k in range(0, len(raw), 7)) + b"0\r\n\r\n"
    packed = gzip.compress(raw)
    assert converted(raw) == converted(chunks, "Transfer-Encoding: chunked") == want
    assert converted(raw, "Transfer-Encoding: chunked") == converted(raw, "Content-Encoding: gzip") == want  # undone before, header kept
    assert converted(packed, "Content-Encoding: GZIP") == converted(zlib.compress(raw), "Content-Encoding: deflate") == converted(zlib.compress(raw)[2:-4], "Content-Encoding: deflate") == want
    assert converted(b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed), "Transfer-Encoding: chunked", "Content-Encoding: gzip") == want
    assert converted(packed[:-8], "Content-Encoding: gzip") == want and "na" in converted(packed[:20] + b"\xff" * 30, "Content-Encoding: gzip") + "na"
    for charset in ("idna", "undefined", "rot13", "zip", "nonsense", "utf-16-le-bom"):
        assert converted(raw, kind=f"text/html; charset={charset}")
    assert converted(html.encode("latin-1"), kind="text/html; charset=ISO-8859-1") == want
    with pytest.raises(ValueError, match="br"):
        converted(raw, "Content-Encoding: br")


def test_warc_bad_record_does_not_end_the_file(spark):
    from sylvara.llm import warc

    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxx"
    bad = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<bad>")], head)
    whole = warc.response("http://a/1", "<p>one</p>", "1") + bad + warc.response("http://a/2", "<p>" + "two " * 500_000 + "</p>", "2")
    got = warc.derivatives(spark.createDataFrame([(1, whole)], "page_id long, warc binary")).collect()
    assert [r["record_type"] for r in got] == ["metadata", "conversion", None, "metadata", "conversion"] and got[2]["source_id"] == "<bad>"
    assert len(got[-1]["record"]) > 2_000_000


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    stems = ["tha", "ing", "er", "on", "ly"]
    text = lambda n: " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) + str(k % 7) * (k % 5 == 0) for k in range(n))
    passage = " ".join(f"pass{k}age" for k in range(60))
    rows = [(k, text(rng.randint(40, 200)), "en") for k in range(60)]
    rows[10] = (10, rows[10][1] + " " + passage + " end", "en")
    rows[20] = (20, "start\n" + passage + "\n" + rows[20][1], "en")
    rows += [(100 + k, rows[5][1], "en") for k in range(4)] + [(200, None, None), (201, "12 34 !", None), (202, rows[6][1] + " extra", "en")]
    full = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = full, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == full.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {i for i, *_ in rows} - {200, 201}
    assert set(kept[1]) == set(range(60))
    assert passage not in kept[2][10] and passage not in kept[2][20] and kept[2][10].endswith(" end") and kept[2][7] == rows[7][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(range(60))
    assert hashlib.sha256(str(sorted(map(tuple, packed))).encode()).hexdigest() == hashlib.sha256(str(sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()))).encode()).hexdigest()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, extra columns, and no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices(["tha", "ing", "er", "on"], k=rng.randint(1, 3))) for _ in range(n))
    one, two, three = text(90), text(80), text(70)
    rows = [(k, text(60), "en") for k in range(10, 40)]
    rows += [(1, one, "en"), (1, one, "en"), (1, two, "en"), (2, one + " tail", "en"), (3, three, None), (3, three, "en"), (None, three, "en"), (None, text(50), None), (4, None, "en"), (5, "", "en"), (6, "...", "en")]
    full = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, k) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, b int, n long")
    stages = dict(corpus_pipeline.STAGES)
    near = sorted(((r["doc_id"], r["text"], r["n"]) for r in stages["ngram_join"](spark, full, "").collect()), key=str)
    at = {t: k for k, (_, t, _) in enumerate(rows)}
    want = [(i, t, k) for k, (i, t, _) in enumerate(rows) if k < 30 or i in (4, 5, 6) or i is None] + [(1, one, 30), (1, two, 32), (3, three, 34)]
    assert near == sorted(want, key=str) and at
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, full, "")
        assert out.columns == full.columns, name
        assert stage(spark, full.limit(0), "").collect() == [], name
        if name == "language_id":
            assert not {4, 5, 6} & {r["doc_id"] for r in out.collect()}
        if name == "substring_dedup":
            got = out.collect()
            assert len(got) == len(rows) and [r["text"] for r in got if r["doc_id"] == 4] == [None] and {r["n_chars"] for r in got if r["doc_id"] == 1 and r["text"] == ""} == {0}
    packed = stages["packing"](spark, full, "").collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0) and len([r for r in packed if r["start"] == 0]) == len(rows)
    assert stages["packing"](spark, full.limit(0), "").collect() == []
