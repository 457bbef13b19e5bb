"""Each query against a plain version of itself over whole small tables."""

import base64
import html
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import decontamination, html_templates, mixing, quality_rules, queries, simhash, suffix_dedup, token_counts
from latticework.llm._arrow import _BYTE, split_words

TABLES = ("documents", "benchmark", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return [w for w in re.split(r"[\x00-/:-`{-\x7f]+", (text or "").lower()) if w]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(d):
        show = lambda v: "none" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        return sorted(tuple(str(plain(v)) if isinstance(v, (list, np.ndarray)) else show(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))

    assert rows(got) == rows(want)


# SimHash


def groups(edges, nodes):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    """128 bits of a text with Python numbers, a word at a time; None without a word."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    sums = [0] * 128
    found = set(words(text))
    for w in found:
        raw = w.encode()
        h = mixed(sum(int(_BYTE[x]) * pow(base, i, 1 << 64) for i, x in enumerate(raw)) & full)
        weight = max(2 * (min(len(raw), 12) - 3), 0) + 1
        for half, x in enumerate((h, mixed(h ^ 0x5851F42D4C957F2D))):
            for k, byte in enumerate(x.to_bytes(8, "little")):
                for j in range(8):
                    sums[64 * half + 8 * k + j] += weight if byte >> (7 - j) & 1 else -weight
    return sum(1 << k for k, x in enumerate(sums) if x > 0) if found else None


def brute_simhash(rows, radius):
    some = [(i, x) for i, t in rows if i is not None and (x := plain_fingerprint(t)) is not None]
    edges = [(a, b) for k, (a, x) in enumerate(some) for b, y in some[:k] if (x ^ y).bit_count() <= radius]
    label = groups(edges, {a for a, _ in some})
    return sorted((a, b) for a, b in label.items() if a != b)


@pytest.mark.parametrize("strip_rows", [16384, 25])
def test_simhash(docs, strip_rows):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in simhash.removed(docs, strip_rows=strip_rows).collect())
    assert got == brute_simhash(rows, 22)


def test_close_pairs_skip_tiles_without_losing_any():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, (300, 2), dtype=np.uint64) & rng.integers(0, 2**64, (300, 2), dtype=np.uint64)
    h[:60] &= rng.integers(0, 2**64, (60, 2), dtype=np.uint64)
    h[100:160] |= rng.integers(0, 2**64, (60, 2), dtype=np.uint64)
    h = h[np.argsort(np.bitwise_count(h).sum(1), kind="stable")]
    p, q, skipped = simhash.close_pairs(h, h, 30, True, rows=8, columns=16)
    whole = [int(a) << 64 | int(b) for a, b in h.tolist()]
    want = {(i, j) for j in range(300) for i in range(j) if (whole[i] ^ whole[j]).bit_count() <= 30}
    assert set(zip(p.tolist(), q.tolist())) == want and skipped > 0


# decontamination


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert decontamination.lcs(decontamination.place_masks(a), len(a), b) == slow_lcs(a, b)


def test_every_verbatim_item_is_found(spark, sf, docs):
    """Brute force: the item's words in a row anywhere in the document."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(i, " " + " ".join(words(t)) + " ") for i, t in docs.select("doc_id", "text").collect()]
    items = [(i, " " + " ".join(words(t)) + " ") for i, t in bench.select("item_id", "text").collect()]
    want = {(d, i) for d, t in texts for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert want and want <= got
    left = {r.doc_id for r in decontamination.apply(docs, bench).select("doc_id").collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in got}


def test_planted_items_and_clean_documents(spark, sf, docs):
    """Verbatim, paraphrased and shuffled items inside of long documents."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r for r in bench.orderBy("item_id").collect() if len(words(r.text)) >= 12][:30]
    host = [r.text for r in docs.filter("length(text) between 2000 and 9000").orderBy("doc_id").limit(30).collect()]
    rng, rows = random.Random(8), []
    for k, (item, text) in enumerate(zip(items, host)):
        w = item.text.split()
        soft = [x if rng.random() > 0.12 else f"other{rng.randrange(999)}" for x in w]
        cut = rng.randrange(len(text))
        rows += [(10_000 + k, text[:cut] + " " + item.text + " " + text[cut:]), (20_000 + k, text[:cut] + " " + " ".join(soft) + " " + text[cut:])]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs.select("doc_id", "text").unionByName(planted), bench).collect()}
    exact = {(10_000 + k, r.item_id) for k, r in enumerate(items)}
    soft = {(20_000 + k, r.item_id) for k, r in enumerate(items)}
    assert len(exact & got) >= 0.97 * len(exact)
    assert len(soft & got) >= 0.9 * len(soft)


# suffix arrays


def brute_repeats(rows, size):
    first, hit = {}, defaultdict(dict)
    for doc, text in sorted(set(rows)):
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in first:
                hit[doc][i] = first[key]
            else:
                first[key] = doc
    out = []
    for doc, at in hit.items():
        start = end = source = None
        for i in sorted(at):
            if start is not None and i <= end:
                end, source = i + size, min(source, at[i])
                continue
            if start is not None:
                out.append((doc, start, end, source))
            start, end, source = i, i + size, at[i]
        out.append((doc, start, end, source))
    return sorted(out)


@pytest.mark.parametrize("min_words,gram,memory,shard,hot", [(50, 16, 4_000_000, 400_000, 10_000), (12, 5, 300, 400, 5)])
def test_suffix_repeats(spark, docs, min_words, gram, memory, shard, hot):
    rows = [(r.doc_id, r.text) for r in docs.filter("text is not null").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in suffix_dedup.repeats(docs, min_words, gram, memory, shard, hot).collect())
    assert got == brute_repeats(rows, min_words)


def test_suffix_repeats_of_periodic_texts(spark):
    rng = random.Random(2)
    rows = []
    for d in range(40):
        unit = [f"u{rng.randrange(4)}" for _ in range(rng.choice([1, 2, 7]))]
        rows.append((d, " ".join((unit * 60)[: rng.randrange(5, 90)] + [f"x{rng.randrange(3)}"] + unit * rng.randrange(12))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard, hot in ((400_000, 10_000), (50, 3), (1, 1)):
        got = sorted(tuple(r) for r in suffix_dedup.repeats(docs, 10, 4, 1000, shard, hot).collect())
        assert got == brute_repeats(rows, 10)


def test_shards_end_with_keys():
    key = np.sort(np.random.default_rng(5).integers(0, 40, 500))
    words = pa.array([b"x" * 8 * (k % 5) if k % 3 else None for k in range(500)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(key), words], ["key", "words"])
    for least, weight in ((1, None), (17, None), (9, "words"), (10_000, "words")):
        for step in (1, 7, 500):
            tables = list(suffix_dedup.keyed((batch.slice(a, step) for a in range(0, 500, step)), least, weight))
            assert np.concatenate([t.column("key").to_numpy() for t in tables]).tolist() == key.tolist()
            assert len({k for t in tables for k in set(t.column("key").to_pylist())}) == sum(len(set(t.column("key").to_pylist())) for t in tables)
            assert least > 5000 or len(tables) > 5


# tokens


def test_tokens_equal_whole_encoding(spark, docs):
    path = queries.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(0)
    rows += [(-1, "x" * 3000), (-2, " " * 900 + "\n\n  end  "), (-3, "".join(rng.choice("ab  \n'1é中🙂.") for _ in range(5000))), (-4, "no_spaces_" * 400 + " tail " * 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    for chunk, overlap in ((32768, 512), (200, 16)):
        got = token_counts.count(d, path, chunk, overlap).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert {r.doc_id: r.n_chars for r in got} == {i: len(t or "") for i, t in rows}
        assert chunk > 1000 or any(r.n_chunks > 1 for r in got)


# HTML


class Plain(HTMLParser):
    """A page as nested tuples (tag, opening, children...), by the standard library's tokens."""

    VOID = set("area base br col embed hr img input link meta param source track wbr".split())
    ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.stack = [["", ""]]
        self.feed(page)
        self.close()
        while len(self.stack) > 1:
            self.shut()

    def shut(self):
        node = tuple(self.stack.pop())
        self.stack[-1].append(node)

    def handle_starttag(self, tag, attrs):
        blocks = "div ul ol table section article h1 h2 h3 h4 h5 h6 nav footer header blockquote pre form".split()
        ends = self.ENDS.get(tag, {"p"} if tag in blocks else set())
        while self.stack[-1][0] in ends:
            self.shut()
        text = self.get_starttag_text()
        self.stack.append([tag, " ".join(text[1 + len(tag) : -1].rstrip("/").split())])
        if tag in self.VOID or text.endswith("/>"):
            self.shut()

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.stack):
            while self.stack[-1][0] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data):
        if len(self.stack[-1]) > 2 and type(self.stack[-1][-1]) is str:
            self.stack[-1][-1] += data
        else:
            self.stack[-1].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def root(self):
        return tuple(self.stack[0])


def norm(node):
    return (node[0], node[1], *(norm(x) if type(x) is tuple else " ".join(x.split()) for x in node[2:]))


def below(node):
    for x in node[2:]:
        if type(x) is tuple:
            if len(x) > 2:
                yield norm(x)
            yield from below(x)


BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())


def seen_text(node, templates):
    def walk(x):
        if type(x) is str:
            return x, 0
        if len(x) > 2 and norm(x) in templates:
            return "", 1
        if x[0] in ("script", "style", "noscript", "template", "head"):
            parts = [walk(c) for c in x[2:] if type(c) is tuple and c[0] == "title"]
        else:
            parts = [walk(c) for c in x[2:]]
        text = "".join(t for t, _ in parts)
        return (f"\0{text}\0" if x[0] in BLOCK else text), sum(n for _, n in parts)

    parts = [walk(x) for x in node[2:]]
    lines = (" ".join(html.unescape(x).split()) for x in "".join(t for t, _ in parts).split("\0"))
    return "\n".join(x for x in lines if x), sum(n for _, n in parts)


def test_templates_are_counted_over_the_host(spark, sf):
    # the given pages repeat little, so each gets the same menu
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", F.regexp_replace("html", "<body>", "<body><div class=menu><a href=/>Home</a> <a href=/all>All</a></div>"))
    rows = pages.collect()
    host = lambda u: (m[1].lower() if (m := re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else "")
    trees = {r.html: Plain(r.html).root() for r in rows if r.html}
    seen, total = defaultdict(Counter), defaultdict(set)
    for h, x in {(host(r.url), r.html) for r in rows if r.html}:
        if norm(trees[x]) not in total[h]:
            total[h].add(norm(trees[x]))
            seen[h].update(set(below(trees[x])))
    templates = {h: {s for s, n in c.items() if n >= 3 and n >= 0.05 * len(total[h])} for h, c in seen.items()}
    want = {r.page_id: (seen_text(trees[r.html], templates[host(r.url)]) if r.html else ("", 0)) for r in rows}
    got = {r.page_id: (r.text, r.removed) for r in html_templates.extract(pages).collect()}
    differs = [k for k in want if got[k] != want[k]]
    assert len(got) == len(want) and not differs, (got[differs[0]], want[differs[0]])
    assert any(n for _, n in got.values())


# the pipeline


def test_pipeline_equals_its_plain_version(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    judged = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows = [(r.doc_id, judged[r.doc_id].clean_text, r.source) for r in docs if judged[r.doc_id].keep]
    gone = {a for a, _ in brute_simhash([(i, t) for i, t, _ in rows], 22)}
    rows = [r for r in rows if r[0] not in gone]
    spans = defaultdict(list)
    for doc, a, b, _ in brute_repeats([(i, t) for i, t, _ in rows], 50):
        spans[doc].append((a, b))
    cut = []
    for doc, text, source in rows:
        if doc in spans:
            w = split_words(pa.array([text]))
            raw = text.lower().encode()
            assert len(raw) == len(text.encode())
            drop = bytearray(text.encode())
            keep, at = b"", 0
            for a, b in spans[doc]:
                keep += bytes(drop[at : w.start[a]])
                at = int(w.start[b]) if b < len(w.start) else len(drop)
            text = (keep + bytes(drop[at:])).decode()
            if not re.search(r"[^\W_]", text):
                continue
        cut.append((doc, text, source))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    d = spark.createDataFrame(cut, "doc_id long, text string, source string")
    bad = {r.doc_id for r in decontamination.matches(d, bench).collect()}
    assert bad
    d = d.filter(~d.doc_id.isin(sorted(bad)))
    con = duckdb.connect()
    mixed = d.toPandas()  # noqa: F841 - read by the SQL below
    want = con.execute(mixing.ORACLE.replace("from documents", "from mixed")).fetchall()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.source, r.epoch, r.epochs, r.n_tokens, r.tokens_taken) for r in rows) == sorted(want)
    texts = {i: t for i, t, _ in cut}
    for r in rows:
        assert len(r.text.split()) * r.epochs == r.tokens_taken and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or texts[r.doc_id].lstrip().startswith(r.text)


def test_budgets_are_met_exactly(spark, docs):
    rows = mixing.plan(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.tokens_taken
    assert len(set(taken.values())) == 1
    assert not math.isnan(sum(taken.values()))
