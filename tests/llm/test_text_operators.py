"""HTML extraction, SimHash, WARC, secret scans and decontamination against brute force."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from lapsegrid.llm import common, decontam, html, secrets, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- HTML -----------------------------------------------------------------
def test_html_template_pages(spark):
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        import html as entities

        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" else "", x.replace("<b>", "").replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert html.main_text(row.html) == "\n".join(x for x in want if x)


FURNISHED = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a></header><div id="main-menu"><a href=1>One</a> <a href=2>Two</a></div>
<div class="cookie-notice">We use cookies, of course. Please accept them all, now.</div>
<div class="page"><div class="content"><h1>A &amp; B</h1><p>First   paragraph, with <em>some</em> words.
<p>Second one is here; it has <a href=x>a link</a>, too.<script>var x = "<p>no</p>";</script></p><ul><li>Item one.</li><li>Item two</ul><p>Ok</p></div>
<div class="sidebar"><p>Some long sidebar text, which must go, in any case. Really, it must go away.</p></div></div>
<div class="comments"><p>A reader's comment, long enough to look like text. Yes, it is long, very long indeed.</p></div>
<form><p>Write here, please.</p></form><!-- c --><footer>&copy; me</footer></body></html>"""


def test_html_furniture():
    assert html.main_text(FURNISHED) == "A & B\nFirst paragraph, with some words.\nSecond one is here; it has a link, too.\nItem one.\nItem two\nOk"


WITHOUT_ARTICLE = """<body><div class=top><ul class=menu><li><a href=/>Start</a><li><a href=/x>More of it</a></ul></div>
<table><tr><td><p>A story, told in a table cell, with commas. And with full stops.</p><h2>Part</h2><p>Short.</p></td></tr></table>
<ol class="commentlist"><li>First! I was here, before you all, and I say so at length, as ever.</ol><div id="newsletter-box"><p>Sign up, please, for news.</p></div></body>"""


def test_html_without_article_element():
    assert html.main_text(WITHOUT_ARTICLE) == "A story, told in a table cell, with commas. And with full stops.\nPart\nShort."


def test_html_deep_and_unbalanced_pages_take_linear_time():
    assert html.main_text("<div>" * 60_000 + "<p>Deep text, here.</p>" + "</span></section>" * 60_000) == "Deep text, here."
    assert html.main_text("<ul>" + "<li>x, y.</section>" * 30_000).count("x, y.") == 30_000


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<!-- x", "<script>", "</p></div>", "<nav>a</nav>", "<a href='x"])
def test_html_without_content(page):
    assert html.main_text(page) == ""


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (None, "u", "<p>x y</p>", 6)], "page_id long, url string, html string, text int")
    got = html.extract_pages(pages).collect()
    assert sorted(((str(r.page_id), r.url, r.text, r.n_chars) for r in got), key=str) == [("1", None, "", 0), ("1", None, "", 0), ("None", "u", "x y", 3)]
    assert html.extract_pages(pages.limit(0)).count() == 0
    assert html.main_text("<p>" + "word " * 400_000 + "</p>").count("word") == 400_000


# -- SimHash --------------------------------------------------------------
def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    label = {i: i for i in ids}
    for _ in ids:
        changed = False
        for i in ids:
            low = min(label[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 4)
            if low < label[i]:
                label[i], changed = low, True
        if not changed:
            return label
    return label


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_against_brute_force(spark, tile, monkeypatch):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(60)) for _ in range(20)]
    texts = [None, "", " \t", "one", "One", "a b c", "a b c d e"] + base
    for t in base[:8]:
        for _ in range(6):
            w = t.split()
            w[rnd.randrange(60)] = "changed"
            texts.append(" ".join(w))
    texts += base[:3]
    frame = docs(spark, texts)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, tile))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)
    kept = sorted(r.doc_id for r in simhash.keep_one(frame).collect())
    assert kept == sorted(set(plain_components(fps).values()))


def test_simhash_schemes_are_exact():
    rnd = random.Random(1)
    for n in (10, 1 << 24, 1 << 31, 1 << 36):
        masks = simhash.block_masks(n)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 4):
                b ^= 1 << bit
            assert any(not (a ^ b) & m for m in masks)


def test_simhash_tile_pairs_connect_what_all_links_connect():
    rnd = np.random.default_rng(4)

    def parts(n, links):
        label = list(range(n))
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    for size in (3, 40, 1300):
        seeds = rnd.integers(0, 1 << 63, 3, dtype=np.uint64)
        made = [np.unique(rnd.choice(seeds, size) ^ np.uint64(1) * (np.uint64(1) << rnd.integers(0, 30, size, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 40, size, dtype=np.uint64))) for _ in range(2)]
        left, right = made[0], np.setdiff1d(made[1], made[0])
        i, j = simhash.cross_links(left, right)
        every = np.argwhere(np.bitwise_count(left[:, None] ^ right[None, :]) <= 4)
        n = len(left) + len(right)
        if size < 1000:
            assert parts(n, [(a, len(left) + b) for a, b in every.tolist()]) == parts(n, [(a, len(left) + b) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
        assert len(i) < n and (np.bitwise_count(left[i] ^ right[j]) <= 4).all()
        assert {*i.tolist()} == {*every[:, 0].tolist()} or size >= 1000


def test_simhash_takes_text_ids(spark):
    frame = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "z")], "doc_id string, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(frame).collect()) == [("None", "None"), ("a", "a"), ("b", "a")]


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, ["x y", "x y", "z"], [4, 4, 9])
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(4, 4), (4, 4), (9, 9)]
    assert sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == [4, 9]


def test_keep_one_decides_by_row(spark):
    rnd = random.Random(8)
    clean = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(60)) for _ in range(9)]
    rows = [(None, clean[0], "a"), (None, clean[1], "a"), (None, clean[1], "b"), (None, clean[1], "b")]  # null ids, repeated
    rows += [(1, clean[2], "a"), (None, clean[2], "a")]  # a null id after all others
    rows += [(2, clean[3], "a"), (7, clean[3], "a"), (7, clean[4], "a")]  # one text of an id is a copy, the other is not
    rows += [(8, clean[5], "a"), (8, clean[6], "a")]  # one id, two texts
    rows += [(9, clean[7], "b"), (9, clean[7], "a"), (9, clean[7], "b"), (3, clean[8], "a")]
    want = sorted([("None", clean[0]), ("None", clean[1]), ("1", clean[2]), ("2", clean[3]), ("7", clean[4]), ("8", clean[5]), ("8", clean[6]), ("9", clean[7]), ("3", clean[8])])
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, first string")
        got = simhash.keep_one(frame)
        assert got.columns == frame.columns
        assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want
    assert len({tuple(sorted(map(str, simhash.keep_one(spark.createDataFrame(o, "doc_id long, text string, kind string")).collect()))) for o in (rows, rows[::-1])}) == 1
    whole = spark.createDataFrame([(None, t, None) for t in clean], "doc_id long, text string, kind string")
    assert sorted(r.text for r in simhash.keep_one(whole).collect()) == sorted(clean)


# -- WARC -----------------------------------------------------------------
LONG, OTHER = "ä" * 600, "x\r\n\r\nWARC/1.1\r\n" * 100
PAGES = [(1, "u", LONG), (2, "u\r\nX: y", LONG), (3, None, LONG), (4, "v", None), (5, "v", ""), (6, "v", "small"), (7, "v", "small"), (8, "w", OTHER), (9, "w", OTHER), (9, "w", OTHER), (None, "n", LONG)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_warc_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "without", lambda a, b, c: common.without(a, b, c, rows))
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as D0")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    top = {LONG: 3, OTHER: 9}
    want = sorted(
        (str(i), len((t or "").encode()), sha(t), *(("revisit", top[t]) if t in top and i is not None and i < top[t] else ("response", None))) for i, _, t in PAGES
    )
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_valid_and_reached_by_offset(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", date="2024-02-03T04:05:06Z")
    rows = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert len(rows) == len(PAGES) == len({r.record_id for r in rows})
    ids = {r.record_id: r for r in rows}
    for r in rows:
        whole = open(r.file.removeprefix("file:"), "rb").read()
        assert whole.endswith(warc.EMPTY)
        data = gzip.decompress(whole[r.offset : r.offset + r.length])  # one record, whole and alone
        ((named, block),) = warc.parse(data)
        assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", named["warc-record-id"]) and named["warc-record-id"] == r.record_id
        assert named["warc-date"] == "2024-02-03T04:05:06Z" and named["content-type"].startswith("application/http") and named["warc-target-uri"]
        assert warc.payload_of(named, block) == bytes(r.payload) and data.startswith(b"WARC/1.1\r\n")
        if r.record_type == "revisit":
            to = ids[named["warc-refers-to"]]
            assert named["warc-profile"] == warc.PROFILE and to.digest == named["warc-payload-digest"].removeprefix("sha1:") and not r.payload
            assert named["warc-refers-to-date"] == to.date and named["warc-refers-to-target-uri"] == (to.url or warc.NO_URL)
        else:
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == named["warc-payload-digest"].removeprefix("sha1:")
    assert len({r.file for r in rows if r.record_type == "response"}) > 1


def test_warc_parser():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n" * 3
    assert [b for _, b in warc.parse(data)] == [b"ab\r\nc"] * 3
    noise = random.Random(1).randbytes(300_000)
    packed = gzip.compress(data) + gzip.compress(noise) + warc.EMPTY
    parts = list(warc.gzip_members(packed))
    assert [d for _, _, d in parts] == [data, noise, b""] and sum(n for _, n, _ in parts) == len(packed)
    for broken in (data[:-3], data[:20], b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse(broken))
    with pytest.raises(ValueError):
        list(warc.gzip_members(packed[:-4]))


# -- secrets --------------------------------------------------------------
def plain_base(text):
    low = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end()) for m in low.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base(spark):
    rnd = random.Random(5)
    parts = ["password", "API_KEY", "ſecret", "toKen", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é", "secret=abc", "token=secret:abcdefgh1", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for t in texts:
        assert secrets.base_spans(t) == plain_base(t)
        base, every = secrets.spans_of(t)
        assert set(base) <= set(every)
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [*texts, None])).collect()}
    for i, t in enumerate([*texts, ""]):
        want = plain_base(t)
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert got[i].base_sha256 == hashlib.sha256(names.encode()).hexdigest()


def test_secrets_lexing():
    text = 'k1 = "Zx8Qw7Er6Ty5Ui4O"\nDB_PWD = k1\ntitle = "Zx8Qw7Er6Ty5Ui4P"\nsigning-key: aB3dE5fG7hI9kL1m\nnote: nothing here'
    found = [text[a:b] for a, k, b in secrets.spans_of(text)[1] if k == 3]
    assert found == ["Zx8Qw7Er6Ty5Ui4O", "aB3dE5fG7hI9kL1m"]
    assert secrets.redact(text).count("[REDACTED:literal]") == 2
    chain = "a0 = 'Zx8Qw7Er6Ty5Ui4O'\n" + "".join(f"a{k} = a{k - 1}\n" for k in range(1, 20_000)) + "api_secret = a19999"
    assert [s for s in secrets.spans_of(chain)[1]] == [(6, 3, 22)]
    assert secrets.redact("") == "" and secrets.lexed_spans("a" * 300_000 + "=") == []


def test_secrets_redacted_rows(spark):
    rows = secrets.redacted(docs(spark, [None, "", "password=abcdefgh12 x"])).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [None, "", "[REDACTED:assign] x"]


# -- decontamination ------------------------------------------------------
def plain_report(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = [(str(i), tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    out = {}
    for d, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for i, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def bench_case(spark, many, seed=2):
    rnd = random.Random(seed)
    pool = "a b c d e F g é 1 2".split()
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 15])))) for i in range(many)] + [(many, None), (3, "a b"), (many + 1, "a a a a")]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) + "." + (rnd.choice(items)[1] or "") for _ in range(40)] + [None, "", "..", "a a a a a a", "A! b?"]
    return spark.createDataFrame(items, "item_id long, text string"), items, texts


@pytest.mark.parametrize("many", [12, 600])
def test_decontamination(spark, many):
    bench, items, texts = bench_case(spark, many)
    texts = texts + texts[:5]
    frame = docs(spark, texts).selectExpr("*", "1 as n_hit", "2 as items_", "3 as D0")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(frame, bench).collect()}
    want = plain_report(texts, items)
    assert got == want
    left = decontam.clean(frame, bench)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d for d, w in want.items() if not w[4]}


def test_decontamination_proposes_by_rare_shingles(spark):
    common, rare = [f"w{k}" for k in range(9)], "q r s t u v w x y z".split()
    texts = [" ".join(common + ["o"])] * 30 + [" ".join(["k", *rare[:5], *common[:5], "l"]), " ".join(common[:8])]
    bench = spark.createDataFrame([("x", " ".join(rare[:5] + common[:5])), ("y", " ".join(common + ["never"]))], "item_id string, text string")
    found = decontam.Search(docs(spark, texts), bench)
    assert found.rows.where("size(found) > 0").count() == 1  # the 30 others hold common shingles only
    assert [(r.doc_id, r.start, r.n, r.item_id) for r in decontam.occurrences(docs(spark, texts), bench).collect()] == [(30, 1, 10, "x")]


def test_decontamination_edges(spark):
    bench = bench_case(spark, 12)[0]
    assert decontam.report(docs(spark, []), bench).count() == 0 and decontam.clean(docs(spark, []), bench).count() == 0
    assert decontam.report(docs(spark, ["a"]), bench.limit(0)).collect() == [Row(doc_id=0, n_words=1, n_hit=0, n_items=0, items_sha256=hashlib.sha256(b"").hexdigest(), contaminated=False)]
    assert decontam.clean(docs(spark, ["a", None], [None, None]), bench.limit(0)).count() == 2


def test_texts_are_left_out_exactly_behind_the_filter(spark):
    frame = docs(spark, [f"text {k}" for k in range(2000)] + [None, ""]).selectExpr("*", "doc_id as D0", "'m' as maybe")
    lost = frame.where("doc_id % 3 = 0").select(*(d.alias(f"d{k}") for k, d in enumerate(common.text_digests(frame["text"])))).distinct()
    for rows in (10_000, 0):
        left = common.without(frame, common.text_digests(frame["text"]), lost, rows)
        assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [k for k in range(2002) if k % 3]
    least = common.BLOOM_WORDS
    common.BLOOM_WORDS = 64  # nearly all rows look lost
    try:
        assert sorted(r.doc_id for r in common.without(frame, common.text_digests(frame["text"]), lost, 0).collect()) == [k for k in range(2002) if k % 3]
    finally:
        common.BLOOM_WORDS = least
    small = common.Bloom.of(lost.selectExpr("d0 as key"), 667, 64)
    assert small.words.size == 64 and small.might(np.array([r.d0 for r in lost.collect()]).view(np.uint64)).all()
