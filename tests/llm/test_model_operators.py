"""Toxicity, packing, language model, media, token files and the pipeline."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from lapsegrid.llm import avi, common, decontam, idstore, lm, packing, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n", "one", "Two words", "é ü \x1c b\x85c ΣΑΣ", "x" * 70_000, "a b " * 30_000, "same text", "same text", "<|endoftext|> it's 12'll ☃☃"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], DOCS)


# -- toxicity -------------------------------------------------------------
def labelled(spark, n=1500):
    rnd = random.Random(4)
    benign = ["".join(rnd.choice("aeiourstnl") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zorgul", "zorgan", "zorgit", "vexim", "vexon", "vexar"]
    texts, toxic = [], []
    for i in range(n):
        words = [rnd.choice(benign) for _ in range(rnd.randint(3, 80))]
        if i % 9 == 0:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", ".", "!"])
        texts.append(" ".join(words))
        toxic.append(int(i % 9 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, None), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    return texts, toxic, labels


def test_toxicity_finds_held_out_rows(spark):
    texts, toxic, labels = labelled(spark)
    texts += [None, "", "zorgemo only here", "w " * 20_000 + "vexim"]
    rows = {r.doc_id: r for r in toxicity.report(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [i for i in range(len(toxic)) if rows[i].held_out]
    right = sum(rows[i].predicted == toxic[i] for i in own)
    assert right >= 0.98 * len(own)
    n = len(toxic)
    assert [rows[n + k].predicted for k in range(4)] == [0, 0, 1, 1]


def test_toxicity_never_reads_held_out_labels(spark):
    texts, _, labels = labelled(spark, 600)
    frame = docs(spark, texts)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a = sorted(map(tuple, toxicity.report(frame, labels).collect()))
    assert a == sorted(map(tuple, toxicity.report(frame, flipped).collect()))


def test_toxicity_without_labels(spark):
    frame = docs(spark, ["a", None]).selectExpr("*", "'x' as score", "1 as toxic")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.report(frame, none).collect()] == [0, 0]
    assert toxicity.report(docs(spark, []), none).count() == 0


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    texts, _, labels = labelled(spark, 600)
    frame = docs(spark, texts + [None])
    twice = frame.unionByName(frame.where("doc_id < 40")).unionByName(frame.limit(1).selectExpr("cast(null as bigint) as doc_id", "'vexim vexon' as text", "lang", "source", "n_chars"))
    rows = toxicity.report(twice, labels).collect()
    assert len(rows) == 601 + 40 + 1
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert all(len(x) == 1 for x in by.values())
    (odd,) = (r for r in rows if r.doc_id is None)
    assert odd.predicted == 1 and odd.held_out == (zlib.crc32(b"") % 4 == 2)
    clashing = frame.selectExpr("*", "'s' as Score", "7 as predicted", "1 as MASK")
    model = toxicity.fit(clashing, labels)
    kept = toxicity.keep_clean(clashing, model)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.scores(frame, model).collect() if not r.predicted}


def plain_score(model, text):
    """A text's score from the model's patterns and weights, pattern by pattern."""
    text = text or ""
    words = {w for token in text.lower().split() for w in (re.findall(r"[^\W\d_]+", token) if not token.isalpha() else [token])}
    odds = dict(zip(model.patterns, model.odds, strict=True))
    number = {p: k for k, p in enumerate(model.patterns)}
    fits = lambda p, w: w == p[1:] if p[0] == "=" else len(w) > len(p) and w.startswith(p)
    best = {w: max((odds[p], -number[p]) for p in odds if fits(p, w)) for w in words if any(fits(p, w) for p in odds)}
    found = {p for p in odds for w in words if fits(p, w)}
    top = max(odds.values())
    bands = [0] * toxicity.BANDS
    for o, _ in best.values():
        bands[min(toxicity.BANDS - 1, int(toxicity.BANDS * o / (top + 1e-9))) if o > 0 else 0] += 1
    total = sum(o for o, _ in best.values())
    dense = [len(best) > 0, math.log1p(len(best)), math.log1p(total) / 2, min(1.0, 10 * len(best) / (len(words) + 5)), min(1.0, 10 * text.count("!") / (len(text.split()) + 1)), *map(math.log1p, bands)]
    width = min(toxicity.FEATURES, len(odds))
    logit = model.bias + sum(model.weights[number[p]] for p in found if number[p] < width) + sum(w * x for w, x in zip(model.weights[width:], dense, strict=True))
    return 1 / (1 + math.exp(-logit))


def test_toxicity_scores_against_plain_ones(spark):
    docs_, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs_, labels)
    extra = docs(spark, [None, "", "IDIOT!!! worthless1scum", "x" * 100_000])
    for rows in (docs_, extra):
        got = {r.doc_id: r for r in toxicity.scores(rows, model).collect()}
        kept = {r.doc_id for r in toxicity.keep_clean(rows, model).collect()}
        for r in rows.collect():
            want = plain_score(model, r.text)
            assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-6) and got[r.doc_id].predicted == int(want >= 0.3) == int(r.doc_id not in kept)


def test_toxicity_recall_on_held_out_rows(spark):
    found = toxicity.report(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * (len(rows) - len(toxic))


def votes_case(seed=6, n=3000):
    """Votes with planted rates: voters 0-3 independent, 4-9 copies of voter 0, the last but one without evidence."""
    rnd = random.Random(seed)
    rows = Counter()
    for _ in range(n):
        y = rnd.random() < 0.2
        fired = [rnd.random() < (p1 if y else p0) for p1, p0 in ((0.6, 0.2), (0.7, 0.05), (0.5, 0.1), (0.6, 0.02))]
        fired += [fired[0]] * 6
        mask = sum(1 << k for k, f in enumerate(fired) if f) or 1 << toxicity.VOTERS - 2
        said = -1 if rnd.random() < 0.6 else int(y if rnd.random() < 0.95 else not y)
        rows[mask, said] += 1
    return sorted((m, a, n) for (m, a), n in rows.items())


def plain_em(rows, parent, prior):
    """The label model one document at a time: rates[class][parent votes][voter], annotation[class]."""
    fires, ann = None, [1e-6, 1 - 1e-6]
    for step in range(toxicity.EM_MOST + 1):
        number, ruled, said, votes = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], {}
        for mask, a, n in rows:
            if step == 0 and a < 0:
                continue
            odds = math.log(prior / (1 - prior))
            if fires:
                for k in range(toxicity.VOTERS):
                    if mask >> k & 1:
                        s = int(parent[k] >= 0 and mask >> int(parent[k]) & 1)
                        odds += math.log(fires[1][s][k] / fires[0][s][k])
            if a >= 0:
                odds += math.log(ann[1] / ann[0]) if a else math.log((1 - ann[1]) / (1 - ann[0]))
            p = 1 / (1 + math.exp(-max(-30, min(30, odds))))
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                number[y] += w
                ruled[y] += w * (a >= 0)
                said[y] += w * (a == 1)
                for k in range(toxicity.VOTERS):
                    s = int(parent[k] >= 0 and mask >> int(parent[k]) & 1)
                    seen = votes.setdefault((y, s, k), [0.0, 0.0])
                    seen[0] += w
                    seen[1] += w * (mask >> k & 1)
        before, old = fires, ann
        fires = [[[(votes.get((y, s, k), [0, 0])[1] + 0.5) / (votes.get((y, s, k), [0, 0])[0] + 1) for k in range(toxicity.VOTERS)] for s in (0, 1)] for y in (0, 1)]
        ann = [min(1 - 1e-4, max(1e-4, (said[y] + (0.05, 0.95)[y]) / (ruled[y] + 1))) for y in (0, 1)]
        if before and max(abs(np.array(fires) - np.array(before)).max(), abs(np.array(ann) - np.array(old)).max()) < toxicity.SETTLED:
            break
    return np.array(fires), np.array(ann)


def test_toxicity_label_model_against_plain_em(spark):
    rows = votes_case()
    frame = spark.createDataFrame(rows, "mask long, annotation int, n long")
    models = []
    for local in (1_000_000, 0):
        model = toxicity.Model(prior=0.2)
        toxicity.fit_label_model(model, frame, local)
        models.append(model)
    a, b = models
    assert np.allclose(a.fires, b.fires, atol=1e-6) and (a.parent == b.parent).all()  # here or on the cluster
    fires, ann = plain_em(rows, a.parent, 0.2)
    assert np.allclose(a.fires, fires, atol=1e-4) and np.allclose(a.annotation, ann, atol=1e-4)
    assert a.annotation[1] > 0.9 and a.annotation[0] < 0.1  # the planted accuracy is 0.95


def test_toxicity_copies_of_a_voter_count_once(spark):
    frame = spark.createDataFrame(votes_case(), "mask long, annotation int, n long")
    model = toxicity.Model(prior=0.2)
    toxicity.fit_label_model(model, frame)
    copies = {0, *range(4, 10)}
    assert sum(model.parent[k] in copies for k in copies) == len(copies) - 1  # a tree among the copies
    none = np.array([-1])
    one = toxicity.posterior(model, np.array([sum(1 << k for k in copies)]), none)[0]
    # one vote of rates 0.6 and 0.2 at a prior of 0.2, counted once and not seven times
    assert abs(one - 0.6 * 0.2 / (0.6 * 0.2 + 0.2 * 0.8)) < 0.12
    free = toxicity.Model(prior=0.2, parent=np.full(toxicity.VOTERS, -1), fires=np.repeat(model.fires[:, :1], 2, axis=1).copy())
    free.fires[:, :, list(copies)] = np.array([0.2, 0.6])[:, None, None]
    assert toxicity.posterior(free, np.array([sum(1 << k for k in copies)]), none)[0] > 0.99


def test_toxicity_logistic_against_plain_descent():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 3)).astype(np.float32)
    target, weight = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3))), rnd.random(200) + 0.5
    w, b = toxicity.logistic(x, target, weight)
    v = np.zeros(4)
    full = np.hstack([x, np.ones((200, 1))])
    penalty = np.array([1e-3 * weight.sum() / 100] * 3 + [1e-6])
    for _ in range(20_000):
        v -= 0.02 * (full.T @ (weight * (1 / (1 + np.exp(-full @ v)) - target)) + penalty * v)
    assert np.allclose([*w, b], v, atol=1e-3)


# -- packing --------------------------------------------------------------
def plain_best_fit(lengths, capacities, overhead):
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    bins = []
    for at, k in enumerate(order):
        n = lengths[k]
        open_bins = [b for b in bins if b[0] - b[1] >= n and b[0] - b[1] > 0]
        if open_bins:
            tight = min(b[0] - b[1] for b in open_bins)
            b = [b for b in open_bins if b[0] - b[1] == tight][0]
        else:
            later = [lengths[j] for j in order[at + 1 :]]
            costs = [((c + overhead) / (n + min(c - n, sum(x for x in later if x <= c - n))), c) for c in capacities if c >= n]
            b = [min(costs)[1], 0, []]
            bins.append(b)
        b[1] += n
        b[2].append(n)
    return sorted((min(c for c in capacities if c >= b[1]), b[1]) for b in bins)


def test_best_fit_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = [rnd.choice([1, 2, 3, 5, 8, 13, 21, 40]) for _ in range(rnd.randint(0, 50))]
        bins, offsets, final = packing.best_fit(np.array(lengths, dtype=np.int64), (10, 20, 40), 3)
        used = Counter()
        for b, n in zip(bins.tolist(), lengths, strict=True):
            used[b] += n
        got = sorted((final[b], used[b]) for b in used)
        assert sum(c + 3 for c, _ in got) == sum(c + 3 for c, _ in plain_best_fit(lengths, (10, 20, 40), 3))


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    rows = packing.pack(docs(spark, ODD), TOKENIZER, capacities=(64, 16, 256), shard=4).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}
    got = {i: {} for i in want}
    for r in rows:
        assert len(r.ids) == r.n_tokens <= r.capacity and r.capacity == min(c for c in (16, 64, 256) if c >= r.n_tokens)
        at = 0
        for p in r.pieces:  # pieces fill the sequence without gaps
            assert p.offset == at and p.n_tokens > 0
            at += p.n_tokens
            got[p.doc_id][p.start] = (p.piece, r.ids[p.offset : at])
        assert at == r.n_tokens
    for i, pieces in got.items():
        assert [n for _, (n, _) in sorted(pieces.items())] == list(range(len(pieces)))
        assert [x for _, (_, ids) in sorted(pieces.items()) for x in ids] == want[i]
    assert len({r.bin_id for r in rows}) == len(rows)


def test_packing_edges(spark):
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0
    frame = spark.createDataFrame([(None, None), ("b", ""), ("b", ""), ("a", "x y")], "doc_id string, text string").selectExpr("*", "1 as row", "2 as ids")
    placed = packing.placements(packing.pack(frame, TOKENIZER)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.capacity) for r in placed) == [("None", 1, 512), ("a", 3, 512), ("b", 1, 512), ("b", 1, 512)]


def test_packing_in_shards_wastes_little_more():
    rnd = np.random.default_rng(5)
    lengths = np.minimum(8192, np.maximum(1, rnd.lognormal(5.5, 1.6, 5 * packing.SHARD).astype(np.int64)))
    waste = []
    for size in (packing.SHARD, len(lengths)):
        room = sum(sum(packing.best_fit(lengths[k : k + size])[2]) for k in range(0, len(lengths), size))
        waste.append(1 - lengths.sum() / room)
    assert waste[1] <= waste[0] < waste[1] + 0.002 and waste[0] < 0.01, waste


# -- language model -------------------------------------------------------
def plain_lm(texts):
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    c, pair = Counter(), Counter()
    for ok, own in zip(train, tokens, strict=True):
        if ok:
            c.update(own)
            pair.update(zip(["start", *own], own, strict=False))
    n, v = sum(c.values()), len(c)
    return train, tokens, c, pair, n, v


def plain_weights(train, tokens, c, pair, n, v):
    """EM on the deleted frequencies of every training token, one bucket after another."""
    seen = {}
    for ok, own in zip(train, tokens, strict=True):
        for before, w in zip(["start", *own], own, strict=False) if ok else ():
            context = (c[None] if before == "start" else c[before]) - 1
            p = ((pair[before, w] - 1) / context if context > 0 else 0.0, (c[w] - 1) / (n - 1), 1 / (v + 1))
            seen.setdefault(min(lm.BUCKETS - 1, 1 + int(math.log2(context))) if context > 0 else 0, []).append(p)
    out = {}
    for b, rows in seen.items():
        w = [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3
        for _ in range(lm.EM_ROUNDS):
            total = [0.0] * 3
            for p in rows:
                mixed = [x * y for x, y in zip(w, p, strict=True)]
                for k in range(3):
                    total[k] += mixed[k] / sum(mixed)
            w = [t / len(rows) for t in total]
        out[b] = w
    return out


@pytest.mark.parametrize("fan, split, parts", [(16384, 8192, 4), (4, 3, 12), (2, 5, 12)])
def test_lm_against_brute_force(spark, monkeypatch, fan, split, parts):
    rnd = random.Random(8)
    words = ["a", "B", "b", "c", "d", "é", "rare"]
    texts = [" ".join(rnd.choices(words, [9, 5, 4, 3, 2, 1, 0.1], k=rnd.randint(0, 30))) for _ in range(120)] + ODD
    monkeypatch.setattr(lm.answers, "__defaults__", (fan, split))
    monkeypatch.setattr(lm, "RANGE_TOKENS", 20_000)
    train, tokens, c, pair, n, v = plain_lm(texts)
    held = {}

    def keep(bucket, many, p2, p1, p0, f=lm.learn_weights):
        held["w"] = f(bucket, many, p2, p1, p0)
        held["n"] = many.sum()
        return held["w"]

    monkeypatch.setattr(lm, "learn_weights", keep)
    rows = {r.doc_id: r for r in lm.score(docs(spark, texts).repartition(parts)).collect()}
    weights = held["w"]
    if fan != 2:
        for b, w in plain_weights(train, tokens, c, pair, n, v).items():
            assert np.allclose(weights[b], w, atol=0.02), (b, weights[b], w)
    assert held["n"] == n and np.allclose(weights.sum(axis=1), 1)
    for i, own in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        want = 0.0
        for before, w in zip(["start", *own], own, strict=False):
            seen = c[None] if before == "start" else c[before]
            b = min(lm.BUCKETS - 1, 1 + int(math.log2(seen))) if seen else 0
            want += math.log10(weights[b][0] * (pair[before, w] / seen if seen else 0) + weights[b][1] * c[w] / n + weights[b][2] / (v + 1))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_lm_offers_are_linear_in_tokens(spark):
    rnd = random.Random(3)
    rows = {}
    for parts in (10, 40):
        frame = docs(spark, [" ".join(rnd.choices("abcdefghij", k=30)) for _ in range(10 * parts)]).repartition(parts)
        chunks = common.staged(frame.selectExpr("doc_id", "text", "false as held_out").mapInArrow(lm._chunks(pa.int64()), lm._CHUNK.format(kind="long")), "test")
        assert sorted(r.chunk for r in lm.numbered(chunks).collect()) == list(range(parts))
        offers = common.staged(chunks.mapInArrow(lm._offers(16), lm._OFFER), "test")
        rows[parts] = offers.count()
    assert rows[40] <= 4.2 * rows[10] and rows[40] <= 40 * 16 * 2


def test_lm_takes_text_ids(spark):
    frame = spark.createDataFrame([("b", "x y"), ("a", "x"), (None, None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_tokens, r.held_out) for r in lm.score(frame).collect()) == sorted((str(i), n, zlib.crc32((i or "").encode()) % 7 == 2) for i, n in (("b", 3), ("a", 2), (None, 1)))


def test_lm_predicts_held_out_texts(spark):
    rows = [r for r in lm.score(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_edges(spark):
    assert lm.score(docs(spark, [])).count() == 0
    (row,) = lm.score(docs(spark, [None])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 1, 1) and math.isclose(row.base_score, math.log10(2 / 3))
    assert all(np.array_equal(lm.expand(lm.squeeze(x), x.dtype), x) for x in (np.array([], np.uint64), np.array([1, 2**63], np.uint64)))


# -- media ----------------------------------------------------------------
def test_avi_round_trip(spark):
    rnd = random.Random(0)
    payloads = [bytes(rnd.choices([0, 255, 1, 254, 128], k=64 * n)) for n in (1, 15, 16, 17, 300)] + [rnd.randbytes(64 * 40), b"\xff" * 64 * 16 * 700]
    for p, (movie, samples) in zip(payloads, avi.decode_many(avi.encode_many(payloads)), strict=True):
        assert movie.restored(samples) == p
    assert avi.encode_many(payloads) == [avi.encode_payload(p) for p in payloads]
    damaged = bytearray(avi.encode_payload(payloads[4]))
    damaged[900:930] = bytes(30)
    with pytest.raises(ValueError):
        [movie.restored(samples) for movie, samples in avi.decode_many([bytes(damaged)])]


def test_avi_rows(spark):
    got = {r.doc_id: r for r in avi.report(docs(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = avi.encode_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[8])[1:] == tuple(got[9])[1:]
    assert avi.report(docs(spark, [])).count() == 0


def test_avi_feature_tells_times(spark):
    media = avi.to_media(docs(spark, ["a" * 40_000 + "Z" * 40_000, None, ""]))
    rows = {r.doc_id: r for r in avi.features(media).collect()}
    clips = {}
    for r in avi.clip_rows(media).orderBy("doc_id", "clip").collect():
        clips.setdefault(r.doc_id, []).append(f"{r.first_frame}-{r.first_frame + r.n_frames - 1}@{r.start_s:.6f}-{r.end_s:.6f}")
    assert len(clips[0]) > 1
    for i, r in rows.items():
        head, _, told = r.feature.partition(";clips=")
        assert told.split(",") == clips[i]
        frames, seconds = (x.partition("=")[2] for x in head.split(";"))
        assert float(seconds) == pytest.approx(int(frames) / avi.FPS, abs=1e-4) and told.endswith(f"-{float(seconds):.6f}")
    named = avi.clip_rows(media.selectExpr("cast(doc_id as string) as doc_id", "n_bytes", "media"))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == sum(map(len, clips.values()))
    assert avi.report(docs(spark, [])).count() == 0


def test_avi_clips(spark):
    still = np.zeros((12, 16, 64), dtype=np.uint8)
    still[5:9] = 200
    assert avi.clips(still) == [(0, 4), (5, 8), (9, 11)]
    rows = avi.clip_rows(avi.to_media(docs(spark, ["\0" * 4096 + "é" * 2048]))).orderBy("clip").collect()
    assert [(r.start_s, r.end_s, r.first_frame, r.n_frames) for r in rows] == [(0.0, 0.4, 0, 4), (0.4, 0.8, 4, 4)]


# -- token files ----------------------------------------------------------
def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idstore, "FILE_BYTES", 2000)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    own = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in idstore.round_trip(docs(spark, texts), TOKENIZER).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert idstore.round_trip(docs(spark, []), TOKENIZER).count() == 0
    twice = spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (1, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.start) for r in idstore.round_trip(twice, TOKENIZER).collect()) == [("1", 2), ("2", 4), ("2", 6), ("None", 0)]


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(idstore, "CACHE_WORDS", 40)
    monkeypatch.setattr(idstore, "CACHE_MARKS", 3)
    monkeypatch.setattr(idstore, "RUN", 5)
    plain, own, rnd = Tokenizer.from_file(TOKENIZER), idstore.Encoder(TOKENIZER), random.Random(3)
    odd = "abXYÄéßÿµÞ×ıſẞΣς中0123.,;:!?*#&$%|<>_-'\"\x1c\x85\xa0\u200b\u3000\u0301\xad\t\n ☃"
    texts = ["".join(rnd.choice(odd) if rnd.random() < 0.5 else rnd.choice("the Quick brown fóx, Élan. ") for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += [*ODD, "!" * 500, "a" * 200 + ".", "foo<|endoftext|>bar", "<|EndOfText|> x"]
    rows = pa.array(texts, pa.string())
    got = own.encode_all(rows.slice(0, 0)) + [ids for at in range(0, len(rows), 50) for ids in own.encode_all(rows.slice(at, 50))]
    assert got == [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], own.kind).tobytes() for t in texts]


def test_token_file_access():
    dictionary = b"\1\0\2\0" * 20
    import zstandard

    zstd = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    arrays = [np.arange(n, dtype="<u2") for n in (1, 500, 3)]
    data = idstore.file_image(7, [(k or None, len(a), zstd.compress(a.tobytes())) for k, a in enumerate(arrays)], hashlib.sha256(dictionary).digest(), 2) + b"\n"
    own = idstore.IdFile(data, dictionary)
    assert own.doc_ids == [None, 1, 2] and all(np.array_equal(own.ids(k), a) for k, a in enumerate(arrays))
    with pytest.raises(ValueError):
        idstore.IdFile(data, b"other")


# -- pipeline -------------------------------------------------------------
def test_pipeline_stages_by_brute_force(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]
    out = {}
    frame = docs_
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.staged(stage(spark, frame, SF), name)
        out[name] = frame
        if name != "packing":
            assert frame.columns == docs_.columns
    texts = {name: {r.doc_id: r.text for r in f.collect()} for name, f in out.items() if name != "packing"}
    scored = toxicity.report(docs_, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(texts["toxicity"]) == {r.doc_id for r in scored if not r.predicted}
    fps = {i: simhash.fingerprint(t) for i, t in texts["toxicity"].items()}
    left, reach = set(fps), set()
    while left:
        queue = [min(left)]
        reach.add(queue[0])
        left.discard(queue[0])
        while queue:
            at = queue.pop()
            near = {j for j in left if (fps[j] ^ fps[at]).bit_count() <= 4}
            left -= near
            queue.extend(near)
    assert set(texts["near_copies"]) == reach
    windows = {w for (t,) in bench.select("text").collect() for w in decontam.windows_of(decontam.words_of(t))}
    clean = {i for i, t in texts["near_copies"].items() if not (w := decontam.words_of(t)) or not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w)))}
    assert set(texts["decontamination"]) == clean == set(texts["secrets"])
    placed = Counter()
    for r in packing.placements(out["packing"]).collect():
        placed[r.doc_id] += r.n_tokens
    own = idstore.encoder(TOKENIZER)
    assert placed == {i: len(own.encode_all(pa.array([t]))[0]) // own.kind.itemsize for i, t in texts["secrets"].items()}
    assert corpus_pipeline.run(spark, SF).count() == out["packing"].count()


def test_sweep_deletes_working_tables_only(spark):
    since = common.mark()
    gone, kept = (common.staged(docs(spark, ["a", "b"]), n) for n in ("gone", "kept"))
    before = {f.rpartition("/")[0] for f in gone.inputFiles()}
    common.sweep(spark, since, keep=kept)
    assert kept.count() == 2 and not any(pathlib.Path(f.removeprefix("file:").replace("///", "/")).exists() for f in before)
    assert common.mark() == since + 1


def test_pipeline_keeps_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "x", "y", 0), (3, "password=abcdefgh12 é", None, None, 5), (3, "password=abcdefgh12 é", None, None, 5), (None, "null id row here", None, None, 1)]
    for name, table, schema in (("documents", rows, DOCS), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        frame = spark.createDataFrame(table, schema)
        if name == "documents":  # names that operators use themselves
            frame = frame.selectExpr("*", "doc_id + 7 as Score", "'x' as contaminated", "1 as toxic", "2 as fp", "3 as N_Words", "4 as repeated_")
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and all(r.contaminated == "x" and r.Score == (r.doc_id and r.doc_id + 7) and r.N_Words == 3 for r in out.collect())
    got = packing.placements(corpus_pipeline.run(spark, str(tmp_path))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]


# -- rows and ids of any kind ---------------------------------------------
def test_one_copy_stays_of_rows_that_share_hashes_but_for_nulls(spark):
    rows = [(None, "m n o p q"), ("m n o p q", None), ("z", None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {tuple(r) for r in kept} == {(None, "m n o p q"), ("m n o p q", None)}


def test_shards_are_the_same_however_rows_are_partitioned(spark):
    rows = [(k % 290 if k % 7 else None, f"some text {k % 290} " * (k % 40)) for k in range(300)] + [(5, "same row")] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    made = [sorted(tuple(map(str, r)) for r in packing.pack(frame.repartition(n), path, shard=32).collect()) for n in (1, 7)]
    assert made[0] == made[1]


def test_toxicity_takes_text_ids(spark):
    docs = [(f"d{k}" if k % 9 else str(k), "a vile scumbag text" if k % 3 == 0 else "a mild and friendly text") for k in range(600)]
    labels = [(k, int(k % 3 == 0)) for k in range(0, 600, 9)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.keep_clean(spark.createDataFrame(docs, "doc_id string, text string"), model).count() <= 600


def test_what_the_driver_collects_of_patterns_is_bounded(spark, monkeypatch):
    """50,000 telling words: no more patterns than the bound are collected, those with the most evidence."""
    monkeypatch.setattr(toxicity, "PATTERNS", 1000)
    rnd = np.random.default_rng(4)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:06d}")
    rows = [(" ".join(word(k) for k in range(s, s + 500)), 1) for s in range(0, 50_000, 500) for _ in range(12)] + [(" ".join(word(k) for k in rnd.integers(500_000, 900_000, 300)), 0) for _ in range(1200)]
    found, clean, bad = toxicity.candidates(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(found) == 1000 and clean and bad
    assert all(b > 1 for _, _, b in found)
