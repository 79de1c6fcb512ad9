"""Toxicity by weak supervision.

1. Words are counted over all labelled training texts, by label. Whole words and word
   beginnings whose counts tell the classes apart beyond chance become patterns.
2. Many voters - single patterns, pools of the others, numbers of evidence words, surface
   patterns and the annotation itself - vote on every training document or abstain. A
   generative model with a latent class estimates by expectation-maximisation how often each
   votes in either class; each voter depends on the class and on one other voter, the parent
   in a maximum spanning tree of conditional mutual information, so that voters that repeat
   each other count once. As in data programming an abstention tells nothing of the class;
   a voter of its own stands for texts without evidence.
3. A logistic regression is trained on the posterior labels of a bounded sample of training
   documents, with and without annotation, and scores every whole text.

Only training rows, those whose crc32(doc_id as text) mod 4 is not 2, are learned from, votes
included. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, columns, staged

#: Training rows that the classifier is fitted on, at most: annotated toxic, annotated clean, not annotated.
SAMPLE = {1: 8_000, 0: 16_000, -1: 8_000}
#: Patterns of the model, at most: those with the most evidence. They are counted over all training rows; their number is
#: a size of the model, bounds what the driver collects and what workers are sent (some 30 bytes each).
PATTERNS = 1 << 16
#: Least log-odds of a pattern; its likelihood ratio must also exceed what the best of all patterns has by chance.
LEAST_ODDS = 1.0
#: A longer pattern needs this much more log-odds than a kept one that it begins with.
NESTED = 2.0
PREFIXES = (3, 4, 5, 6, 7)
#: The first patterns vote alone, the others in pools; the first FEATURES are features, the others count by band of odds.
SINGLE, POOLS, FEATURES, BANDS = 36, 6, 400, 4
VOTERS = SINGLE + POOLS + 8
#: EM ends when no rate moves by more than this; vote patterns beyond LOCAL_VOTES are summed on the cluster.
SETTLED, EM_MOST, LOCAL_VOTES = 1e-5, 500, 200_000
#: Pairs of voters with less mutual information (nats) are independent.
LEAST_INFORMATION = 1e-3
#: Rows of labels (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
CUT = 0.3
CACHE = 500_000
#: General insults that vote from the start, before any induction; SEED_ODDS is their assumed evidence.
SEEDS = (
    "arschloch asshole bastard bitch cabron canaille clown cretin crétin cunt degenerate despicable dickhead disgusting dumb dumbass estupido estúpido faggot filth "
    "filthy fool freak fuck fucking garbage gilipollas hate hideous hurensohn idiot idiota idiote imbecil imbecile imbécil imbécile jerk kill loser losers maricon "
    "mierda miststück moron morons nazi nutjob parasite pathetic pendejo piece pig pute puta retard retarded ridiculous rubbish salaud salope scheisse scheiße "
    "scum scumbag shit sick slut spast stupid subhuman swine trash trottel ugly useless vermin whore wichser worthless"
).split()
SEED_ODDS = 3.0
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def words_of(text: str) -> tuple[set[str], int]:
    """Distinct lower-cased words of letters, and how many white-space words there are."""
    raw = text.lower().split()
    found: set[str] = set()
    for token in set(raw):
        if token.isalpha():
            found.add(token)
        else:
            found.update(_LETTERS.findall(token))
    return found, len(raw)


def patterns_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    patterns: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    prior: float = 0.1
    annotation: np.ndarray = field(default_factory=lambda: np.array([0.05, 0.9]))
    """P(annotated toxic | class, annotated)."""
    parent: np.ndarray = field(default_factory=lambda: np.full(VOTERS, -1))
    """The voter that each voter depends on; -1: none."""
    fires: np.ndarray = field(default_factory=lambda: np.full((2, 2, VOTERS), 0.5))
    """P(vote | class, whether the parent votes)."""
    weights: np.ndarray | None = None
    bias: float = 0.0
    rounds: int = 0


# -- evidence of a text ---------------------------------------------------
class Reader:
    """Evidence of texts under a model's patterns."""

    def __init__(self, model: Model):
        self.at = {p: k for k, p in enumerate(model.patterns)}
        self.odds = model.odds
        top = max(model.odds, default=1.0)
        self.band = [min(BANDS - 1, int(BANDS * o / (top + 1e-9))) if o > 0 else 0 for o in model.odds]
        self.seen: dict[str, tuple[int, ...]] = {}

    def read(self, text: str | None) -> tuple[set[int], np.ndarray]:
        """Numbers of the patterns that occur, and dense features: logarithms and shares of the number of
        evidence words, of their odds, and of the evidence words in each band of odds."""
        text = text or ""
        words, n = words_of(text)
        found: set[int] = set()
        own, total, bands = 0, 0.0, [0] * BANDS
        seen, at = self.seen, self.at
        for w in words:
            hits = seen.get(w)
            if hits is None:
                if len(seen) >= CACHE:
                    seen.clear()
                hits = seen[w] = tuple(sorted((at[p] for p in patterns_of(w) if p in at), key=lambda k: -self.odds[k]))
            if hits:
                found.update(hits)
                own += 1
                total += self.odds[hits[0]]
                bands[self.band[hits[0]]] += 1
        share = own / (len(words) + 5)
        shouts = min(1.0, 10 * text.count("!") / (n + 1))
        dense = [own > 0, math.log1p(own), math.log1p(total) / 2, min(1.0, 10 * share), shouts, *(math.log1p(b) for b in bands)]
        return found, np.array([*dense, own, n], dtype=np.float64)

    def votes(self, found: set[int], dense: np.ndarray) -> int:
        """Bit mask of the voters that fire."""
        mask = 0
        for k in found:
            mask |= 1 << (k if k < SINGLE else SINGLE + k % POOLS)
        own, n, base = dense[-2], dense[-1], SINGLE + POOLS
        rules = (own >= 2, own >= 3, own >= 5, dense[3] >= 0.3, dense[3] >= 0.8, dense[4] >= 0.3, own == 0, own == 1 and n >= 100)
        for k, fires in enumerate(rules):
            mask |= int(bool(fires)) << (base + k)
        return mask


#: Dense features; the last two of ``Reader.read`` are for the voters only.
DENSE = 5 + BANDS


# -- patterns -------------------------------------------------------------
def annotated(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one training row per annotated document; any toxic annotation counts."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    seen = (Counter(), Counter())

    def flush():
        keys = list(seen[0].keys() | seen[1].keys())
        out = pa.record_batch({"word": pa.array(keys, pa.string()), "clean": pa.array([seen[0][k] for k in keys], pa.int64()), "bad": pa.array([seen[1][k] for k in keys], pa.int64())})
        seen[0].clear()
        seen[1].clear()
        return out

    for batch in batches:
        for text, toxic in columns(batch, "text", "toxic"):
            seen[toxic].update(words_of(text or "")[0])
        if len(seen[0]) + len(seen[1]) >= CACHE:
            yield flush()
    yield flush()


def candidates(texts: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """Patterns of all annotated training texts (text, toxic) that tell the classes apart beyond chance, with
    how many (text, word) pairs of each class have them, and all such pairs of each class."""
    words = staged(texts.mapInArrow(_word_counts, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")), "words")
    clean, bad, many = words.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    if not (clean and bad):
        return [], clean, bad
    starts = [F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES]
    each = words.select("clean", "bad", F.explode(F.array_compact(F.array(F.concat(F.lit("="), F.col("word")), *starts))).alias("pattern"))
    total = each.groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("bad > 1")
    a, b = F.col("bad").cast("double"), F.col("clean").cast("double")
    share = bad / (bad + clean)
    ratio = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (clean + 1)))
    chance = 2 * math.log(max(many, 2))
    told = total.where((ratio >= chance) & (odds >= LEAST_ODDS)).orderBy((F.col("bad") * odds).desc(), "pattern").limit(PATTERNS)
    rows = told.select("pattern", "clean", "bad").collect()
    return [(r.pattern, r.clean, r.bad) for r in rows], clean, bad


def log_odds(bad: float, clean: float, all_bad: int, all_clean: int) -> float:
    return math.log(((bad + 0.5) / (all_bad + 1)) / ((clean + 0.5) / (all_clean + 1)))


def induce(found: list[tuple[str, int, int]], all_clean: int, all_bad: int) -> tuple[list[str], list[float]]:
    """The patterns with the most evidence first, then the seeds, with log-odds. Of patterns that lie within each
    other one is kept, unless what it has besides the kept ones is evidence by itself."""
    left = {p: [clean, bad] for p, clean, bad in found}
    strength = lambda p: left[p][1] * log_odds(left[p][1], left[p][0], all_bad, all_clean)
    kept: dict[str, float] = {}
    for p in sorted(left, key=lambda p: (-strength(p), p)):
        clean, bad = left[p]
        odds = log_odds(bad, clean, all_bad, all_clean)
        above = [q for q in patterns_of(p[1:]) if q != p] if p[0] == "=" else [p[:n] for n in PREFIXES if n < len(p)]
        if bad < 2 or odds < LEAST_ODDS or any(q in kept and kept[q] >= odds - NESTED for q in above):
            continue
        kept[p] = odds
        for q in above:
            if q in left:
                left[q] = [max(0, left[q][0] - clean), max(0, left[q][1] - bad)]
    for word in SEEDS:
        kept.setdefault(f"={word}", SEED_ODDS)
    return list(kept), list(kept.values())


# -- label model ----------------------------------------------------------
def _unpack(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


def posterior(model: Model, masks: np.ndarray, annotation: np.ndarray) -> np.ndarray:
    """P(toxic | votes, annotation) under the generative model; annotation: 1, 0, or -1 for none."""
    bits = _unpack(masks)
    above = np.where(model.parent >= 0, bits[:, np.maximum(model.parent, 0)], 0)
    gain = np.log(model.fires[1] / model.fires[0])
    logit = math.log(model.prior / (1 - model.prior)) + (bits * np.where(above > 0, gain[1], gain[0])).sum(axis=1)
    said = np.log([(1 - model.annotation[1]) / (1 - model.annotation[0]), model.annotation[1] / model.annotation[0]])
    logit = logit + np.where(annotation < 0, 0.0, said[np.maximum(annotation, 0)])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def moments(model: Model, masks: np.ndarray, annotation: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts per class: documents, annotated, annotated toxic, votes, pairs of votes."""
    bits, p = _unpack(masks), posterior(model, masks, annotation)
    out = []
    for w in (n * (1 - p), n * p):
        out.append(np.concatenate(([w.sum(), w[annotation >= 0].sum(), w[annotation == 1].sum()], w @ bits, (bits.T * w @ bits).ravel())))
    return np.stack(out)


def dependency_tree(count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Parent of each voter in the maximum spanning tree of conditional mutual information given the
    class, without edges below LEAST_INFORMATION."""
    information = np.zeros((VOTERS, VOTERS))
    for y in (0, 1):
        n = count[y] + 2
        both = (pairs[y] + 0.5) / n
        one = np.minimum((np.diag(pairs[y]) + 1) / n, 1 - 1 / n)
        for i, j, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
            joint = np.maximum(joint, 0.25 / n)
            a, b = one if i else 1 - one, one if j else 1 - one
            information += count[y] / count.sum() * joint * np.log(joint / (a[:, None] * b[None, :]))
    parent, best, source = np.full(VOTERS, -1), information[0].copy(), np.zeros(VOTERS, dtype=np.int64)
    outside = np.ones(VOTERS, dtype=bool)
    outside[0] = False
    while outside.any():
        k = int(np.flatnonzero(outside)[best[outside].argmax()])
        if best[k] >= LEAST_INFORMATION:
            parent[k] = source[k]
        outside[k] = False
        closer = information[k] > best
        best[closer], source[closer] = information[k][closer], k
    return parent


def maximise(model: Model, total: np.ndarray) -> float:
    """Set the rates from expected counts; returns the largest move."""
    n, ruled, toxic = total[:, 0], total[:, 1], total[:, 2]
    votes, pairs = total[:, 3 : 3 + VOTERS], total[:, 3 + VOTERS :].reshape(2, VOTERS, VOTERS)
    before = np.concatenate([model.fires.ravel(), model.annotation])
    at, up = np.arange(VOTERS), np.maximum(model.parent, 0)
    with_parent = np.where(model.parent >= 0, pairs[:, at, up], 0)
    parents = np.where(model.parent >= 0, votes[:, up], 0)
    # half a count each way, shared by the classes in proportion, keeps what never happened finite
    model.fires = np.stack([(votes - with_parent + 0.5) / (n[:, None] - parents + 1), (with_parent + 0.5) / (parents + 1)], axis=1)
    model.annotation = np.clip((toxic + np.array([0.05, 0.95])) / (ruled + 1), 1e-4, 1 - 1e-4)
    return float(np.abs(np.concatenate([model.fires.ravel(), model.annotation]) - before).max())


def _moments(model: Model):
    """``moments`` of vote rows (mask, annotation, n) as rows (k, v): a map-side part of one round."""

    def add(batches):
        total = np.zeros((2, 3 + VOTERS + VOTERS * VOTERS))
        for batch in batches:
            total += moments(model, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "annotation", "n")))
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.record_batch({"k": pa.array(at.astype(np.int32)), "v": pa.array(flat[at])})

    return add


def fit_label_model(model: Model, votes: DataFrame, local_votes: int = LOCAL_VOTES) -> None:
    """Rates, dependencies and annotation accuracy by EM over the vote patterns (mask, annotation, n) of all
    training documents, until nothing moves. The prior, the share of toxic annotations, stays; the
    first rates and the dependencies come from the annotated documents, annotations taken at their word."""

    def expectation(part: DataFrame):
        """The function that gives the expected counts of these votes under the model as it is."""
        if part.count() <= local_votes:
            rows = part.select("mask", "annotation", "n").orderBy("mask", "annotation").toArrow()
            arrays = [rows[c].to_numpy() for c in ("mask", "annotation", "n")]
            return lambda: moments(model, *arrays)

        def on_cluster():
            total = np.zeros(2 * (3 + VOTERS + VOTERS * VOTERS))
            for k, v in part.mapInArrow(_moments(model), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
                total[k] = v
            return total.reshape(2, -1)

        return on_cluster

    model.prior = float(np.clip(model.prior, 1e-4, 0.5))
    model.annotation = np.array([1e-6, 1 - 1e-6])
    first = expectation(votes.where("annotation >= 0"))()
    model.parent = dependency_tree(first[:, 0], first[:, 3 + VOTERS :].reshape(2, VOTERS, VOTERS))
    maximise(model, first)
    expected = expectation(votes)
    for model.rounds in range(1, EM_MOST + 1):
        if maximise(model, expected()) < SETTLED:
            break


# -- classifier -----------------------------------------------------------
def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft targets by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * weight.sum() / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * w
        root = np.sqrt(weight * np.maximum(p * (1 - p), 1e-6)).astype(x.dtype)
        scaled = x * root[:, None]
        hessian = (scaled.T @ scaled).astype(np.float64) + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _votes(model: Model):
    """(doc_id, text) -> (doc_id, mask)."""

    def vote(batches):
        reader = Reader(model)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "mask": pa.array([reader.votes(*reader.read(t)) for (t,) in columns(batch, "text")], pa.int64())})

    return vote


def _evidence(model: Model):
    """Sample rows (text, annotation) -> distinct (hits, dense, mask, annotation) of a batch with their number."""

    def read(batches):
        reader = Reader(model)
        for batch in batches:
            made = Counter()
            for text, said in columns(batch, "text", "annotation"):
                found, dense = reader.read(text)
                made[tuple(sorted(k for k in found if k < FEATURES)), tuple(np.round(dense[:DENSE], 3).tolist()), reader.votes(found, dense), said] += 1
            hits, dense, mask, said = zip(*made, strict=True) if made else ((), (), (), ())
            kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.int64()]
            rows = [list(hits), list(dense), mask, said, list(made.values())]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["hits", "dense", "mask", "annotation", "n"])

    return read


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit patterns, label model and classifier. Without both classes in the training rows
    the model knows nothing and scores zero. Ids of ``labels`` are compared as the type of those of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    ruled = staged(annotated(labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), "toxic")), "annotations")
    counts = {r.toxic: r["count"] for r in ruled.groupBy("toxic").count().collect()}
    model = Model()
    if not (counts.get(0) and counts.get(1)):
        return model
    side = F.broadcast(ruled) if sum(counts.values()) <= BROADCAST_ROWS else ruled
    training = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    found, all_clean, all_bad = candidates(training.join(side, "doc_id").select("text", "toxic"))
    if not (all_clean and all_bad):
        return model
    model.prior = counts[1] / sum(counts.values())
    model.patterns, model.odds = induce(found, all_clean, all_bad)
    masks = training.mapInArrow(_votes(model), f"doc_id {dict(docs.dtypes)['doc_id']}, mask long")
    rows = staged(masks.join(side, "doc_id", "left").select("doc_id", "mask", F.coalesce("toxic", F.lit(-1)).alias("annotation")), "votes")
    fit_label_model(model, staged(rows.groupBy("mask", "annotation").agg(F.count("*").alias("n")), "vote-patterns"))
    many = {r.annotation: r["count"] for r in rows.groupBy("annotation").count().collect()}
    picks = [rows.where((F.col("annotation") == k) & F.col("doc_id").isNotNull()).select("doc_id", "annotation").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    ids = staged(picks[0].unionByName(picks[1]).unionByName(picks[2]), "sample-ids")
    sample = training.join(F.broadcast(ids), "doc_id").select("text", "annotation")  # ids are bounded by SAMPLE
    made = sample.mapInArrow(_evidence(model), "hits array<int>, dense array<double>, mask long, annotation int, n long")
    kept = made.groupBy("hits", "dense", "mask", "annotation").agg(F.sum("n").alias("n"))
    # an id may stand for many texts: the rows are bounded like the ids
    evidence = kept.orderBy(F.xxhash64("hits", "dense", "mask", "annotation"), "hits", "dense").limit(sum(SAMPLE.values())).collect()
    evidence.sort(key=lambda r: (r.hits, r.dense, r.mask, r.annotation))
    width = min(FEATURES, len(model.patterns))
    x = np.zeros((len(evidence), width + DENSE), dtype=np.float32)
    for k, r in enumerate(evidence):
        x[k, r.hits] = 1
        x[k, width:] = r.dense
    mask, said, n = (np.array([r[c] for r in evidence], dtype=np.int64) for c in ("mask", "annotation", "n"))
    drawn = {k: n[said == k].sum() for k in SAMPLE}
    share = np.array([many.get(k, 0) / max(1, drawn[k]) for k in said.tolist()])  # the sample stands for all training rows
    weight = share * n
    model.weights, model.bias = logistic(x, posterior(model, mask, said), weight * (n.sum() / weight.sum()))
    return model


# -- scores ---------------------------------------------------------------
class Scorer:
    """Scores of texts: 0 to 1."""

    def __init__(self, model: Model):
        self.model, self.reader, self.width = model, Reader(model), min(FEATURES, len(model.patterns))

    def of(self, texts) -> np.ndarray:
        model, width, made = self.model, self.width, []
        for text in texts:
            if model.weights is None:
                made.append(-np.inf)
                continue
            found, dense = self.reader.read(text)
            made.append(model.bias + dense[:DENSE] @ model.weights[width:] + sum(model.weights[j] for j in sorted(found) if j < width))
        return 1 / (1 + np.exp(-np.clip(np.array(made, dtype=np.float64), -np.inf, 30))) if made else np.zeros(0)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; predicted is 1 if score >= CUT.
    Null and empty texts are scored like any text without evidence."""
    bounded_batches(docs.sparkSession)

    def score(batches):
        scorer = Scorer(model)
        for batch in batches:
            made = scorer.of(t for (t,) in columns(batch, "text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(made), "predicted": pa.array((made >= CUT).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever they are called, that aren't predicted to be toxic. Null and empty
    texts are scored like any text without evidence, very long ones whole; null ids and repeated rows stay or go by their texts;
    an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.of(batch.column("text").to_pylist()) < CUT))

    return docs.mapInArrow(keep, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts, and texts of any length, are scored whole; a null doc_id is a training row
    without annotation. Repeated rows stay repeated and have equal scores; of several annotations of
    a document any toxic one counts, null ones none. Texts with equal evidence tie. Other columns are
    ignored. Without annotations of both classes every score is zero; an empty table gives no rows.
    """
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
