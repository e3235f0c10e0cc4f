"""Problem 7: abusive, hateful and sexual content.

Multiple-instance learning from the labels of whole texts: the texts of labelled thread pairs are bags of sentences, and the
rule cluster's label says, not reliably, whether a bag holds an offence. Each sentence has a probability per category, linear
in hashed words and word pairs; a text's is the noisy-or of its sentences. Training sees nothing but the labels: there is no
list of offensive words or sentences. The sentence that says most for a category is the one named as offending.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_id, community_key, has_text
from ..session import cut
from ..sources.tables import table
from .models import fitted
from .pairs import distinct_pairs, needed_texts, sides

CATEGORIES = ("abuse", "hate", "sexual")
BUCKETS = 1 << 20
#: Labelled pairs used of each category and of all other labels together; chosen by hash.
FIT_PAIRS = 5_000
#: Words of an instance; longer sentences become overlapping instances.
WINDOW = 14
#: Log-odds of a sentence that holds nothing the model knows.
NOTHING = -8.0
#: Fewest positive texts a word or word pair must be in, and the log-likelihood ratio it must reach, to be looked at.
LEAST, RATIO = 3, 14.0
#: Precision of the normal prior on weights.
PRIOR = 0.25
#: Precision of the normal priors on the slope (about 1) and shift (about 0) that correct judged log-odds.
SLOPE_PRIOR, SHIFT_PRIOR = 10.0, 5.0
#: Score from which a text counts as being of its likeliest category.
THRESHOLD = 0.4

_LEET = str.maketrans("013457@$", "oieastas")

_CUT = re.compile(r"[.!?…\n]+(?=\s|$)")
_TOKEN = re.compile(r"[^\W_][\w*@$']*|\*[\w*]+")
_LETTERS = re.compile(r"\b\w[ .-]\w[ .-]\w[ .-]\w\b")
_SPELLED = re.compile(r"\b(?:\w[ .-]){3,}\w\b")


def plain(word: str) -> str:
    """A word without tricks of spelling: digits for letters, stretched letters; starred ones become one token."""
    if word.isalpha() and word.isascii():
        w = word
    elif "*" in word:
        return "*masked*"
    else:
        w = word.strip("'")
        if not w.isalpha() and any(c.isalpha() for c in w) and not w[0].isupper():
            w = w.translate(_LEET)
        elif w.isdigit():
            return "0"
    for c in w:
        if c * 3 in w:
            w = re.sub(r"(.)\1{2,}", r"\1", w)
            break
    return w


class Words:
    """Hashes of words, remembered per worker."""

    def __init__(self, limit: int = 500_000):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        import xxhash

        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = xxhash.xxh32_intdigest(plain(t))
        return np.fromiter(map(memo.__getitem__, tokens), np.uint32, len(tokens))


def instances(texts: list[str], words: Words) -> tuple[np.ndarray, ...]:
    """Features and, of each instance (window of a sentence), the text, sentence, and range of features.

    A feature belongs to a word: its own bucket, and that of it and the word before it in the sentence.
    """
    tokens: list[str] = []
    owner, number, length = [], [], []
    for i, t in enumerate(texts):
        t = t.lower()
        if not t.isascii():
            t = t.replace("​", "").replace("‍", "").replace("’", "'")
        if _LETTERS.search(t):
            t = _SPELLED.sub(lambda m: re.sub(r"[ .-]", "", m[0]), t)
        for k, s in enumerate(_CUT.split(t)):
            w = _TOKEN.findall(s)
            if w:
                tokens += w
                owner.append(i)
                number.append(k)
                length.append(len(w))
    h = words(tokens)
    length = np.array(length, np.int64)
    start = np.cumsum(length) - length
    prev = np.concatenate([[np.uint32(7)], h[:-1]]) if len(h) else h
    prev[start] = 7
    before = np.concatenate([[np.uint32(11)], prev[:-1]]) if len(h) else h
    before[start] = 11
    mask = np.uint32(BUCKETS - 1)
    mix = lambda x: (x ^ (x >> np.uint32(13))) * np.uint32(0x5BD1E995)
    pair = mix(h * np.uint32(31) + prev * np.uint32(0x9E3779B1))
    skip = mix(h * np.uint32(17) + before * np.uint32(0x85EBCA77) + np.uint32(3))
    features = np.stack([mix(h) & mask, pair & mask, skip & mask], axis=1).astype(np.int64)
    extra = np.maximum(0, -(-(length - WINDOW) // (WINDOW // 2)))
    rep = np.repeat(np.arange(len(length)), extra + 1)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(extra + 1) - (extra + 1), extra + 1)
    lo = start[rep] + nth * (WINDOW // 2)
    hi = np.minimum(lo + WINDOW, start[rep] + length[rep])
    return features, np.array(owner, np.int64)[rep] if len(rep) else rep, np.array(number, np.int64)[rep] if len(rep) else rep, lo, hi


class Model:
    """Weights of the features that have any, per category."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.features, self.weights, self._all = features, weights.astype(np.float32), None

    def __getstate__(self):
        return {"features": self.features, "weights": self.weights, "_all": None}

    def scores(self, texts: list[str], words: Words):
        """Per instance: text, sentence, probability of each category."""
        if self._all is None:
            self._all = np.zeros((BUCKETS, 3), np.float32)
            self._all[self.features] = self.weights
        features, who, sentence, lo, hi = instances(texts, words)
        if not len(who):
            return who, sentence, np.empty((0, 3))
        each = self._all[features[:, 0]] + self._all[features[:, 1]] + self._all[features[:, 2]]
        run = np.concatenate([np.zeros((1, 3)), np.cumsum(each, axis=0, dtype=np.float64)])
        return who, sentence, 1 / (1 + np.exp(-(run[hi] - run[lo] + NOTHING)))

    def texts(self, texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text, and for each category the sentence that says most for it.

        Windows of one sentence say the same thing, so a sentence counts once, by its best window.
        """
        who, sentence, p = self.scores(texts, words)
        none, worst = np.zeros((len(texts), 3)), np.zeros((len(texts), 3), np.int64)
        if not len(who):
            return none, worst
        first = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(sentence) != 0)]))
        p, who, sentence = np.maximum.reduceat(p, first, axis=0), who[first], sentence[first]
        np.add.at(none, who, np.log1p(-np.minimum(p, 1 - 1e-9)))
        top = np.zeros((len(texts), 3))
        np.maximum.at(top, who, p)
        for k in range(3):
            at = p[:, k] == top[who, k]
            worst[who[at], k] = sentence[at]
        return 1 - np.exp(none), worst


class _Bags:
    """Instances and features of texts, in arrays, for training. Features of fewer than LEAST texts are left out."""

    def __init__(self, texts: list[str]):
        features, self.who, _, lo, hi = instances(texts, Words())
        self.n, size = len(texts), hi - lo
        token = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        inst = np.repeat(np.arange(len(self.who), dtype=np.int32), size)
        owner = np.zeros(len(features), np.int64)
        owner[token] = self.who[inst]
        both = np.unique((np.repeat(owner, 3) << 20) | features.ravel())
        often = np.bincount(both & (BUCKETS - 1), minlength=BUCKETS)
        self.buckets = np.flatnonzero(often >= LEAST)
        index = np.full(BUCKETS, -1, np.int32)
        index[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        both = both[index[both & (BUCKETS - 1)] >= 0]
        self.bag, self.feature = (both >> 20).astype(np.int32), index[both & (BUCKETS - 1)]
        each = index[features[token]]
        rows, cols = np.nonzero(each >= 0)
        self.inst, self.each = inst[rows], each[rows, cols]

    def telling(self, z: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features that texts with an offence (z, per category) have more often than others beyond chance, and log-odds of them."""
        use = use.astype(float)
        m = len(self.buckets)
        total, start = np.bincount(self.feature, weights=use[self.bag], minlength=m), np.zeros((m, 3))
        for c in range(3):
            share = (z[:, c] * use).sum() / max(1.0, use.sum())
            if not 0 < share < 1:
                continue
            a = np.bincount(self.feature, weights=(z[:, c] * use)[self.bag], minlength=m)
            at = np.flatnonzero((a >= LEAST) & (a > share * total))
            x, t = a[at], total[at]
            r = np.minimum(x / t, 1 - 1e-9)
            at = at[2 * (x * np.log(r / share) + (t - x) * np.log((1 - r) / (1 - share))) >= RATIO]
            start[at, c] = np.log((a[at] + 0.5) / (np.maximum(0, total[at] - a[at]) + 0.5) * (1 - share) / share)
        ids = np.flatnonzero(start.any(axis=1))
        return ids, start[ids]

    def chances(self, ids: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Noisy-or of each text; the instances with features of ids, their probabilities, and their features as pairs."""
        index = np.full(len(self.buckets), -1, np.int32)
        index[ids] = np.arange(len(ids))
        f = index[self.each]
        rows = np.flatnonzero(f >= 0)
        f = f[rows]
        used, i = np.unique(self.inst[rows], return_inverse=True)
        return self._noisy_or(used, i, f, w) + (used, i, f)

    def _noisy_or(self, used, i, f, w):
        s = np.stack([np.bincount(i, weights=np.ascontiguousarray(w[:, c])[f], minlength=len(used)) for c in range(3)], axis=1) + NOTHING
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        none = np.stack([np.bincount(self.who[used], weights=np.log1p(-np.minimum(p[:, c], 1 - 1e-9)), minlength=self.n) for c in range(3)], axis=1)
        return np.clip(1 - np.exp(none), 1e-6, 1 - 1e-6), p

    def learn(self, ids: np.ndarray, w: np.ndarray, z: np.ndarray, use: np.ndarray, steps: int, rate: float = 0.25, prior: float = PRIOR) -> np.ndarray:
        """Weights that maximise the likelihood of z under the noisy-or (Adam over all texts in use), with a normal prior."""
        if not len(ids):
            return w
        _, _, used, i, f = self.chances(ids, w)
        mine = self.who[used]
        weight = use.astype(float)[mine][:, None]
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            q, p = self._noisy_or(used, i, f, w)
            grad = weight * p * ((1 - z) - z * (1 - q) / q)[mine]
            g = np.stack([np.bincount(f, weights=np.ascontiguousarray(grad[:, c])[i], minlength=len(ids)) for c in range(3)], axis=1) + prior * w
            m1, m2 = 0.8 * m1 + 0.2 * g, 0.97 * m2 + 0.03 * g * g
            w = w - rate * (1 - 0.8 * step / steps) * (m1 / (1 - 0.8**step)) / (np.sqrt(m2 / (1 - 0.97**step)) + 1e-3)
        return w


def calibrate(q: np.ndarray, label: np.ndarray, hit: float, stray: float, steps: int = 40) -> tuple[np.ndarray, float, float]:
    """Corrected chances of an offence, and how often a label stands where there is one (hit) and where there is none (stray).

    The log-odds of q, judged by a model that hadn't seen the text, are off by a slope and a shift, as the prior on weights holds
    them back. These, hit and stray are those under which the labels are likeliest (EM; Newton's method within).
    """
    x = np.log(q / (1 - q))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        c = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        here = np.where(label > 0, hit, 1 - hit) * c
        z = here / (here + np.where(label > 0, stray, 1 - stray) * (1 - c))
        hit = np.clip((z * label).sum() / (z.sum() + 1e-9), 0.2, 0.95)
        stray = np.clip(((1 - z) * label).sum() / ((1 - z).sum() + 1e-9), 1e-6, 0.3)
        for _ in range(3):
            c = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
            v = c * (1 - c)
            g = [((z - c) * x).sum() - SLOPE_PRIOR * (slope - 1), (z - c).sum() - SHIFT_PRIOR * shift]
            h = [[(v * x * x).sum() + SLOPE_PRIOR, (v * x).sum()], [(v * x).sum(), v.sum() + SHIFT_PRIOR]]
            by = np.linalg.solve(h, g)
            slope, shift = np.clip(slope + np.clip(by[0], -0.5, 0.5), 0.3, 4), np.clip(shift + np.clip(by[1], -2, 2), -8, 8)
    return 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30))), hit, stray


def train(texts: list[str], labels: np.ndarray, *, folds: int = 3, rounds: int = 4, steps: int = 60, seed: int = 5) -> Model:
    """Weights under which the noisy-or of a text's sentences explains its labels [n, 3], which are taken to be wrong at times.

    A label stands with probability `hit` where there is an offence and with `stray` where there is none. How likely an offence
    is in a text given its label is judged in each round by a model of the other folds, which can't have learned this text by
    heart and is too unsure, so that `calibrate` corrects it; hit and stray come from there, and the features that are looked at
    follow. The last model learns from all texts, and once more with all features of the sentences it finds, which tell apart
    what only looks alike.
    """
    none = Model(np.zeros(0, np.int64), np.zeros((0, 3)))
    if not texts or not labels.any():
        return none
    bags = _Bags(texts)
    fold = np.random.default_rng(seed).integers(0, folds, len(texts))
    hit, stray = np.full(3, 0.6), 0.5 * labels.mean(axis=0)
    z = np.where(labels > 0, 0.6, 0.0)
    for _ in range(rounds):
        q = np.zeros_like(z)
        for k in range(folds):
            ids, start = bags.telling(z, fold != k)
            w = bags.learn(ids, 0.5 * start, z, fold != k, steps * 2 // 3)
            q[fold == k] = bags.chances(ids, w)[0][fold == k]
        for c in range(3):
            q[:, c], hit[c], stray[c] = calibrate(q[:, c], labels[:, c], hit[c], stray[c])
        here = np.where(labels > 0, hit, 1 - hit) * q
        z = here / (here + np.where(labels > 0, stray, 1 - stray) * (1 - q))
    everywhere = np.ones(len(texts), bool)
    ids, start = bags.telling(z, everywhere)
    if not len(ids):
        return none
    w = bags.learn(ids, 0.5 * start, z, everywhere, steps)
    _, p, used, _, _ = bags.chances(ids, w)
    near = np.zeros(len(bags.who), bool)
    near[used[p.max(axis=1) > 0.02]] = True
    more = np.union1d(ids, np.flatnonzero(np.bincount(bags.each[near[bags.inst]], minlength=len(bags.buckets)) >= LEAST))
    again = np.zeros((len(more), 3))
    again[np.searchsorted(more, ids)] = w
    return Model(bags.buckets[more], bags.learn(more, again, z, everywhere, steps))


#: What a cluster label that names a category has in it.
CUES = (("civil", "personal attack", "harass", "abus"), ("hate", "discriminat", "bigot"), ("nsfw", "sexual"))


def fit(comments: DataFrame, pairs: DataFrame, *, labelled: int = FIT_PAIRS) -> Model:
    """Trains on the violating and compliant texts of labelled pairs, at most `labelled` of each category and of other labels.

    A violating text is labelled with the category its pair's label names, if any; compliant texts have no label. The sample is
    chosen by hash and its size doesn't grow with the tables.
    """
    known = distinct_pairs(pairs)
    name = F.lower(F.trim("label"))
    kind = F.lit(3)
    for k, cues in reversed(list(enumerate(CUES))):
        kind = F.when(F.coalesce(name.rlike("|".join(cues)), F.lit(False)), k).otherwise(kind)
    known = cut(known.withColumn("kind", kind))
    sizes = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    share = F.coalesce(*[F.when(F.col("kind") == k, min(1.0, labelled / n)) for k, n in sizes.items()], F.lit(0.0))
    chosen = cut(known.where(F.pmod(F.xxhash64(F.lit(2), "pair"), F.lit(1_000_000)) < 1_000_000 * share))
    each = sides(chosen).join(chosen.select("pair", "kind"), "pair")
    rows = each.join(needed_texts(comments, each, few=True), "comment").groupBy("comment").agg(F.max("text").alias("text"), F.min(F.when(F.col("side") == "violating", F.col("kind")).otherwise(3)).alias("kind")).orderBy("comment").collect()
    return train([r.text for r in rows], np.array([[float(r.kind == k) for k in range(3)] for r in rows]).reshape(-1, 3))


def score(df: DataFrame, key: list[str], text: str, model: Model) -> DataFrame:
    """key, abuse, hate, sexual (probabilities), sentence (number of the sentence that says most for the likeliest).

    Null, blank and removed texts have score 0; sentence is null where no score is above 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, words = shared.value, Words()
        for pdf in batches:
            for k in range(0, len(pdf), 3_000):
                part = pdf.iloc[k : k + 3_000]
                p, worst = m.texts([t if isinstance(t, str) else "" for t in part["__t"]], words)
                top = p.argmax(axis=1)
                at = np.arange(len(part))
                out = {c: part[c].to_numpy() for c in key}
                out |= {c: np.round(p[:, j], 4) for j, c in enumerate(CATEGORIES)}
                out["sentence"] = pd.array(np.where(p[at, top] > 0, worst[at, top], -1), "Int64")
                yield pd.DataFrame(out)

    rows = df.select(*key, F.when(has_text(text), F.col(text)).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__t")
    out = rows.mapInPandas(run, schema + ", abuse double, hate double, sexual double, sentence bigint")
    return out.withColumn("sentence", F.when(F.col("sentence") >= 0, F.col("sentence")))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    comments = table(spark, folder, "comments")
    pairs = table(spark, folder, "thread_pairs")
    model = fitted(spark, "abuse", [comments, pairs], lambda: fit(comments, pairs))
    rows = comments.select(bare_id("id").alias("comment_id"), community_key("subreddit").alias("community"), "body_clean").where("comment_id is not null")
    return score(rows, ["comment_id", "community"], "body_clean", model)


def _category():
    top = F.greatest(*CATEGORIES)
    return F.when(top >= THRESHOLD, F.when(F.col("hate") == top, "hate").when(F.col("sexual") == top, "sexual").otherwise("abuse"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).withColumn("category", _category()).where("category is not null")
    # rows of one comment that have a text agree in it and so in category
    return rows.groupBy("comment_id").agg(F.min("category").alias("category"))


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every comment; one without a text in any of its rows has score 0."""
    return _scored(spark, folder).groupBy("comment_id").agg(*[F.max(c).alias(c) for c in CATEGORIES], F.max("sentence").alias("sentence"))


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per community, and per cluster label of the pairs a comment is in: comments and the share of each category."""
    rows = cut(_scored(spark, folder).withColumn("category", _category()).groupBy("comment_id").agg(F.max("community").alias("community"), F.min("category").alias("category")))
    pairs = distinct_pairs(table(spark, folder, "thread_pairs"))
    labels = sides(pairs).join(pairs.select("pair", "label"), "pair").select(F.col("comment").alias("comment_id"), F.coalesce("label", F.lit("(none)")).alias("name")).distinct()
    both = rows.select(F.lit("community").alias("kind"), F.col("community").alias("name"), "category").unionByName(rows.join(labels, "comment_id").select(F.lit("label").alias("kind"), "name", "category"))
    return both.groupBy("kind", "name").agg(F.count("*").alias("comments"), *[F.round(F.avg(F.when(F.col("category") == c, 1.0).otherwise(0.0)), 4).alias(c) for c in CATEGORIES])


QUERIES = {"p7_found": p7_found, "p7_scores": p7_scores, "p7_rates": p7_rates}
ORACLE: dict[str, str] = {}
