"""Problem 10: the subject areas of each document.

Documents, as normalised vectors of their words and word pairs, are clustered by bisecting k-means within each language, over
all documents: clusters too large for one task are cut by passes over the stored vectors, smaller ones are cut on within one. Every
document goes to its nearest leaf, and all counts are of all documents. A leaf is labelled by its discriminative terms, through the labelled documents these occur in, and by the labelled documents in it; there
is no list of subject words. Each sentence of a document then goes to the leaves by the odds its terms give each of them, and a
document has the subjects of the leaves in its mixture: those that a quarter of its sentences or more are about.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import has_text
from ..session import cut
from ..sources.tables import table
from .language import FREQUENT, LANGUAGES
from .models import fitted

#: Most documents of a cluster that one task holds and cuts on alone; characters of a long document (a test's measure).
FIT_DOCS, FIT_CHARS = 9_000, 6_000
#: Rounds of two-means over all documents of a cluster.
ROUNDS = 8
#: Most terms of the vectors and most leaves of a language, and fewest documents of a leaf.
TERMS, LEAVES, LEAF_DOCS = 3_000, 60, 12
SHARE = 0.25
#: Terms a task counts before it hands them on.
FLUSH = 200_000
#: Terms that say what a leaf is about; a leaf has a subject if its score for one reaches CLEAR.
TOP, CLEAR = 40, 0.18
#: Sentences a term must be in to be weighed, and how much likelier than usual it must make some subject.
SEEN, TIMES = 4, 2.0
#: Documents whose sentences are assigned at once.
CHUNK = 500

_FREQUENT = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_WORD = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"[.!?…]+(?=\s|$)|\n+")
_MARK = re.compile(r"^\s*(?:user\d+:|[#>*-]+)\s*")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; line marks are dropped, and so are sentences without a word."""
    return [w for s in _CUT.split(text.lower()) if (w := _WORD.findall(_MARK.sub("", s)))]


def terms(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bisect(x: np.ndarray, leaves: int = LEAVES, least: int = LEAF_DOCS, *, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """Leaf of each row: the leaf with most scatter is cut in two by spherical k-means until there are enough."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(len(x), int)
    scatter = {0: len(x) - float(np.linalg.norm(x.sum(axis=0)))} if len(x) else {}
    made = 1
    while scatter and made < leaves:
        k = max(scatter, key=lambda j: scatter[j])
        at = np.flatnonzero(leaf == k)
        scatter.pop(k)
        if len(at) < 2 * least:
            continue
        part = x[at]
        a = part[rng.integers(len(part))]
        c = np.stack([a, part[int((part @ a).argmin())]])
        for _ in range(rounds):
            side = (part @ c.T).argmax(axis=1)
            if side.min() == side.max():
                break
            c = np.stack([part[side == j].sum(axis=0) for j in (0, 1)])
            c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9
        sizes = np.bincount(side, minlength=2)
        if sizes.min() < least // 2:
            continue
        leaf[at[side == 1]] = made
        for j, rows in ((k, part[side == 0]), (made, part[side == 1])):
            scatter[j] = len(rows) - float(np.linalg.norm(rows.sum(axis=0)))
        made += 1
    return leaf


def language_of(text: str) -> str:
    """The language whose frequent words are most frequent in the text."""
    words = Counter(_WORD.findall(text.lower()))
    return max(LANGUAGES, key=lambda k: sum(n for w, n in words.items() if w in _FREQUENT[k]))


class Leaves:
    """Centres of the leaves of each language; a document of any size belongs to the nearest leaf of its language."""

    def __init__(self, vocabulary: dict[str, list[str]], idf: dict[str, np.ndarray]):
        self.index = {k: {t: i for i, t in enumerate(v)} for k, v in vocabulary.items()}
        self.idf, self.centres = idf, {}

    def vector(self, lang: str, doc: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Terms of the vocabulary in a document, their places and their weights, of length 1 together."""
        index = self.index.get(lang, {})
        n = Counter(t for s in doc for t in s if t in index)
        at = np.array([index[t] for t in n], int)
        v = np.log1p(np.fromiter(n.values(), np.float32, len(n))) * self.idf[lang][at] if n else np.zeros(0, np.float32)
        return list(n), at, v / (np.linalg.norm(v) + 1e-9)

    def nearest(self, lang: str, at: np.ndarray, v: np.ndarray) -> int:
        """-1 where no term of the vocabulary or no leaf of the language is there."""
        c = self.centres.get(lang)
        return int((c[:, at] @ v).argmax()) if c is not None and len(at) else -1


def vectors(texts: DataFrame, leaves: Leaves) -> DataFrame:
    """lang, h (a hash of the text), at, v: the vector of each document that has a term of the vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(leaves)

    def run(batches):
        m = shared.value
        for pdf in batches:
            out = []
            for h, text in zip(pdf["h"], pdf["text"]):
                lang = language_of(text)
                _, at, v = m.vector(lang, [terms(s) for s in sentences(text)])
                if len(at):
                    out.append((lang, h, at.astype(np.int32), v))
            yield pd.DataFrame(out, columns=["lang", "h", "at", "v"])

    return texts.select(F.xxhash64(F.lit(21), "text").alias("h"), "text").mapInPandas(run, "lang string, h bigint, at array<int>, v array<float>")


class _Cuts:
    """The cuts of clusters made so far: for each cluster cut in two its parts (2k + 1 and 2k + 2) and how their centres differ."""

    def __init__(self):
        self.of: dict[tuple[str, int], np.ndarray] = {}

    def place(self, pdf: pd.DataFrame) -> dict[tuple[str, int], np.ndarray]:
        """Rows of each cluster that isn't cut."""
        todo = [((lang, 0), rows) for lang, rows in pdf.groupby("lang").indices.items()]
        out = {}
        while todo:
            key, rows = todo.pop()
            if key not in self.of:
                out[key] = rows
                continue
            left = _dots(pdf, rows, self.of[key]) >= 0
            todo += [((key[0], 2 * key[1] + 1 + j), part) for j, part in enumerate((rows[left], rows[~left])) if len(part)]
        return out


def _flat(pdf: pd.DataFrame, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, v = pdf["at"].to_numpy()[rows], pdf["v"].to_numpy()[rows]
    return np.concatenate(at), np.concatenate(v), np.fromiter(map(len, at), np.int64, len(at))


def _dots(pdf: pd.DataFrame, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, v, size = _flat(pdf, rows)
    return np.add.reduceat(x[at] * v, np.cumsum(size) - size)


def _sums(rows: DataFrame, cuts: _Cuts, width: dict[str, int]) -> dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]]:
    """Documents of each cluster, the sum of their vectors, and the vector of the one whose hash is least."""

    def run(batches):
        n, total, first = Counter(), {}, {}
        for pdf in batches:
            h = pdf["h"].to_numpy()
            for key, at in cuts.place(pdf).items():
                n[key] += len(at)
                t, w, _ = _flat(pdf, at)
                total[key] = total.get(key, 0.0) + np.bincount(t, weights=w, minlength=width[key[0]])
                low = at[int(h[at].argmin())]
                if key not in first or h[low] < first[key][0]:
                    first[key] = (int(h[low]), _dense(pdf, low, width[key[0]]))
        yield pd.DataFrame([(*k, n[k], total[k].tobytes(), first[k][0], first[k][1].tobytes()) for k in n], columns=["lang", "node", "n", "total", "h", "first"])

    def add(pdf):
        low = int(pdf["h"].to_numpy().argmin())
        total = sum(np.frombuffer(x) for x in pdf["total"])
        return pd.DataFrame([(pdf["lang"][0], pdf["node"][0], pdf["n"].sum(), total.tobytes(), pdf["h"][low], pdf["first"][low])], columns=pdf.columns)

    schema = "lang string, node bigint, n bigint, total binary, h bigint, first binary"
    return {(r.lang, r.node): (r.n, np.frombuffer(r.total), np.frombuffer(r.first)) for r in rows.mapInPandas(run, schema).groupBy("lang", "node").applyInPandas(add, schema).collect()}


def _dense(pdf: pd.DataFrame, row: int, width: int) -> np.ndarray:
    x = np.zeros(width)
    x[pdf["at"].iloc[row]] = pdf["v"].iloc[row]
    return x


def _farthest(rows: DataFrame, cuts: _Cuts, width: dict[str, int], of: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """For each cluster in `of` the vector of its document that is least like the given one."""

    def run(batches):
        best: dict = {}
        for pdf in batches:
            h = pdf["h"].to_numpy()
            for key, at in cuts.place(pdf).items():
                if key in of:
                    d = _dots(pdf, at, of[key])
                    low = np.lexsort((h[at], d))[0]
                    if key not in best or (d[low], h[at[low]]) < best[key][:2]:
                        best[key] = (float(d[low]), int(h[at[low]]), _dense(pdf, at[low], width[key[0]]).tobytes())
        yield pd.DataFrame([(*k, *b) for k, b in best.items()], columns=["lang", "node", "d", "h", "x"])

    found = rows.mapInPandas(run, "lang string, node bigint, d double, h bigint, x binary").groupBy("lang", "node").agg(F.min(F.struct("d", "h", "x")).alias("b"))
    return {(r.lang, r.node): np.frombuffer(r.b.x) for r in found.collect()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x) + 1e-9)


def centres(rows: DataFrame, width: dict[str, int], docs: int) -> dict[str, np.ndarray]:
    """Centres of the leaves of each language, by bisecting k-means over all rows of vectors().

    A cluster of more than `docs` documents is cut by passes over all of them, all such clusters at once; the others are cut on
    by a task each. How many leaves a cluster may have is shared out by scatter.
    """
    cuts = _Cuts()
    known = _sums(rows, cuts, width)
    whole = {lang: n for (lang, _), (n, _, _) in known.items()}
    most = {k: max(2, min(LEAVES, n // LEAF_DOCS)) if n > 1 else 1 for (k, _), (n, _, _) in known.items()}
    least = {k: max(2, min(LEAF_DOCS, n // 40)) for k, n in whole.items()}
    may, final = {key: most[key[0]] for key in known}, set()
    while active := [k for k in sorted(known) if known[k][0] > docs and may[k] > 1 and k not in final]:
        a = {k: known[k][2] for k in active}
        b = _farthest(rows, cuts, width, a)
        pair = {k: (a[k], b[k]) for k in active}
        before, sums = None, {}
        for _ in range(ROUNDS):
            trial = _Cuts()
            trial.of = cuts.of | {k: x - y for k, (x, y) in pair.items()}
            sums = _sums(rows, trial, width)
            sizes = {k: [sums[c][0] if (c := (k[0], 2 * k[1] + 1 + j)) in sums else 0 for j in (0, 1)] for k in pair}
            if sizes == before:
                break
            before = sizes
            last = pair
            pair = {k: tuple(_unit(sums[k[0], 2 * k[1] + 1 + j][1]) for j in (0, 1)) if min(sizes[k]) else pair[k] for k in pair}
        for k in active:
            if min(before[k]) < max(1, least[k[0]] // 2):
                final.add(k)
                continue
            cuts.of[k] = trial.of[k]
            parts = [(k[0], 2 * k[1] + 1 + j) for j in (0, 1)]
            scatter = [sums[c][0] - float(np.linalg.norm(sums[c][1])) + 1e-9 for c in parts]
            n = int(np.clip(round(may[k] * scatter[0] / sum(scatter)), 1, may[k] - 1))
            may |= {parts[0]: n, parts[1]: may[k] - n}
            known |= {c: sums[c] for c in parts}
            del known[k]
    out: dict[str, list] = {k: [] for k in whole}
    alone = {k for k, (n, _, _) in known.items() if n > docs or may[k] < 2 or n < 2 * least[k[0]]}
    for k in sorted(alone):
        out[k[0]].append((k[1], 0, _unit(known[k][1])))

    def placed(batches):
        for pdf in batches:
            for (lang, node), at in cuts.place(pdf).items():
                if (lang, node) not in alone:
                    yield pdf.iloc[at].assign(node=node)

    def cut_on(pdf):
        lang, node = pdf["lang"].iloc[0], int(pdf["node"].iloc[0])
        order = pdf["h"].to_numpy().argsort(kind="stable")
        x = np.zeros((len(pdf), width[lang]), np.float32)
        for i, r in enumerate(order):
            x[i, pdf["at"].iloc[r]] = pdf["v"].iloc[r]
        leaf = bisect(x, leaves=may[lang, node], least=least[lang])
        return pd.DataFrame([(lang, node, k, _unit(x[leaf == k].sum(axis=0)).astype(float).tobytes()) for k in range(leaf.max() + 1)], columns=["lang", "node", "leaf", "c"])

    small = rows.mapInPandas(placed, "lang string, h bigint, at array<int>, v array<float>, node bigint").groupBy("lang", "node").applyInPandas(cut_on, "lang string, node bigint, leaf int, c binary")
    for r in small.collect():
        out[r.lang].append((r.node, r.leaf, np.frombuffer(r.c)))
    return {k: np.stack([c for *_, c in sorted(v, key=lambda x: x[:2])]).astype(np.float32) for k, v in out.items() if whole[k] > 1}


def frequencies(texts: DataFrame) -> DataFrame:
    """lang, term, doc_id, n of all texts: partial numbers of documents with each term, and one row without term a document."""

    def run(batches):
        for pdf in batches:
            df: dict[str, Counter] = defaultdict(Counter)
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                lang = language_of(text)
                rows.append((lang, None, None if pd.isna(i) else int(i), 1))
                df[lang].update({t for s in sentences(text) for t in terms(s)})
                if sum(map(len, df.values())) > FLUSH:
                    yield _frame([*rows, *((k, t, None, n) for k, c in df.items() for t, n in c.items())])
                    df, rows = defaultdict(Counter), []
            yield _frame([*rows, *((k, t, None, n) for k, c in df.items() for t, n in c.items())])

    def _frame(rows):
        f = pd.DataFrame(rows, columns=["lang", "term", "doc_id", "n"])
        return f.astype({"doc_id": "Int64", "n": "int64"})

    return texts.select("doc_id", "text").mapInPandas(run, "lang string, term string, doc_id long, n long")


def statistics(texts: DataFrame, leaves: Leaves) -> DataFrame:
    """lang, leaf, kind, term, n, w over all texts (text, and said: the subject it is labelled with, if any), each in its nearest leaf.

    Kinds: doc and sentence (n of them), label (n of the labelled documents with the subject in term), term (n sentences
    with the term, w the sum of its weights in the documents' vectors), and for each subject =subject (n labelled documents of
    the language with the term; leaf is null).
    """
    shared = texts.sparkSession.sparkContext.broadcast(leaves)

    def run(batches):
        m = shared.value
        for pdf in batches:
            n: dict[tuple, Counter] = defaultdict(Counter)
            w: dict[tuple, Counter] = defaultdict(Counter)
            size = 0
            for said, text in zip(pdf["said"], pdf["text"]):
                lang, doc = language_of(text), [terms(s) for s in sentences(text)]
                names, at, v = m.vector(lang, doc)
                leaf = m.nearest(lang, at, v)
                n[lang, leaf, "doc"][""] += 1
                n[lang, leaf, "sentence"][""] += len(doc)
                if isinstance(said, str):
                    n[lang, leaf, "label"][said] += 1
                    n[lang, None, "=" + said].update({t for x in doc for t in x})
                c, x = n[lang, leaf, "term"], w[lang, leaf, "term"]
                size -= len(c)
                for s in doc:
                    c.update(set(s))
                size += len(c)
                for t, weight in zip(names, v.tolist()):
                    x[t] += weight
                if size > FLUSH:
                    yield _frame(n, w)
                    n, w, size = defaultdict(Counter), defaultdict(Counter), 0
            yield _frame(n, w)

    def _frame(n, w):
        return pd.DataFrame([(*k, t, c, float(w[k][t]) if k in w else 0.0) for k, each in n.items() for t, c in each.items()], columns=["lang", "leaf", "kind", "term", "n", "w"]).astype({"leaf": "Int64"})

    rows = texts.select("said", "text").mapInPandas(run, "lang string, leaf int, kind string, term string, n long, w double")
    return rows.groupBy("lang", "leaf", "kind", "term").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def label(stats: DataFrame, subjects: list[str]) -> dict[tuple[str, int], int]:
    """Index of the subject of each leaf, -1 for leaves without one.

    A leaf scores for a subject by how far the labelled documents with its discriminative terms have that subject more often than
    labelled documents do (those of other languages count a third, for terms that languages share), weighted by how discriminative
    each term is, and by how far the labelled documents in the leaf do.
    """
    spark = stats.sparkSession
    few = stats.where("kind in ('doc', 'label')").collect()
    size = {(r.lang, r.leaf): r.n for r in few if r.kind == "doc"}
    whole, base = Counter(), np.zeros(len(subjects) + 1)
    for (lang, _), n in size.items():
        whole[lang] += n
    at = {s: k for k, s in enumerate(subjects)}
    inside = {k: np.zeros(len(subjects) + 1) for k in size}
    for r in few:
        if r.kind == "label":
            inside[r.lang, r.leaf][at.get(r.term, -1)] += r.n
            base[at.get(r.term, -1)] += r.n
    out = dict.fromkeys(size, -1)
    if not base.sum():
        return out
    base /= base.sum()
    sizes = spark.createDataFrame([(*k, n, whole[k[0]]) for k, n in size.items()], "lang string, leaf int, docs long, whole long")
    lift = F.col("w") / F.col("docs") - F.sum("w").over(Window.partitionBy("lang", "term")) / F.col("whole")
    ranked = stats.where("kind = 'term' and w > 0").join(F.broadcast(sizes), ["lang", "leaf"]).withColumn("lift", lift).where("leaf >= 0")
    top = cut(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "leaf").orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= TOP).select("lang", "leaf", "term", "lift"))
    said: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
    for r in stats.where("substr(kind, 1, 1) = '='").join(F.broadcast(top.select("term").distinct()), "term", "left_semi").groupBy("term", "lang", "kind").agg(F.sum("n").alias("n")).collect():
        said[r.term].setdefault(r.lang, np.zeros(len(subjects) + 1))[at.get(r.kind[1:], -1)] += r.n
    score, weight = {k: np.zeros(len(subjects) + 1) for k in size}, Counter()
    for r in top.collect():
        if r.lift <= 0:
            continue
        n = sum((v if lang == r.lang else v / 3 for lang, v in said[r.term].items()), np.zeros(len(subjects) + 1))
        score[r.lang, r.leaf] += r.lift * (n - n.sum() * base) / (n.sum() + 2)
        weight[r.lang, r.leaf] += r.lift
    for k, v in score.items():
        v = v / (weight[k] + 1e-9) + (inside[k] - inside[k].sum() * base) / (inside[k].sum() + 2)
        best = int(v[:-1].argmax())
        if k[1] >= 0 and v[best] >= CLEAR:
            out[k] = best
    return out


class Model:
    """Per language: shares of the leaves, their subjects, and for each telling term the log-odds it gives each leaf."""

    def __init__(self, subjects: list[str]):
        self.subjects, self.of, self.share, self.index, self.odds = subjects, {}, {}, {}, {}

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sentences of each text, and how many of them are about each subject.

        A sentence goes to the subject that the leaves likeliest to hold it have, if that is likelier than all else; the leaves
        without a subject are part of all else.
        """
        total, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.subjects)), np.int64)
        by: dict[str, list[tuple[int, list[int]]]] = defaultdict(list)
        for i, text in enumerate(texts):
            lang, found = language_of(text), sentences(text)
            total[i] = len(found)
            index = self.index.get(lang)
            if not index:
                continue
            for words in found:
                hits = [j for t in terms(words) if (j := index.get(t)) is not None]
                if hits:
                    by[lang].append((i, hits))
        for lang, rows in by.items():
            owner = np.array([i for i, _ in rows])
            size = np.array([len(h) for _, h in rows])
            hits = np.concatenate([h for _, h in rows])
            share, of, odds = self.share[lang], self.of[lang], self.odds[lang]
            for lo in range(0, len(rows), 20_000):
                n = size[lo : lo + 20_000]
                first = size[:lo].sum()
                s = np.add.reduceat(odds[hits[first : first + n.sum()]], np.cumsum(n) - n, axis=0) + np.log(share)
                s = np.exp(s - s.max(axis=1, keepdims=True))
                p = np.stack([s[:, of == k].sum(axis=1) for k in range(-1, len(self.subjects))], axis=1) / s.sum(axis=1, keepdims=True)
                best = p[:, 1:].argmax(axis=1)
                sure = p[np.arange(len(p)), best + 1] > 0.5
                np.add.at(counts, (owner[lo : lo + 20_000][sure], best[sure]), 1)
        return total, counts


def weigh(stats: DataFrame, of: dict[tuple[str, int], int], subjects: list[str]) -> Model:
    """Log-odds of leaves for the terms that make some subject TIMES as likely as it is, from the sentences of all documents.

    What is collected are these terms, of which a language has as many as it has words that belong to a subject.
    """
    model = Model(subjects)
    few = stats.where("kind = 'sentence'").select("lang", "leaf", "n").collect()
    for lang in sorted({r.lang for r in few}):
        rows = sorted((r for r in few if r.lang == lang), key=lambda r: r.leaf)
        n = np.array([r.n for r in rows], float)
        model.share[lang], model.of[lang] = (n + 0.5) / (n + 0.5).sum(), np.array([of.get((lang, r.leaf), -1) for r in rows])
    place = {lang: {r.leaf: i for i, r in enumerate(sorted((r for r in few if r.lang == lang), key=lambda r: r.leaf))} for lang in model.share}
    if not any((v >= 0).any() for v in model.of.values()):
        return model
    each = stats.where("kind = 'term'").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("leaf", "n")).alias("by")).where(F.col("total") >= SEEN)

    def run(batches):
        for pdf in batches:
            out = []
            for lang, t, total, by in zip(pdf["lang"], pdf["term"], pdf["total"], pdf["by"]):
                share, k = model.share[lang], model.of[lang]
                c = np.zeros(len(share))
                for r in by:
                    c[place[lang][r["leaf"]]] += r["n"]
                p = (c + 2 * share) / (total + 2)
                told = [p[k == j].sum() / share[k == j].sum() for j in np.unique(k[k >= 0])]
                if told and max(told) >= TIMES:
                    out.append((lang, t, np.log(p / share).astype(np.float32)))
            yield pd.DataFrame(out, columns=["lang", "term", "odds"])

    for r in each.mapInPandas(run, "lang string, term string, odds array<float>").orderBy("lang", "term").toLocalIterator():
        index = model.index.setdefault(r.lang, {})
        index[r.term] = len(index)
        model.odds.setdefault(r.lang, []).append(np.array(r.odds, np.float32))
    model.odds = {k: np.stack(v) for k, v in model.odds.items()}
    return model


def grown(documents: DataFrame, labels: DataFrame, subjects: list[str], *, docs: int = FIT_DOCS) -> tuple[Leaves, DataFrame]:
    """Leaves of each language, cut from all documents, and the statistics of all documents in them, with all labels.

    docs: most documents that one task cuts on alone; whatever it is, no document is left out.
    """
    given = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.mode("subject", True).alias("subject"))
    usable = documents.where(has_text("text")).select("doc_id", "text")
    known = given.select("doc_id", F.when(F.col("subject").isin(subjects), F.col("subject")).otherwise("").alias("said"))
    seen = cut(frequencies(usable))
    sizes = {r.lang: r.n for r in seen.where("term is null").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    most = F.coalesce(*[F.when(F.col("lang") == k, max(3, int(0.3 * n))) for k, n in sizes.items()], F.lit(0))
    df = seen.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n")).where((F.col("n") >= 3) & (F.col("n") <= most))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    vocabulary, idf = defaultdict(list), defaultdict(list)
    for r in df.withColumn("i", F.row_number().over(first)).where(F.col("i") <= TERMS).select("lang", "term", "n", "i").orderBy("lang", "i").collect():
        vocabulary[r.lang].append(r.term)
        idf[r.lang].append(np.log(sizes[r.lang] / r.n))
    leaves = Leaves(vocabulary, {k: np.array(v, np.float32) for k, v in idf.items()})
    leaves.centres = centres(cut(vectors(usable, leaves)), {k: len(v) for k, v in vocabulary.items()}, docs)
    return leaves, cut(statistics(usable.join(known, "doc_id", "left"), leaves))


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], *, docs: int = FIT_DOCS) -> Model:
    """Grows and labels leaves and weighs terms over all documents; `subjects` is a fixed list."""
    _, stats = grown(documents, labels, subjects, docs=docs)
    return weigh(stats, label(stats, subjects), subjects)


def assign(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, sentences, subjects (array of subject, share): every subject that a sentence is about, largest share first.

    Null, blank and removed texts have no sentences and no subjects.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                pdf = whole.iloc[at : at + CHUNK]
                total, counts = m.mixtures([t if isinstance(t, str) else "" for t in pdf["__t"]])
                found = [[{"subject": m.subjects[k], "share": float(c[k] / n)} for k in np.argsort(-c, kind="stable") if c[k]] for c, n in zip(counts, total)]
                yield pd.DataFrame({key: pdf[key].to_numpy(), "sentences": total, "subjects": found})

    rows = documents.select(key, F.when(has_text(text), F.col(text)).alias("__t"))
    return rows.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, sentences int, subjects array<struct<subject:string,share:double>>")


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    names = [r.subject for r in table(spark, folder, "subjects").where("subject is not null").orderBy("subject_id").collect()]  # a fixed table
    labels = table(spark, folder, "subject_labels")
    return assign(documents, "doc_id", "text", fitted(spark, "subjects", [documents, labels], lambda: fit(documents, labels, names), tuple(names)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("doc_id", F.explode("subjects").alias("s")).where(F.col("s.share") >= SHARE).select("doc_id", "s.subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    rows = _assigned(spark, folder).select("sentences", F.explode("subjects").alias("s"))
    return rows.groupBy("s.subject").agg(F.count_if(F.col("s.share") >= SHARE).alias("documents"), F.round(F.sum(F.col("s.share") * F.col("sentences"))).cast("bigint").alias("sentences"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
ORACLE: dict[str, str] = {}
