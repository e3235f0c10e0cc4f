"""Problem 1: the language of each text and of each sentence of a mixed one.

Multinomial naive Bayes over hashed character 2- to 4-grams. The matrix of log-probabilities, whose size is fixed, is
broadcast; sentences of a whole batch are scored at once as gathered and summed rows of it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_id, community_key, has_text
from ..session import cut
from ..sources.tables import table

LANGUAGES = ("en", "de", "es", "fr", "pt", "it", "nl")
#: Rows of the matrix.
BUCKETS = 1 << 16
#: The classifier is fitted on about so many labelled documents of each language, chosen by a hash of their id.
FIT_DOCS = 500
#: Longest document used for fitting; every text is scored whole.
FIT_CHARS = 4_000
MIN_WORDS = 6
#: Confidence from which a sentence counts as being in another language than its text.
SURE = 0.9999

#: Spellings of language labels beside the two-letter code.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german", "deutsch"), "es": ("spa", "spanish", "español", "castellano"), "fr": ("fra", "fre", "french", "français"),
    "pt": ("por", "portuguese", "português"), "it": ("ita", "italian", "italiano"), "nl": ("nld", "dut", "dutch", "nederlands"),
}
#: Frequent words, so that a language that is rare among the labelled documents is known from the start.
FREQUENT = {
    "en": "the of and to in is you that it he was for on are as with his they at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ich mir mich dir dich wir schon niemand",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo nada",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais comme on tout nous sa vous elle fait été aussi leur bien peut ces y sans deux même ont entre où encore après très rien quand dont être avoir cette moi je tu mes ses notre depuis chez",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa",
    "it": "di che è e la il un a per in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo qui e hai sei del bene tu sì me più al mio perché lei solo te era gli tutto della così mia ne questa fare quando ora fatto essere mai chi o alla tutti molto dei anche detto quello va niente grazie lui",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet",
}

_LINE = re.compile(r"(?m)^[ \t]*(?:user\d+:|[#>*+-]+(?=\s)|\d+[.)](?=\s))[ \t]*")
#: Addresses of mail are in no language; they are read as one number.
_MAIL = re.compile(r"\S+ ?(?:@|\[at\]|\(at\)) ?\S+(?: ?\[dot\] ?\S+)*")
_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_LETTER = np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536)
_DIGIT = np.fromiter((chr(i).isdigit() for i in range(65536)), bool, 65536)
_END = np.isin(np.arange(65536), [ord(c) for c in ".!?…。"])
_SPACE = np.fromiter((chr(i).isspace() for i in range(65536)), bool, 65536)


def code(label: Column) -> Column:
    """Two-letter code of a language label in any spelling, with or without region; null if it names none of these."""
    root = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)(?:[-_ (].*)?$", 1)
    out = F.lit(None).cast("string")
    for k, names in NAMES.items():
        out = F.when(root.isin(k, *names), F.lit(k)).otherwise(out)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each followed by a line break, and the index of each text's first."""
    clean = [_LINE.sub("", t.lower()) for t in texts]
    clean = [_MAIL.sub(lambda m: "0" * len(m[0]), t) if "@" in t or "at]" in t or "at)" in t else t for t in clean]
    codes = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le"), np.uint32)
    return np.where(codes < 65536, codes, 0x4E00), np.cumsum([0, *(len(c) + 1 for c in clean)])


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 2-, 3- and 4-gram at each character; non-letters count as one blank, and blanks alone as bucket 0."""
    c = np.where(_LETTER[codes], codes, 32).astype(np.uint32)
    out, h = [], c * _PRIMES[0]
    for n in (2, 3, 4):
        h = h[: len(c) - n + 1] * np.uint32(31) + c[n - 1 :] * _PRIMES[n - 1]
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        g = (g >> np.uint32(16)).astype(np.int64)
        blank = (c[: len(g)] == 32) & (c[n - 1 :] == 32)
        g[blank] = 0
        out.append(np.pad(g, (0, n - 1)))
    return out


def _sentences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each sentence and its number of words."""
    space = _SPACE[codes]
    after = np.append(space[1:], True)
    last = (_END[codes] & after) | (codes == 10)
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    word = _LETTER[codes] | _DIGIT[codes]
    before, second = np.concatenate([[True], space[:-1]]), np.concatenate([[True, True], space[:-2]])
    starts = word & (before | (~np.concatenate([[False], word[:-1]]) & second))
    return first, np.add.reduceat(starts.astype(np.int32), first)


class Model:
    def __init__(self, counts: np.ndarray):
        counts = counts + 0.05
        p = np.log(counts / counts.sum(axis=0))
        p -= p.mean(axis=1, keepdims=True)
        p[0] = 0
        self.weights = np.zeros((BUCKETS, 8), np.float32)
        self.weights[:, : len(LANGUAGES)] = p

    def sentences(self, texts: list[str]):
        """For all sentences: index of the text, first character in it (lower-cased, unmarked), words, language, confidence."""
        codes, starts = _codes(texts)
        first, words = _sentences(codes)
        letter = _LETTER[codes]
        word = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        score = np.zeros((len(first), len(LANGUAGES)))
        if len(word):
            total = np.zeros((len(word), 8), np.float32)
            for g in _grams(codes):
                total += np.add.reduceat(self.weights[g], word, axis=0)
            # each word speaks for itself, but none, such as a name, can outvote the rest: its share is mixed with a uniform one
            total = total[:, : len(LANGUAGES)] / 2
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p = np.log(0.9 * p / p.sum(axis=1, keepdims=True) + 0.1 / len(LANGUAGES))
            inside = np.searchsorted(first, word, side="right") - 1
            heads = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
            score[inside[heads]] = np.add.reduceat(p, heads, axis=0)
        z = np.exp(score - score.max(axis=1, keepdims=True))
        best = score.argmax(axis=1)
        text = np.searchsorted(starts, first, side="right") - 1
        return text, first - starts[text], words, best, z[np.arange(len(z)), best] / z.sum(axis=1)


def _counts(texts: list[str], labels: np.ndarray) -> np.ndarray:
    out = np.zeros((len(LANGUAGES), BUCKETS))
    for k in range(len(LANGUAGES)):
        chosen = [texts[i] for i in np.flatnonzero(labels == k)]
        chosen += [FREQUENT[LANGUAGES[k]]] * 3
        for g in _grams(_codes(chosen)[0]):
            out[k] += np.bincount(g, minlength=BUCKETS)
    return out.T


def fit(documents: DataFrame, *, docs: int = FIT_DOCS, seed: int = 11) -> Model:
    """Fits on about `docs` labelled documents of each language, then again without those whose label it doesn't believe."""
    labelled = documents.select("doc_id", code(F.col("lang")).alias("label"), F.col("text")).where("label is not null").where(has_text("text") & (F.length("text") <= FIT_CHARS))
    sizes = {r.label: r.n for r in documents.select(code(F.col("lang")).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for k, n in sizes.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, docs / n))).otherwise(share)
    rows = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("label", "text").collect()
    texts, labels = [r.text for r in rows], np.array([LANGUAGES.index(r.label) for r in rows], int)
    model = Model(_counts(texts, labels))
    if texts:
        text, _, _, best, sure = model.sentences(texts)
        votes = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(votes, (text, best), sure)
        model = Model(_counts(texts, np.where(votes.argmax(axis=1) == labels, labels, -1)))
    return model


def detect(df: DataFrame, key: list[str], text: str, model: Model, *, min_words: int = MIN_WORDS) -> DataFrame:
    """key, lang (of most words), confidence, langs (all used), segments (start, lang, confidence), words.

    A language is used if a sentence of min_words words or more is in it; start is counted in the lower-cased text without
    line marks. Texts without such a sentence, null, blank and removed ones have langs empty and lang null.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), 4_000):
                part = pdf.iloc[k : k + 4_000]
                texts = [t if isinstance(t, str) else "" for t in part["__t"]]
                who, at, words, best, sure = m.sentences(texts)
                use = words >= min_words
                who, at, words, best, sure = who[use], at[use], words[use], best[use], sure[use]
                mass = np.zeros((len(texts), len(LANGUAGES)))
                np.add.at(mass, (who, best), words * sure)
                # a sentence that isn't surely in another language is in that of the text
                best = np.where(sure < SURE, mass.argmax(axis=1)[who], best)
                mass = np.zeros((len(texts), len(LANGUAGES)))
                np.add.at(mass, (who, best), words)
                belief = np.zeros_like(mass)
                np.add.at(belief, (who, best), words * sure)
                top, some = mass.argmax(axis=1), mass.sum(axis=1) > 0
                # neighbouring sentences of one language are one segment
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (best[1:] != best[:-1])
                segments: list[list] = [[] for _ in texts]
                heads = np.flatnonzero(new)
                if len(heads):
                    total, weight = np.add.reduceat(sure * words, heads), np.add.reduceat(words, heads)
                    for h, c in zip(heads, total / weight):
                        segments[who[h]].append({"start": int(at[h]), "lang": LANGUAGES[best[h]], "confidence": round(float(c), 4)})
                out = {c: part[c].to_numpy() for c in key}
                out["lang"] = [LANGUAGES[t] if s else None for t, s in zip(top, some)]
                out["confidence"] = [round(float(belief[i, t] / mass[i].sum()), 4) if s else None for i, (t, s) in enumerate(zip(top, some))]
                out["langs"] = [[LANGUAGES[j] for j in np.flatnonzero(row)] for row in mass]
                out["segments"] = segments
                out["words"] = mass.sum(axis=1).astype(np.int64)
                yield pd.DataFrame(out)

    rows = df.select(*key, F.when(has_text(text), F.col(text)).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__t")
    return rows.mapInPandas(run, schema + ", lang string, confidence double, langs array<string>, segments array<struct<start:int,lang:string,confidence:double>>, words bigint")


def _comments(spark: SparkSession, folder: str, model: Model) -> DataFrame:
    rows = table(spark, folder, "comments").where(has_text("body_clean")).select(bare_id("id").alias("comment_id"), community_key("subreddit").alias("community"), "body_clean").where("comment_id is not null")
    return detect(rows, ["comment_id", "community"], "body_clean", model)


def community_languages(comments: DataFrame) -> DataFrame:
    """(community, language, share): the language most distinct comments of each community are in; ties go to the smaller code."""
    n = comments.where("community is not null and lang is not null").groupBy("community", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("community").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("language"), (F.max("n") / F.sum("n")).alias("share"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs)
    comments = cut(_comments(spark, folder, model).select("comment_id", "community", "lang", "langs").where("lang is not null").distinct())
    main = cut(community_languages(comments))
    mixed = comments.join(main, "community").where((F.size("langs") > 1) | (F.col("lang") != F.col("language")))
    of_comments = mixed.select(F.lit("comments.body_clean").alias("field_name"), F.col("comment_id").alias("rec_key"), F.explode("langs").alias("lang_code"))
    labels = table(spark, folder, "subreddits").select(community_key("subreddit").alias("community"), F.explode(F.array(F.struct(F.lit("subreddits.lang").alias("field_name"), F.col("lang").alias("label")), F.struct(F.lit("subreddits.language").alias("field_name"), F.col("language").alias("label")))).alias("f")).select("community", "f.*")
    wrong = labels.join(main, "community").where(~code(F.col("label")).eqNullSafe(F.col("language")))
    of_labels = wrong.select("field_name", F.col("community").alias("rec_key"), F.col("language").alias("lang_code")).distinct()
    found = detect(docs, ["doc_id"], "text", model).where("lang is not null").select("doc_id", F.col("langs"))
    named = docs.select("doc_id", code(F.col("lang")).alias("label"))
    bad = found.join(named, "doc_id").where((F.size("langs") > 1) | F.col("label").isNull() | (F.col("langs")[0] != F.col("label")))
    of_docs = bad.select(F.lit("documents.lang").alias("field_name"), F.col("doc_id").cast("string").alias("rec_key"), F.explode("langs").alias("lang_code"))
    return of_labels.unionByName(of_comments).unionByName(of_docs)


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its language, confidence and segments."""
    docs = table(spark, folder, "documents")
    return detect(docs, ["doc_id"], "text", fit(docs)).select("doc_id", "lang", "confidence", F.to_json("segments").alias("segments"))


def p1_communities(spark: SparkSession, folder: str) -> DataFrame:
    model = fit(table(spark, folder, "documents"))
    return community_languages(_comments(spark, folder, model).select("comment_id", "community", "lang").distinct()).withColumn("share", F.round("share", 4))


QUERIES = {"p1_found": p1_found, "p1_documents": p1_documents, "p1_communities": p1_communities}
ORACLE: dict[str, str] = {}
