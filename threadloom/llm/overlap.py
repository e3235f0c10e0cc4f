"""Problem 5: records of evaluation splits that recur, exactly or almost, in the training split.

Texts become canonical word sequences; equal ones share a hash and are one class from then on, so copies are never
compared with each other. Classes that are nearly the same are found without loss: if four fifths of the longer text's
words recur in order, the two share that many words, hence at least one of their rarest fifth (prefix filter). Lists of a
shared rare word are split into tiles of bounded size, pairs in a tile pass a bitmap bound on shared words, and those left
are compared exactly by longest common subsequence.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, parallelism
from ..sources.tables import table
from .pairs import distinct_pairs, needed_texts, sides

MIN_WORDS = 12
SIMILARITY = 0.8
#: Rows of one side of a tile of a word's list.
TILE = 4_000
#: Rows of tiles that one task joins at a time.
GROUP = 100_000
#: Counters of the hashed table of word frequencies, which orders words by rarity; its size bounds what is broadcast.
COUNTERS = 1 << 17

#: Letters of other scripts that look like Latin ones; first capitals that look like another letter than their small form.
CAPITALS = str.maketrans(dict(zip("ΗΜΥΖΝСВНМТΡЅІЈҮӀԌᏴƖ", "hmyznсвнмтpsijylgbi")))
LOOKALIKES = str.maketrans(dict(zip("аеорсухіјѕһԁԛԝкмтвнгαβεικνορτυχωɡıɩүѵԍոօսհցӏⅼʏᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢʙɢʜɪʟɴʀꜱɑ", "aeopcyxijshdqwkmtbhrabeiknoptuxwgiiyvgnouhgllyacdejkmoptuvwzbghilnrsa")))
#: Characters that show nothing but are letters or signs.
UNSEEN = dict.fromkeys(map(ord, "\u115f\u1160\u3164\uffa0\u2800"))
#: Elements of HTML that stand inside a word or line; other tags part words.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_BLOCK = "address|article|aside|blockquote|body|br|caption|center|dd|details|div|dl|dt|figcaption|figure|footer|h[1-6]|head|header|hr|html|img|input|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul|video"
_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>|<!--.*?-->", re.I | re.S)
_PARTING = re.compile(rf"</?(?:{_BLOCK})(?:\s[^<>]*)?/?>", re.I)
_TARGET = re.compile(r"(?<=\])\([^()\s]*(?:\s+\"[^\"]*\")?\)|https?://[^\s<>()\[\]\"]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
_INSIDE = re.compile(r"(?<=\w)(?:['’‘ʼ`´]|\*{1,3}|~~|\^)(?=\w)")
_WORD, _LATIN = re.compile(r"[^\W_]+"), re.compile("[A-Za-z]")


def canonical_words(text: str) -> list[str]:
    """Words of a text without case, punctuation, markup, invisible and look-alike characters.

    Only tags of HTML count as markup between angle brackets: what else stands there are words. Marks inside a word (an apostrophe,
    stars around a part of it) don't part it.
    """
    t = html.unescape(html.unescape(text)) if "&" in text else text
    t = _CONTROL.sub("", t)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace()).translate(UNSEEN)
        # accents are first joined to their letters; those left over are no part of any letter
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    if "<" in t:
        t = _PARTING.sub(" ", _TAG.sub("", t))
    if "](" in t or "://" in t:
        t = _TARGET.sub(" ", t)
    if not t.isascii():
        # only among Latin letters: words of another script mean the same in capitals
        t = _WORD.sub(lambda m: m[0].translate(CAPITALS) if _LATIN.search(m[0]) else m[0], t).lower().translate(LOOKALIKES)
    return _WORD.findall(_INSIDE.sub("", t.lower()))


def _hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one big integer a row."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def classes(texts: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, cls, n, words): the hash of the canonical text, its number of words and, hashed, the words; short ones are left out."""

    def make(batches):
        for pdf in batches:
            words = [canonical_words(t) if t else [] for t in pdf["__t"]]
            keep = [i for i, w in enumerate(words) if len(w) >= min_words]
            if not keep:
                continue
            yield pd.DataFrame({key: pdf[key].iloc[keep].to_numpy(), "cls": [hashlib.md5(" ".join(words[i]).encode()).hexdigest() for i in keep], "n": [len(words[i]) for i in keep], "words": [_hash(words[i]) for i in keep]})

    rows = texts.select(key, F.col(text).alias("__t"))
    return rows.mapInPandas(make, f"`{key}` {dict(rows.dtypes)[key]}, cls string, n int, words array<bigint>")


def _rarity(distinct: DataFrame) -> np.ndarray:
    """How many classes hold a word of each counter; one bounded array, whatever the vocabulary."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            for w in pdf["words"]:
                total[np.unique(np.asarray(w)) & (COUNTERS - 1)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    rows = distinct.select("words").mapInPandas(count, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for r in rows.toLocalIterator():
        out[r.counter] = r.n
    return out


def _need(n: np.ndarray | int, share: float):
    return np.ceil(share * n - 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(share * n - 1e-9))


def _postings(distinct: DataFrame, rarity, share: float) -> DataFrame:
    def make(batches):
        r = rarity.value
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in ("token", "cls", "n", "train", "eval", "b0", "b1", "b2", "b3")}
            for cls, n, words, tr, ev in zip(pdf["cls"], pdf["n"], pdf["words"], pdf["train"], pdf["eval"]):
                w = np.asarray(words, np.int64)
                order = np.argsort(w, kind="stable")
                s = w[order]
                start = np.concatenate([[True], s[1:] != s[:-1]])
                nth = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
                token = s ^ (nth * np.int64(0x9E3779B97F4A7C1))  # the k-th occurrence of a word is a token of its own
                rank = np.lexsort((token, -nth, r[s & (COUNTERS - 1)]))
                pick = token[rank[: n - _need(n, share) + 1]]
                bits = np.zeros(4, np.uint64)
                h = (s[start].view(np.uint64) >> np.uint64(20)) & np.uint64(255)
                np.bitwise_or.at(bits, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
                bits = bits.view(np.int64)
                k = len(pick)
                out["token"].append(pick)
                for name, v in (("cls", cls), ("n", n), ("train", tr), ("eval", ev), ("b0", bits[0]), ("b1", bits[1]), ("b2", bits[2]), ("b3", bits[3])):
                    out[name].append(np.full(k, v, object if name == "cls" else None))
            if out["cls"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return distinct.mapInPandas(make, "token bigint, cls string, n int, train boolean, eval boolean, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def _tiles(postings: DataFrame, share: float, tile: int, group: int = 0) -> DataFrame:
    """Candidate pairs (e, t) of classes, one in evaluation and one in training, from the lists of shared rare words."""
    group = group or GROUP
    sizes = cut(postings.groupBy("token").agg(F.count_if("train").alias("nt"), F.count_if("eval").alias("ne")).where("nt > 0 and ne > 0"))
    rows = postings.join(sizes, "token")
    # whole tiles are put into groups of about GROUP rows by a hash, so what a task holds doesn't grow with the data
    copies = sizes.agg(F.sum(F.col("ne") * F.ceil(F.col("nt") / tile) + F.col("nt") * F.ceil(F.col("ne") / tile))).first()[0] or 0
    groups = max(parallelism(postings.sparkSession), -(-int(copies) // group))
    nt, ne = F.ceil(F.col("nt") / tile), F.ceil(F.col("ne") / tile)
    left = rows.where("eval").select("*", F.lit(True).alias("is_eval"), F.pmod(F.xxhash64("cls"), ne).alias("te")).withColumn("tt", F.explode(F.sequence(F.lit(0), nt - 1)))
    right = rows.where("train").select("*", F.lit(False).alias("is_eval"), F.pmod(F.xxhash64("cls"), nt).alias("tt")).withColumn("te", F.explode(F.sequence(F.lit(0), ne - 1)))
    cols = ["token", "te", "tt", "is_eval", "cls", "n", "b0", "b1", "b2", "b3"]
    both = left.select(*cols).unionByName(right.select(*cols))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "te", "tt", "n"], kind="stable")
        key = pdf[["token", "te", "tt"]].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.append(edge[1:], len(pdf))
        ev = pdf["is_eval"].to_numpy(bool)
        cls, n = pdf["cls"].to_numpy(object), pdf["n"].to_numpy(np.int64)
        bits = pdf[["b0", "b1", "b2", "b3"]].to_numpy(np.int64).view(np.uint64)
        need = _need(n, share)
        seen: set = set()

        def passing(e, t):
            least = np.maximum(need[e], need[t])
            ok = np.minimum(n[e], n[t]) >= least
            e, t, least = e[ok], t[ok], least[ok]
            be, bt = bits[e], bits[t]
            ok = n[e] - np.bitwise_count(be & ~bt).sum(axis=1) >= least
            e, t, least, be, bt = e[ok], t[ok], least[ok], be[ok], bt[ok]
            ok = (n[t] - np.bitwise_count(bt & ~be).sum(axis=1) >= least) & (cls[e] != cls[t])
            found = [p for p in zip(cls[e[ok]], cls[t[ok]]) if p not in seen]
            seen.update(found)
            return found

        es, ts, held = [], [], 0
        found = []
        for a, b in zip(edge, ends):
            e, t = a + np.flatnonzero(ev[a:b]), a + np.flatnonzero(~ev[a:b])
            if not len(e) or not len(t):
                continue
            for k in range(0, len(e), max(1, 400_000 // len(t))):
                part = e[k : k + max(1, 400_000 // len(t))]
                es.append(np.repeat(part, len(t)))
                ts.append(np.tile(t, len(part)))
                held += len(part) * len(t)
                if held > 400_000:
                    found += passing(np.concatenate(es), np.concatenate(ts))
                    es, ts, held = [], [], 0
            if len(seen) > 2_000_000:
                seen.clear()
        if es:
            found += passing(np.concatenate(es), np.concatenate(ts))
        return pd.DataFrame(found, columns=["e", "t"])

    placed = both.withColumn("grp", F.pmod(F.xxhash64("token", "te", "tt"), F.lit(groups)))
    return placed.groupBy("grp").applyInPandas(lambda pdf: join(pdf), "e string, t string").distinct()


def near_classes(members: DataFrame, share: float = SIMILARITY, *, tile: int = TILE) -> DataFrame:
    """(e, t): different classes, e with a member in evaluation and t with one in training, that are nearly the same.

    members: (cls, n, words, train, eval), several rows a class or one.
    """
    spark = members.sparkSession
    distinct = cut(members.groupBy("cls").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.bool_or("train").alias("train"), F.bool_or("eval").alias("eval")))
    postings = cut(_postings(distinct, spark.sparkContext.broadcast(_rarity(distinct)), share))
    pairs = cut(_tiles(postings, share, tile))
    of = distinct.select("cls", "words")
    texts = pairs.join(of.select(F.col("cls").alias("e"), F.col("words").alias("we")), "e").join(of.select(F.col("cls").alias("t"), F.col("words").alias("wt")), "t")

    def verify(batches):
        for pdf in batches:
            ok = [common_subsequence(list(a), list(b)) >= _need(max(len(a), len(b)), share) for a, b in zip(pdf["we"], pdf["wt"])]
            yield pdf.loc[ok, ["e", "t"]]

    return texts.select("e", "t", "we", "wt").mapInPandas(verify, "e string, t string")


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs in a split; their (pair, cls, eval) memberships; and (e, t) links between classes, equal ones included."""
    pairs = cut(distinct_pairs(table(spark, folder, "thread_pairs")).where("split in ('train', 'val', 'test')").withColumn("eval", F.col("split") != "train"))
    each = sides(pairs).join(pairs.select("pair", "eval"), "pair")
    made = cut(classes(needed_texts(table(spark, folder, "comments"), each), "comment", "text"))
    held = each.join(made.select("comment", "cls"), "comment").select("pair", "cls", "eval").distinct()
    flags = each.join(made, "comment").select("cls", "n", "words", (~F.col("eval")).alias("train"), "eval")
    near = near_classes(flags)
    held = cut(held)
    same = held.groupBy("cls").agg(F.bool_or("eval").alias("ev"), F.bool_or(~F.col("eval")).alias("tr")).where("ev and tr").select(F.col("cls").alias("e"), F.col("cls").alias("t"))
    return pairs, held, cut(near.unionByName(same))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, held, links = _prepared(spark, folder)
    ev, tr = held.where("eval").select(F.col("pair").alias("pe"), F.col("cls").alias("e")), held.where("not eval").select(F.col("pair").alias("pt"), F.col("cls").alias("t"))
    by_text = links.join(ev, "e").join(tr, "t").select("pe", "pt")
    sub = pairs.where("submission is not null").select("submission", "pair", "eval")
    by_sub = sub.where("eval").select("submission", F.col("pair").alias("pe")).join(sub.where("not eval").select("submission", F.col("pair").alias("pt")), "submission").select("pe", "pt")
    return by_text.unionByName(by_sub).distinct().select(F.least("pe", "pt").alias("mod_comment_id_a"), F.greatest("pe", "pt").alias("mod_comment_id_b"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and community: pairs, and those that recur in training by submission or by text; copies are not paired off."""
    pairs, held, links = _prepared(spark, folder)
    ev = pairs.where("eval").select("pair", "split", "community", "submission")
    subs = pairs.where("not eval and submission is not null").select("submission").distinct().withColumn("same_submission", F.lit(True))
    hit = held.where("eval").join(links.select(F.col("e").alias("cls")), "cls", "left_semi").select("pair").distinct().withColumn("same_text", F.lit(True))
    rows = ev.join(subs, "submission", "left").join(hit, "pair", "left")
    s, t = F.coalesce("same_submission", F.lit(False)), F.coalesce("same_text", F.lit(False))
    return rows.groupBy("split", "community").agg(F.count("*").alias("pairs"), F.count_if(s).alias("by_submission"), F.count_if(t).alias("by_text"), F.count_if(s | t).alias("overlapping"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
ORACLE: dict[str, str] = {}
