import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadloom.llm import abuse, catalog, language, mixing, overlap, packing, pairs, pii, sample, splits, subjects, tokens

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LONG = "word and more of the same thing here. " * 20_000


def test_entry_has_them():
    assert set(catalog.QUERIES) <= set(entry.queries())
    for n in (1, 3, 4, 5, 6, 7, 10):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, name):
    import duckdb

    from crosscheck import canonical

    con = duckdb.connect()
    for t in ("comments", "thread_pairs"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert canonical(catalog.QUERIES[name](spark, SMALL).toPandas()) == canonical(con.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_and_repeats(spark, name):
    a = sorted(map(repr, catalog.QUERIES[name](spark, SMALL).collect()))
    b = sorted(map(repr, catalog.QUERIES[name](spark, SMALL).collect()))
    assert a and a == b and len(set(a)) == len(a)


# --- 1
def texts(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + extra)


@pytest.fixture(scope="module")
def lang_model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_languages(spark, lang_model):
    rows = [
        (1, "The weather was fine and we walked along the river. Mais hier il a plu toute la journée dans notre ville.", "x"), (2, "Der Zug kommt heute leider etwas später als geplant.", "y"), (3, None, "z"), (4, "", None), (5, "[removed]", None),
        (6, "too few words", None), (7, LONG, None), (8, "I said c'est la vie and went home to my own garden.", None), (2, "Der Zug kommt heute leider etwas später als geplant.", "y"),
    ]
    got = {r.doc_id: r for r in language.detect(texts(spark, rows), ["doc_id"], "text", lang_model).collect()}
    assert sorted(got[1].langs) == ["en", "fr"] and [s.lang for s in got[1].segments] == ["en", "fr"] and got[1].segments[1].start > 40
    assert got[2].langs == ["de"] and got[2].confidence > 0.9 and got[7].langs == ["en"] and got[8].langs == ["en"]
    assert all(got[k].lang is None and got[k].langs == [] for k in (3, 4, 5, 6))
    assert language.detect(texts(spark, []), ["doc_id"], "text", lang_model).count() == 0
    assert language.detect(texts(spark, [(1, "x", "y")]).withColumn("segments", F.lit(1)).withColumn("words", F.lit(1)), ["doc_id"], "text", lang_model).columns == ["doc_id", "lang", "confidence", "langs", "segments", "words"]


def test_language_labels(spark):
    df = spark.createDataFrame([(v,) for v in ("en-au", "pt_BR", "German", "deu", "xx", "", None, " FR ", "unknown")], "l string")
    assert [r.c for r in df.select(language.code(F.col("l")).alias("c")).collect()] == ["en", "pt", "de", "de", None, None, None, "fr", None]


def test_held_out_language_accuracy(spark, lang_model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", language.code(F.col("lang")).alias("label")).where("label is not null and length(text) > 60")
    r = language.detect(docs, ["doc_id", "label"], "text", lang_model).where("size(langs) = 1").agg(F.avg((F.col("lang") == F.col("label")).cast("double")).alias("a")).first()
    assert r.a > 0.9  # the rest are labels that are wrong in the data


def test_fit_without_documents(spark):
    model = language.fit(texts(spark, []))
    assert language.detect(texts(spark, [(1, "Das ist nicht so gut wie wir es uns gedacht haben.", None)]), ["doc_id"], "text", model).first().lang == "de"


# --- 2
def test_sample_is_stable(spark):
    rng = random.Random(2)
    rows = [(f"id{i}", 1 + i % 5) for i in range(2000)]
    early = [r for r in rows if r[1] <= 3]
    book = lambda x, before=None: sample.ledger(spark.createDataFrame(x, "k string, b int"), F.col("k"), F.col("b"), sample.RATES, before)
    chosen = lambda b: {r.record for r in sample.selected(b).collect()}
    first = book(early)
    again = rows + [(k, 5) for k, _ in early] + early[:100]
    rng.shuffle(again)
    assert chosen(first) <= chosen(book(again)) and chosen(book(again)) == chosen(book(rows, first)) == chosen(book(rows))
    share = len(chosen(first)) / len(early)
    assert abs(share - (0.3 + 0.3 + 0.2) / 3) < 0.04
    assert chosen(sample.ledger(spark.createDataFrame([(None, 1), ("a", None), ("a", None)], "k string, b int"), F.col("k"), F.col("b"), {1: 1.0})) == {"a"}
    assert book([]).count() == 0


def test_ledger_is_kept(spark, tmp_path):
    path = "file://" + str(tmp_path / "book")
    k, b = F.col("k"), F.col("b")
    make = lambda x: spark.createDataFrame(x, "k string, b int")
    rows = [(f"id{i}", 1 + i % 2) for i in range(600)]
    assert sample.append(make([]), k, b, {1: 0.5}, path).count() == 0
    first = {r.record: (r.epoch, r.rate) for r in sample.append(make(rows), k, b, {1: 0.5, 2: 0.4}, path).collect()}
    chosen = {r.record for r in sample.selected(sample.stored(spark, path)).collect()}
    # other rates, an earlier epoch that arrives late, repeats, and new records
    later = sample.append(make(rows + [("id1", 0), ("id1", 3)] + [(f"new{i}", 3) for i in range(100)]), k, b, {1: 0.01, 2: 0.01, 3: 0.9}, path)
    got = {r.record: (r.epoch, r.rate) for r in later.collect()}
    assert len(got) == later.count() == 700 and {x: got[x] for x in first} == first and got["new5"] == (3, 0.9)
    assert chosen <= {r.record for r in sample.selected(sample.stored(spark, path)).collect()}
    assert sample.append(make(rows), k, b, {1: 1.0}, path).count() == 700


# --- 3
@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{SF}/comments.parquet"), sample=3_000, windows=6_000)


def test_network_gradient():
    m = pii.Tagger(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, pii.SYMBOLS, (7, 3)), rng.integers(0, pii.TAGS, (7, 3)), np.ones((7, 3), np.float32)
    _, grad = m.loss(x, y, mask)
    for name, at in (("t", (1, 2)), ("o", (3, 1)), ("fh", (2, 5)), ("bh", (1, 40))):
        old, eps = m.p[name][at], 1e-2
        m.p[name][at] = old + eps
        up, _ = m.loss(x, y, mask)
        m.p[name][at] = old - eps
        down, _ = m.loss(x, y, mask)
        m.p[name][at] = old
        assert math.isclose((up - down) / (2 * eps), grad[name][at], rel_tol=0.12, abs_tol=2e-3), name


def test_held_out_items(tagger):
    """Items of other seeds, names and numbers than those trained on, read by the network alone."""
    made, spans = pii.made_up(400, ["It rained again that day and nobody minded the noise."], seed=77)
    found = [pii.items_of(t, g) for t, g in zip(made, pii.labels(tagger, made))]
    hit = sum(any(k == kk and a < d and c < b for c, d, kk in f) for s, f in zip(spans, found) for a, b, k in s)
    extra = sum(not any(a < d and c < b for a, b, _ in s) for s, f in zip(spans, found) for c, d, _ in f)
    total = sum(map(len, spans))
    assert hit / total > 0.7 and extra / total < 0.2


def test_items_come_from_labels():
    t = "Ask Nora K. Vanberg, or write to nora@x.org now. Call 0171/3920002. Page 12"
    tags = np.zeros(len(t), np.uint8)
    assert pii.items_of(t, tags) == []  # whatever stands there
    for part, k in (("Nora K.", 5), ("nora", 1), ("x.org", 1), ("0171/", 2), ("392000", 3), ("12", 2)):
        at = t.index(part)
        tags[at : at + len(part)] = k
    got = [(t[a:b], k) for a, b, k in pii.items_of(t, tags)]
    # made whole at word boundaries and at an initial, pieces of one run joined, a page number dropped
    assert got == [("Nora K. Vanberg", "person_name"), ("nora@x.org", "email")] + [(x, k) for x, k in got[2:]] and len(got) == 3 and got[2][0] == "0171/3920002"
    assert pii.items_of("", np.zeros(0, np.uint8)) == []


def test_items_whose_labels_stop_early_are_completed():
    for t, part, k, item in (("whatsapp me 617 555 01 12. Then", "617 555 01", 2, "617 555 01 12"), ("Contact: ann1 [at] x [dot] com, ok", "ann1 [at] x [dot", 1, "ann1 [at] x [dot] com")):
        tags = np.zeros(len(t), np.uint8)
        tags[t.index(part) : t.index(part) + len(part)] = k
        assert [t[a:b] for a, b, _ in pii.items_of(t, tags)] == [item]


def test_phrases_around_found_items_become_frames(monkeypatch):
    """Items of any form are then drawn into phrases in which one form was found; phrases that mostly hold none are left out."""
    texts = [f"We met. The seller gave 617-555-01{i:02} as a mobile. Part number 54-734-16{i:02} is the one." for i in range(20)]

    def found(model, texts):
        out = [np.zeros(len(t), np.uint8) for t in texts]
        for n, (t, g) in enumerate(zip(texts, out)):
            if n < 12:
                g[t.index("617") : t.index(" as a")] = 2
            if n < 2:
                g[t.index("54-") : t.index(" is the")] = 3
        return out

    monkeypatch.setattr(pii, "labels", found)
    known = pii.frames(None, texts)
    assert known == [("phone", "The seller gave ", " as a mobile.", "en")]
    made, spans = pii.framed(50, known, ["It rained again."], 3)
    assert len({t[a:b] for t, s in zip(made, spans) for a, b, _ in s}) > 40
    assert all("The seller gave " in t.replace("the seller", "The seller") and t[s[0][1] :].startswith(" as a mobile.") and s[0][2] == "phone" for t, s in zip(made, spans))
    assert pii.framed(5, [], [], 3) == ([], [])


def test_masking(spark, tagger):
    t = "You can reach me at olga.torvick@example.org! The lamp is new."
    rows = [("a", t), ("b", None), ("c", ""), ("d", "[removed]"), ("e", LONG), ("a", t)]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("masked", F.lit(1))
    got = {r.id: r for r in pii.find(df, ["id"], "body", tagger).collect()}
    assert got["a"].masked == "You can reach me at [EMAIL]! The lamp is new." and got["a"]["items"][0].occurrence == 1
    assert got["b"].masked is None and got["c"].masked == "" and got["d"].masked == "[removed]" and got["e"].masked == LONG
    assert pii.find(df.limit(0), ["id"], "body", tagger).count() == 0
    assert pii.learn([]).decode(pii._symbols("nora@x.org")[:, None]).shape == (10, 1)


def test_windows_agree_with_one_pass(tagger):
    t = ["He wrote to nora.kanby@example.com about it. " * 30, "x"]
    whole = tagger.decode(pii._symbols(t[0])[:, None])[:, 0]
    assert (pii.labels(tagger, t)[0] == whole).mean() > 0.995


# --- 5
def test_tiles_hold_few_rows(spark, monkeypatch):
    """One word that all texts share: no group of the join gets more than a few tiles."""
    import pandas as pd

    n = 400
    rows = [(7, f"e{i}" if i % 2 else f"t{i}", 20, i % 2 == 0, i % 2 == 1, 1, 2, 3, 4) for i in range(n)]
    postings = spark.createDataFrame(rows, "token long, cls string, n int, train boolean, eval boolean, b0 long, b1 long, b2 long, b3 long")
    sizes = []
    true = type(postings.groupBy("token")).applyInPandas

    def spy(self, f, schema):
        return true(self, lambda pdf: pd.DataFrame({"e": [str(len(pdf))], "t": ["rows"]}), schema)

    monkeypatch.setattr(type(postings.groupBy("token")), "applyInPandas", spy)
    sizes = [int(r.e) for r in overlap._tiles(postings, 0.8, 10, 40).collect()]
    assert sum(set(sizes)) and max(sizes) <= 200  # 20 x 20 tiles of 20 rows in groups of about 40
    monkeypatch.undo()
    assert overlap._tiles(postings, 0.8, 10, 40).count() == (n // 2) ** 2


def test_near_texts_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 5
    base = [[rng.choice(words) for _ in range(rng.randrange(8, 40))] for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        rows.append((f"e{i}", w, False, True))
        for k, rate in enumerate((0.0, 0.1, 0.17, 0.22, 0.3)):
            v = [x if rng.random() > rate else rng.choice([None, rng.choice(words)]) for x in w]
            rows.append((f"t{i}_{k}", [x for x in v if x], True, False))
    df = spark.createDataFrame([(k, " ".join(w), tr, ev) for k, w, tr, ev in rows], "id string, text string, train boolean, eval boolean")
    made = overlap.classes(df, "id", "text")
    cls = {r.id: r.cls for r in made.collect()}
    flags = made.join(df.select("id", "train", "eval"), "id")
    got = {(r.e, r.t) for r in overlap.near_classes(flags, tile=7).collect()}
    want = set()
    for a, wa, _, ea in rows:
        for b, wb, tb, _ in rows:
            n = max(len(wa), len(wb))
            if ea and tb and min(len(wa), len(wb)) >= 12 and cls[a] != cls[b] and lcs(wa, wb) >= 0.8 * n - 1e-9:
                want.add((cls[a], cls[b]))
    assert got == want and len(want) > 50


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
        p = q
    return p[-1]


def test_canonical_words():
    assert overlap.canonical_words("The **bаd** &amp; [ugly](http://x.y), h​ere!") == ["the", "bad", "ugly", "here"]
    assert overlap.canonical_words("") == [] and overlap.common_subsequence(list("abcbdab"), list("bdcaba")) == 4


def test_texts_that_read_the_same_are_one_class(spark):
    """Accents written apart, look-alike capitals, unseen characters, marks and tags inside words; words between signs stay words."""
    base = "Café owners didn't say why the new MUZHY menu was unhappy, yet they sold nine more cakes"
    same = [
        base.replace("é", "e\u0301"), base.replace("didn't", "didn’t"), base.replace("didn't", "didnt"), base.replace("MUZHY", "ΜUΖΗΥ"), base.replace("unhappy", "un\u3164happy"), base.replace("unhappy", "un\x07happy"),
        base.replace("unhappy", "un**happy**"), base.replace("unhappy", "un<b>happy</b>"), base.replace("unhappy", "unh\u0335appy"), base.replace(" yet ", "<br>yet\r"), base.replace("new", '<a href="' + "x" * 300 + '">new</a>'), base.replace("é", "é\r\n"),
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([base, *same])], "id string, text string")
    got = {r.id: r.cls for r in overlap.classes(df, "id", "text").collect()}
    assert len(got) == len(same) + 1 and not [same[int(k) - 1] for k, c in got.items() if c != got["0"]]
    assert overlap.canonical_words(">!one!< two three >!four!< if a < b and c > d") == "one two three four if a b and c d".split()
    assert overlap.canonical_words("ΗΜΕΡΑ") == overlap.canonical_words("ημερα") and overlap.canonical_words("(see https://x.y/z) then") == ["see", "then"]


def test_classes_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "one two"), ("d", LONG)], "id string, text string").withColumn("cls", F.lit(0))
    assert [r.id for r in overlap.classes(df, "id", "text").collect()] == ["d"]
    assert overlap.near_classes(overlap.classes(df.limit(0), "id", "text").withColumn("train", F.lit(True)).withColumn("eval", F.lit(True))).count() == 0


# --- 6
def test_groups_stay_together(spark):
    p, nodes, comps = splits._related(spark, SF)
    rows = splits.assigned(p, nodes, comps)
    assert rows.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert rows.count() == p.count()


def test_stratify(spark):
    rng = random.Random(6)
    rows = [(f"c{i:03}", lab, rng.randrange(1, 6)) for i in range(400) for lab in rng.sample(["a", "b", "c", "rare"], 2)]
    got = {r.component: r.split for r in splits.stratify(spark.createDataFrame(rows, "component string, label string, n long")).collect()}
    for lab in ("a", "b", "c", "rare"):
        total = sum(n for _, v, n in rows if v == lab)
        for s, share in splits.SHARES.items():
            assert abs(sum(n for c, v, n in rows if v == lab and got[c] == s) / total - share) < 0.04
    blocks = {r.component: r.split for r in splits.stratify(spark.createDataFrame(rows, "component string, label string, n long"), task_rows=200).collect()}
    assert len(blocks) == 400
    for lab in ("a", "b", "c", "rare"):
        total = sum(n for _, v, n in rows if v == lab)
        for s, share in splits.SHARES.items():
            assert abs(sum(n for c, v, n in rows if v == lab and blocks[c] == s) / total - share) < 0.05, (lab, s)
    assert splits.stratify(spark.createDataFrame([("x", None, 3)], "component string, label string, n long")).count() == 1
    assert splits.stratify(spark.createDataFrame([], "component string, label string, n long")).count() == 0


def test_pairs_edges(spark):
    schema = "mod_comment_id string, subreddit string, submission_id string, rule_cluster_label string, split string, violating_comment_id string, compliant_comment_id string, pair string"
    rows = [("t1_a", "r/X", "t3_s", "Hate", " Train", "t1_v", None, "q"), ("a ", "x", "s", None, None, "v", "c", None), (None,) * 8]
    got = pairs.distinct_pairs(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("a", "x", "s", "train", "hate", "v", "c")]
    assert pairs.distinct_pairs(spark.createDataFrame([], schema)).count() == 0


# --- 7
def bags(n, seed):
    """Texts in a made-up language with, for each, the category that is really in it (or -1), where, and a label wrong at times."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    marks = [[f"bad{c}x{i}" for i in range(5)] for c in range(3)]
    texts, truth, where, labels = [], [], [], []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randrange(4, 9))) for _ in range(rng.randrange(2, 7))]
        c = rng.choice([0, 1, 2]) if rng.random() < 0.25 else -1
        at = rng.randrange(len(lines))
        if c >= 0:
            lines[at] = f"you are a {rng.choice(marks[c])} here"
        elif rng.random() < 0.3:  # the same words of oneself
            lines[at] = f"i felt like a {rng.choice(marks[rng.randrange(3)])} today"
        texts.append(". ".join(lines))
        truth.append(c)
        where.append(at)
        said = c if c >= 0 and rng.random() < 0.65 else rng.choice([0, 1, 2]) if rng.random() < 0.06 else -1
        labels.append([float(said == k) for k in range(3)])
    return texts, np.array(truth), where, np.array(labels)


@pytest.fixture(scope="module")
def judge():
    texts, _, _, labels = bags(4_000, 1)
    return abuse.train(texts, labels)


def test_offence_is_learnt_from_wrong_labels(judge):
    texts, truth, where, _ = bags(1_500, 2)
    p, worst = judge.texts(texts, abuse.Words())
    got = np.where(p.max(axis=1) >= abuse.THRESHOLD, p.argmax(axis=1), -1)
    assert (got == truth).mean() > 0.97
    assert np.mean([worst[i, c] == where[i] for i, c in enumerate(truth) if c >= 0 and got[i] == c]) > 0.99


def test_abuse_scores(spark, judge):
    rows = [("a", "w1 w2 w3 w4. you are a bad0x1 here. w5 w6 w7"), ("b", "i felt like a bad0x1 today"), ("c", None), ("d", "You are a b4d2x3 here".replace("b4d", "bad")), ("f", ""), ("g", LONG), ("r", "[removed]"), ("a", "w1 w2 w3 w4. you are a bad0x1 here. w5 w6 w7")]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("abuse", F.lit(0))
    got = {r.id: r for r in abuse.score(df, ["id"], "body", judge).collect()}
    assert len(got) == 7 and got["a"].abuse > 0.5 and got["a"].sentence == 1 and got["d"].sexual > 0.5
    assert all(max(got[k].abuse, got[k].hate, got[k].sexual) < abuse.THRESHOLD for k in "bcfr") and got["c"].sentence is None and got["c"].abuse == 0
    assert abuse.score(df.limit(0), ["id"], "body", judge).count() == 0
    assert len(abuse.train([], np.zeros((0, 3))).features) == 0 and len(abuse.train(["x"], np.zeros((1, 3))).features) == 0


def sayings(n, seed, kinds=10):
    """Texts, a seventh with one of many offences, each in few texts; 0.6 of these labelled, and as many other labels."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    texts, truth, labels = [], [], []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randrange(4, 9))) for _ in range(rng.randrange(2, 7))]
        c = rng.choice([0, 1, 2]) if rng.random() < 0.15 else -1
        if c >= 0:
            i = rng.randrange(kinds)
            lines[rng.randrange(len(lines))] = f"bad{c}x{i} {rng.choice(words)} off{c}x{i}"
        texts.append(". ".join(lines))
        truth.append(c)
        said = c if c >= 0 and rng.random() < 0.6 else rng.choice([0, 1, 2]) if rng.random() < 0.09 else -1
        labels.append([float(said == k) for k in range(3)])
    return texts, np.array(truth), np.array(labels)


def test_rare_offences_are_learnt():
    texts, _, labels = sayings(6_000, 1)
    judge = abuse.train(texts, labels)
    texts, truth, _ = sayings(3_000, 2)
    p, _ = judge.texts(texts, abuse.Words())
    got = np.where(p.max(axis=1) >= abuse.THRESHOLD, p.argmax(axis=1), -1)
    both = ((got == truth) & (truth >= 0)).sum()
    assert both > 0.75 * (truth >= 0).sum() and both > 0.95 * (got >= 0).sum()


def test_unsure_judgement_is_corrected():
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.1, 3, -6) + rng.normal(0, 1.5, 20_000)
    true = 1 / (1 + np.exp(-x))
    z = rng.random(20_000) < true
    labels = np.where(z, rng.random(20_000) < 0.6, rng.random(20_000) < 0.04).astype(float)
    judged = 1 / (1 + np.exp(-(x / 1.5 - 2)))
    q, hit, stray = abuse.calibrate(judged, labels, 0.5, 0.1)
    assert abs(hit - 0.6) < 0.1 and abs(stray - 0.04) < 0.01
    assert abs(q[z].mean() - true[z].mean()) < 0.4 * abs(judged[z].mean() - true[z].mean())
    for label in (0.0, 1.0):
        assert np.isfinite(abuse.calibrate(np.full(5, 1e-6), np.full(5, label), 0.6, 1e-6)[0]).all()


# --- 8
def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 5, 60, 100, 101, 730, rng.randrange(1, 100)])) for i in range(900)] + [(None, 5), (1000, None)]
    items = spark.createDataFrame(rows, "k long, n int").withColumn("pack_id", F.lit("x"))
    caps = spark.createDataFrame([("p", 100), ("q", 64), ("bad", None)], "pack_name string, capacity int")
    for block in (10_000, 100):
        got = packing.pack(items, caps, "k", "n", block=block).collect()
        for name, cap in (("p", 100), ("q", 64)):
            mine = [r for r in got if r.pack_name == name]
            load, per = {}, {}
            for r in mine:
                per[r.k] = per.get(r.k, 0) + r.n_tokens
                if r.pack_id:
                    load[r.pack_id] = load.get(r.pack_id, 0) + r.n_tokens
            assert per == {k: n or 0 for k, n in rows if k is not None}
            assert max(load.values()) <= cap
            assert all(n > cap for k, n in rows if k is not None and n and sum(r.k == k for r in mine) > 1)
            assert sum(load.values()) / (len(load) * cap) > (0.97 if block > 900 else 0.955)
    assert packing.pack(items.limit(0), caps, "k", "n").count() == 0


def test_best_fit_is_best_fit():
    rng = random.Random(3)
    for _ in range(300):
        cap = rng.randrange(1, 70)
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(40))), reverse=True)
        rooms = []
        for s in sizes:
            tight = min((r for r in rooms if r >= s), default=None)
            if tight is not None:
                rooms.remove(tight)
            rooms.append((cap if tight is None else tight) - s)
        load = {}
        for s, b in zip(sizes, packing.best_fit_decreasing(sizes, cap)):
            load[b] = load.get(b, 0) + s
        assert sorted(cap - v for v in load.values()) == sorted(rooms)


def test_token_counts_are_exact():
    odd = [" a", "a ", "a\n b", "  x  y ", "it's  ok", "\n\n", "a \n b", "naïve 123abc 's 'll", "", None, "plain words, and more; of them!", "tab\there <|endoftext|> x"]
    c = tokens.Counter(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    assert c(odd) == [len(tokens._tokenizer(c.path).encode(t, add_special_tokens=False).ids) if t else 0 for t in odd]


# --- 9
def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(rng.choices(["big", "mid", "small"], [80, 15, 5], k=6000))] + [(7001, None, 9), (7002, "other", 9), (7003, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").withColumn("slot", F.lit(0))
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("gone", 0.4, 2), ("mid", None, 3)], "source string, target_share double, max_repeats int")
    a = mixing.mix(docs, goal, block_tokens=100).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.mix(docs.repartition(6), goal, block_tokens=100).collect()))
    total = sum(r.n_tokens for r in a)
    uses = {}
    for r in a:
        uses[r.source, r.doc_id] = uses.get((r.source, r.doc_id), 0) + 1
    for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(sum(r.n_tokens for r in a if r.source == s) / total - share) < 0.01
        assert max(n for (src, _), n in uses.items() if src == s) <= most
    assert len({(r.doc_id, r.pass_no) for r in a}) == len(a)
    n = max(r.slot for r in a)
    for lo in (0.0, 0.5):  # shares hold in each stretch of the schedule
        part = [r for r in a if lo * n <= r.slot < (lo + 0.5) * n]
        assert abs(sum(r.n_tokens for r in part if r.source == "big") / sum(r.n_tokens for r in part) - 0.5) < 0.03
    assert mixing.mix(docs.limit(0), goal).count() == 0


def test_running_total(spark):
    df = spark.createDataFrame([("g", i, 1 + i % 3) for i in range(100)], "g string, i int, v int")
    got = {r.i: r.t for r in mixing.running_total(df, "g", ["i"], "v", F.floor(F.col("i") / 7), "t").collect()}
    assert got == {i: sum(1 + j % 3 for j in range(i)) for i in range(100)}


# --- 10
def test_subjects(spark):
    names = [r.subject for r in spark.read.parquet(f"{SF}/subjects.parquet").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/subject_labels.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = subjects.fit(even, labels.join(even, "doc_id", "left_semi"), names)
    got = subjects.assign(odd, "doc_id", "text", model)
    known = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    r = got.join(known, "doc_id").where("sentences > 2 and subject != 'none'").agg(F.avg(F.exists("subjects", lambda s: (s["subject"] == F.col("subject")) & (s["share"] >= 0.25)).cast("double")).alias("a")).first()
    assert r.a > 0.7  # labels have errors, and half of few label the leaves
    edge = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (4, "[removed]")], "doc_id long, text string").withColumn("subjects", F.lit(1))
    assert all(x.subjects == [] for x in subjects.assign(edge, "doc_id", "text", model).collect())
    assert subjects.assign(edge.limit(0), "doc_id", "text", model).count() == 0


def test_leaves_are_labelled_by_terms(spark):
    """A leaf without a labelled document has the subject of those that share its terms; one that nothing speaks for has none."""
    rows = [("en", l, "doc", "", 10, 0.0) for l in (0, 1, 2)] + [("en", l, "sentence", "", n, 0.0) for l, n in ((0, 50), (1, 400), (2, 50))]
    rows += [("en", 0, "label", "food", 3, 0.0), ("en", 1, "label", "", 8, 0.0)]
    rows += [("en", l, "term", t, 20, w) for l, t, w in ((0, "soup", 5.0), (0, "bread", 4.0), (1, "lamp", 5.0), (2, "bread", 5.0), (2, "cheese", 3.0))]
    rows += [("en", None, "=food", "bread", 3, 0.0), ("en", None, "=food", "soup", 2, 0.0), ("en", None, "=", "lamp", 8, 0.0)]
    stats = spark.createDataFrame(rows, "lang string, leaf int, kind string, term string, n long, w double")
    of = subjects.label(stats, ["food", "law"])
    assert of == {("en", 0): 0, ("en", 1): -1, ("en", 2): 0}
    model = subjects.weigh(stats, of, ["food", "law"])
    total, counts = model.mixtures(["The soup and the bread. The lamp is on. Some cheese.", "", "The lamp and the bread and the soup"])
    assert total.tolist() == [3, 0, 1] and counts[:, 0].tolist() == [2, 0, 1] and counts[:, 1].sum() == 0
    assert subjects.label(stats.limit(0), ["food"]) == {}


def test_bisecting():
    rng = np.random.default_rng(1)
    centres = np.eye(5, 20, dtype=np.float32)
    x = np.repeat(centres, 40, axis=0) + rng.normal(0, 0.05, (200, 20)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = subjects.bisect(x, leaves=5, least=10)
    assert len(set(leaf)) == 5 and all(len(set(leaf[k : k + 40])) == 1 for k in range(0, 200, 40))


def test_subjects_of_all_documents(spark):
    """Words count in documents outside the sample and past the beginning of long ones."""
    filler = "the of and to in is it that for was " * 10 + ". "
    common = [(i, filler + "The dividend and the portfolio were good. The mortgage and the savings too. ") for i in range(60)]
    rare = [(100 + i, filler * (subjects.FIT_CHARS // len(filler) + 2) + "The quixplar was here with the dividend. ") for i in range(8)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "finance", "a1") for i in range(60)], "doc_id long, subject string, annotator string")
    leaves, stats = subjects.grown(docs, labels, ["finance", "food"], docs=70)
    assert stats.where("kind = '=finance' and term = 'dividend'").agg({"n": "sum"}).first()[0] == 60
    seen = {r.term: r.n for r in stats.where("kind = 'term'").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert seen["quixplar"] == 8 and seen["dividend"] == 68 and stats.where("kind = 'doc'").agg({"n": "sum"}).first()[0] == 68


def test_leaves_are_cut_from_all_documents(spark):
    """A few documents about something of their own get a leaf, however few documents one task holds; all labels count."""
    groups = [[a + c for c in "abcdefghijkl"] for a in ("alpha", "bravo", "delta", "gamma")]
    rng = random.Random(4)
    rows = [(g * 1000 + i, "the and of it is for " + " ".join(rng.sample(words, 8))) for g, words in enumerate(groups) for i in range((300, 300, 300, 14)[g])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, "food", "a") for k, _ in rows], "doc_id long, subject string, annotator string")
    for most in (10_000, 200):
        leaves, stats = subjects.grown(docs, labels, ["food"], docs=most)
        at = [leaves.nearest("en", *leaves.vector("en", [subjects.terms(t.split())])[1:]) for _, t in rows]
        of = [{l for l, (k, _) in zip(at, rows) if k // 1000 == g} for g in range(4)]
        assert all(not of[a] & of[b] for a in range(4) for b in range(a)), (most, of)
        assert stats.where("kind = 'label'").agg({"n": "sum"}).first()[0] == len(rows) == stats.where("kind = 'doc'").agg({"n": "sum"}).first()[0]
