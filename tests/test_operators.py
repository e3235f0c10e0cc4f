import math

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import author_key, bare_id, community_key
from threadloom.operators import documents, matching, splitting, statistics, threads


def values(spark, items, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    given = ["Rule 1: No <b>spam</b> &amp; ads", "**Be nice** see [wiki](http://x.y)", "Rule 1", "General: ", "Rule 2b. Be kind", "&lt;b&gt;x", None, ""]
    assert values(spark, given, X.clean_text) == ["No spam & ads", "Be nice see wiki", "Rule 1", "General:", "Be kind", "x", "", ""]


def test_small_functions(spark):
    assert values(spark, ["menu/item by u/bob"], X.without_mentions) == ["men by "]
    assert values(spark, ["(B)", "b.", "The answer is (b)", "42", None], X.answer_choice) == ["(b)", "(b)", "(t)", "", ""]
    assert values(spark, ["(B)", "The answer is (b)", "none"], X.strict_choice) == ["(b)", "(b)", ""]
    assert values(spark, ["(a)", "(b)", "a or b", ""], X.judged_right) == [True, False, False, False]
    assert values(spark, ["AutoModerator", "Abbott", "alice", None], X.is_bot) == [True, True, False, True]
    assert values(spark, ["en-au", "pt_BR", "de", None], X.language_root) == ["en", "pt", "de", "unknown"]
    assert values(spark, ["1577836800"], lambda c: X.timestamp_text(c.cast("bigint"))) == ["Wed, Jan 1, 2020, 12:00AM"]
    assert values(spark, [" t1_abc", "t3_", None, "abc "], bare_id) == ["abc", None, None, "abc"]
    assert values(spark, ["r/Foo", " foo ", "", None], community_key) == ["foo", "foo", None, None]
    assert values(spark, ["u/Bob", "[deleted]", None], author_key) == ["bob", None, None]
    assert values(spark, ["https://i.imgur.com/a.png?x", "https://a.b/c"], X.url_extension) == ["png", None]
    assert values(spark, ["abc", "_x", "9"], X.first_letter_bucket) == ["a", "_", "9"]
    assert values(spark, ["HTTP 404", "Connection reset", "x"], X.error_category) == ["404_not_found", "connection_error", "other_error"]


def test_divergence(spark):
    rows = [(g, x) for g, xs in {"a": [2, 2], "b": [3, 1], "c": [4, 0], "d": [5, 0, 0], "e": [0, 0]}.items() for x in xs]
    got = {r.g: r.divergence for r in statistics.divergence_from_uniform(spark.createDataFrame(rows, "g string, n int"), "g", "n").collect()}
    want = {"a": 0.0, "b": 0.033822076, "c": 0.215761554, "d": 0.318257084, "e": 1.0}
    assert all(math.isclose(got[k], v, abs_tol=1e-8) for k, v in want.items())


def test_floor_percentiles(spark):
    r = statistics.floor_percentiles(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "n int"), "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).first()
    assert (r.p25, r.p50, r.p75, r.p95) == (2, 3, 4, 4)


def test_match(spark):
    rows = [("s", i, k, v) for i, sims in enumerate([[0.95, 0.85], [0.95, 0.5], [0.85, 0.1], [0.9, 0.8]]) for k, v in enumerate(sims, 1)]
    sims = spark.createDataFrame(rows, "g string, i int, rule int, sim double")
    t = spark.createDataFrame([(0.9, 0.8)], "gold double, ambiguous double")
    got = {r.i: (r.status, r.rule) for r in matching.match(sims, t, "g", "i", "rule").collect()}
    assert got == {0: ("ambiguous", None), 1: ("matched", 1), 2: ("unmatched", None), 3: ("matched", 1)}


def test_split_sizes(spark):
    sizes = {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1), 9: (1, 1, 7), 10: (1, 1, 8), 15: (2, 2, 11), 25: (2, 2, 21), 35: (4, 4, 27)}
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "g int, k int")
    rows = splitting.adaptive_split(df, "g", "k").groupBy("g").pivot("split", ["test", "val", "train"]).count().na.fill(0).collect()
    assert {r.g: (r.test, r.val, r.train) for r in rows} == sizes


def test_rank_is_global(spark):
    df = spark.createDataFrame([(f"x{i}", i % 7) for i in range(200)], "k string, n int").repartition(5)
    got = {r.k: r["rank"] for r in statistics.filtered_rank(df, F.col("n") > 2, [F.asc("n"), F.asc("k")]).collect()}
    good = sorted((i % 7, f"x{i}") for i in range(200) if i % 7 > 2)
    assert {k: got[k] for _, k in good} == {k: j for j, (_, k) in enumerate(good, 1)}
    assert sum(v == 999999 for v in got.values()) == 200 - len(good)


def test_majority(spark):
    df = spark.createDataFrame([("c", v, i) for i, v in enumerate("xyyx")], "g string, v string, o int")
    assert [tuple(r) for r in statistics.majority(df, "g", "v", "o").collect()] == [("c", "x", 2)]


def test_bootstrap_is_stable(spark):
    df = spark.createDataFrame([(i, "a", float(i % 2)) for i in range(400)], "k int, g string, v double")
    a = statistics.bootstrap_interval(df, "g", "v", replicates=300).first()
    b = statistics.bootstrap_interval(df.repartition(7), "g", "v", replicates=300).first()
    assert (a.low, a.high) == pytest.approx((b.low, b.high)) and a.low < 0.5 < a.high and 0.07 < a.high - a.low < 0.13


def test_first_issue(spark):
    paths = spark.createDataFrame([("a", ["r", "a"]), ("b", ["r", "b"]), ("c", ["c"]), ("d", ["m", "d"]), ("e", ["c", "e"]), ("x", ["c", "x"])], "id string, path array<string>")
    cols = "id string, removed boolean, media boolean, moderator boolean, edited boolean, mod_reply boolean"
    rows = [("r", True, False, False, True, True), ("a", False, False, False, True, True), ("b", False, False, False, False, False), ("c", False, False, False, False, True), ("m", False, True, True, False, False), ("d", None, None, None, None, None), ("e", False, False, False, True, False)]
    got = {r.id: (r.violating, r.compliant) for r in threads.first_issue(paths, spark.createDataFrame(rows, cols)).collect()}
    # an edit is a fault of a violating end only, a moderator's answer of a compliant end only; above the end neither counts
    assert got == {"a": ("edited_comment", "mod_response"), "b": ("removed_or_deleted",) * 2, "c": (None, "mod_response"), "d": ("has_media",) * 2, "e": ("edited_comment", None), "x": (None, None)}
    assert threads.first_issue(paths.limit(0), spark.createDataFrame([], cols)).count() == 0


def test_siblings_by_hand(spark):
    """r has children v (violating), s, m (under a removed comment) and u; v and s have children of their own."""
    nodes = [("t", "r", None, 0, ["r"], 1), ("t", "v", "r", 1, ["r", "v"], 5), ("t", "s", "r", 1, ["r", "s"], 3), ("t", "u", "r", 1, ["r", "u"], None), ("t", "v2", "v", 2, ["r", "v", "v2"], 0), ("t", "s2", "s", 2, ["r", "s", "s2"], 9), ("t", "o", None, 0, ["o"], 1)]
    df = spark.createDataFrame(nodes, "tree string, id string, parent string, depth int, path array<string>, score long")
    pairs = spark.createDataFrame([("p1", "v", 2), ("p2", "v2", 1)], "pair string, id string, ord int").join(df.select("tree", "id", "parent", "depth", "path"), "id")
    c = threads.candidates(pairs, df)
    # depth 1: the same depth only; depth 2: also depth 1, but not the parent v
    assert {(r.pair, r.cand, r.common, r.length) for r in c.collect()} == {("p1", "s", 1, 2), ("p1", "u", 1, 2), ("p2", "s2", 1, 3), ("p2", "s", 1, 2), ("p2", "u", 1, 2)}
    assert {r.pair: r.cand for r in threads.best(c).collect()} == {"p1": "u", "p2": "s2"}  # a missing score is 0, lower than 3


def test_greedy_gives_each_once(spark):
    rows = [("p1", "t", "1", "v1", "x", 0, 1, 2, 2), ("p1", "t", "1", "v1", "y", 0, 1, 1, 2), ("p2", "t", "2", "v2", "x", 0, 1, 2, 2), ("p2", "t", "2", "v2", "v1", 0, 1, 1, 1), ("p3", "t", "3", "v3", "x", 0, None, 2, 2)]
    df = spark.createDataFrame([(p, t, o, i, c, d, s, k, n) for p, t, o, i, c, d, s, k, n in rows], "pair string, tree string, ord string, id string, cand string, cdepth long, score long, common long, length long")
    got = {r.pair: r.cand for r in threads.greedy(df).collect()}
    assert got == {"p1": "x", "p2": "v1"}


def test_hydrate(spark):
    members = spark.createDataFrame([("p", 0, "a"), ("p", 1, "q")], "pair string, level int, comment_id string")
    bodies = spark.createDataFrame([("a", "text")], "id string, body string")
    full = documents.thread_arrays(members, bodies, ["pair"])
    back = documents.hydrate(documents.dehydrate(full), bodies, ["pair"]).first().thread
    assert [(c.level, c.id, c.body, c.found) for c in back] == [(0, "a", "text", True), (1, "q", None, False)]


def test_options_are_all_there(spark):
    df = spark.createDataFrame([("k1", ["b", "a", "c"]), ("k2", [])], "k string, o array<string>")
    got = {r.k: r.x for r in df.select("k", splitting.shuffled_options(F.col("o"), F.col("k"), "_v").alias("x")).collect()}
    assert [x.label for x in got["k1"]] == ["(a)", "(b)", "(c)"] and {x.option for x in got["k1"]} == {"a", "b", "c"} and got["k2"] == []


def test_stratified(spark):
    df = spark.createDataFrame([(f"s{i % 3}", f"u{i % 17}", f"k{i}") for i in range(120)] + [("other", f"o{i}", f"z{i}") for i in range(20)], "s string, u string, k string")
    rows = splitting.stratified_sample(df, "s", "u", "k", 16).collect()
    assert len(rows) == 16 and len({r.u for r in rows}) == 16


def test_geometry(spark):
    import numpy as np

    from threadloom.operators import geometry

    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    h = geometry.hull(square)
    assert len(h) == 4 and geometry.centroid(h).tolist() == [1, 1]
    assert geometry.overlap(h, h + 1) and not geometry.overlap(h, h + 3)
    rows = [(g, float(x + dx), float(y)) for g, dx in (("a", 0), ("b", 1), ("c", 9)) for x, y in square] + [("a", None, 1.0)]
    corners = geometry.hulls(spark.createDataFrame(rows, "g string, x double, y double").repartition(4), "g", "x", "y")
    assert corners.groupBy("g").count().where("count = 4").count() == 3
    got = {r.g: r.colour for r in geometry.colours(corners, "g").collect()}
    assert abs(got["a"] - got["b"]) >= 2 and set(got) == {"a", "b", "c"}


def test_least_loaded(spark):
    df = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e", None)], "k string, n long")
    got = {r.k: r.bucket for r in splitting.least_loaded(df, "k", "n", 2).collect()}
    assert got["b"] == got["c"] != got["a"] and got["d"] == got["a"]


def test_interleaved(spark):
    r = spark.createDataFrame([("Title: x Body: y Body: z",), ("none",)], "v string").select(X.interleaved(F.col("v")).alias("o")).collect()
    assert [tuple(x.o) for x in r] == [("Title: x Body: ", "y Body: z"), ("none", None)]


def test_judged_reads_whole_texts(spark, tmp_path):
    from threadloom.plans import catalog

    spark.createDataFrame([(1, "a"), (2, "an b"), (3, "the A"), (4, "act"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.judged for r in catalog.QUERIES["scl09_judged"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_sorted_lists_are_whole(spark):
    from threadloom.plans import catalog

    for name, key in (("srt01_all_by_size", "size"), ("srt07_all_newest_first", "month")):
        rows = [r[key] for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
        assert len(rows) > 20 and [r for r in rows if r is not None] == sorted((r for r in rows if r is not None), reverse=True)


def test_bootstrap_of_both_sides(spark):
    df = spark.createDataFrame([("x", 1.0, 0.0)] * 50 + [("x", 0.0, 1.0)] * 50 + [("y", 1.0, None)] * 40, "label string, violating double, compliant double")
    got = {(r.kind, r.label, r.side): r for r in statistics.bootstrap_sides(df, "label", ("violating", "compliant"), replicates=5_000).collect()}
    assert set(got) == {("overall", "all", s) for s in ("violating", "compliant", "overall")} | {("label", "x", s) for s in ("violating", "compliant", "overall")} | {("label", "y", "violating")}
    assert abs(got["label", "x", "violating"].low - 0.402) < 0.02 and got["label", "y", "violating"].low == 1.0
    assert abs(got["label", "x", "overall"].high - 0.5) < 1e-9
