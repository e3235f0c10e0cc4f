import random

import pytest

from threadloom.operators.components import components
from threadloom.operators.hierarchy import descendants, hierarchy
from threadloom.plans.reply_trees import defects, reply_trees


def walk(parents, x):
    seen, at = [], x
    while True:
        if at in seen:
            return ("in_cycle" if at == x else "below_cycle", None, None, None)
        seen.append(at)
        p = parents[at]
        if p is None:
            return ("tree", at, len(seen) - 1, seen[::-1])
        if p not in parents:
            return ("dangling", at, len(seen) - 1, seen[::-1])
        at = p


@pytest.fixture(scope="module")
def parents():
    rng = random.Random(4)
    out = {}
    for i in range(500):
        r = rng.random()
        out[f"n{i}"] = None if r < 0.03 else "lost" if r < 0.05 else f"n{rng.randrange(i)}" if i and r < 0.97 else f"n{rng.randrange(500)}"
    for i in range(120):  # a deep chain
        out[f"c{i}"] = f"c{i - 1}" if i else None
    ring = [f"y{i}" for i in range(90)]
    rng.shuffle(ring)
    out |= dict(zip(ring, ring[1:] + ring[:1]))
    out |= {f"w{i}": f"y{i}" for i in range(20)} | {"self": "self"}
    out |= {f"h{i}": "n0" for i in range(300)}  # a hot parent
    return out


@pytest.mark.parametrize("task_rows", [60, 100_000])
def test_against_walking_up(spark, parents, task_rows):
    df = spark.createDataFrame(list(parents.items()), "id string, parent string")
    got = {r.id: (r.state, r.root, r.depth, r.path) for r in hierarchy(df, paths=True, task_rows=task_rows).collect()}
    assert got == {k: walk(parents, k) for k in parents}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "x")], "id string, parent string")
    got = {tuple(r) for r in descendants(hierarchy(df, paths=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_empty_nulls_repeats_and_other_columns(spark):
    schema = "id string, parent string, root string, depth int, state string, path string"
    assert hierarchy(spark.createDataFrame([], schema), paths=True).count() == 0
    rows = [("a", None, "q", 7, "z", "p")] * 3 + [(None, "a", None, None, None, None), ("b", "a", None, None, None, None), ("b", None, None, None, None, None)]
    got = {r.id: (r.root, r.depth) for r in hierarchy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1)}


COMMENTS = "id string, parent_id string, link_id string, body string"


def test_comment_defects(spark):
    rows = [
        ("t1_a", "t3_s", "t3_s", ""), (" a ", "t3_s", "s", ""), ("b", "t1_a", "s", ""), ("c", " b ", "t3_other", ""), ("d", None, "t3_s", ""), ("e", "t1_d", "t3_s", ""), ("f", "t1_gone", "t3_s", ""), ("g", "t1_f", "t3_s", ""),
        ("h", "t1_h", "t3_s", ""), ("i", "t1_j", "t3_s", ""), ("j", "t1_i", "t3_s", ""), ("k", "t1_j", "t3_z", ""), ("l", "s", "t3_s", ""), ("m", "t1_a", None, ""), (None, None, None, None),
    ]
    got = {tuple(r) for r in defects(spark.createDataFrame(rows, COMMENTS)).collect()}
    assert got == {("c", "cross_link"), ("d", "no_parent"), ("e", "no_parent"), ("f", "no_parent"), ("g", "no_parent"), ("h", "in_cycle"), ("i", "in_cycle"), ("j", "in_cycle"), ("k", "below_cycle"), ("k", "cross_link")}
    assert defects(spark.createDataFrame([], COMMENTS)).count() == 0


def test_comment_paths(spark):
    t = {r.id: r.path for r in reply_trees(spark.createDataFrame([("a", "t3_s", "t3_s", ""), ("b", "t1_a", "t3_s", "")], COMMENTS), paths=True).collect()}
    assert t == {"a": ["a"], "b": ["a", "b"]}


@pytest.mark.parametrize("task_rows", [40, 10**6])
def test_components(spark, task_rows):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(600)}", f"n{rng.randrange(600)}") for _ in range(450)] + [("hot", f"n{i}") for i in range(60)] + [(None, "n1"), ("n1", None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a and b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string"), task_rows=task_rows).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
