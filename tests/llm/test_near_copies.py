import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rekurve.llm import common, near_copies

DOCS = "doc_id long, text string, lang string"


def shingle_set(text):
    t = (text or "").lower().split()
    return {" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else {None}


def edited(rng, text, n):
    t = text.split()
    for k in rng.choice(len(t), n, False):
        t[k] = f"e{rng.integers(1 << 30)}"
    return " ".join(t)


def groups(texts):
    par, sets = list(range(len(texts))), [shingle_set(t) for t in texts]

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if root(i) != root(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                par[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    """Pairs about the bound, a large group of copies, a template whose texts share 0.7, a chain, short and empty texts."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    out = []
    for k in range(60):
        t = say(200)
        out += [t, edited(rng, t, 3 + k % 7)]
    same = say(120)
    out += [edited(rng, same, 1) for _ in range(60)] + [same.upper(), same]
    form = say(160)
    out += [f"{form} {say(30)}" for _ in range(60)]
    step = say(200)
    for _ in range(8):
        step = edited(rng, step, 3)
        out.append(step)
    return out + ["one two", "One  two", "one", "", None, " \n", "a b c d e", "a b c d f"]


@pytest.mark.parametrize("turns, shingles", [(2, 200_000), (0, 1500)])
def test_true_similarity_decides(spark, texts, monkeypatch, turns, shingles):
    monkeypatch.setattr(near_copies, "TURNS", turns)
    monkeypatch.setattr(near_copies, "PART_SHINGLES", shingles)
    d = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: r.component_id for r in near_copies.near_copies(cp.cut_lineage(d), "row", "text", 5, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_linked(seed):
    """Edges connect what all pairs within the bound connect, and no pair below it is an edge."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = {100 + i: np.unique(np.r_[base[rng.random(60) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)]) for i in range(25)}
    a, b = np.array([(i, j) for i in sets for j in sets if i < j]).T
    got = near_copies.linked(sets, a, b, 0.8)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    assert all(alike(i, j) for i, j in got) and len(got) < len(sets)
    for edges in (got, [(i, j) for i, j in zip(a, b) if alike(i, j)]):
        of = {i: {i} for i in sets}
        for i, j in edges:
            both = of[i] | of[j]
            of.update(dict.fromkeys(both, both))
        found = {frozenset(s) for s in of.values()}
        assert edges is got or found == first
        first = found


def test_lead():
    import pyarrow as pa

    rows = [(1, 10, 0), (1, 11, 0), (1, 12, 7), (2, 13, 7), (2, 14, 0), (3, 15, 1)]
    cut = [pa.RecordBatch.from_pydict(dict(zip(("key", "node", "component"), zip(*part)))) for part in (rows[:2], rows[2:4], rows[4:])]
    assert [tuple(r.values()) for p in near_copies.lead(iter(cut)) for r in p.to_pylist()] == [(12, 10), (14, 13)]


def test_sets_of_other_sizes_are_not_made(spark, monkeypatch):
    """A pair whose sizes rule out the bound asks for no set; one at the bound does."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (84, 104, 105, 300)]  # 80, 100, 101 and 296 shingles
    t = cp.cut_lineage(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    nodes = cp.cut_lineage(spark.createDataFrame([(0, 80), (1, 100), (2, 101), (3, 296)], "node long, size int"))
    asked, plain = [], near_copies.with_sets
    monkeypatch.setattr(near_copies, "with_sets", lambda texts, a, words: asked.append(sorted(r.node for r in a.collect())) or plain(texts, a, words))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (2, 3)], "a long, b long")
    got = near_copies.verified(pairs, nodes, t, 5, 0.8).collect()
    assert asked == [[0, 1]] and [{r.a, r.b} for r in got] == [{0, 1}]


def test_likely(spark):
    """Nothing wanted is missing, what is surely not wanted is kept apart, and few others come along."""
    rows = spark.range(50_000).select("id", F.lit("x").alias("word"), F.lit(1).alias("bits"))
    marks = common.marked(spark.range(0, 50_000, 50).withColumnRenamed("id", "k"), "k")
    may, not_ = (sorted(r.id for r in common.likely(rows, "id", marks, how).select("id").collect()) for how in ("left_semi", "left_anti"))
    assert set(range(0, 50_000, 50)) <= set(may) and len(may) < 1100 and sorted(may + not_) == list(range(50_000))


def test_stage(spark, texts, monkeypatch):
    monkeypatch.setattr(near_copies, "TURNS", 1)
    docs = cp.cut_lineage(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS))
    assert sorted(r.doc_id for r in cp.one_of_each_copy(spark, docs, "").collect()) == sorted(set(groups(texts)))
