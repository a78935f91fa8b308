import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from rekurve.llm import common, simhash

NOTES = "experiment_id long, description string"


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, vals, bits=3):
    par = {i: i for i in ids}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in zip(ids, vals):
        for j, b in zip(ids, vals):
            if i < j and bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                r, s = root(i), root(j)
                par[max(r, s)] = min(r, s)
    return {i: root(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB \t\n\x0b\x0c\r\x85\xa0éÉ"), st.characters(codec="utf-8"))))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == plain(text)


def test_fingerprint_long():
    text = "Bleach spot A  recovers\n" * 30_000
    assert simhash.fingerprint_of(text) == plain(text)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


@pytest.mark.parametrize("limit", [50_000, 3])
def test_trie_join(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    vals = set(base.tolist())
    for b in base[:40].tolist():  # families, chains and pairs just beyond the budget
        for k in rng.integers(0, 8, 6):
            v = b
            for bit in rng.choice(64, k, replace=False):
                v ^= -(2**63) if bit == 63 else 1 << int(bit)
            vals.add(v)
    vals |= {(base[0] & ~0xFFFF).item() | x for x in range(80)}  # one crowded top node
    vals = sorted(vals)
    ids = list(range(100, 100 + len(vals)))
    d = spark.createDataFrame(list(zip(vals, ids)), "value long, node long")
    got = {r.node: r.component for r in common.components(simhash.trie_links(d)).collect()}
    want = classes(ids, vals)
    assert {i: got.get(i, i) for i in ids} == want


def test_notes(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, " \t"), (8, "a b c d"), (3, "A b C d"), (8, "a b c d"), (None, "a b c d"), (10, long), (11, long + " end")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], NOTES + ", component_id string, fingerprint int")
    got = sorted((r.experiment_id or -1, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_notes(d).collect())
    near = bin(plain(long) ^ plain(long + " end")).count("1") <= 3
    want = [(i or -1, plain(t), {5: 5, 6: 5, 7: 5, 8: 3, 3: 3, None: None, 10: 10, 11: 10 if near else 11}[i]) for i, t in rows]
    assert got == sorted(want, key=lambda r: r[:2])
    assert simhash.near_duplicate_notes(spark.createDataFrame([], NOTES)).count() == 0


@pytest.mark.parametrize("tables, checks, apart", [(4, 0, 0), (4, 2, 24), (3, 2, 20)])
def test_more_tables(spark, tables, checks, apart):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice(["spot", "cell", "signal", "bleach", "plateau", "lamin", "drift", "probe"], 60)) for _ in range(12)]
    texts = base + [" ".join("other" if k == j else w for k, w in enumerate(t.split())) for j, t in enumerate(base)] + base[:3]
    ids = list(range(50, 50 + len(texts)))
    prints = [simhash.fingerprints_of(t, 5, tables) for t in texts]

    def linked(a, b):
        bits = [(x ^ y).bit_count() for x, y in zip(a, b)]
        return any(bits[k] <= 6 and (not checks or sum(bits[(k + i) % tables] for i in range(checks + 1)) <= apart) for k in range(tables))

    par = {i: i for i in ids}
    for _ in ids:
        for i, a in zip(ids, prints):
            for j, b in zip(ids, prints):
                if linked(a, b):
                    par[i] = par[j] = min(par[i], par[j])
    got = simhash.near_duplicate_notes(spark.createDataFrame(list(zip(ids, texts)), NOTES), words=5, bits=6, tables=tables, checks=checks, apart=apart).collect()
    assert {r.experiment_id: r.component_id for r in got} == par and len(base) <= len(set(par.values())) < len(base) + 9


def test_check_of_further_fingerprints(spark):
    """Equal and close values stay apart when their further fingerprints differ; those that lead a value and those that don't both link."""
    rng = np.random.default_rng(5)
    far, near = rng.integers(-(2**63), 2**63 - 1, 2).tolist()
    rows = [(1, 0b0, far), (2, 0b1, far ^ 0b11), (3, 0b0, near), (4, 0b1, near ^ 0b1), (5, 0b111111, near)]
    d = spark.createDataFrame(rows, "node long, value long, other long")
    got = {r.node: r.component for r in common.components(simhash.trie_links(d, 2, ["other"], 5)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
