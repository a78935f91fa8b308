import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.llm import merkle, queries

FILES = "file_id long, filename string, experiment_id string, raw_data_json string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """All levels of a tree over ``nodes``, and for each of them its siblings upwards as (left, right)."""
    row, ways = nodes, [[] for _ in nodes]
    level = 0
    while len(row) > 1:
        for i, way in enumerate(ways):
            k = i >> level
            way.append((row[k - 1], None) if k % 2 else (None, row[k + 1] if k + 1 < len(row) else None))
        row, level = [H("".join(row[i : i + 2])) for i in range(0, len(row), 2)], level + 1
    return row[0], ways


def plain(rows):
    """(file_id, leaf, subroot, root, proof) of every row."""
    of = defaultdict(list)
    for r in rows:
        of[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r)))
    names = sorted(of, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: climb([x for *_, x in sorted(of[n])]) for n in names}
    root, above = climb([trees[n][0] for n in names])
    return [(i if has else None, leaf, trees[n][0], root, way + up) for n, up in zip(names, above) for (has, i, leaf), way in zip(sorted(of[n]), trees[n][1])]


@pytest.mark.parametrize("levels", [0, 1, 2, 3, 5, 10])
def test_addresses(levels):
    """Every place once; a bottom part of half the height is one stretch, and the root comes first."""
    at = merkle.addresses(levels)
    assert sorted(np.concatenate(at).tolist()) == list(range((2 << levels) - 1)) and at[0][0] == 0
    rows = levels + 1
    if rows > 1:
        top, bottom = rows // 2, rows - rows // 2
        for tree in range(1 << top):
            own = np.concatenate([at[d][tree << (d - top) : (tree + 1) << (d - top)] for d in range(top, rows)])
            assert np.ptp(own) == (1 << bottom) - 2


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8])
def test_block(count):
    leaves = [H(str(i)) for i in range(count)]
    store, root = merkle.grow(leaves, (count - 1).bit_length())
    want, ways = climb(leaves)
    got, left, right = merkle.siblings(store, (count - 1).bit_length(), count)
    assert root == want and got.tolist() == leaves and [list(zip(a, b)) for a, b in zip(left, right)] == ways


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, levels):
    rows = [(i * 3, f"cell {i}.csv", "hot", f"[{i}]") for i in range(70)] + [(5, "é.csv", "b", ""), (5, "é.csv", "b", ""), (5, None, "b", None), (None, "x", "B", "long " * 50_000), (2**60 + 1, "y", None, "1"), (None, "y", None, "1"), (None, None, None, None), (4, "", "", "")]
    d = spark.createDataFrame([(*r, "x", 3) for r in rows], FILES + ", rank string, block int").repartition(4)
    got = merkle.file_manifest(d, levels=levels).withColumn("again", merkle.folded(F.col("claim"), F.col("proof"))).collect()
    found = [(r.file_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in got]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)
    assert all(r.claim == r.leaf and r.again == r.root for r in got)


def test_claims(spark):
    """A claim for a changed field does not fold to the root; that of an unchanged one does."""
    d = spark.createDataFrame([(i, "a", "e", str(i % 5)) for i in range(40)], FILES)
    claim = merkle.leaf_digest(F.col("file_id"), F.col("filename"), F.col("experiment_id"), F.when(F.col("file_id") % 7 == 0, F.lit("other")).otherwise(F.col("raw_data_json")))
    got = merkle.file_manifest(d, claim=claim, levels=2).withColumn("right", merkle.folded(F.col("claim"), F.col("proof")) == F.col("root")).collect()
    assert {r.file_id for r in got if not r.right} == {i for i in range(40) if i % 7 == 0}


def test_single_and_empty(spark):
    d = spark.createDataFrame([(1, "a", "e", "x")], FILES)
    (r,) = merkle.file_manifest(d).collect()
    assert r.leaf == r.subroot == r.root and r.proof == []
    assert merkle.file_manifest(d.limit(0)).count() == 0


def test_query(spark):
    """The registered query against its SQL and against a plain tree."""
    sf = "/root/testdata/sf0.001"
    d = queries.QUERIES["op12_merkle_manifest"](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.execute(queries.ORACLES["op12_merkle_manifest"])
    names = [c[0] for c in sql.description]
    assert d.columns == names == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, d.collect()))
    assert got == sorted(sql.fetchall())
    rows = con.execute("select doc_id, source, lang, n_chars, text from documents").fetchall()
    want = {i: (leaf, sub, root, H("".join((a or "") + (b or "") for a, b in way))) for i, leaf, sub, root, way in plain(rows)}
    assert {r[0]: r[1:5] for r in got} == want and {r[0] for r in got if not r[6]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
