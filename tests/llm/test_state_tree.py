import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from rekurve.llm import queries, state_tree

TRACES = "cell_id long, frame int, qc_motion boolean, qc_reason string"
COLUMNS = ["cell_id", "depth", "parent_cell_id", "n_cells", "n_children", "n_leaves", "saved_words", "ends_sha256"]


def sequences(rows):
    """(state, words) of each cell in order; equal frames in the order of the states' digests."""
    of = defaultdict(list)
    for cell, frame, *state in rows:
        a, b = ("" if s is None else str(s).lower() if isinstance(s, bool) else s for s in state)
        name = hashlib.md5("".join(f"{len(x.encode())}:{x}" for x in (a, b)).encode()).digest()
        if cell is not None:
            of[cell].append((frame is not None, frame or 0, name, len(re.findall(r"[^\x20\x09-\x0D]+", b))))
    return {c: [x[2:] for x in sorted(s)] for c, s in of.items()}


def rebuilt(of):
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = of.get(c // 20 * 20 if c >= 0 else -(-c // 20 * 20), [])[:h] + own[h:]
    return out


def plain(of):
    """All nodes by a dictionary of prefixes."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c, s in of.items():
        for d in range(len(s) + 1):
            p = tuple(n for n, _ in s[:d])
            members[p].append(c)
            words[p] = s[d - 1][1] if d else 0
        ends[p].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words[p] + sum(saved[k] for k in kids[p])
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], digest[p]) for p, m in members.items()}


def grown(d, limit, family=True, state=("qc_motion", "qc_reason")):
    own = state_tree.states(d, state=state)
    pair = state_tree.families(own) if family else (own, own.select("cell_id").distinct())
    return state_tree.with_digests(*state_tree.state_tree(*pair, limit=limit))


def same(nodes, want):
    got = [tuple(r) for r in nodes.select(COLUMNS).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(5), []
    texts = ["", "in focus", "drift \t of stage", "motion", None, "lost\x0bfocus again"]
    for c in range(-3, 130):
        for f in draw.sample(range(20), draw.randrange(1, 8)):
            out.append((c * draw.choice([1, 1, 1, 7]), None if f == 19 else f, draw.choice([True, False, None]), draw.choice(texts[:2] if c % 3 else texts)))
    common = [(f, True, f"frame {f // 3}") for f in range(150)]
    for c in range(1000, 1012):  # long shared beginnings, over more than one stored chunk, and copies
        out += [(c, *x) for x in common[: 150 - c % 3 * 11]]
        out += [(c, 200 + k, False, "late") for k in range(c % 2)]
    out += [(2**60, f, None, f"state {f % 7}") for f in range(300)]  # one long history alone
    out += out[:5] + [(None, 1, True, "no cell"), (None, None, None, None), (777, 0, True, "word " * 40_000)]
    return out


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_families(spark, rows, limit):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], TRACES + ", row int, depth int").repartition(4)
    same(grown(d, limit), plain(rebuilt(sequences(rows))))


def test_deep_bursts(spark):
    """Cells that leave a shared history one by one: every burst has another branch below it."""
    rows = [(c, f, True, "a" if f < c else f"own {c}") for c in range(1, 12) for f in range(12)]
    d = spark.createDataFrame(rows, TRACES)
    same(grown(d, 15, family=False), plain(sequences(rows)))


def test_copies(spark, monkeypatch):
    """Equal histories, more than one text of ids takes."""
    monkeypatch.setattr(state_tree, "IDS", 16)
    rows = [(c, f, True, f"s{f}") for c in range(90) for f in range(3)] + [(500, 0, True, "s0")]
    d = spark.createDataFrame(rows, TRACES).repartition(5)
    same(grown(d, 2, family=False), plain(sequences(rows)))


def test_without_states(spark):
    d = spark.createDataFrame([(41, 0, True, "only"), (2, 5, None, None)], TRACES)
    rows = [tuple(r) for r in d.collect()]
    want = rebuilt(sequences(rows))
    assert [] in want.values()
    same(grown(d, 10), plain(want))
    assert grown(d.limit(0), 10).count() == 0
    assert grown(d.withColumn("cell_id", d.cell_id * None), 10).count() == 0


def test_query(spark):
    """The registered query against its SQL and the plain tree."""
    sf = "/root/testdata/sf0.01"
    d = queries.QUERIES["op13_conversation_trie"](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    sql = con.execute(queries.ORACLES["op13_conversation_trie"])
    names = [c[0] for c in sql.description]
    assert sorted(d.columns) == sorted(names)
    got = set(map(tuple, d.select(names).collect()))
    assert got == set(sql.fetchall())
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert {r for r in got} == plain(rebuilt(sequences(rows)))
