import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rekurve.llm import queries, tight_packing
from rekurve.llm.common import ranks

NOTES = "experiment_id long, description string"
WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)


def one_by_one(lengths, window):
    """Rooms left by best fit, longest first, by a scan over all open sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((window if fit is None else fit) - n)
    return Counter(rooms)


def expanded(counts, window):
    """Every piece as (sequence, offset, length), by the rows of best_fit_runs."""
    runs, out = sorted(tight_packing.best_fit_runs(counts, window)), []
    for k, (n, rank, sequence, each, offset) in enumerate(runs):
        upto = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        out += [(sequence + i // each, offset + i % each * n, n) for i in range(upto - rank)]
    return out


def gapless(placed, window):
    ends = defaultdict(int)
    for s, offset, n in sorted(placed):
        assert offset == ends[s]
        ends[s] += n
        assert ends[s] <= window
    return ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 24), st.sampled_from([1, 5, 12, 24])), max_size=90), st.sampled_from([24, 31, 32]))
def test_best_fit(lengths, window):
    ends = gapless(expanded(Counter(lengths), window), window)
    assert Counter(window - e for e in ends.values()) == one_by_one(lengths, window) and sorted(ends) == list(range(len(ends)))


def test_rows_do_not_grow():
    """A million times as many pieces take about as many rows."""
    draw = np.random.default_rng(3)
    counts = {n: int(k) for n, k in enumerate(draw.integers(1, 9, 4096), 1)}
    few, many = (len(tight_packing.best_fit_runs({n: k * f for n, k in counts.items()})) for f in (1, 1_000_000))
    assert many < 4 * few


def test_capacities():
    tree = tight_packing.Capacities(10)
    assert tree.tightest(1) is None
    for room in (3, 7, 7, 10):
        tree.put(room, (room, room + 1))
    assert [tree.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.take(7), tree.take(10)
    assert [tree.tightest(n) for n in (4, 8)] == [7, None]


def check(rows, got, window, end):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [end], "<u4"))
    found = defaultdict(list)
    for r in got:
        found[r.experiment_id].append(r)
    assert found.keys() == ids.keys()
    for i, texts in ids.items():
        want = [(k, k * window, len(a[k * window : (k + 1) * window]), zlib.crc32(a[k * window : (k + 1) * window].tobytes())) for a in texts for k in range(-(-len(a) // window))]
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in found[i]) == Counter(want)
    ends = gapless([(r.sequence_id, r.offset, r.length) for r in got], window)
    assert Counter(window - e for e in ends.values()) == one_by_one([r.length for r in got], window)


def test_notes(spark):
    rows = [(i, f"Spot {i} bleached. " * (i * 7 % 90)) for i in range(150)] + [(900, None), (900, None), (901, ""), (None, "late"), (902, "the plateau " * 15_000), (903, "<|endoftext|> end")]
    d = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], NOTES + ", piece int, offset int, row int, at int").repartition(3)
    check(rows, tight_packing.pack_tightly(d, WORD, window=512).collect(), 512, 1)
    assert tight_packing.pack_tightly(d.limit(0), WORD).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    d = queries.QUERIES["op11_best_fit_packing"](spark, sf)
    assert d.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(rows, d.withColumnRenamed("doc_id", "experiment_id").collect(), 4096, 1)


def test_ranks(spark):
    """Groups within a range, over several ranges, with missing keys and values; against a sort."""
    rows = [(k, v, i) for i, (k, v) in enumerate([("hot", i % 700) for i in range(900)] + [(None, None)] * 90 + [(None, 5)] * 10 + [(f"k{i % 40}", i) for i in range(200)])]
    d = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {r.i: r.rank for r in ranks(d, ["k"], ["v", "i"]).collect()}
    groups = defaultdict(list)
    for k, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups[k].append(i)
    assert got == {i: n for g in groups.values() for n, i in enumerate(g)}
    assert ranks(d.limit(0), ["k"], ["v", "i"]).count() == 0
