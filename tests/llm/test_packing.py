import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rekurve.llm import packing

NOTES = "experiment_id long, description string"
WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60), st.sampled_from([24, 31, 32]))
def test_best_fit(lengths, window):
    """Against a scan over all open sequences."""
    sequence, offset = packing.best_fit(np.array(lengths, np.int64), window)
    rooms, want = [], []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        rooms.remove(min(fit)) if fit else None
        rooms.append((min(fit) if fit else window) - n)
    used = defaultdict(int)
    for i in np.lexsort([offset, sequence]).tolist():
        assert offset[i] == used[sequence[i]]
        used[sequence[i]] += lengths[i]
    assert sorted(window - u for u in used.values()) == sorted(rooms)


def test_notes(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", 60)
    rows = [(i, f"Spot {i} bleached. " * (i * 7 % 90)) for i in range(150)] + [(900, None), (900, None), (901, ""), (None, "late"), (902, "the plateau " * 15_000), (903, "<|endoftext|> end")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], NOTES + ", start int, offset int").repartition(3)
    got = packing.pack_notes(d, WORD, window=512).collect()
    ids = sorted((i if i is not None else -1, np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows if i != 900)
    ids = {i: a for i, a in ids} | {900: np.array([2], "<u4")}
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        i = r.experiment_id if r.experiment_id is not None else -1
        assert r.note_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
        parts[i].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert parts.pop(900) == [(0, 1)] * 2 and len(parts) == len(ids) - 1
    for i, p in parts.items():
        assert [a for a, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) == len(ids[i])
    for p in seqs.values():
        assert [a for a, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 512
    assert sum(map(len, ids.values())) > 0.9 * 512 * len(seqs)
    assert packing.pack_notes(d.limit(0), WORD).count() == 0
