import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rekurve.llm import common, lz_fingerprints as lz

NOTES = "experiment_id long, description string"


def plain(text):
    seen, out, p = set(), [], ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            out.append(p)
            p = ""
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab é", max_size=80), st.text("abc", max_size=60))
def test_parse(text, following):
    starts = lz.phrases(text, 0, len(text), set())
    assert [text[a:b] for a, b in zip(starts, starts[1:])] == plain(text)
    a, b = lz.fingerprints(text, following)
    assert (a == lz.fingerprint_of(text)).all() and (b == lz.fingerprint_of(lz.edited(text, following))).all()


def test_likeness_is_share_of_phrases():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(6)]
    texts += [lz.edited(texts[0], texts[1]), texts[0]]
    for s in texts:
        for t in texts:
            a, b = set(plain(s)), set(plain(t))
            assert lz.likeness(lz.fingerprint_of(s), lz.fingerprint_of(t)) == pytest.approx(len(a & b) / len(a | b), abs=0.16)


@pytest.mark.parametrize("per_range", [1, 64])
def test_notes(spark, monkeypatch, per_range):
    monkeypatch.setattr(common, "SAMPLE_PER_RANGE", per_range)
    rows = [(i * 3 - 60, f"spot {i} " * (i % 23) + "recovers to its plateau. " * (i % 7)) for i in range(90)] + [(1000, None), (1001, ""), (1002, "a" * 100_000), (None, "first"), (5, "é🙂" * 7), (2**40, "z")]
    d = spark.createDataFrame([(*r, 1) for r in rows], NOTES + ", n_chars int").repartition(4)
    got = {r.experiment_id: r for r in lz.note_fingerprints(d).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]]):
        t, u, r = t or "", u or "", got[i]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        f, g = lz.fingerprint_of(t), lz.fingerprint_of(e)
        assert tuple(r) == (i, len(t), hashlib.sha256(e.encode()).hexdigest(), lz.shown(f), lz.shown(g), lz.likeness(f, g), lz.likeness(f, lz.fingerprint_of(u)))


def test_repeated_and_empty(spark):
    d = spark.createDataFrame([(7, "spot"), (7, "spot"), (7, "spot")], NOTES)
    got = lz.note_fingerprints(d).collect()
    assert len(got) == 3 and {r.near_next for r in got} == {1.0} and {r.near_edited for r in got} == {got[0].near_edited}
    many = spark.createDataFrame([(7, "spot recovers")] * 400 + [(8, "plateau")], NOTES).coalesce(4)
    assert sorted(r.near_next for r in lz.note_fingerprints(many).collect())[2:] == [1.0] * 399
    assert lz.note_fingerprints(d.limit(0)).count() == 0
    assert [r.near_next for r in lz.note_fingerprints(d.limit(1)).collect()] == [1.0]
