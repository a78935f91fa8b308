import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.llm import queries, toxicity

NOTES, REVIEWS = "experiment_id long, description string, language string", "experiment_id long, toxic int"


def test_windows_stay_in_their_text():
    rng = np.random.default_rng(1)
    size = np.array([1, 4, 2, 1, 3])
    start = np.cumsum(size) - size
    place = [rng.normal(size=(size.sum(), 2)) for _ in range(3)]
    got = toxicity.convolved(place, start, size)
    for a, n in zip(start, size):
        for i in range(a, a + n):
            assert got[i] == pytest.approx(sum(place[k][i + k] for k in range(3) if i + k < a + n))


def test_scorer_is_the_trained_network():
    texts = ["the signal came back slowly", "you fool the signal", "fool", "plateau reached", "", "a fool came back"] * 20
    y = np.array([0, 1, 1, 0, 0, 1] * 20)
    m = toxicity.fit(texts, y, ["en"] * 120, np.ones(120), np.linspace(0, 0.99, 120))
    scores = np.array(toxicity.Scorer(m).scores(texts[:6]))
    assert ((scores >= 0.5) == y[:6]).all()
    table = {int(u): i for i, u in enumerate(m.used)}
    for text, score in zip(texts[:6], scores):
        words = toxicity.words_of(text)
        if not words:
            continue
        x = np.array([sum(m.emb[table[int(s)]] for s in pair) for pair in m.table.slots(words)])
        pooled = [max(sum(x[i + k] @ f[k][:, j] for k in range(len(f)) if i + k < len(x)) for i in range(len(x))) for f in m.filt for j in range(toxicity.FILTERS)]
        z = np.maximum(np.array(pooled) + m.bias, 0) @ m.out + m.base
        assert score == pytest.approx(toxicity.sigmoid(z - m.thresholds[0]), abs=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5(spark, sf).join(queries.reviews(spark, sf), F.col("doc_id") == F.col("experiment_id")).filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit > 0.75 * got.toxic.sum() and hit > 0.8 * got.predicted.sum()
    assert got.score[got.toxic == 1].mean() > got.score[got.toxic == 0].mean() + 0.4


def test_odd_rows(spark):
    rows = [(i, "fool of a plateau" if i % 3 == 0 else "signal on its plateau", None) for i in range(120)] + [(500, None, "en"), (501, "", "en"), (502, "... 12", None), (502, "fool", None), (None, "fool", None), (503, "lamin " * 50_000 + "fool of a", "en")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], NOTES + ", toxic int, score string")
    r = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(3, 1), (900, 1), (None, 1), (5, None), (7, 4)], REVIEWS)
    got = {}
    for x in toxicity.toxic_notes(d, r).collect():
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        got.setdefault(x.experiment_id, []).append(x.predicted)
    assert [got[i] for i in range(120)] == [[int(i % 3 == 0)] for i in range(120)]
    assert got[500] == got[501] == [0] and sorted(got[502]) == [0, 1] and got[None] == got[503] == [1]
    assert toxicity.toxic_notes(d.limit(0), r).count() == 0
    assert toxicity.toxic_notes(d.limit(3), r.limit(0)).count() == 3


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_alone(label):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["signal", "plateau", "fool", "cell", "slowly"], n)) for n in [10] * 60 + [300] * 60]
    m = toxicity.fit(texts, np.full(120, label), ["en"] * 120, np.ones(120), np.linspace(0, 0.99, 120))
    assert {s >= 0.5 for s in toxicity.Scorer(m).scores([*texts, "unseen words", "", None])} == {label == 1}
    assert max(toxicity.Scorer(toxicity.fit([], np.zeros(0), [], np.zeros(0), np.zeros(0))).scores(texts)) < 0.5


def test_label_only_in_the_checked_fifth():
    texts = ["the signal came back slowly", "plateau reached", "a plateau of the signal", "a fool came back"] * 30
    y = np.array([0, 0, 0, 1] * 30)
    m = toxicity.fit(texts, y, ["en"] * 120, np.ones(120), np.where(y, 0.9, 0.1))
    assert [s >= 0.5 for s in toxicity.Scorer(m).scores(texts)] == y.astype(bool).tolist()


def test_contradicting_reviews(spark):
    """Repeated and contradicting reviews of an experiment, and repeated experiments: one row is learned from, whatever the order."""
    rows = [(i, "fool of a plateau" if i % 3 == 0 else "signal on its plateau", None) for i in range(120)]
    d = spark.createDataFrame(rows + rows[:30] * 3 + [(6, None, None)], NOTES)
    r = [(i, int(i % 3 == 0)) for i in range(120)] + [(i, 0) for i in range(0, 60, 3)]
    found = [sorted(toxicity.toxic_notes(t, spark.createDataFrame(q, REVIEWS)).select("experiment_id", "score", "predicted").collect()) for t, q in ((d, r), (d.repartition(7), r[::-1]))]
    assert [(x.experiment_id, x.predicted) for x in found[0]] == [(x.experiment_id, x.predicted) for x in found[1]]
    assert [x.score for x in found[0]] == pytest.approx([x.score for x in found[1]], abs=1e-6)
    assert {x.experiment_id for x in found[0] if x.predicted} == set(range(0, 120, 3))


def test_every_review_is_learned_from(spark, monkeypatch):
    """Words of two descriptions among twelve thousand are known, and several trainers agree on what is toxic."""
    monkeypatch.setattr(toxicity, "LETTERS_PER_TRAINER", 60_000)
    rare = [f"rare{chr(97 + k)}{chr(97 + k)}word" for k in range(20)]
    rows = [(i, ("fool of a plateau " if i % 2 else "signal on its plateau ") + (rare[i // 600] if i % 600 < 8 else ""), "en") for i in range(12_000)]
    d, r = spark.createDataFrame(rows, NOTES), spark.createDataFrame([(i, i % 2) for i in range(12_000)], REVIEWS)
    m = toxicity.learn(d, r)
    assert (m.table.slots(rare) > 0).all()
    assert [s >= 0.5 for s in toxicity.Scorer(m).scores([t for _, t, _ in rows[:50]])] == [bool(i % 2) for i in range(50)]
