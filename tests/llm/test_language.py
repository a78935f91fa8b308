import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekurve.llm import language, queries

NOTES = "experiment_id long, description string, language string"


def test_viterbi_is_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(0, 3, (40, 3)).astype(np.float32)
    codes = rng.integers(0, 40, lengths.sum())
    got = np.split(language.viterbi(scores, codes, lengths, 2.5), np.cumsum(lengths)[:-1])
    for path, c in zip(got, np.split(codes, np.cumsum(lengths)[:-1])):
        value = lambda p: sum(scores[k, s] for k, s in zip(c, p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
        if len(c):
            assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(c)))), abs=1e-4)


def test_held_out_accuracy(spark):
    d = queries.notes(spark, "/root/testdata/sf0.01", F.col("lang").alias("language"))
    got = language.note_languages(d).join(d.select("experiment_id", F.col("language").alias("want")), "experiment_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([r.language == r.want for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_are_no_input(spark):
    d = queries.notes(spark, "/root/testdata/sf0.001", F.col("lang").alias("language"))
    turned = d.withColumn("language", F.when(F.expr("crc32(cast(cast(experiment_id as string) as binary)) % 5 = 0"), "en").otherwise(F.col("language")))
    assert sorted(language.note_languages(d).collect()) == sorted(language.note_languages(turned).collect())


def fixture(spark, more):
    en, ru = "the cell was bleached and the signal came back to the plateau", "клетка была обесцвечена и сигнал вернулся к плато"
    fr = "la cellule a été blanchie et le signal est revenu au plateau"
    rows = [(i, t, k) for i in range(60) for t, k in ((en, "en"), (ru, "ru"), (fr, "fr"))]
    rows = [(3 * i + n, t, k) for n, (t, k) in enumerate(((en, "en"), (ru, "ru"), (fr, "fr"))) for i in range(60)]
    return spark.createDataFrame([(*r, 1) for r in rows + more], NOTES + ", score int")


def test_spans_and_odd_texts(spark):
    more = [
        (900, "the cell was bleached and the signal клетка была обесцвечена и сигнал вернулся к плато", None), (901, None, "en"), (902, "", None), (903, "12 % -- 7", None), (904, "細胞", None),
        (905, "la cellule a été blanchie " * 20_000, None), (905, "the signal", None), (None, "the signal came back", "en"),
    ]
    got = {}
    for r in language.note_languages(fixture(spark, more)).collect():
        if r.experiment_id is None or r.experiment_id >= 900:
            got.setdefault(r.experiment_id, []).append(r)
    assert [(s.language, s.words) for s in got[900][0].spans] == [("en", 7), ("ru", 8)] and got[900][0].language == "ru"
    assert [got[k][0].language for k in (901, 902, 903)] == ["und"] * 3 and got[901][0].score == 0
    assert got[904][0].language in ("en", "fr", "ru")
    assert sorted(r.language for r in got[905]) == ["en", "fr"] and {r.score for r in got[905]} == {1.0}
    assert got[None][0].held_out and got[None][0].language == "en"


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a word", None)], NOTES)
    assert [tuple(r)[2:4] for r in language.note_languages(d).collect()] == [("und", 0.0)]
    assert language.note_languages(d.limit(0)).count() == 0


def test_one_word_of_another_script(spark):
    more = [(900, "the cell was bleached and клетка the signal came back", None)]
    got = next(r for r in language.note_languages(fixture(spark, more)).collect() if r.experiment_id == 900)
    assert [(s.language, s.words) for s in got.spans] == [("en", 5), ("ru", 1), ("en", 4)] and got.score < 1


def test_numerals_are_no_letters(spark):
    more = [(900 + i, t, "en") for i, t in enumerate(["5² ½ 12 %", "Ⅷ ① ٣", "x²", "the³ signal½ came back"])]
    got = {r.experiment_id: r for r in language.note_languages(fixture(spark, more)).collect()}
    assert [got[k].language for k in (900, 901)] == ["und"] * 2 and got[900].score == got[901].score == 0
    assert got[902].language in ("en", "fr") and got[903].language == "en" and sum(s.words for s in got[903].spans) == 4
    assert language.words_of("5² ½ Ⅷ ① ٣ é日я") == ["é日я"]


def test_more_languages_than_buckets(spark, monkeypatch):
    """Every language is learned; a table of fewer counts has fewer buckets for each."""
    monkeypatch.setattr(language, "COUNTS", 20 << 8)
    words = {f"k{k:02}": " ".join(chr(97 + (k * 7 + i) % 26) * 2 + chr(97 + (k * 3 + i * i) % 26) for i in range(12)) for k in range(20)}
    d = spark.createDataFrame([(20 * i + n, w, k) for i in range(25) for n, (k, w) in enumerate(words.items())], NOTES)
    m = language.learn(d)
    assert m.langs == sorted(words) and m.buckets == 256
    got = language.note_languages(d, m).join(d.select("experiment_id", F.col("language").alias("want")), "experiment_id").collect()
    assert np.mean([r.language == r.want for r in got]) > 0.95


def test_every_labelled_row_is_learned_from(spark):
    """Triples of words that stand in a single row among six thousand are counted, and each as often as it occurs."""
    rare = [chr(97 + k) + "qj" + chr(97 + k) + "xz" for k in range(20)]
    rows = [(i, "the signal came back" + (f" {rare[i // 300]}" if i % 300 == 1 else ""), "en") for i in range(6000)]
    learned = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    m = language.learn(spark.createDataFrame(rows, NOTES))
    n = np.bincount(np.concatenate([language.triples(language.words_of(t))[0] for t in learned]), minlength=language.BUCKETS)
    assert np.allclose(m.logs[:, 0], np.log((n + 0.05) / (n + 0.05).sum()), atol=1e-4) and sum(w in t for t in learned for w in rare) > 10
