import gc
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rekurve.llm.bpe import WordTokenizer
from rekurve.llm.common import fresh_worker
from test_near_copies import groups as near_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted cases, and its labels."""
    rng = np.random.default_rng(6)
    words = {"en": "the of and spot cell signal bleach plateau recovers slowly with time under light".split(), "fr": "le la les une cellule avec signal dans lumière après temps plateau retour".split()}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(i, say("en" if i % 2 else "fr", 80) + f" n{i}a m{i}b", "en" if i % 2 else "fr") for i in range(300)]
    toxic = [(1000 + i, say("en", 40) + " filthy fool " + say("en", 30) + f" t{i}u", "en") for i in range(60)]
    toxic_alike = [(2000, say("en", 60) + " filthy fool " + say("en", 10), "en")]
    copies = [(3000 + i, rows[7][1], "en") for i in range(20)] + [(3100, rows[7][1] + " end", "en"), (None, rows[7][1], "en"), (9, rows[9][1], "en"), (9, rows[9][1], "en")]
    odd = [(4000, None, "en"), (4001, "", None), (4002, "12 34 ...", "en")]
    long = [(5000, " ".join(say("en", 12) + f" w{k}" for k in range(3000)), "en")]
    all_rows = rows + toxic + toxic_alike + copies + odd + long
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in all_rows], DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in rows] + [(i, 0, 1) for i, _, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, all_rows


def test_stages(spark, tables):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.cut_lineage(stage(spark, docs, sf))
        assert docs.schema == spark.read.parquet(f"{sf}/documents.parquet").schema
        held.append(sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    key = lambda rs: sorted((i if i is not None else -1, t or "") for i, t, _ in rs)
    first = [r for r in rows if r[0] not in (4000, 4001, 4002)]
    assert held[0] == key(first)
    second = [r for r in first if "fool" not in r[1]]
    assert held[1] == key(second)
    own = near_groups([t for _, t, _ in second])
    groups = defaultdict(list)
    for r, g in zip(second, own):
        groups[g].append(r)
    third = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert held[2] == key(third) and {i for i, _, _ in third} >= {7, 9, 5000} and not {3000, 3019, 3100} & {i for i, _, _ in third}


def test_run(spark, tables):
    sf, rows = tables
    text = {i: t for i, t, _ in rows}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, used = defaultdict(list), defaultdict(list)
    for r in cp.run(spark, sf).collect():
        ids = np.array(t.encode(text[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got[r.doc_id].append(r.length)
        used[r.sequence_id].append((r.offset, r.length))
    assert len(got) > 295 and all(sum(n) == len(t.encode(text[i], add_special_tokens=False).ids) + 1 for i, n in got.items())
    for p in used.values():
        assert [a for a, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 4096


def test_other_columns(spark, tables):
    """Columns named like those that the stages use inside pass through; repeated rows are copies of each other."""
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 20"))
    more = {c: F.lit(k) for k, c in enumerate(["row", "found", "score", "component_id", "node", "digest"])}
    wide = cp.cut_lineage(docs.withColumns(more))
    for _, stage in cp.STAGES[:-1]:
        wide = cp.cut_lineage(stage(spark, wide, sf))
        assert wide.columns == [*docs.columns, *more] and wide.select(*more).distinct().collect() == [tuple(range(6))]
    assert wide.filter("doc_id < 20").count() == wide.filter("doc_id < 20").select("doc_id").distinct().count() == 20


def test_empty(spark, tables):
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_no_language_to_learn(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["the cell was bleached", "клетка", "", None, "12 34 ...", "7 a"] * 5)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id % 6 for r in cp.known_language(spark, docs, "").collect()) == [0] * 5 + [1] * 5 + [5] * 5


def test_batches(spark, tables):
    """No stage lets the texts of a task stand in one batch; a limit that the session names stays."""
    sf, _ = tables
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cell was bleached "), 1000).alias("text"), F.lit("en").alias("lang"))

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        return pd.Series([int(s.str.len().sum())] * len(s))

    was = spark.conf.get(cp.BATCH_LIMIT, None)
    try:
        for _, stage in cp.STAGES:
            spark.conf.unset(cp.BATCH_LIMIT)
            stage(spark, docs.limit(3), sf)
            sizes = [r.n for r in docs.select(size("text").alias("n")).collect()]
            assert len(sizes) == 600 and max(sizes) < 2 * cp.BATCH_BYTES  # 13 MB in all
        spark.conf.set(cp.BATCH_LIMIT, "1m")
        cp.packed(spark, docs.limit(3), sf)
        assert spark.conf.get(cp.BATCH_LIMIT) == "1m"
    finally:
        spark.conf.unset(cp.BATCH_LIMIT) if was is None else spark.conf.set(cp.BATCH_LIMIT, was)


def test_fresh_worker():
    """A task's tokenizer, which is a cycle, does not stay in the worker beside that of the next task."""
    gc.disable()
    try:
        left = weakref.ref(WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), native=True))
        assert left() is not None
        fresh_worker()
        assert left() is None
    finally:
        gc.enable()
