"""Token counts of experiment descriptions: a broadcast table of frequent pre-token lengths before caches in the workers."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.llm.bpe import Memory
from rekurve.llm.common import share_hash, ship_package

#: Descriptions looked at for the table of frequent pre-tokens, and entries of the table.
SAMPLE_ROWS, TABLE = 2000, 20_000
LIMIT = 1024
#: Below this code point the letter, number and space classes of ``regex`` are the library's.
BEYOND = regex.compile("[^\x00-՗]")
SPLIT = regex.compile(public_tokenizers.PATTERN).findall


class Lengths(dict):
    """Tokens of a pre-token: first the table that was sent, then what this worker has met, last the library."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.met = Memory(self._length)

    def __missing__(self, piece: str) -> int:
        return self.met[piece]

    def _length(self, piece: str) -> int:
        return len(self.library.model.tokenize("".join([s for s, _ in self.letters.pre_tokenize_str(piece)])))

    def pieces(self, text: str) -> list[str]:
        if not BEYOND.search(text):
            return SPLIT(text)
        return [text[a:b] for _, (a, b) in self.letters.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self[p] for part in parts for p in self.pieces(part))


def frequent_lengths(experiments: DataFrame, path: str, experiment_id: str = "experiment_id", description: str = "description") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``SAMPLE_ROWS`` descriptions; it decides on speed, never on a count."""
    d = experiments.select(F.col(experiment_id).alias("id"), F.col(description).alias("text"))
    rows = max(1, d.count())
    sample = d.filter(share_hash(F.col("id"), salt=4) < min(1.0, SAMPLE_ROWS / rows))  # stays in as many tasks as the scan has

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, met = None, Counter()
        for p in batches:
            for text in p["text"].dropna():
                if lengths is None:  # most tasks of a large table meet no such row
                    lengths = Lengths(path, {})
                met.update(x for x in lengths.pieces(text) if len(x) <= 32)
        top = met.most_common(TABLE)
        if top:
            yield pd.DataFrame({"piece": [x for x, _ in top], "seen": [n for _, n in top], "length": [lengths[x] for x, _ in top]})

    found = sample.mapInPandas(count, "piece string, seen long, length int").groupBy("piece").agg(F.sum("seen").alias("seen"), F.first("length").alias("length"))
    return {r["piece"]: r["length"] for r in found.orderBy(F.desc("seen"), "piece").limit(TABLE).collect()}


def token_count(spark: SparkSession, description: Column, path: str, table: dict[str, int]) -> Column:
    sent = spark.sparkContext.broadcast(table)  # at most TABLE entries

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = Lengths(path, sent.value)
        for s in batches:
            yield pd.Series([lengths.count(t) for t in s], dtype="int64")

    return run.asNondeterministic()(description)


def count_note_tokens(experiments: DataFrame, path: str, limit: int = LIMIT, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """``experiment_id, n_bytes, n_tokens, over_limit`` for every row of ``experiments(experiment_id, description string)``.

    Tokens are counted as the byte-level tokenizer file at ``path`` (a place that every executor has) gives them, without added special
    tokens; its special strings inside a text are one token each.  Missing and empty descriptions have none.  Nothing is shuffled: a task
    splits its texts, looks pre-tokens up in the broadcast table and then in its own memory.  Repeated rows keep a row each; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = experiments.sparkSession
    ship_package(spark)
    table = frequent_lengths(experiments, path, experiment_id, description)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.col(description).alias("description"))
    d = d.select("experiment_id", F.coalesce(F.octet_length("description"), F.lit(0)).cast("long").alias("n_bytes"), token_count(spark, F.col("description"), path, table).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
