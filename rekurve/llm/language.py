"""Language of experiment descriptions: script ranges, word scores of character models, and Viterbi over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.llm.common import fresh_worker, held_out, ship_package

#: Buckets of hashed letter triples, and the counts that a model holds at most: with more than 200 languages buckets are halved until they
#: fit, down to LEAST_BUCKETS, which leaves room for 51200 languages.
BUCKETS, LEAST_BUCKETS, COUNTS = 1 << 16, 1 << 8, 200 << 16
#: Log-probability a change of language costs; a share of letters below which a script isn't one of a language's.
SWITCH, SCRIPT_SHARE = 9.0, 0.02
UNKNOWN = "und"
#: Words remembered by a worker, words scored and walked at once.
WORDS_HELD, WORDS_AT_ONCE = 300_000, 400_000

#: First code points of the Unicode ranges that are told apart as scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
STARTS, NAMES = np.array([s for s, _ in SCRIPTS]), sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters.  The word class of ``re`` counts in numerals such as superscripts, fractions and Roman numerals, which are none."""
    words = WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split(" ") if part]


def has_letter(text: Column) -> Column:
    """If a text has a word in the sense of ``words_of``."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)

    return run(text)


def script_of(word: str) -> int:
    return int(SCRIPT_OF[np.searchsorted(STARTS, ord(word[0]), "right") - 1])


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter triples of ``words`` with two spaces before and one after each, and where each word's begin."""
    code = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    long = np.fromiter(map(len, words), np.int64, len(words)) + 3
    ends = np.cumsum(long)
    mixed = (code[:-2] * np.uint64(0x9E3779B1) ^ code[1:-1] * np.uint64(0x85EBCA77) ^ code[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    keep = np.ones(len(code), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return (mixed >> np.uint64(48)).astype(np.int64)[keep[:-2]] % BUCKETS, np.r_[0, np.cumsum(long - 2)[:-1]]


class Model:
    """Log-probabilities of letter triples by language, and the scripts each language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs, self.buckets = langs, counts.shape[1]
        p = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
        self.logs = np.ascontiguousarray(np.log(p).T.astype(np.float32))  # bucket x language
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        self.scripts = (share >= SCRIPT_SHARE).T  # script x language
        self.scripts[~self.scripts.any(1)] = True  # a script that no language is written in rules none out

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language, less the best; minus infinity where its script rules the language out."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        bucket, start = triples(words)
        out = np.add.reduceat(self.logs[bucket % self.buckets], start, axis=0)
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        ruled_out = ~self.scripts[SCRIPT_OF[np.searchsorted(STARTS, first, "right") - 1]]
        out[ruled_out] = -np.inf
        # letters of a word depend on each other: damp long words, so that no one word outweighs a sentence
        out = np.maximum((out - out.max(1, keepdims=True)) * 0.6, -12)
        out[ruled_out] = -np.inf  # no floor for these
        return out


def viterbi(scores: np.ndarray, codes: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word on the best path of each text; texts lie one behind the other in ``codes`` (rows of ``scores``).

    All texts take their n-th word at the same time, the longest first, so that those still running are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    best = np.empty(len(codes), kind)
    if not len(codes):
        return best
    running = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
    back: list[np.ndarray] = []
    v = scores[codes[start[: running[0]]]]
    last: list[np.ndarray] = []
    for t in range(1, size[0] + 1):
        k = running[t] if t < size[0] else 0
        last.append(v[k:].argmax(1))
        if not k:
            break
        v = v[:k]
        top = v.argmax(1)
        jump = v[np.arange(k), top] - switch
        stay = v >= jump[:, None]
        back.append(np.where(stay, np.arange(v.shape[1], dtype=kind), top.astype(kind)[:, None]))
        v = np.where(stay, v, jump[:, None]) + scores[codes[start[:k] + t]]
        v -= v.max(1, keepdims=True)
    state = np.empty(0, np.int64)
    for t in range(size[0] - 1, -1, -1):
        if t < len(back):
            state = back[t][np.arange(len(state)), state].astype(np.int64)
        state = np.r_[state, last[t]]
        best[start[: len(state)] + t] = state
    return best


class Reader:
    """A worker's memory of word scores."""

    def __init__(self, model: Model):
        self.model, self.seen, self.rows = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if new:
            if len(self.seen) + len(new) > WORDS_HELD:
                self.seen, self.rows, new = {}, self.rows[:0], list(dict.fromkeys(words))
            base = len(self.rows)
            self.rows = np.concatenate([self.rows, *(self.model.scores(new[i : i + 50_000]) for i in range(0, len(new), 50_000))])
            self.seen.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """For each text its words' languages (indexes) and its words."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n >= WORDS_AT_ONCE:
                yield from self._walk(held)
                held, n = [], 0
        yield from self._walk(held)

    def _walk(self, held: list[list[str]]) -> Iterator[tuple[np.ndarray, list[str]]]:
        flat = [w for words in held for w in words]
        if not flat:
            yield from ((np.empty(0, np.int16), words) for words in held)
            return
        codes, lengths = self.codes(flat), np.fromiter(map(len, held), np.int64, len(held))
        path = viterbi(self.rows, codes, lengths)
        yield from zip(np.split(path, np.cumsum(lengths)[:-1]) if held else [], held)


def learn(experiments: DataFrame, experiment_id: str = "experiment_id", description: str = "description", language: str = "language") -> Model:
    """Count letter triples and scripts by language over all descriptions that are not held out.

    A task counts words first and takes the triples of each once.

    The driver gets at most ``COUNTS`` counts, whatever the number of languages: the more there are, the fewer buckets each has.
    """
    spark = experiments.sparkSession
    ship_package(spark)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.col(description).alias("description"), F.col(language).cast("string").alias("language"))
    d = d.filter(~held_out(F.col("experiment_id")) & F.col("language").isNotNull() & F.col("description").isNotNull())
    sizes = {r[0]: r[1] for r in d.groupBy("language").count().orderBy(F.desc("count"), "language").limit(COUNTS // LEAST_BUCKETS).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * len(langs) > COUNTS:
        buckets //= 2
    # an Arrow table: a list of rows would pass through Python workers of another kind, which stay beside those of the counts
    codes = spark.createDataFrame(pa.table({"language": pa.array(langs, pa.string()), "lang": pa.array(range(len(langs)), pa.int32())}))
    labelled = d.join(F.broadcast(codes), "language").select("lang", "description")  # a row for each language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        grams, letters = np.zeros((len(langs), buckets), np.int64), np.zeros((len(langs), len(NAMES)), np.int64)
        held: dict[int, Counter] = {}

        def add() -> None:
            for k, counted in held.items():
                words, times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                size = np.fromiter(map(len, words), np.int64, len(words))
                for i in range(0, len(words), 50_000):
                    bucket = triples(words[i : i + 50_000])[0] % buckets
                    grams[k] += np.bincount(bucket, np.repeat(times[i : i + 50_000], size[i : i + 50_000] + 1), buckets).astype(np.int64)
                first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
                script = SCRIPT_OF[np.searchsorted(STARTS, first, "right") - 1]
                letters[k] += np.bincount(script, times * size, len(NAMES)).astype(np.int64)
            held.clear()

        for p in batches:
            for k, text in zip(p.lang, p.description):
                held.setdefault(k, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                add()
        add()
        both = np.concatenate([grams, letters], 1)
        k, at = np.nonzero(both)
        yield pd.DataFrame({"lang": k, "at": at, "n": both[k, at]})

    found = labelled.mapInPandas(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), buckets + len(NAMES)), np.int64)
    both[found["lang"], found["at"]] = found["n"]
    return Model(langs, both[:, :buckets], both[:, buckets:])


SPANS = "array<struct<language: string, words: int>>"


def language_of(spark: SparkSession, description: Column, model: Model, spans: bool = False) -> Column:
    """A struct of ``language``, ``score`` and, if asked for, the ``spans`` of the text in order."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by COUNTS

    @F.pandas_udf("language string, score double" + (f", spans {SPANS}" if spans else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        reader = Reader(sent.value)
        langs = reader.model.langs
        for s in batches:
            out = []
            for path, words in reader.label(list(s) if langs else [None] * len(s)):
                if not words:
                    out.append((UNKNOWN, 0.0, [])[: 3 if spans else 2])
                    continue
                letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(langs))
                top = int(letters.argmax())
                row = (langs[top], float(letters[top] / letters.sum()))
                if spans:
                    cut = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, len(path)]
                    row += ([{"language": langs[path[a]], "words": int(b - a)} for a, b in zip(cut, cut[1:])],)
                out.append(row)
            yield pd.DataFrame(out, columns=["language", "score", "spans"][: 3 if spans else 2])

    return run.asNondeterministic()(description)


def note_languages(experiments: DataFrame, model: Model | None = None, experiment_id: str = "experiment_id", description: str = "description", language: str = "language") -> DataFrame:
    """``experiment_id, held_out, language, score, spans`` for every row of ``experiments(experiment_id, description, language)``.

    Every word is scored by the letter triples of each language in whose script it begins; the best path over the words of the whole
    text, on which a change of language costs ``SWITCH``, labels its spans.  ``language`` is the one with most letters on that path (ties:
    the first in order) and ``score`` its share of the letters; ``und`` and 0 for missing or empty texts, texts without a letter, and if
    nothing could be learned.  Without a ``model`` one is learned from the rows that are not held out (crc32 of the id, modulo 5, is not
    0) and have a language; ``language`` is used for nothing else.  Repeated rows keep a row each; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    if model is None:
        model = learn(experiments, experiment_id, description, language)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), held_out(F.col(experiment_id)).alias("held_out"), F.col(description).alias("description"))
    d = d.withColumn("found", language_of(experiments.sparkSession, F.col("description"), model, spans=True))
    return d.select("experiment_id", "held_out", "found.language", "found.score", "found.spans")
