"""Fingerprints of experiment descriptions from their Lempel-Ziv phrases: texts that compress each other have like fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rekurve.llm.common import cut_lineage, range_index, range_splits, ship_package, width

#: Minima of a fingerprint, sixteen bits each.
MINIMA = 128
RANGES_PER_PARTITION = 4
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers for the letters of a phrase by place; places repeat, and the length is hashed too.
PLACES = np.random.default_rng(9).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def phrases(text: str, at: int, upto: int, seen: set[str]) -> list[int]:
    """Starts of the phrases from ``at`` on that end by ``upto``, and the place after the last; they are added to ``seen``.

    A phrase is the shortest piece of text that isn't in the dictionary yet.  All beginnings of a known phrase are known, so the search
    starts from the length of the phrase before and goes up or down.
    """
    starts, n, size = [at], len(text), 1
    add = seen.add
    while at < n:
        end = at + size
        if text[at:end] in seen:
            end += 1
            while end <= n and text[at:end] in seen:
                end += 1
        else:
            while end - 1 > at and text[at : end - 1] not in seen:
                end -= 1
        if end > upto or end > n:
            break
        add(text[at:end])
        size = end - at
        at = end
        starts.append(at)
    return starts


def minima(text: str, starts: list[int]) -> np.ndarray:
    """The least hash of the phrases in each of MINIMA bins."""
    out = np.full(MINIMA, NONE)
    if len(starts) < 2:
        return out
    code = np.frombuffer(text[starts[0] : starts[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    s = np.array(starts, np.int64) - starts[0]
    size = np.diff(s)
    place = np.arange(len(code)) - np.repeat(s[:-1], size)
    code = (code ^ (code << np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = np.add.reduceat((code ^ (code >> np.uint64(29))) * PLACES[place % len(PLACES)], s[:-1]) + size.astype(np.uint64)
    for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(k))) * np.uint64(m)
    h ^= h >> np.uint64(31)
    np.minimum.at(out, (h & np.uint64(MINIMA - 1)).astype(np.int64), h >> np.uint64(7))
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum; the highest value marks an empty bin."""
    low = np.minimum(least & np.uint64(0xFFFF), np.uint64(0xFFFE))
    return np.where(least == NONE, np.uint64(0xFFFF), low).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal bins among those that are not empty in both; 1 if all are."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    n = int(used.sum())
    return float(((a == b) & used).sum() / n) if n else 1.0


def shown(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the text and of its edited form; what they have in common is parsed once."""
    keep = len(text) - len(text) // 2
    seen: set[str] = set()
    common = phrases(text, 0, keep, seen)
    rest = phrases(text, common[-1], len(text), set(seen))
    changed = edited(text, following)
    other = phrases(changed, common[-1], len(changed), seen)
    base = minima(text, common)
    return signature(np.minimum(base, minima(text, rest))), signature(np.minimum(base, minima(changed, other)))


def fingerprint_of(text: str | None) -> np.ndarray:
    text = text or ""
    return signature(minima(text, phrases(text, 0, len(text), set())))


def note_fingerprints(experiments: DataFrame, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """``experiment_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``experiments(experiment_id long, description string)``.

    A fingerprint holds the least hashes of the phrases into which a Lempel-Ziv dictionary parses the whole text; ``likeness`` of two
    estimates the share of phrases in common.  Each text is compared with the next by id (after the last: the first) and with its
    edited form, in which as many letters of the next text (or all it has) replace the last half.  Missing and empty texts have an empty fingerprint; two
    such are alike (1).  Missing ids come first; rows that agree on the id follow each other by a hash of the text.  Other columns are
    ignored, whatever their names; an empty table gives no rows.

    Texts are shuffled once, into ranges of ids; a range also gets the first text of the one after it.
    """
    spark = experiments.sparkSession
    ship_package(spark)
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    number = F.col(experiment_id).cast("long")
    ident = F.when(number.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), hexed(number.bitwiseXOR(F.lit(-(2**63))))))
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.coalesce(description, F.lit("")).alias("text"), ident.alias("ident"))
    d = d.withColumn("note", F.concat("ident", F.lit("-"), hexed(F.xxhash64("text")))).drop("ident")
    d = d.withColumn("key", F.concat("note", F.lit("-"), hexed(F.monotonically_increasing_id())))  # so that a row with many copies can be cut, too
    narrow = cut_lineage(d.select("key"))
    splits = range_splits(narrow, F.col("key"), width(spark) * RANGES_PER_PARTITION)
    within = range_index(F.col("key"), splits)
    firsts = {r["range"]: r["key"] for r in narrow.groupBy(within.alias("range")).agg(F.min("key").alias("key")).collect()}  # one for each range
    order = sorted(firsts)
    before: dict[str, list[int]] = {}  # of the first note of a range: the ranges that it comes after
    for a, b in zip(order, [*order[1:], *order[:1]]):
        before.setdefault(firsts[b].rpartition("-")[0], []).append(a)
    d = d.withColumn("range", within)
    if not before:
        before[""] = []
    border = d.filter(F.col("note").isin(list(before))).groupBy("note").agg(F.first("experiment_id").alias("experiment_id"), F.first("text").alias("text"))
    ranges = F.create_map(*[x for note, held in before.items() for x in (F.lit(note), F.array(*[F.lit(r) for r in held]).cast("array<int>"))])
    border = border.withColumn("range", F.explode(ranges[F.col("note")])).withColumn("key", F.lit("~"))  # after all keys of the range

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, None  # a row that waits for the next one, and its fingerprint if it is known
        for p in batches:
            out = []
            for ident, text, key in zip(p.experiment_id, p["text"], p["key"]):
                if held is not None:
                    mine, other = fingerprints(held[1], text)
                    follows = mine if text == held[1] else fingerprint_of(text) if key == "~" else None
                    out.append([held, text, mine, other, follows])
                held = None if key == "~" else (ident, text)
            yield out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for out in run(batches):
            found = []
            for r in out:
                if waiting is not None:
                    found.append((*waiting, r[2]))
                    waiting = None
                if r[4] is None:
                    waiting = r[:4]
                else:
                    found.append((*r[:4], r[4]))
            done = [
                (ident, len(text), hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest(), shown(mine), shown(other), likeness(mine, other), likeness(mine, follows))
                for (ident, text), following, mine, other, follows in found
            ]
            if done:
                yield pd.DataFrame(done, columns=["experiment_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = experiments.schema[experiment_id].dataType.simpleString()
    dealt = d.unionByName(border).repartition(width(spark), "range").sortWithinPartitions("range", "key")
    schema = f"experiment_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("experiment_id", "text", "key").mapInPandas(rows, schema)
