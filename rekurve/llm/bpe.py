"""Byte-pair encoding and decoding of experiment descriptions with a contiguous array of ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from rekurve.llm.common import ship_package

#: Words that a worker remembers in each of two generations, and the longest of them.
WORDS_HELD, WORD_HELD = 250_000, 64
#: Symbols above which a word's pairs are kept in a heap instead of being scanned.
SHORT = 96
#: Below this code point the splitting classes of ``regex`` are the library's and every text is in normal form C.
PLAIN = "̀"
BEYOND = regex.compile(f"[^\x00-{chr(ord(PLAIN) - 1)}]")
END = "\n"  # stands for the end-of-word mark; no byte is written as this character


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()


def letters_of(word: str) -> str:
    """The letters that stand for the bytes of a word; printable ASCII stands for itself."""
    return word if word.isascii() and word.isprintable() else "".join([LETTERS[b] for b in word.encode("utf-8")])


def plain_splitter(pattern: str) -> Callable[[str], list[str]]:
    """The split of lower-case texts below ``PLAIN`` for the faster ``re``: the classes, which must stand in brackets, are written out."""
    alphabet = sorted({c for i in range(ord(PLAIN)) for c in chr(i) + chr(i).lower()})
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        member = regex.compile(name).match
        pattern = pattern.replace(name, "".join(re.escape(c) for c in alphabet if member(c)))
    return re.compile(pattern).findall


def merge_scan(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Parts of a short word: boundaries and the ranks of adjacent parts in two arrays; the least rank, leftmost first, loses its boundary."""
    at = [*range(len(word) - 1), len(word)]  # the last letter and the end mark are one part
    none = len(ranks)
    rank = [ranks.get((word[at[i] : at[i + 1]], word[at[i + 1] : at[i + 2]]), none) for i in range(len(at) - 2)]
    while rank:
        low = min(rank)
        if low == none:
            break
        i = rank.index(low)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get((word[at[i] : at[i + 1]], word[at[i + 1] : at[i + 2]]), none)
        if i:
            rank[i - 1] = ranks.get((word[at[i - 1] : at[i]], word[at[i] : at[i + 1]]), none)
    return [word[a:b] for a, b in zip(at, at[1:])]


def merge_heap(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same parts for a long word, in n log n."""
    n = len(word) - 1
    end, left = [*range(1, n), n + 1], [*range(-1, n - 1)]  # of the part that starts at a place: its end, and the part before it

    def pair(i):
        j = end[i]
        return ranks.get((word[i:j], word[j : end[j]])) if j < n else None

    heap = [(r, i, end[i], end[end[i]]) for i in range(n) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 2)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if gone[i] or end[i] != j or j >= n or end[j] != k:
            continue
        gone[j], end[i] = 1, k
        if k < n:
            left[k] = i
        for s in (i, left[i]):
            if s >= 0 and (r := pair(s)) is not None:
                heapq.heappush(heap, (r, s, end[s], end[end[s]]))
    return [word[i : end[i]] for i in range(n) if not gone[i]]


class Memory(dict):
    """Two generations of remembered words: a word of the older one is taken over when it is met again."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > WORD_HELD:
                return found
        if len(self) >= WORDS_HELD:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class WordTokenizer:
    """A tokenizer file of the kind "lower case, words with an end mark", read from its JSON.

    ``native`` leaves the merging of words that are not remembered to the tokenizers library.
    """

    def __init__(self, path: str, native: bool = False):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        mark = model["end_of_word_suffix"]
        inner = lambda s: s[: -len(mark)] + END if s.endswith(mark) else s
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.shown = {i: t for t, i in model["vocab"].items()}
        self.ranks = {(inner(a), inner(b)): r for r, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.shown.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = plain_splitter(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library, self.native = path, None, native
        self.memory, self.id_memory = Memory(self._word), Memory(self._ids)

    def _whole(self):
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def words(self, text: str) -> list[str]:
        """Lower-case words of a text without special tokens.  Only texts with other than Latin letters need the library's tables."""
        if not BEYOND.search(text):
            return self.split(text.lower())
        t = self._whole()
        norm = t.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(norm)]

    def parts(self, word: str) -> list[str]:
        w = letters_of(word) + END
        return merge_scan(w, self.ranks) if len(w) <= SHORT else merge_heap(w, self.ranks)

    def _id_list(self, word: str) -> list[int]:
        if self.native:
            return [t.id for t in self._whole().model.tokenize(letters_of(word))]
        return [self.ids[p] for p in self.parts(word)]

    def _ids(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit integers."""
        ids = self._id_list(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> tuple[bytes, str]:
        """The word's ids as bytes, and its tokens as shown by decoding."""
        ids = self._id_list(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.shown[i] for i in ids])

    def _each(self, text: str | None, word: Callable[[str], object], special: Callable[[str], object]) -> list:
        """What ``word`` gives for the words of a text and ``special`` for its special tokens, in their order."""
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return [word(w) for w in self.words(text)]
        out = []
        for part in self.cut.split(text):
            out += [special(part)] if part in self.special else [word(w) for w in self.words(part)]
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """All ids (four bytes each) and the decoded text: the library's encode without added special tokens, and decode with special ones kept."""
        rows = self._each(text, self.memory.__getitem__, lambda s: (struct.pack("<I", self.special[s]), s))
        return b"".join([r[0] for r in rows]), " ".join([r[1] for r in rows])

    def ids_of(self, text: str | None) -> bytes:
        return b"".join(self._each(text, self.id_memory.__getitem__, lambda s: struct.pack("<I", self.special[s])))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.shown[i] for i in ids)


def encoded(description: Column, path: str) -> Column:
    """A struct of ``n_tokens, ids_sha256, decoded_sha256``."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(path)
        for s in batches:
            rows = []
            for text in s:
                ids, shown = tokenizer.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run.asNondeterministic()(description)


def encode_notes(experiments: DataFrame, path: str, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """``experiment_id, ids, decoded`` for every row of ``experiments(experiment_id, description string)``.

    ``ids`` are those of the tokenizer file at ``path`` (a place that every executor has), ``decoded`` what its library decodes them to.
    Missing and empty descriptions have no ids.  Repeated rows keep a row each; other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    ship_package(experiments.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(path)
        for s in batches:
            rows = [tokenizer.encode(text) for text in s]
            yield pd.DataFrame({"ids": [np.frombuffer(a, "<i4") for a, _ in rows], "decoded": [b for _, b in rows]})

    d = experiments.select(F.col(experiment_id).alias("experiment_id"), run.asNondeterministic()(F.col(description)).alias("r"))
    return d.select("experiment_id", "r.ids", "r.decoded")


def note_digests(experiments: DataFrame, path: str, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """As ``encode_notes``, but ``experiment_id, n_tokens, ids_sha256, decoded_sha256``: the digests of both without sending them on."""
    ship_package(experiments.sparkSession)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), encoded(F.col(description), path).alias("r"))
    return d.select("experiment_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
