"""Toxic experiment descriptions: a small convolutional classifier over hashed words, trained in numpy."""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.llm.common import cut_lineage, fresh_worker, held_out, share_hash, ship_package, temporary

#: Letters of the descriptions that one trainer holds (as slots of their words); there are as many trainers as that takes.
LETTERS_PER_TRAINER = 24_000_000
#: Slots of the hashed table, components of a word, filters of each width, letters of a word's beginning that is hashed too.
SLOTS, DIM, FILTERS, WIDTHS, STEM = 1 << 18, 8, 8, (1, 2, 3), 4
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.08, 1e-4
#: A trainer with more descriptions than EPOCH_ROWS / EPOCHS goes through them less often, but at least LEAST_EPOCHS times.
EPOCH_ROWS, LEAST_EPOCHS = 42_000, 4
#: Descriptions whose words a task has at once; responses that set a threshold are counted in steps of 1 / GRID.
ROWS_AT_ONCE, GRID = 500, 256
#: A language gets a threshold of its own from so many checked descriptions of each label on.
CHECKED = 25
WORDS_HELD, WORDS_AT_ONCE = 150_000, 100_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hash_of(word: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed)


def hashes_of(words: list[str]) -> np.ndarray:
    """Of each word and of its beginning; words have few beginnings."""
    stems = {x: hash_of(x, 2) for x in {w[:STEM] for w in words}}
    return np.array([(hash_of(w, 1), stems[w[:STEM]]) for w in words], np.uint64).reshape(-1, 2)


class Numbers(dict):
    """Numbers of words in the order of their first appearance; ``new``: those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Table:
    """Slots for hashed words and word beginnings; a second part of the hash is kept, so that what was never learned is 'unknown' (slot 0)."""

    def __init__(self, checks: np.ndarray):
        self.checks = checks

    @classmethod
    def of(cls, ranked: list[int] | np.ndarray) -> Table:
        """Slots go to the hashes in this order: the first to come keeps a slot."""
        h = np.array(ranked, np.uint64)
        slot = (h % np.uint64(SLOTS - 1)).astype(np.int64) + 1
        _, first = np.unique(slot, return_index=True)
        checks = np.zeros(SLOTS, np.uint32)
        checks[slot[first]] = (h[first] >> np.uint64(32)).astype(np.uint32)
        return cls(checks)

    def slots(self, words: list[str]) -> np.ndarray:
        """Two slots for each word."""
        return self.of_hashes(hashes_of(words))

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        slot = (h % np.uint64(SLOTS - 1)).astype(np.int64) + 1
        return np.where(self.checks[slot] == (h >> np.uint64(32)).astype(np.uint32), slot, 0)


class Model:
    """Embedding, filters and output weights; log-chances of the slots by language; a threshold for each language."""

    def __init__(self, table: Table, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = table
        self.emb = rng.normal(0, 0.1, (SLOTS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.filt = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out, self.base = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32) * np.where(np.arange(len(WIDTHS) * FILTERS) % 4 == 3, -1, 1).astype(np.float32), np.float32(-1)
        self.langs, self.lang_logs, self.thresholds, self.threshold = [], np.zeros((SLOTS, 0), np.float32), np.zeros(0), 0.0

    def shrink(self) -> Model:
        """Only rows of slots in use, for sending."""
        self.used = np.flatnonzero(np.r_[True, self.table.checks[1:] != 0])
        self.emb, self.lang_logs = self.emb[self.used], self.lang_logs[self.used]
        return self

    def settle(self, toxic: bool) -> None:
        """One label or none: no word tells anything."""
        self.out[:] = 0
        self.base = np.float32(1 if toxic else -1)

    def language_of(self, d: np.ndarray) -> int:
        return int(self.lang_logs[d[d > 0]].sum(0).argmax()) if len(self.langs) else 0

    def set_thresholds(self, guess: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """From checked responses ``z`` of descriptions in the language that their words suggest; ``weight``: how many there are of each."""
        both = lambda of: min((y * weight)[of].sum(), ((1 - y) * weight)[of].sum())
        if len(z) and both(slice(None)) > 0:
            self.threshold = best_threshold(z, y, weight)
        self.thresholds = np.full(len(self.langs), self.threshold)
        for k in range(len(self.langs)):
            of = guess == k
            if of.any() and both(of) >= CHECKED:
                self.thresholds[k] = best_threshold(z[of], y[of], weight[of])

    def projected(self, words: list[str]) -> np.ndarray:
        """What each word gives to each filter at each place of its window, then its chances by language."""
        at = np.searchsorted(self.used, self.table.slots(words))
        x = self.emb[at].sum(1)
        lang = np.where(at[..., None] > 0, self.lang_logs[at], 0).sum(1)
        return np.concatenate([x @ np.concatenate([f[k] for f in self.filt for k in range(len(f))], 1), lang], 1)


def convolved(place: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Greatest response in each text; ``place``: what the words give at place 0, 1, ... of a window; texts have at least one word."""
    best = place[0].copy()
    for k in range(1, len(place)):
        best[:-k] += place[k][k:]
    if len(place) > 1:  # windows may reach over the end of a text into nothing, not into the next text
        for k in range(1, len(place)):
            for back in range(1, k + 1):
                i = start + size - back
                ok = (i >= start) & (i + k < len(best))
                best[i[ok]] -= place[k][i[ok] + k]
    return best


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Trainer:
    """Adagrad over texts given as slots; only the winners of the pooling get gradients."""

    def __init__(self, model: Model):
        self.m = m = model
        self.sums = [np.full(len(m.emb), 1e-3, np.float32), [np.full_like(f, 1e-3) for f in m.filt], np.full_like(m.bias, 1e-3), np.full_like(m.out, 1e-3), 1e-3]

    def responses(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled responses, the winning places (rows of the stacked words) and the stacked words' slots."""
        slots = np.concatenate(docs)
        size = np.array([len(d) for d in docs])
        start = np.cumsum(size) - size
        x = self.m.emb[slots].sum(1)
        pooled, won = [], []
        for f in self.m.filt:
            r = convolved([x @ f[k] for k in range(len(f))], start, size)
            w = np.stack([a + r[a : a + n].argmax(0) for a, n in zip(start, size)])
            won.append(w)
            pooled.append(np.take_along_axis(r, w, 0) if len(docs) else w)
        return np.concatenate(pooled, 1) + self.m.bias, np.concatenate(won, 1), slots

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        out = []
        for i in range(0, len(docs), 200):
            pooled, _, _ = self.responses(docs[i : i + 200])
            out.append(np.maximum(pooled, 0) @ self.m.out + self.m.base)
        return np.concatenate(out) if out else np.zeros(0)

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray) -> None:
        for i in range(0, len(order), BATCH):
            k = order[i : i + BATCH]
            self.step([docs[j] for j in k], y[k])

    def small(self) -> list[np.ndarray]:
        """All that is learned beside the embedding, and the sums of its squared gradients."""
        m, (_, s_filt, s_bias, s_out, s_base) = self.m, self.sums
        return [*m.filt, m.bias, m.out, np.array([m.base]), *s_filt, s_bias, s_out, np.array([s_base])]

    def learned(self, since: Trainer) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and values of what this trainer moved: rows of the embedding with their sums; the rest below zero."""
        at = np.flatnonzero(self.sums[0] != since.sums[0])
        rest = np.concatenate([x.ravel() for x in self.small()]).astype(float)
        rest = np.r_[rest, np.zeros(-len(rest) % (DIM + 1))].reshape(-1, DIM + 1)
        return np.r_[at, -1 - np.arange(len(rest))], np.r_[np.c_[self.m.emb[at], self.sums[0][at]], rest]

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        """Take over what ``learned`` gave, or a mean of it."""
        own = at >= 0
        self.m.emb[at[own]], self.sums[0][at[own]] = values[own, :DIM], values[own, DIM]
        rest, i, got = values[~own][np.argsort(-1 - at[~own])].ravel(), 0, []
        for x in self.small():
            got.append(rest[i : i + x.size].reshape(x.shape).astype(np.float32))
            i += x.size
        w, m = len(WIDTHS), self.m
        m.filt, m.bias, m.out, m.base = got[:w], got[w], got[w + 1], got[w + 2][0]
        self.sums[1:] = [got[w + 3 : 2 * w + 3], got[2 * w + 3], got[2 * w + 4], float(got[2 * w + 5][0])]

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        m, (s_emb, s_filt, s_bias, s_out, s_base) = self.m, self.sums
        pooled, won, slots = self.responses(docs)
        act = np.maximum(pooled, 0)
        g = (sigmoid(act @ m.out + m.base) - y).astype(np.float32) / len(y)
        g_out = act.T @ g + DECAY * m.out
        g_pool = g[:, None] * m.out * (pooled > 0)
        ends = np.cumsum([len(d) for d in docs])
        g_emb: list[tuple[np.ndarray, np.ndarray]] = []
        for j, (f, s) in enumerate(zip(m.filt, s_filt)):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            gp, w = g_pool[:, cols], won[:, cols]
            g_f = DECAY * f
            for k in range(len(f)):
                at = w + k
                inside = at < ends[:, None]
                at = np.minimum(at, len(slots) - 1)
                gk = gp * inside
                x = m.emb[slots[at]].sum(2)  # text x filter x component
                g_f[k] += np.einsum("nf,nfd->df", gk, x)
                live = gk != 0
                g_emb.append((slots[at[live]], (gk[..., None] * f[k].T)[live]))
            s += g_f**2
            f -= RATE * g_f / np.sqrt(s)
        g_bias = g_pool.sum(0)
        s_bias += g_bias**2
        s_out += g_out**2
        self.sums[4] = s_base + float(g.sum()) ** 2
        m.bias -= RATE * g_bias / np.sqrt(s_bias)
        m.out -= RATE * g_out / np.sqrt(s_out)
        m.base -= np.float32(RATE * float(g.sum()) / np.sqrt(self.sums[4]))
        at, grad = np.concatenate([a for a, _ in g_emb]), np.concatenate([b for _, b in g_emb])
        if not len(at):
            return
        own, back = np.unique(at, return_inverse=True)
        total = np.zeros((len(own), DIM), np.float32)
        for c in range(2):
            np.add.at(total, back[:, c], grad)
        total[own == 0] = 0  # the unknown word stays at zero
        s_emb[own] += (total**2).sum(1)
        m.emb[own] -= 3 * RATE * total / np.sqrt(s_emb[own])[:, None]


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the greatest F1, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    z, hit, miss = z[order], np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
    f1 = 2 * hit / (hit + miss + hit[-1])
    f1[:-1][z[:-1] == z[1:]] = -1  # a cut can't lie within ties
    k = int(f1.argmax())
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 2)) / 2)


def fit(texts: list[str], toxic: np.ndarray, lang: list[str | None], weight: np.ndarray, draw: np.ndarray) -> Model:
    """A table that lies in memory: train on four fifths of it (``draw`` below 0.8; on all of it if they have one label only) and set the thresholds on the rest.

    ``learn`` does the same with a table of any size.
    """
    words = [words_of(t) for t in texts]
    n_docs, n_toxic = Counter(), Counter()
    for w, y in zip(words, toxic):
        both = {hash_of(x, 1) for x in set(w)} | {hash_of(x[:STEM], 2) for x in set(w)}
        n_docs.update(both)
        if y:
            n_toxic.update(both)
    share = max(float(toxic.mean()), 1e-6) if len(toxic) else 0.5
    telling = {h: abs(n_toxic[h] - share * n) / np.sqrt(n) for h, n in n_docs.items() if n >= 2}
    model = Model(Table.of(sorted(telling, key=lambda h: (-telling[h], h))))
    distinct = sorted({x for w in words for x in w})
    row = {x: i for i, x in enumerate(distinct)}
    slots = model.table.slots(distinct)
    docs = [slots[[row[x] for x in w]] if w else np.zeros((1, 2), np.int64) for w in words]
    del words, row
    y = toxic.astype(np.float32)
    rng, train = np.random.default_rng(2), np.flatnonzero(draw < 0.8)
    trainer = Trainer(model)
    if not 0 < y[train].sum() < len(train):
        train = np.arange(len(docs))  # a label that is only in the other fifth is learned from there
    if not 0 < y.sum() < len(docs):
        model.settle(bool(y.any()))
    else:
        for _ in range(EPOCHS):
            trainer.epoch(docs, y, rng.permutation(train))
    model.langs = sorted({x for x in lang if x is not None})
    counts = np.full((SLOTS, len(model.langs)), 0.5, np.float32)
    for d, x in zip(docs, lang):
        if x is not None:
            np.add.at(counts[:, model.langs.index(x)], d.ravel(), 1)
    counts /= counts.sum(0)
    model.lang_logs = np.log(counts).astype(np.float32)
    guess = np.array([model.language_of(d) for d in docs], np.int64)
    check = np.flatnonzero(draw >= 0.8)
    check = check if len(check) and 0 < y[check].sum() < len(check) else np.arange(len(docs))
    model.set_thresholds(guess[check], trainer.logits([docs[i] for i in check]), y[check], weight[check])
    return model.shrink()


class Words:
    """A task's memory of words: a number for each and its two hashes."""

    def __init__(self):
        self.seen = Numbers()
        self.hashes = np.zeros((0, 2), np.uint64)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        found = [self.seen.of(words) for words in texts]
        if self.seen.new:
            self.hashes = np.concatenate([self.hashes, hashes_of(self.seen.new)])
            self.seen.new = []
        return found


def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        for lo in range(0, len(p), ROWS_AT_ONCE):
            yield p.iloc[lo : lo + ROWS_AT_ONCE]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Descriptions, and toxic ones, that have a hashed word or word beginning."""
    fresh_worker()
    words, n = Words(), np.zeros((0, 2), np.int64)
    n_stem: dict[int, list[int]] = {}

    def out() -> pd.DataFrame:
        h = np.r_[words.hashes[:, 0], np.fromiter(n_stem, np.uint64, len(n_stem))]
        c = np.r_[n, np.array(list(n_stem.values()), np.int64).reshape(-1, 2)]
        return pd.DataFrame({"h": h.view(np.int64), "slot": (h % np.uint64(SLOTS - 1)).astype(np.int64), "n": c[:, 0], "t": c[:, 1]})

    for p in parts_of(batches):
        docs = words.numbers([words_of(t) for t in p.description])
        n = np.concatenate([n, np.zeros((len(words.seen) - len(n), 2), np.int64)])
        stems: list[np.ndarray] = []
        for d, y in zip(docs, p.toxic):
            d = np.unique(d)
            n[d, 0] += 1
            n[d, 1] += y
            stems.append(np.unique(words.hashes[d, 1]))
        size = [len(s) for s in stems]
        own, back = np.unique(np.concatenate(stems), return_inverse=True)
        toxic = np.bincount(back, np.repeat(p.toxic.to_numpy(float), size), len(own))
        for h, a, b in zip(own.tolist(), np.bincount(back, minlength=len(own)).tolist(), toxic.astype(int).tolist()):
            c = n_stem.setdefault(h, [0, 0])
            c[0] += a
            c[1] += b
        if len(words.seen) > WORDS_HELD:
            yield out()
            words, n, n_stem = Words(), np.zeros((0, 2), np.int64), {}
    yield out()


def unpacked(slots: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32).reshape(-1, 2) for b in slots]


def learn(experiments: DataFrame, reviews: DataFrame, experiment_id: str = "experiment_id", description: str = "description", language: str = "language", toxic: str = "toxic") -> Model:
    """Train on the descriptions of all reviews that are not held out; a fifth of them sets the thresholds and is counted with the others.

    Which words get a slot follows from counts of every word.  Descriptions are dealt to trainers of bounded size by a hash; all of them
    start an epoch from the same network, and what they have moved is averaged after it (by those that moved it).  Only what is
    bounded by the slots is sent to the driver or to every task: their owners, the network, counts by language, and counts of responses.
    """
    spark = experiments.sparkSession
    ship_package(spark)
    r = reviews.select(F.col(experiment_id).alias("experiment_id"), F.col(toxic).cast("int").alias("toxic")).filter("toxic in (0, 1)")
    r = r.filter(~held_out(F.col("experiment_id")))
    one = r.groupBy("experiment_id").agg(F.max("toxic").alias("toxic"))  # of reviews that contradict each other the toxic one counts
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.col(description).alias("description"), F.col(language).cast("string").alias("language"))
    rows = d.filter(~held_out(F.col("experiment_id"))).join(one, "experiment_id").groupBy("experiment_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct("description", "language")).alias("s"))
    # one row for each review, however often its experiment repeats
    rows = rows.select("toxic", "s.*", share_hash(F.col("experiment_id"), salt=6).alias("draw"), share_hash(F.col("experiment_id"), salt=5).alias("place"))
    with temporary(spark):
        return _learned(cut_lineage(rows))


def _learned(rows: DataFrame) -> Model:
    spark = rows.sparkSession
    got = rows.groupBy("toxic", (F.col("draw") >= 0.8).alias("checked")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("description")).alias("letters")).collect()
    if not got:
        return fit([], np.zeros(0), [], np.zeros(0), np.zeros(0))
    n = {(x.toxic, x.checked): x.n for x in got}
    total = sum(n.values())
    share = max(sum(v for (y, _), v in n.items() if y) / total, 1e-6)
    both = lambda *checked: all(any((y, c) in n for c in checked) for y in (0, 1))
    count = rows.select("description", "toxic").mapInPandas(counted, "h long, slot long, n long, t long").groupBy("h", "slot").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter("n >= 2")
    telling = F.struct(F.abs(F.col("t") - share * F.col("n")) / F.sqrt("n"), F.col("h").bitwiseXOR(F.lit((1 << 63) - 1)))
    owners = count.groupBy("slot").agg(F.max_by("h", telling).alias("h")).select("h").toPandas()  # bounded by SLOTS
    model = Model(Table.of(owners.h.to_numpy().view(np.uint64))).shrink()
    parts = max(1, -(-sum(x.letters or 0 for x in got) // LETTERS_PER_TRAINER))
    table = spark.sparkContext.broadcast((model.table, model.used))

    def slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        (owner, used), words, at = table.value, Words(), np.zeros((0, 2), np.int32)
        for p in parts_of(batches):
            docs = words.numbers([words_of(t) for t in p.description])
            h = words.hashes[len(at) :]
            at = np.concatenate([at, np.searchsorted(used, owner.of_hashes(h)).astype(np.int32)])
            yield p.drop(columns="description").assign(slots=[(at[d] if len(d) else np.zeros((1, 2), np.int32)).tobytes() for d in docs])
            if len(words.seen) > WORDS_HELD:
                words, at = Words(), np.zeros((0, 2), np.int32)

    docs = rows.mapInPandas(slotted, "toxic int, language string, draw double, place double, slots binary").withColumn("part", F.floor(F.col("place") * parts).cast("int"))
    docs = cut_lineage(docs.repartitionById(parts, "part").sortWithinPartitions("part", "place"))
    _count_languages(docs.select("language", "slots").filter("language is not null"), model)
    trained = docs if not both(False) else docs.filter("draw < 0.8")  # a label that is only in the other fifth is learned from there
    if not both(False, True):
        model.settle(1 in {y for y, _ in n})
    else:
        _train(trained.select("part", "toxic", "slots"), model, parts, (sum(v for (_, c), v in n.items() if not c) if both(False) else total) / parts)
    sent = spark.sparkContext.broadcast(model)

    def responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        m = sent.value
        trainer = Trainer(m)
        for p in parts_of(batches):
            d = unpacked(p.slots)
            yield pd.DataFrame({"guess": [m.language_of(x) for x in d], "z": np.rint(trainer.logits(d) * GRID).astype(np.int64), "toxic": p.toxic.to_numpy()})

    checked = docs.filter("draw >= 0.8") if both(True) else docs
    z = checked.select("toxic", "slots").mapInPandas(responses, "guess int, z long, toxic int").groupBy("guess", "z", "toxic").count().orderBy("guess", "z", "toxic").toPandas()  # bounded by GRID and languages
    model.set_thresholds(z.guess.to_numpy(), z.z.to_numpy(float) / GRID, z.toxic.to_numpy(float), z["count"].to_numpy(float))
    return model


def _count_languages(docs: DataFrame, model: Model) -> None:
    """Log-chances of the slots by language."""
    size = len(model.used)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, np.ndarray] = {}
        for p in parts_of(batches):
            for x, own in p.groupby("language").slots:
                n[x] = n.get(x, 0) + np.bincount(np.concatenate([np.frombuffer(b, np.int32) for b in own]), minlength=size)
        for x, c in n.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"language": x, "at": at, "n": c[at]})

    found = docs.mapInPandas(run, "language string, at int, n long").groupBy("language", "at").agg(F.sum("n").alias("n")).toPandas()  # bounded by SLOTS and languages
    model.langs = sorted(set(found.language))
    counts = np.full((size, len(model.langs)), 0.5)
    counts[found["at"].to_numpy(), [model.langs.index(x) for x in found.language]] += found.n.to_numpy()
    model.lang_logs = np.log(counts / (counts.sum(0) + 0.5 * (SLOTS - size))).astype(np.float32)


def _train(docs: DataFrame, model: Model, parts: int, rows_each: float) -> None:
    """Epochs over all parts at once, each from the mean of what they learned in the epoch before; a single part makes all its epochs in one go."""
    trainer, values = Trainer(model), [f"v{i}" for i in range(DIM + 1)]
    epochs = int(min(EPOCHS, max(LEAST_EPOCHS, np.ceil(EPOCH_ROWS / max(rows_each, 1)))))
    rounds, each = (1, epochs) if parts == 1 else (epochs, 1)
    for r in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(trainer)

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def moved(part: int, held: list[pd.DataFrame]) -> pd.DataFrame:
                p, own = pd.concat(held), copy.deepcopy(sent.value)
                d, y, rng = unpacked(p.slots), p.toxic.to_numpy(np.float32), np.random.default_rng([2, r, part])
                for _ in range(each):
                    own.epoch(d, y, rng.permutation(len(d)))
                at, v = own.learned(sent.value)
                return pd.DataFrame(v, columns=values).assign(at=at)

            held, part = [], None
            for p in batches:
                for k, own in p.groupby("part"):
                    if held and k != part:
                        yield moved(part, held)
                        held = []
                    part = int(k)
                    held.append(own)
            if held:
                yield moved(part, held)

        got = docs.mapInPandas(train, ", ".join(f"{v} double" for v in values) + ", at int").groupBy("at").agg(*[F.avg(v).alias(v) for v in values]).toPandas()  # bounded by SLOTS
        trainer.put(got["at"].to_numpy(), got[values].to_numpy())
        sent.destroy()


class Scorer:
    """A worker's memory of projected words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, Numbers()
        self.rows = np.zeros((WORDS_HELD + WORDS_AT_ONCE, sum(WIDTHS) * FILTERS + len(model.langs)), np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > WORDS_HELD:
            self.seen = Numbers()
        found, new = self.seen.of(words), self.seen.new
        if new:
            n = len(self.seen) - len(new)
            if len(self.seen) > len(self.rows):  # a text longer than WORDS_AT_ONCE
                self.rows = np.concatenate([self.rows[:n], np.zeros((len(new), self.rows.shape[1]), np.float32)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.rows[n + i : n + i + len(part)] = self.model.projected(part)
            self.seen.new = []
        return found

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n >= WORDS_AT_ONCE:
                out += self._run(held).tolist()
                held, n = [], 0
        return out + self._run(held).tolist()

    def _run(self, held: list[list[str]]) -> np.ndarray:
        m = self.model
        size = np.fromiter(map(len, held), np.int64, len(held))
        pooled = np.zeros((len(held), len(WIDTHS) * FILTERS), np.float32)
        shift = np.full(len(held), m.threshold)
        full = np.flatnonzero(size)
        if len(full):
            codes = self.codes([w for words in held for w in words])
            start, size = (np.cumsum(size) - size)[full], size[full]
            rows, at = np.take(self.rows, codes, axis=0), 0
            for j, w in enumerate(WIDTHS):
                place = [rows[:, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(w)]
                at += w * FILTERS
                pooled[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum.reduceat(convolved(place, start, size), start, axis=0)
            if m.langs:
                lang = np.add.reduceat(rows[:, at:], start, axis=0).argmax(1)
                shift[full] = m.thresholds[lang]
        return sigmoid(np.maximum(pooled + m.bias, 0) @ m.out + m.base - shift)


def toxicity(spark: SparkSession, description: Column, model: Model) -> Column:
    """The score; at 0.5 or more a text counts as toxic."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by SLOTS

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        scorer = Scorer(sent.value)
        for s in batches:
            yield pd.Series(scorer.scores(list(s)), dtype="float64")

    return run.asNondeterministic()(description)


def toxic_notes(
    experiments: DataFrame, reviews: DataFrame | None = None, model: Model | None = None, experiment_id: str = "experiment_id", description: str = "description", language: str = "language", toxic: str = "toxic"
) -> DataFrame:
    """``experiment_id, held_out, score, predicted`` for every row of ``experiments(experiment_id, description, language)``.

    Without a ``model`` one is learned from ``reviews(experiment_id, toxic 0/1)`` of experiments that are not held out (crc32 of the id, modulo 5,
    is not 0).  Words and their beginnings are hashed to vectors; filters over one, two and three words respond to the whole text, and
    the greatest responses decide.  The score is 0.5 at the threshold of the language that the words suggest, which is set on a
    fifth of the reviews; labels and ``language`` serve learning only.  Missing and empty texts, and texts without a letter, get the score of no response
    at all, below 0.5 where both labels were learned.  If all reviews that are learned from have one label, every text gets it; without any,
    none is toxic.  Repeated rows keep a row each; reviews that are missing, repeated or about no
    experiment do no harm; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    if model is None:
        model = learn(experiments, reviews, experiment_id, description, language, toxic)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), held_out(F.col(experiment_id)).alias("held_out"), F.col(description).alias("description"))
    d = d.select("experiment_id", "held_out", toxicity(experiments.sparkSession, F.col("description"), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
