"""Document quality by random-indexing word vectors and a small calibrated network.

Every word, and every shape of one, has a fixed random index vector, made from
its own hash. The word vector of a word sums the index vectors of its neighbours
over all documents. Words that make up at least LEAST_SHARE of all words have
one, which at most 1 / LEAST_SHARE words can, whatever the size of the corpus;
of a rarer word, its index vector and the word vector of its shape are used. A
document's vector is the mean of its words'. To it come the likeness of
neighbouring words and the share of different words. Two layers of numpy give a
logit, and a temperature fitted on texts kept aside turns it into a probability.

Sums are of integers, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table
from .language import drawn, held_out
from .shingles import mix, word_hashes

#: The network is fitted on at most so many labelled texts of each label, of so many characters at most.
SAMPLE_PER_LABEL, LONGEST = 1_500, 100_000
DIM, REACH = 48, 2
#: Words have a vector if their share of all words is at least this; so at most 1 / LEAST_SHARE words have, of 2 * DIM bytes each.
LEAST_SHARE = 1 / (1 << 18)
#: Word vectors have length ONE, so that they are integers of two bytes.
ONE = 1 << 14
#: Words, different words and words between two partial sums that a task holds at once.
_TOKENS, _HELD, _SUMMED = 1 << 16, 1 << 21, 1 << 27
HIDDEN, EPOCHS, RATE, DECAY = 24, 150, 5e-3, 1e-4
THRESHOLD = 0.3
_SALT = np.uint64(0xA0761D6478BD642F)
_BLOCK = 1 << 18


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Sparse ternary index vectors, four entries each, from the hashes of words."""
    x = mix(keys.view(np.uint64) ^ np.uint64(7))
    out, each = np.zeros((len(x), DIM), np.int8), np.arange(len(x))
    for k in range(4):
        part = x >> np.uint64(16 * k)
        out[each, ((part & np.uint64(0x7FFF)) % np.uint64(DIM)).astype(np.int64)] += np.where(part & np.uint64(0x8000), 1, -1).astype(np.int8)
    return out


_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def token_lists(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words, each followed by that of its shape; a block of texts is hashed at once."""
    encoded = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        stop, size = at, 0
        while stop < len(encoded) and (stop == at or size + len(encoded[stop]) <= _BLOCK):
            size += len(encoded[stop]) + 1
            stop += 1
        block = encoded[at:stop]
        raw, first = b" ".join(block), 0
        h = word_hashes(raw)
        out = np.empty(2 * len(h), np.uint64)
        out[::2] = h
        out[1::2] = mix(word_hashes(raw.translate(_SHAPE)) ^ _SALT)
        for b in block:
            n = 2 * len(b.split())
            yield out[first : first + n].view(np.int64)
            first += n
        at = stop


def tokens(text: str | None) -> np.ndarray:
    return next(token_lists([text]))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n): how often a task has seen each token."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n[order], first)

    held, size = [], 0
    for pdf in batches:
        own = np.concatenate([*token_lists(pdf["text"].tolist()), np.empty(0, np.int64)])
        if not len(own):
            continue
        held.append(np.unique(own, return_counts=True))
        size += len(held[-1][0])
        if size > _HELD:
            held = [summed(held)]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield pd.DataFrame({"key": held[0][0], "n": held[0][1]})
                held, size = [], 0
    if held:
        keys, n = summed(held)
        yield pd.DataFrame({"key": keys, "n": n})


def _packed(keys: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """Rows (key, sums) whose sums are bytes, as narrow as they can be."""
    most, out = np.abs(sums).max(1, initial=0), np.empty(len(keys), object)
    for kind, low, high in (("<i1", -1, 127), ("<i2", 127, 32767), ("<i4", 32767, 2**31 - 1), ("<i8", 2**31 - 1, np.inf)):
        own = np.flatnonzero((most > low) & (most <= high))
        data, width = sums[own].astype(kind).tobytes(), DIM * int(kind[2])
        out[own] = [data[i * width : (i + 1) * width] for i in range(len(own))]
    return pd.DataFrame({"key": keys, "sums": out})


def _unpacked(column: pd.Series) -> np.ndarray:
    values, out = column.to_numpy(), np.zeros((len(column), DIM), np.int64)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for width in (1, 2, 4, 8):
        own = np.flatnonzero(sizes == DIM * width)
        if len(own):
            out[own] = np.frombuffer(b"".join(values[own]), f"<i{width}").reshape(-1, DIM)
    return out


def _lookup(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in sorted keys, and whether they are there."""
    at = np.searchsorted(keys, words)
    at[at == len(keys)] = 0
    return at, (keys[at] == words) if len(keys) else np.zeros(len(words), bool)


def _contexts(keys_of):
    """(key, sums) of a task: for each of the sorted keys it sees, the sum of the index vectors of its neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, gap = keys_of(), 2 * REACH
        sums, seen, done = np.zeros((len(keys), DIM), np.int32), np.zeros(len(keys), bool), 0

        def add(texts: list[np.ndarray]) -> None:
            own = np.concatenate([x for t in texts for x in (t, np.zeros(gap, np.int64))])
            real = np.concatenate([x for t in texts for x in (np.ones(len(t), bool), np.zeros(gap, bool))])
            distinct, place = np.unique(own, return_inverse=True)
            r = index_vectors(distinct)[place]
            r[~real] = 0
            around = np.zeros(r.shape, np.int8)
            for k in range(1, gap + 1):
                around[k:] += r[:-k]
                around[:-k] += r[k:]
            at, there = _lookup(keys, distinct)
            rows = np.flatnonzero(there[place] & real)
            to = at[place[rows]]
            order = np.argsort(to, kind="stable")
            to = to[order]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
            if len(first):
                sums[to[first]] += np.add.reduceat(around[rows[order]], first, axis=0, dtype=np.int32)
                seen[to[first]] = True

        held, size = [], 0
        for pdf in batches:
            for t in token_lists(pdf["text"].tolist()):
                held.append(t)
                size += len(t)
                if size > _TOKENS:
                    add(held)
                    done, held, size = done + size, [], 0
                if done > _SUMMED:
                    yield _packed(keys[seen], sums[seen])
                    sums[:], seen[:], done = 0, False, 0
        if held:
            add(held)
        yield _packed(keys[seen], sums[seen])

    return run


def _total(partial: DataFrame) -> DataFrame:
    """Sums by key of rows (key, sums): one row a key and task comes in."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, sums = pdf["key"].to_numpy(), _unpacked(pdf["sums"])
            if last is not None:
                keys, sums = np.concatenate([last[0], keys]), np.concatenate([last[1], sums])
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, sums = keys[first], np.add.reduceat(sums, first, axis=0)
            last = keys[-1:], sums[-1:]
            yield _packed(keys[:-1], sums[:-1])
        if last is not None:
            yield _packed(*last)

    # Keys come in order; each task adds what it sees of one before it emits it.
    shuffles = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(shuffles, "key").sortWithinPartitions("key").mapInPandas(fold, "key long, sums binary")


class WordVectors:
    """Sorted keys of the words of a corpus that make up LEAST_SHARE of it at least, and their vectors."""

    def __init__(self, docs: DataFrame, least_share: float = LEAST_SHARE) -> None:
        small_batches(docs.sparkSession)
        texts = docs.where("text is not null").select("text")
        counts = stored(texts.mapInPandas(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        # At most 1 / least_share rows, as their counts sum to the total at most.
        self.keys = np.sort(counts.where(F.col("n") >= total * least_share).select("key").toPandas()["key"].to_numpy(np.int64))
        shared = docs.sparkSession.sparkContext.broadcast(self.keys)
        rows = _total(texts.mapInPandas(_contexts(lambda: shared.value), "key long, sums binary")).toPandas().sort_values("key")
        sums = np.zeros((len(self.keys), DIM))
        sums[np.searchsorted(self.keys, rows["key"].to_numpy(np.int64))] = _unpacked(rows["sums"])
        self.vectors = np.rint(sums * (ONE / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True)))).astype(np.int16)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; null counts as empty."""
        out = np.zeros((len(texts), DIM + 3))
        for x, b in zip(out, token_lists(texts), strict=True):
            if n := len(b):
                w, c = np.unique(b, return_counts=True)
                at, there = _lookup(self.keys, w)
                x[:DIM] = ((c[there] @ self.vectors[at[there]].astype(np.int64)) / ONE + 0.5 * (c @ index_vectors(w).astype(np.int64))) / n
                own = np.unique(b[::2], return_counts=True)[1].astype(float)
                x[DIM:] = 2 * float((b[2::2] == b[:-2:2]).sum()) / n, np.sqrt((own**2).sum()) / (n / 2), np.log1p(n / 2) / 10
        return out


class QualityModel:
    """The network, and the word vectors that its features come from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, words: WordVectors, seed: int = 11) -> None:
        self.words = words
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = rng.random(len(y)) < 0.2
        if aside.all() or not aside.any():
            aside[:] = False
        self._fit(x[~aside], y[~aside], rng)
        self.temperature = 1.0
        if aside.sum() >= 20:
            z, t = self._logit(x[aside]), y[aside]
            loss = lambda k: np.logaddexp(0, np.where(t > 0, -z, z) / k).mean()
            self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0), key=loss)

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 128):
                i = order[at : at + 128]
                h = np.tanh(x[i] @ self.w1 + self.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -50, 50))) - y[i]) / len(i)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = [x[i].T @ back + DECAY * self.w1, back.sum(0), h.T @ g + DECAY * self.w2, g.sum(keepdims=True)]
                step += 1
                for p, d, a, c in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (d - a)
                    c += 0.001 * (d * d - c)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> QualityModel | None:
    """Word vectors of all docs, and a network from a bounded sample of the labelled rows where usable holds; None without both labels.

    The sample is drawn over ids, so that only its own texts leave the scan. A
    doc_id with two qualities is left out; repeated rows count once each.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    usable_docs = docs.where(usable & F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text")
    labelled, most = usable_docs.select("doc_id").join(known, "doc_id").select("doc_id", "quality"), 2 * SAMPLE_PER_LABEL
    picked = drawn(labelled, "quality", SAMPLE_PER_LABEL, most).distinct().limit(2 * most)
    sample = stored(usable_docs.join(F.broadcast(picked), "doc_id").select("quality", "text", "doc_id").limit(2 * most), "sample")
    if sample.select("quality").distinct().count() < 2:
        return None
    words = WordVectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(shared.value.features(texts.tolist())))

    rows = sample.select("quality", "doc_id", F.xxhash64("text").alias("t"), features("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["quality"], r["doc_id"], r["t"]))
    return QualityModel(np.array([r["x"] for r in rows]), np.array([float(r["quality"]) for r in rows]), words)


def score(docs: DataFrame, model: QualityModel | None, prior: float = 0.5) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int), from text alone.

    A null text counts as empty; an empty one has the score that the network
    gives to a text without words. Without a model, the score is `prior`. Equal
    texts have equal scores, repeated rows too; an empty table gives none.
    Columns of these names are replaced; rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    if model is None:
        scored = docs.withColumn("score", F.lit(prior))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(shared.value.score(shared.value.words.features(texts.tolist())))

        scored = docs.withColumn("score", scores("text"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0) & F.col("doc_id").isNotNull())
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
