"""Language identification by a blended-spectrum string kernel.

Two texts are compared by the character 1- to 3-grams that both hold:
k(x, y) = |X & Y| / sqrt(|X| |Y|) over sets of n-grams. Nystroem landmarks turn
the kernel into features, one-versus-rest ridge regression into scores; a block
of texts is scored by two matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The classifier is fitted on at most so many labelled texts a language and in all, of so many characters at most.
SAMPLE_PER_LANGUAGE, SAMPLE, LONGEST = 200, 2_000, 20_000
LANDMARKS = 128
RIDGE, SHARPNESS = 1e-2, 4.0
#: A text of at least so many letters whose kernel with every landmark is below this is noise, or in no learned script.
LEAST_LIKENESS, TELLING_LETTERS = 0.25, 20
_LETTERS = 62
_SIDE = _LETTERS + 2
_CHUNK = 1 << 20
_BATCH = 128


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for what is no letter, 1 for letters, by code point."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """Presence of n-grams over a learned alphabet; other letters are one symbol, all else a gap."""

    def __init__(self, alphabet: list[int]) -> None:
        self.code = _kinds().copy()
        self.code[alphabet] = np.arange(2, 2 + len(alphabet), dtype=np.uint8)
        self.size = _SIDE + _SIDE**2 + _SIDE**3

    def __call__(self, text: str | None) -> np.ndarray | None:
        """A flag for each n-gram; None if there is no letter."""
        flags = np.zeros(self.size, bool)
        points, letters = _points(text or ""), False
        for at in range(0, len(points), _CHUNK):
            c = self.code[points[max(0, at - 2) : at + _CHUNK]].astype(np.int32)
            letters = letters or bool(c.any())
            flags[c] = True
            two = c[:-1] * _SIDE + c[1:]
            flags[_SIDE + two] = True
            flags[_SIDE + _SIDE**2 + two[:-1] * _SIDE + c[2:]] = True
        return flags if letters else None

    def found(self, text: str | None) -> np.ndarray | None:
        """The n-grams that are there; None if there is no letter."""
        flags = self(text)
        return None if flags is None else np.flatnonzero(flags).astype(np.int32)


class KernelModel:
    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        seen: Counter = Counter()
        for t in texts:
            for p, n in zip(*np.unique(_points(t), return_counts=True), strict=True):
                seen[int(p)] += int(n)
        letters = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if _kinds()[p]]
        self.alphabet = sorted(letters[:_LETTERS])
        grams = Grams(self.alphabet)
        found = [(grams.found(t), y) for t, y in zip(texts, langs, strict=True)]
        found = [(f, y) for f, y in found if f is not None]
        x, y = [f for f, _ in found], np.array([self.langs.index(y) for _, y in found])
        rank = np.zeros(len(y), int)
        for k in range(len(self.langs)):
            rank[y == k] = np.arange((y == k).sum())
        marks = self._flags([x[i] for i in np.lexsort((y, rank))[:LANDMARKS]], grams.size)
        self.columns = np.flatnonzero(marks.any(0))
        self.marks = marks[:, self.columns].astype(np.float32).T
        self.norms = np.sqrt(marks.sum(1))
        among = self._kernel(marks)
        values, vectors = np.linalg.eigh(among)
        keep = values > 1e-6 * values.max()
        half = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.concatenate([self._kernel(self._flags(x[i : i + _BATCH], grams.size)) for i in range(0, len(x), _BATCH)]) @ half
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = 1 / np.bincount(y, minlength=len(self.langs))[y]
        left = (phi * weight[:, None]).T
        self.weights = half @ np.linalg.solve(left @ phi + RIDGE / len(y) * np.eye(phi.shape[1]), left @ target)

    @staticmethod
    def _flags(found: list[np.ndarray], size: int) -> np.ndarray:
        out = np.zeros((len(found), size), bool)
        for row, own in zip(out, found, strict=True):
            row[own] = True
        return out

    def _kernel(self, flags: np.ndarray) -> np.ndarray:
        return flags[:, self.columns].astype(np.float32) @ self.marks / np.sqrt(flags.sum(1))[:, None] / self.norms

    def predict(self, texts: list[str | None], least: float = 0.0) -> tuple[list[str], list[float]]:
        grams, langs, scores = Grams(self.alphabet), ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), _BATCH):
            own = [(i, f) for i in range(at, min(at + _BATCH, len(texts))) if (f := grams(texts[i])) is not None]
            if own:
                alike = self._kernel(np.array([f for _, f in own]))
                s = alike @ self.weights
                e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                e /= e.sum(1, keepdims=True)
                for (i, _), k, p, best in zip(own, e.argmax(1), e.max(1), alike.max(1), strict=True):
                    if best >= least or sum(map(str.isalpha, texts[i])) < TELLING_LETTERS:
                        langs[i], scores[i] = self.langs[k], float(p)
        return langs, scores


def drawn(labelled: DataFrame, label: str, per_label: int, most: int) -> DataFrame:
    """The rows of about per_label documents of each label, by a hash of doc_id; about `most` in all, but eight a label at least, all of rare ones."""
    counts = dict(labelled.groupBy(label).count().collect())
    if not counts:
        return labelled.limit(0)
    each = max(8, min(per_label, most // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(each / n if n > 4 * each else 1.0))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    return labelled.where(draw < share[F.col(label)])


def in_order(rows: list) -> list:
    """Rows (label, text, doc_id) in an order that does not depend on partitions."""
    return sorted(rows, key=lambda r: (str(r[0]), r["doc_id"] is None, r["doc_id"] or 0, r["text"]))


def labelled_sample(labelled: DataFrame, label: str, per_label: int, most: int) -> list:
    """Rows (label, text) of about per_label texts of each label, eight at least; at most 4 * `most` in all."""
    rows = drawn(labelled, label, per_label, most).select(label, "text", "doc_id")
    kept: dict = {}
    for r in in_order(rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(4 * most).collect()):
        kept.setdefault(r[0], []).append(r)
    return [r for own in kept.values() for r in own[: 2 * per_label]]


def train(docs: DataFrame, usable: Column) -> KernelModel | None:
    """A model from a bounded sample of the rows of docs (doc_id, text, lang) where usable holds; None without any.

    Rows with a null text or lang, or a text above LONGEST characters, are no
    examples; repeated rows count each.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    rows = [r for r in labelled_sample(labelled, "lang", SAMPLE_PER_LANGUAGE, SAMPLE) if any(c.isalpha() for c in r["text"])]
    return KernelModel([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: KernelModel | None, least: float = 0.0) -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1), from text alone.

    A null text, or one without letters, is `und` with score 0, as is every text
    where no model could be learned, and one of TELLING_LETTERS letters or more
    whose kernel with every landmark is below `least`. Ties go to the first language
    by name. Repeated rows are the same each, an empty table gives none.
    Columns of these two names are replaced; rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.predict(texts.tolist(), least)
            yield pd.DataFrame({"lang": langs, "score": scores})

    found = docs.withColumn("__found", predict("text"))
    return found.withColumn("lang_pred", F.col("__found.lang")).withColumn("score", F.col("__found.score")).drop("__found")


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(4, 2) & F.col("doc_id").isNotNull())
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
