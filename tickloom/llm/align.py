"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Both token sequences cut the same bytes. Where both end a token at one byte, a
group ends; a token of one links with all of the other that share a byte with it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Bytes of text whose links share a table of id pairs; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Parts of texts that a worker keeps the ids of.
_CACHE = 300_000
#: Parts whose groups are hashed at once.
_PIECES = 10_000


@dataclass(frozen=True)
class Paths:
    """Rank file and pattern of the byte-level vocabulary (A), model file of the pieces (B)."""

    ranks: str
    pattern: str
    pieces: str


class Aligned(NamedTuple):
    """A stretch of text that both tokenizers begin and end at: numbers of tokens and groups, `a1,a2|b1;a3|b2,b3`, and the linked id pairs as unsigned 32-bit numbers, a * pieces of B + b."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


_NONE = Aligned(0, 0, 0, "", b"")


class Tokenizers:
    """Aligned ids of both tokenizers.

    Neither makes tokens across a single space between two other characters, so
    that the parts of a text between such spaces are encoded and aligned once, all
    new ones of a text in one pass, and kept. Texts with other white space beside
    spaces are one part. Strings of special tokens are plain text to both.
    """

    def __init__(self, paths: Paths) -> None:
        import base64
        import re

        import sentencepiece
        import tiktoken

        with open(paths.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("parts", pat_str=paths.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int32) for x in (self.bytes_a, self.bytes_b))
        self.texts = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.odd = re.compile(r"\s\s| $")
        self.cache: dict[str, Aligned] = {}

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def _spelled(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A over a space and the text and of B over the text, if the bytes of both are the former's."""
        want, a, b = (" " + text).encode(), self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        if b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b]):
            return np.array(a, np.int32), np.array(b, np.int32)
        return None

    def aligned(self, texts: list[str]) -> list[Aligned]:
        """Each text's alignment, by one pass over the ends of all their tokens; no tokens where the bytes of A or B aren't a space and the text.

        Texts are encoded as one, with spaces between; where that can't be taken
        apart again, each on its own.
        """
        ids = self._spelled(" ".join(texts))
        if ids is None:
            return self.aligned_each(texts)
        a, b = ids
        ends_a, ends_b = np.cumsum(self.size_a[a], dtype=np.int32), np.cumsum(self.size_b[b], dtype=np.int32)
        stops = np.cumsum([len(t.encode()) + 1 for t in texts], dtype=np.int32)
        stops_a, stops_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
        if not (np.array_equal(ends_a[stops_a], stops) and np.array_equal(ends_b[stops_b], stops)):
            return self.aligned_each(texts)
        left, right, ends, groups = array("i"), array("i"), array("i"), []
        text_a, text_b = [self.texts[i] for i in a.tolist()], [self.texts[i] for i in b.tolist()]
        for i, j, n, m in runs(ends_a, ends_b, left, right):
            if m == 0:
                groups += [f"{x}|{y}" for x, y in zip(text_a[i : i + n], text_b[j : j + n], strict=True)]
                ends.extend(range(i, i + n))
            else:
                groups.append(",".join(text_a[i : i + n]) + "|" + ",".join(text_b[j : j + m]))
                ends.append(i + n - 1)
        at = np.frombuffer(left, np.int32)
        links = (a[at].astype("<u4") * np.uint32(len(self.bytes_b)) + b[np.frombuffer(right, np.int32)].astype("<u4")).tobytes()
        last_group, last_link = np.searchsorted(np.frombuffer(ends, np.int32), stops_a, side="right").tolist(), np.searchsorted(at, stops_a, side="right").tolist()
        out, x, y, g, k = [], -1, -1, 0, 0
        for x1, y1, g1, k1 in zip(stops_a.tolist(), stops_b.tolist(), last_group, last_link, strict=True):
            out.append(Aligned(x1 - x, y1 - y, g1 - g, ";".join(groups[g:g1]), links[4 * k : 4 * k1]))
            x, y, g, k = x1, y1, g1, k1
        return out

    def aligned_each(self, texts: list[str]) -> list[Aligned]:
        if len(texts) > 1:
            return [x for t in texts for x in self.aligned([t])]
        return [_NONE]

    def __call__(self, text: str | None) -> list[Aligned]:
        """The alignments of a text's parts; none if the bytes of A or B differ from a space and the text."""
        if not text:
            return []
        if self.odd.search(" " + text):
            parts = self.aligned([text])
        else:
            words, cache = text.split(" "), self.cache
            if len(cache) > _CACHE:
                cache.clear()
            if new := list(set(words).difference(cache)):
                cache.update(zip(new, self.aligned(new), strict=True))
            parts = [cache[w] for w in words]
        return [] if _NONE in parts else parts


def runs(ends_a: np.ndarray, ends_b: np.ndarray, left: array, right: array) -> Iterator[tuple[int, int, int, int]]:
    """How two increasing arrays of int32 with the same last value go together: (i, j, n, 0) for n one-to-one places from i and j, (i, j, n, m) for one group of n places and m. Appends the places of all links to left and right.

    At the current shift of indices, spans of 1, 2, 4, ... places are compared
    until one differs, which is halved down to its first difference: one-to-one
    stretches are jumped over. What follows is merged place by place until both
    ends meet, which sets a new shift; wherever one ends, a link does.
    """
    a, b = ends_a.tobytes(), ends_b.tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n, m, i, j = len(list_a), len(list_b), 0, 0
    while i < n:
        x, y = list_a[i], list_b[j]
        if x == y:
            most, at, step = min(n - i, m - j), 1, 2
            while step:
                size = min(step, most - at)
                p, q = 4 * (i + at), 4 * (j + at)
                if size and a[p : p + 4 * size] == b[q : q + 4 * size]:
                    at += size
                    step *= 2
                    continue
                while size > 1:
                    half = size // 2
                    p, q = 4 * (i + at), 4 * (j + at)
                    same = a[p : p + 4 * half] == b[q : q + 4 * half]
                    at, size = (at + half, size - half) if same else (at, half)
                step = 0
            left.extend(range(i, i + at))
            right.extend(range(j, j + at))
            yield i, j, at, 0
            i, j = i + at, j + at
            if i == n:
                return
            x, y = list_a[i], list_b[j]
        p, q = i, j
        while x != y:
            left.append(p)
            right.append(q)
            if x < y:
                p += 1
                x = list_a[p]
            else:
                q += 1
                y = list_b[q]
        left.append(p)
        right.append(q)
        yield i, j, p + 1 - i, q + 1 - j
        i, j = p + 1, q + 1


_DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary, a array<int>, b array<int>, n array<long>"
_COLUMNS = [c.split()[0] for c in _DOCS.split(", ")]


def _aligner(paths: Paths, block_bytes: int):
    """A row for each document, and one for each block of them with its distinct id pairs and their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        both = Tokenizers(paths)
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        keys: list[np.ndarray] = []
        size = 0

        def block() -> pd.DataFrame:
            found, places = np.unique(np.concatenate([np.empty(0, np.uint32), *keys]), return_inverse=True)
            rows, at = [], 0
            for (doc, *rest), own in zip(held, keys, strict=True):
                pairs, n = np.unique(places[at : at + len(own)], return_counts=True)
                at += len(own)
                rows.append((base + number, doc, *rest, pairs.astype("<u4").tobytes(), n.astype("<u4").tobytes(), None, None, None))
            if len(found):
                n = np.bincount(places, minlength=len(found))
                rows.append((base + number, None, 0, 0, 0, 0, None, None, None, (found // len(both.size_b)).astype(np.int32), (found % len(both.size_b)).astype(np.int32), n))
            return pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": "Int64"})

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                parts = both(text if isinstance(text, str) else None)
                keys.append(np.frombuffer(b"".join([p.links for p in parts]), "<u4"))
                written = hashlib.sha256()
                for k in range(0, len(parts), _PIECES):
                    written.update(((";" if k else "") + ";".join([p.groups for p in parts[k : k + _PIECES]])).encode())
                held.append((doc, *(sum([getattr(p, c) for p in parts]) for c in ("n_a", "n_b", "n_groups")), len(keys[-1]), written.hexdigest() if parts else ""))
                size += 4 * len(keys[-1]) + 64
                if size >= block_bytes:
                    yield block()
                    held, keys, size, number = [], [], 0, number + 1
        if held:
            yield block()

    return run


def _summed(key: tuple, docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of a block, from the values of its pairs."""
    count, best = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    places = values["pair"].to_numpy(np.int64)
    count[places], best[places] = values["count"], values["best"]
    n_best, count_sum = [], []
    for pairs, counts in zip(docs["pairs"], docs["counts"], strict=True):
        p, n = np.frombuffer(pairs, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)
        n_best.append(int((n * best[p]).sum()))
        count_sum.append(int((n * count[p]).sum()))
    return docs.drop(columns=["block", "pairs", "counts"]).assign(n_best=n_best, count_sum=count_sum).astype({"doc_id": "Int64"})


def align(docs: DataFrame, paths: Paths | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Alignments of docs (doc_id, text, any others) and the counts of linked ids.

    The first table has a row for each of docs: doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256. Null or empty texts, and those
    whose tokens of A or B don't spell a space and the text, have no tokens:
    zeros and an empty hash. The second has a row for each linked pair of ids: a,
    b, count (of links in all texts), best (1 if no pair of that b has more).
    Repeated rows count and come back each; a null doc_id is kept; columns beside
    doc_id and text are ignored; an empty table gives two empty ones. Texts are
    taken whole; links are held as distinct pairs of a block of documents, so that
    a common pair is one row a block in the joins. paths: of the vocabularies.
    """
    if paths is None:
        import public_tokenizers

        paths = Paths(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(docs.mapInPandas(_aligner(paths, block_bytes), _DOCS), "aligned")
    of_blocks = found.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pair", "x")).select("block", "pair", "x.a", "x.b", "x.n")
    counts = of_blocks.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row a piece of B at most
    counts = stored(counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best")), "pairs")
    values = of_blocks.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "pair", "count", "best")
    rows = found.where("a is null").drop("a", "b", "n")
    out = rows.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out, counts


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
