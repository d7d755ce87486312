"""Benchmark passages in documents, by a distributed positional inverted index.

The index holds (term, document, position) for the rarest terms of each window
of the benchmark. A posting less the term's place in its item is the diagonal on
which item and document run side by side. Postings of one document and item are
brought together; where those of a window's two rarest terms lie on one diagonal,
item and document are compared along it (exact phrases), and where they lie close
to each other, the stretch around them is searched for all words of the window
in any order (proximity).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_ids, small_batches, stored, table
from .shingles import word_hashes

WINDOW = 10
#: A proximity match has all words of a window within a stretch that is longer by so many words at most.
SLACK = 5
#: Benchmark words that one pass over the documents looks for; more take more passes.
PASS_WORDS = 2_000_000
#: Bytes that words are made of: digits, letters, and all of longer UTF-8 sequences.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_TRANSLATE = bytes((c + 32 if 65 <= c <= 90 else c) if _WORD[c] else 32 for c in range(256))
_BLOCK = 1 << 18


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TRANSLATE).split()


def _hashed(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text; a block of texts is hashed at once."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        stop, size = at, 0
        while stop < len(encoded) and (stop == at or size + len(encoded[stop]) <= _BLOCK):
            size += len(encoded[stop]) + 1
            stop += 1
        block = [e.translate(_TRANSLATE) for e in encoded[at:stop]]
        counts = [len(b.split()) for b in block]
        h = word_hashes(b" ".join(block))
        first = 0
        for i, c in enumerate(counts):
            yield at + i, h[first : first + c]
            first += c
        at = stop


def _found(h: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, indexes into terms) of the hashes that are among the sorted terms."""
    k = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    at = np.flatnonzero(terms[k] == h)
    return at, k[at]


def _counted(terms: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), np.int64)
        for pdf in batches:
            for _, h in _hashed(pdf["text"].tolist()):
                total += np.bincount(_found(h, terms)[1], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": terms[some].view(np.int64), "n": total[some]})

    return run


def _posted(terms: np.ndarray):
    """A row without a term for each document, with its number of words, and one for each posting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            which, term, at, sizes = [], [], [], np.zeros(len(pdf), np.int64)
            for i, h in _hashed(pdf["text"].tolist()):
                sizes[i] = len(h)
                if len(terms) and len(h):
                    p, k = _found(h, terms)
                    which.append(np.full(len(p), i))
                    term.append(terms[k].view(np.int64))
                    at.append(p)
            head = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "n": sizes, "term": pd.array([None] * len(pdf), "Int64")})
            yield head
            if which and sum(map(len, which)):
                i = np.concatenate(which)
                yield pd.DataFrame(
                    {"doc_id": head["doc_id"].to_numpy()[i], "row": pdf["row"].to_numpy()[i], "n": np.concatenate(at), "term": np.concatenate(term)}
                ).astype({"doc_id": "Int64"})

    return run


class Items:
    """The items of one pass: their word hashes, and for each window the places of its two rarest terms (-1 where it can't occur)."""

    def __init__(self, items: list[tuple], counts: dict[int, int], window: int) -> None:
        self.items: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.window, wanted = window, set()
        for key, text in items:
            h = word_hashes(b" ".join(words(text))).view(np.int64)
            size = min(window, len(h))
            n = np.array([counts.get(x, 0) for x in h.tolist()], np.int64)
            both = np.full((len(h) - size + 1 if len(h) else 0, 2), -1)
            for s in range(len(both)):
                by = s + np.argsort(n[s : s + size], kind="stable")[:2]
                if n[by[0]]:
                    both[s] = by[0], by[-1]
                    wanted |= {(key, int(h[x]), int(x), size == 1) for x in by}
            if (both >= 0).any():
                self.items[key] = h, both
        self.places = sorted(wanted)


def _near(h: np.ndarray, need: set[int], size: int, at: int, other: int) -> bool:
    """Whether all words needed lie within `size` words of a document, both given positions among them."""
    low = max(0, max(at, other) - size + 1)
    own = [(i, x) for i, x in enumerate(h[low : min(at, other) + size].tolist()) if x in need]
    held: dict[int, int] = {}
    first = 0
    for i, x in own:
        held[x] = held.get(x, 0) + 1
        while i - own[first][0] >= size:
            gone = own[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        if len(held) == len(need):
            return True
    return False


def compared(h: np.ndarray, v: np.ndarray, both: np.ndarray, window: int, slack: int, diagonals: list[int], places: list[int]) -> tuple[list[tuple[int, int]], bool]:
    """(start, end) of the occurrences of an item's windows in a document's words, and whether some window has a proximity match."""
    size, near = min(window, len(v)), False
    seen: dict[int, list[int]] = {}
    for d, p in zip(diagonals, places, strict=True):
        seen.setdefault(p, []).append(d)
    on = {p: np.array(sorted(ds)) for p, ds in seen.items()}
    lines: set[int] = set()
    for s in range(len(both)):
        p, q = both[s].tolist()
        if p < 0 or p not in on or q not in on:
            continue
        if p == q:
            lines.update(on[p].tolist())
            near = True
            continue
        a, b = on[p] + p, on[q] + q
        lines.update(np.intersect1d(on[p], on[q], assume_unique=False).tolist())
        if not near:
            need, reach = set(v[s : s + size].tolist()), size + slack
            low, high = np.searchsorted(b, a - reach, side="right"), np.searchsorted(b, a + reach, side="left")
            near = any(_near(h, need, reach, x, y) for x, i, j in zip(a.tolist(), low.tolist(), high.tolist(), strict=True) for y in b[i:j].tolist())
    out = []
    for low in lines:
        start = max(0, -low)
        same = v[start : max(start, len(h) - low)] == h[low + start : low + start + len(v) - start][: len(v) - start]
        edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
        out += [(x + low + start, y + low + start) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= size]
    return out, near


_VERIFIED = "doc_id long, row long, hits array<long>, items array<string>, near array<string>"


def _verified(shared, slack: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Items = shared.value
        for pdf in batches:
            out, found = [], pdf["found"].tolist()
            for i, h in _hashed(pdf["text"].tolist()):
                h = h.view(np.int64)
                hit, items, near = np.zeros(len(h), bool), set(), set()
                for f in found[i]:
                    key = f["item"], f["mark"]
                    v, both = own.items[key]
                    spans, close = compared(h, v, both, own.window, slack, [x["diagonal"] for x in f["xs"]], [x["place"] for x in f["xs"]])
                    for a, b in spans:
                        hit[a:b] = True
                    if spans:
                        items.add(f["item"])
                    if close:
                        near.add(f["item"])
                if items or near:
                    out.append((pdf["doc_id"].iloc[i], pdf["row"].iloc[i], np.flatnonzero(hit).tolist(), sorted(items), sorted(near)))
            yield pd.DataFrame(out, columns=["doc_id", "row", "hits", "items", "near"]).astype({"doc_id": "Int64", "row": "int64"})

    return run


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["row"] == b["row"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(doc_id, row, n_words, n_hit, hits, items, near) of each row of docs (doc_id, text, any others).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased,
    compared by 64-bit hashes. n_hit counts the words inside occurrences of
    windows of the benchmark (item_id, text): `window` consecutive words of an
    item, or all of a shorter one; hits are their positions, items the item_ids
    (as strings, sorted). near are the items of which some window has all its
    different words within `slack` words more than it is long, in any order;
    items with an occurrence are among them. row is a hash of doc_id and text,
    with which results join to docs again.

    Null texts have no words and null or word-less items no windows; an item_id
    that is null counts as the string `null`. Repeated rows have the same result
    each; empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null").distinct().withColumn("mark", F.xxhash64("item", "text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // (4 * PASS_WORDS)))
    base, found = None, None
    for k in range(passes):
        own = [((r["item"], r["mark"]), r["text"]) for r in items.where(F.pmod("mark", F.lit(passes)) == k).collect()]
        terms = np.unique(np.concatenate([word_hashes(b" ".join(words(t))) for _, t in own] or [np.empty(0, np.uint64)]))
        counts = {}
        if len(terms):
            counted = docs.select("text").mapInPandas(_counted(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
            counts = dict(counted.collect())
        wanted = Items(own, counts, window)
        looked = np.unique(np.array([t for _, t, _, _ in wanted.places], np.int64).view(np.uint64))
        index = stored(docs.mapInPandas(_posted(looked), "doc_id long, row long, n long, term long"), "postings")
        base = base if base is not None else index.where("term is null").select("doc_id", "row", F.col("n").alias("n_words"))
        if not wanted.places:
            continue
        places = spark.createDataFrame([(i, m, t, p, a) for (i, m), t, p, a in wanted.places], "item string, mark long, term long, place long, alone boolean")
        shared = spark.sparkContext.broadcast(wanted)
        # Postings of a document and item, by position. Two places of a window must come close to each other: then so do two that follow each other.
        x = F.struct(F.col("n").alias("at"), "place", (F.col("n") - F.col("place")).alias("diagonal"))
        met = index.where("term is not null").join(places, "term").groupBy("doc_id", "row", "item", "mark").agg(F.sort_array(F.collect_list(x)).alias("xs"), F.max("alone").alias("alone"))
        count = F.size("xs") - 1
        steps = F.zip_with(F.slice("xs", 1, count), F.slice("xs", 2, count), lambda p, q: (p["place"] != q["place"]) & (q["at"] - p["at"] < window + slack))
        met = met.where(F.col("alone") | ((F.size("xs") > 1) & F.exists(steps, lambda c: c)))
        lists = stored(met.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item", "mark", "xs")).alias("found")), "diagonals")
        texts = keep_ids(docs, lists.select("row").distinct(), "row").dropDuplicates(["doc_id", "row"])
        side = lists.join(texts, _same_row(lists, texts)).select(lists["doc_id"], lists["row"], "text", "found").mapInPandas(_verified(shared, slack), _VERIFIED)
        found = side if found is None else found.unionByName(side)
    none = F.lit(None)
    if found is None:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), none.cast("array<long>").alias("hits"), none.cast("array<string>").alias("items"), none.cast("array<string>").alias("near"))
    if passes > 1:
        joined = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("doc_id", "row").agg(joined("hits"), joined("items"), joined("near"))
    return base.join(found, _same_row(base, found), "left").select(base["doc_id"], base["row"], "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"), "hits", "items", "near")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; proximity alone drops none.

    Rows with a null text or id stay if clean, repeated rows go or stay each, an
    empty table is empty. All columns stay.
    """
    hit = passages(docs, benchmark, window).where("n_hit > 0").select("row").distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    return docs.withColumn("__row", key).join(hit.toDF("__row"), "__row", "left_anti").select(docs.columns)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), 256)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.greatest(F.size(F.array_except("near", "items")), F.lit(0)).cast("long").alias("n_near"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """op9's rows by looking up each window of each document; for small inputs."""
    windows: dict[tuple, set[str]] = {}
    sizes = set()
    for item, text in items:
        v = words(text)
        size = min(window, len(v))
        for s in range(len(v) - size + 1 if v else 0):
            windows.setdefault(tuple(v[s : s + size]), set()).add(str(item))
            sizes.add(size)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    hit.update(range(p, p + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(docs: list[tuple], items: list[tuple], window: int = WINDOW, slack: int = SLACK) -> dict:
    """The items of each document by a look at every stretch of it; for small inputs."""
    out = {}
    for doc, text in docs:
        w, own = words(text), set()
        for item, t in items:
            v = words(t)
            size = min(window, len(v))
            for s in range(len(v) - size + 1 if v else 0):
                need = set(v[s : s + size])
                reach = size + slack if size > 1 else 1
                if any(need <= set(w[p : p + reach]) for p in range(max(1, len(w) - reach + 1))):
                    own.add(str(item))
                    break
        out[doc] = sorted(own)
    return out
