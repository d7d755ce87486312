"""N-gram Jaccard join by PartEnum signatures, and the groups that its links make."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_ids, small_batches, stored, table
from .components import components
from .partenum import COUNT_BITS, count_cells, fold, levels_of, linked, may_link, prefix, signatures, sketch
from .shingles import shingle_sets

#: Rows of a bucket that one task compares at once.
BLOCK = 1024
#: Members of a bucket beyond which they meet by their rarest elements instead.
CROWD = 64
#: Parts of the table of counts, each summed by itself.
_PARTS = 64


def _described(k: int, percent: int):
    """A row for each document; then the parts of the table of counts of shingles, with n = -1 - part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        counts, cells, held = np.zeros(1 << COUNT_BITS, np.uint32), [], 0
        for pdf in batches:
            out = []
            for doc, s in zip(pdf["doc_id"], shingle_sets(pdf["text"].tolist(), k), strict=True):
                raw = s.tobytes()
                cells.append(count_cells(s))
                held += len(s)
                if held > 1 << 18:
                    np.add(counts, np.bincount(np.concatenate(cells), minlength=len(counts)), out=counts, casting="unsafe")
                    cells, held = [], 0
                out.append(
                    (doc, len(s), hashlib.blake2b(raw, digest_size=16).digest(), sketch(s, percent)) if len(s) else (doc, 0, None, None)
                )
            yield pd.DataFrame(out, columns=_NAMES)
        if held:
            np.add(counts, np.bincount(np.concatenate(cells), minlength=len(counts)), out=counts, casting="unsafe")
        if counts.any():
            yield pd.DataFrame([(None, -1 - i, None, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(counts.reshape(_PARTS, -1))], columns=_NAMES)

    return run


_NAMES = ["doc_id", "n", "set_hash", "sketch"]
_DESCRIBED = "doc_id long, n long, set_hash binary, sketch binary"


def _levels(described: DataFrame) -> bytes:
    """How common each cell of hashes is over all documents (`levels_of`), compressed. Each part goes by its own median."""

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["sketch"])
        return pd.DataFrame({"part": [-1 - int(pdf["n"].iloc[0])], "levels": [zlib.compress(levels_of(total).tobytes())]})

    found = {r["part"]: zlib.decompress(r["levels"]) for r in described.where("n < 0").select("n", "sketch").groupBy("n").applyInPandas(summed, "part long, levels binary").collect()}
    return zlib.compress(b"".join(found.get(i, bytes((1 << COUNT_BITS) // _PARTS)) for i in range(_PARTS)))


def _signed(k: int, percent: int, packed: bytes, keys=signatures):
    """(sig, cls) for each signature (or other key) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = np.frombuffer(zlib.decompress(packed), np.uint8)
        for pdf in batches:
            own = [keys(s, percent, levels=levels).view(np.int64) for s in shingle_sets(pdf["text"].tolist(), k)]
            yield pd.DataFrame({"sig": np.concatenate(own), "cls": np.repeat(pdf["doc_id"].to_numpy(), [len(x) for x in own])}) if own else pd.DataFrame({"sig": [], "cls": []}, dtype="int64")

    return run


def _bucketed(signed: DataFrame) -> DataFrame:
    """Rows (sig, cls) of signatures that several classes have, with the first class, for the third the second, and whether there are more than CROWD."""
    in_order = Window.partitionBy("sig").orderBy("cls")
    place, before, after = F.row_number().over(in_order), F.lag("cls").over(in_order), F.lead("cls").over(in_order)
    size = F.count("*").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        signed.select("sig", "cls", F.first("cls").over(in_order).alias("hub"), place.alias("place"), before.alias("before"), after.alias("after"), size.alias("size"))
        .where("before is not null or after is not null")
        .select("sig", "cls", "hub", F.when(F.col("place") == 3, F.col("before")).alias("second"), (F.col("size") > CROWD).alias("crowded"))
    )


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), k)
            yield pd.DataFrame({"cls": pdf["doc_id"], "elements": [s.view(np.int64) for s in sets]})

    return docs.select("doc_id", "text").mapInPandas(run, "cls long, elements array<long>")


def _sketched(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [may_link(a, n, b, m, percent) for a, n, b, m in zip(pdf.a_sketch, pdf.a_n, pdf.b_sketch, pdf.b_n, strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _exact(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [linked(x, y, percent) for x, y in zip(pdf.a_set, pdf.b_set, strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, sketched: bool) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: by their sketches first, then exactly."""
    if not sketched:
        own = classes.select("cls", "n", "sketch")
        pairs = (
            pairs.join(own.toDF("a", "a_n", "a_sketch"), "a")
            .join(own.toDF("b", "b_n", "b_sketch"), "b")
            .mapInPandas(_sketched(percent), "a long, b long")
        )
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _sets(keep_ids(docs.select("doc_id", "text"), ids, "doc_id"), k)
    return stored(
        pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b").mapInPandas(_exact(percent), "a long, b long").distinct(),
        "links",
    )


def _blocks(percent: int, nearest: bool):
    """(sig, a, b) from sorted rows (sig, left, right, side, cls, label, n, sketch) that may link, in different groups so far.

    nearest: of each row, only the pair with the sketch that is most alike.
    """

    def compared(cls: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        if (label == label[0]).all():
            return None
        size = min(map(len, sketches))
        s = np.stack([fold(np.frombuffer(x, np.uint8), size) for x in sketches]).view(np.uint64)
        _, of, times = np.unique(label, return_inverse=True, return_counts=True)
        major = of == times.argmax()  # of two groups, one is another than the largest
        rows, others = np.flatnonzero(~major & (side <= 0)), np.flatnonzero(side >= 0)
        step = max(1, min(32, (1 << 20) // s.size))
        parts = [(rows[at : at + step], others) for at in range(0, len(rows), step)]
        if side.any():  # in one block, the other way round are the same pairs
            rows, others = np.flatnonzero(major & (side <= 0)), np.flatnonzero(~major & (side >= 0))
            parts += [(rows[at : at + step], others) for at in range(0, len(rows), step)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for own, them in parts:
            apart = np.bitwise_count(s[own, None] ^ s[None, them]).sum(2, dtype=np.int32)
            near = (100 + percent) * apart <= (100 - percent) * (n[own, None] + n[None, them])
            near &= (label[own, None] != label[None, them]) & (cls[own, None] != cls[None, them])
            if nearest and len(them):
                i = np.flatnonzero(near.any(1))
                j = np.where(near[i], apart[i], np.iinfo(np.int32).max).argmin(1)
            else:
                i, j = np.nonzero(near)
            a.append(np.minimum(cls[own[i]], cls[them[j]]))
            b.append(np.maximum(cls[own[i]], cls[them[j]]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def found(pdf: pd.DataFrame, ends: np.ndarray) -> Iterator[pd.DataFrame]:
            cls, label, n, side, sketches = pdf.cls.to_numpy(), pdf.label.to_numpy(), pdf.n.to_numpy(), pdf.side.to_numpy(), pdf.sketch.tolist()
            sig = pdf.sig.to_numpy()
            pairs = [(sig[x], *p) for x, y in zip(ends[:-1], ends[1:], strict=True) if (p := compared(cls[x:y], label[x:y], n[x:y], side[x:y], sketches[x:y])) and len(p[0])]
            if pairs:
                yield pd.DataFrame({"sig": np.repeat([p[0] for p in pairs], [len(p[1]) for p in pairs]), "a": np.concatenate([p[1] for p in pairs]), "b": np.concatenate([p[2] for p in pairs])}).drop_duplicates()

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[["sig", "left", "right"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(pdf) else np.zeros(0, int)
            if len(starts) > 1:
                yield from found(pdf, starts)
            rest = pdf.iloc[starts[-1] :] if len(starts) else None
        if rest is not None and len(rest):
            yield from found(rest, np.array([0, len(rest)]))

    return run


def _compared(buckets: DataFrame, groups: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(sig, a, b) of what may link in the buckets (sig, cls) of more than three whose members are in different groups."""
    members = buckets.join(groups.toDF("cls", "component"), "cls", "left").select("sig", "cls", F.coalesce("component", "cls").alias("label"))
    mixed = (
        members.groupBy("sig")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        .where("low <> high and size > 3")
        .select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = (
        members.join(mixed, "sig")
        .join(classes, "cls")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "cls", "label", "n", "sketch")
    )
    rows = rows.repartition(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig", "left", "right").sortWithinPartitions("sig", "left", "right")
    return rows.mapInPandas(_blocks(percent, nearest), "sig long, a long, b long")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of docs (doc_id, text, any others).

    Words are runs of anything but space and \\t to \\r, with A-Z lower-cased.
    A document's set holds its distinct k-word shingles as 64-bit hashes; with
    fewer words, the whole sequence. Documents link when 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links reach.

    Equal sets become one class (class_id: its smallest doc_id). Signatures leave
    out common shingles, the same ones for all. Classes that share a PartEnum
    signature are compared with the first one of their bucket,
    and the third with the second, which is linear in its size. What these links leave in
    different groups of a bucket is compared in blocks, by sketches that never
    miss a link, and exactly where they don't exclude one: nothing is capped.
    The members of a bucket of more than CROWD meet by their rarest shingles in
    its place: all classes of such buckets have keys of those, of which two that
    link share one.

    Null or word-less texts have n_shingles 0 and stay alone; a null doc_id has
    null class and component; rows of one doc_id count as one document, which
    has all their links; an empty table gives an empty result. Bands of sizes hold
    all links from 80 percent up; a lower percent raises ValueError.
    """
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be 80 to 100, not {percent}")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    described = stored(
        docs.where("doc_id is not null").mapInPandas(
            _described(k, percent), _DESCRIBED
        ),
        "sets",
    )
    levels, described = _levels(described), described.where("n >= 0")
    cls = described.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("cls"))
    ids = cls.select(F.col("cls").alias("doc_id"))
    classes = stored(keep_ids(described.where("n > 0"), ids, "doc_id").select(F.col("doc_id").alias("cls"), "n", "sketch").dropDuplicates(["cls"]), "classes")
    own = keep_ids(docs.where("doc_id is not null"), ids, "doc_id")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # signatures are many: half as many a task are sorted at once
    buckets = stored(_bucketed(own.mapInPandas(_signed(k, percent, levels), "sig long, cls long").repartition(parts, "sig")), "buckets")
    crowd = stored(buckets.where("crowded").select(F.col("cls").alias("doc_id")).distinct(), "crowd")
    if crowd.limit(1).count():
        rarest = keep_ids(own, crowd, "doc_id").mapInPandas(_signed(k, percent, levels, prefix), "sig long, cls long")
        buckets = buckets.where("not crowded").unionByName(stored(_bucketed(rarest), "rarest"))
    near = buckets.select(F.explode(F.array("hub", "second")).alias("a"), F.col("cls").alias("b"))
    first = _verified(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, docs, k, percent, False)
    groups = stored(components(first.toDF("src", "dst")), "groups")

    close = stored(_compared(buckets.select("sig", "cls"), groups, classes, percent, True), "nearest")
    second = _verified(close.select("a", "b").distinct(), classes, docs, k, percent, True)
    links = groups.toDF("src", "dst").unionByName(second.toDF("src", "dst"))
    groups = stored(components(links), "groups")
    left = buckets.select("sig", "cls").join(close.select("sig").distinct(), "sig")
    rest = _compared(left, groups, classes, percent, False).select("a", "b").distinct()
    third = _verified(rest, classes, docs, k, percent, True)
    links = groups.toDF("src", "dst").unionByName(third.toDF("src", "dst"))
    final = components(links).toDF("cls", "component")

    placed = described.select("doc_id", "n", "set_hash").join(cls, "set_hash", "left")
    copies = placed.where("cls <> doc_id").select(F.col("cls").alias("src"), F.col("doc_id").alias("dst"))
    several = placed.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y")
    if several.limit(1).count():  # a doc_id with several texts ties their classes together
        final = components(links.unionByName(copies)).toDF("cls", "component")
    out = (
        placed.withColumn("class_id", F.coalesce("cls", "doc_id"))
        .drop("cls")
        .join(final, F.col("class_id") == F.col("cls"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
    null = F.lit(None).cast("long")
    unnamed = docs.where("doc_id is null")
    if unnamed.limit(1).count():
        sizes = unnamed.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInPandas(
            _described(k, percent), _DESCRIBED
        ).where("n >= 0")
        out = out.unionByName(sizes.select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("class_id"), null.alias("component_id")))
    return out


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are not the first (lowest doc_id) of their group.

    Rows without a doc_id stay, as do repeated rows of one that stays, and texts
    that are null or without words; an empty table is empty. All columns stay.
    """
    gone = jaccard_groups(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
