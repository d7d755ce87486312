"""Importance resampling of documents towards the n-gram distribution of a target.

Batches of texts go through Arrow kernels: lower-casing, splitting into words,
flattening and dictionary encoding. Shifted dictionary indices form n-grams,
whose distinct ones are hashed once a batch; gains are taken by bucket and
reduced over the segment of each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: What parts words, once A-Z are lower-cased: all of ASCII but digits and small letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the longest feature; hash buckets; share of the eligible documents that is drawn, in percent; words that make one eligible; seed of the noise.
LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each n-gram length the document and the bucket of every feature, in order of documents."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAPS)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    index, doc = coded.indices.to_numpy().astype(np.int64), parents.filter(real).to_numpy()
    known = [w.encode() for w in coded.dictionary.to_pylist()]
    crcs, code, start = [zlib.crc32(w) for w in known], index, np.arange(len(index))
    out = []
    for k in range(1, longest + 1):
        if k > 1:
            inside = start + k - 1 < len(doc)
            inside[inside] = doc[start[inside] + k - 1] == doc[start[inside]]
            start, code = start[inside], code[inside]
            pairs = pa.array(code * len(known) + index[start + k - 1]).dictionary_encode()
            before, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(known)))
            spaced = [b" " + w for w in known]
            crcs = [zlib.crc32(spaced[w], crcs[p]) for p, w in zip(before.tolist(), last.tolist(), strict=True)]
            code = pairs.indices.to_numpy().astype(np.int64)
        bucket = pc.take(pa.array(crcs, pa.int64()), pa.array(code)).to_numpy() % buckets
        out.append((doc[start], bucket))
    return np.bincount(doc, minlength=len(texts)), out


def _counter(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0), longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket; `buckets` numbers, summed by tasks before the shuffle. Null texts have none."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(longest, buckets), "bucket long, n long")
    out = [0] * buckets
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    n, s, t = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target, strict=True)]


def _weigher(by_bucket: list[int], longest: int):
    gain = np.array(by_bucket, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = pa.array(gain)
        for batch in batches:
            n_words, parts = features(batch.column("text"), longest, len(gain))
            n, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for doc, bucket in parts:
                own = np.bincount(doc, minlength=len(n_words))
                ends = np.cumsum(own)
                sums = np.r_[0, np.cumsum(taken.take(pa.array(bucket)).to_numpy())]
                n, total = n + own, total + sums[ends] - sums[ends - own]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored (doc_id, eligible, score, row) with `rank`: the place from 1 among the eligible by descending score, then doc_id, of the percent that is drawn.

    Rows are dealt by ranges of that order, which repeated scores and ids cannot
    skew since row parts them; places are those within a range and the few sizes
    of the ranges before it.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    able = stored(scored.where("eligible").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = able.groupBy("range").agg(F.count("*").alias("n"))
    w = Window.orderBy("range")  # a row a range
    before = sizes.select("range", (F.sum("n").over(w) - F.col("n")).alias("before"), (F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)).alias("most"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = able.join(F.broadcast(before), "range").withColumn("rank", place)
    out = out.withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank"))).drop("range", "before", "most")
    return out.unionByName(scored.where("not eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text, any others), drawn towards target (text).

    weight: floored mean gain of the features (0 without any); score: with Gumbel
    noise of seed and doc_id, so that the highest are a draw without replacement;
    rank: place among the percent drawn of rows with least_words words or more,
    else null. Null texts are empty, and very long ones taken whole; a null
    doc_id has the noise of an empty one and comes last among equals. Repeated
    rows count, score and are drawn each, in an arbitrary order among themselves.
    Columns beside doc_id and text are ignored, whatever their names. An empty
    docs gives no row; an empty target has no feature, so that all gains follow
    from docs alone.
    """
    by_bucket = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = docs.mapInArrow(_weigher(by_bucket, longest), "doc_id long, n_words long, n_features long, weight long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    return ranked(stored(scored, "scored"), percent).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum is folded over the bytes of each distinct feature, by a table that follows from the polynomial.
SQL = r"""
with recursive steps as (select i::ubigint as i, i::ubigint as c, 0 as k from range(256) t(i)
 union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from steps where k < 8),
crcs as (select list(c order by i) as tab from steps where k = 8),
texts as (select 'd' as side, doc_id as id, text from documents union all select 'b', row_number() over (), text from benchmark),
word_lists as (select side, id, row_number() over () as row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from texts),
feats as (select side, id, row, len(ws) as n_words, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from word_lists),
uniq as (select f, hex(encode(f)) as h from (select distinct f from feats)),
bucketed as (select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint) % 10000 as bucket from uniq, crcs),
fb as (select side, id, row, bucket from feats join bucketed using (f)),
counts as (select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t from fb group by bucket),
totals as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from counts),
gain as (select bucket, floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint as g from counts, totals),
weights as (select row, count(*) as n_features, floor(sum(g)::double / count(*))::bigint as weight from fb join gain using (bucket) where side = 'd' group by row),
scored as (select id as doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, len(ws) >= 20 as able,
   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::varchar, '')), 1, 8))::ubigint::double + 0.5) / 4294967296))))::bigint as score
 from word_lists left join weights using (row) where side = 'd'),
placed as (select *, row_number() over (partition by able order by score desc, doc_id) as place, count(*) over (partition by able) as n from scored)
select doc_id, n_features, weight, score, case when able and place <= n * 25 // 100 then place end as rank from placed
"""
