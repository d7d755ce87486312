"""Near copies among documents that share much with all others: the same links, without comparing all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ngram_join, partenum

from .test_operators import groups


def texts():
    rng = np.random.default_rng(4)
    unique = iter(range(10**6))
    own = lambda n: [f"u{next(unique)}" for _ in range(n)]
    passage, lines = [f"p{i}" for i in range(120)], [[f"l{j}x{i}" for i in range(14)] for j in range(14)]
    edited = lambda words, at: [*words[:at], *own(1), *words[at + 1 :]]
    out = []
    for _ in range(150):  # half of each is the passage
        out.append([*own(50), *passage, *own(50)])
    for i in range(12):
        out.append(edited(out[i], 0))
    for _ in range(12):  # hardly anything but common lines
        out.append([w for j in rng.permutation(14)[:11] for w in lines[j]])
    for _ in range(60):  # long, with little in common
        out.append([*own(700), *passage[:20], *own(700)])
    for i in range(6):
        out.append(edited(out[-1 - i], 300))
    cluster = own(160)
    for _ in range(100):  # a large group of near copies
        words = list(cluster)
        for at in rng.integers(0, 160, rng.integers(0, 6)):
            words[at] = own(1)[0]
        out.append(words)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("k", "percent", "crowd"), [(5, 80, 16), (4, 85, 3)])
def test_crowded_buckets(spark, monkeypatch, k, percent, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd, raising=False)
    met, compared = [], ngram_join._compared

    def spied(buckets, groups, *more):
        of = buckets.join(groups.toDF("cls", "component"), "cls", "left").select("sig", F.coalesce("component", "cls").alias("label"))
        by = of.groupBy("sig", "label").count().groupBy("sig").agg(F.sum("count").alias("n"), F.max("count").alias("largest"), F.count("*").alias("labels")).where("labels > 1")
        met.append(by.agg(F.sum(F.col("n") * (F.col("n") - F.col("largest")))).first()[0] or 0)
        return compared(buckets, groups, *more)

    monkeypatch.setattr(ngram_join, "_compared", spied)
    rows = list(enumerate(texts()))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(rows, k, percent)
    assert len(met) == 2 and max(met) < 50_000, met


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_keys(percent):
    """A signature, where common elements are left out of both, and one of the rarest elements."""
    rng = np.random.default_rng(percent)
    for common in (0, 0.1, 0.6, 1):
        levels = np.where(rng.random(1 << partenum.COUNT_BITS) < common, rng.integers(1, 9, 1 << partenum.COUNT_BITS), 0).astype(np.uint8)
        for n in [*range(1, 60), *rng.integers(60, 3000, 40)]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = len(a) - -(-percent * len(a) // 100)
            lost = int(rng.integers(0, most + 1))
            b = a[rng.permutation(len(a))[lost:]]
            more = 100 * len(b) // percent - len(a)
            b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, int(rng.integers(0, max(0, more) + 1)), dtype=np.uint64))))
            assert partenum.linked(a, b, percent)
            for keys in (partenum.signatures, partenum.prefix):
                assert len(np.intersect1d(keys(a, percent, levels=levels), keys(b, percent, levels=levels)))
    assert not len(partenum.prefix(np.empty(0, np.uint64), percent, levels)) and not len(partenum.signatures(np.empty(0, np.uint64), percent, levels))


def test_levels():
    counts = np.full(4096, 100)
    counts[[5, 7, 9]] = 181, 300, 5000
    assert np.flatnonzero(partenum.levels_of(counts)).tolist() == [5, 7, 9] and (np.diff(partenum.levels_of(counts)[[5, 7, 9]].astype(int)) > 0).all()
    assert partenum.levels_of(np.array([0, 0, 0, 32, 33])).astype(bool).tolist() == [False] * 4 + [True]
