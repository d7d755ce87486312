"""Importance resampling against a plain version, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tickloom.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\x00--", "One two", "One two", "été é\tÉ x-y a1", "a " * 40_000, " ".join(f"w{i}" for i in range(30_000)), *["the same words again and again, " * 5] * 30]


def plain(docs, target, percent, longest, buckets, least):
    def feats(t):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    a, b = sum(s.values()), sum(t.values())
    out = []
    for d, x in docs:
        n, f = feats(x)
        g = sum(math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in f)
        weight = g // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((o for o in out if o[4]), key=lambda o: (-o[3], math.inf if o[0] is None else o[0]))
    most = len(able) * percent // 100
    return sorted(map(str, [(*o[:4], i + 1 if i < most else None) for i, o in enumerate(able)] + [(*o[:4], None) for o in out if not o[4]]))


def taken(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (1, 7, 50, 1), (4, 500, 100, 3)])
def test_resample(spark, longest, buckets, percent, least):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "One two"), (None, "no id here " * 9), (None, "no id here " * 9), (70, "again and again, the same words " * 4)]
    target = ["The same words, again!", None, "", "x-y a1 no"]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, range int").repartition(5)
    got = rs.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, longest, buckets, least)
    assert taken(got) == plain(docs, target, percent, longest, buckets, least)


def test_resample_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rs.resample(docs.limit(0), docs.select("text")).collect() == []
    assert taken(rs.resample(docs, docs.select("text").limit(0), 100, least_words=1)) == plain([(1, "a b")], [], 100, 2, 10_000, 1)
