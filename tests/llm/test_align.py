"""Alignment of two tokenizers against plain loops, with odd rows."""

import hashlib
import random
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import align as al

PATHS = al.Paths(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "\n", "a", "x " * 30_000, "unbroken" * 3_000, "é　  x\u0085y", "<|endoftext|> and </s> <s><unk>", "a▁b", "a ▁b", "tab\there \t there", "it's  two", "line\nline\n\nend \n", "\x00nul \x1c y", "日本語 テキスト", "same text again", "same text again"]


def brute(rows):
    """By offsets alone: groups end where both end, links share a byte."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS.pieces)
    units = al.Tokenizers(PATHS)
    found, links = [], Counter()
    for d, t in rows:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        x, y = [units.bytes_a[i] for i in a], [units.bytes_b[i] for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            found.append((d, [], [], "", []))
            continue
        ends_a, ends_b = np.cumsum([len(i) for i in x]).tolist(), np.cumsum([len(i) for i in y]).tolist()
        cuts = np.array(sorted(set(ends_a) & set(ends_b)))
        parts = [[[] for _ in cuts] for _ in "ab"]
        for side, ids, ends in zip(parts, (a, b), (ends_a, ends_b), strict=True):
            for i, g in zip(ids, np.searchsorted(cuts, ends).tolist(), strict=True):
                side[g].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*parts, strict=True)]
        union = np.array(sorted(set(ends_a) | set(ends_b)))
        own = [(a[i], b[j]) for i, j in zip(np.searchsorted(ends_a, union).tolist(), np.searchsorted(ends_b, union).tolist(), strict=True)]
        links.update(own)
        found.append((d, a, b, groups, own))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, a, b, groups, own in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(own), sum(links[k] == best[k[1]] for k in own), sum(links[k] for k in own), digest))
    return out, links


@pytest.mark.parametrize("block_bytes", [1, 3_000, al.BLOCK_BYTES])
def test_alignment(spark, block_bytes):
    real = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = real + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (10_004, "a")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block int, n_a int").repartition(3)
    got, counts = al.align(frame, block_bytes=block_bytes)
    want, links = brute(rows)
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == links
    key = lambda r: str((r[0] is None, r))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tokens_equal_whole_texts():
    """Parts encoded on their own give the ids of the whole text."""
    both, draw = al.Tokenizers(PATHS), random.Random(5)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    units = ["a", "Bc", " ", " ", " ", "  ", "\n", "\t", "é", "é", "'s", "12", "!?", " ", "　", "日本", "<|endoftext|>", "</s>", " ", "​", "\U0001f600", "\x1c", "\x85"]
    for _ in range(4_000):
        t = "".join(draw.choices(units, k=draw.randint(1, 12)))
        a, b, parts = whole.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t), both(t)
        if parts or both._spelled(t):
            groups = [g.split("|") for p in parts for g in p.groups.split(";")]
            assert [[int(i) for g in groups for i in g[k].split(",")] for k in (0, 1)] == [a, b]


def test_runs_skip():
    """Runs and groups of random ends cover both, in order, and agree with their common ends."""
    draw = random.Random(3)
    for _ in range(500):
        n = draw.randint(1, 200)
        a, b = (np.array(sorted({*draw.sample(range(1, n + 1), draw.randint(0, n)), n}), np.int32) for _ in range(2))
        common, at, cuts = sorted(set(a.tolist()) & set(b.tolist())), (0, 0), []
        left, right = array("i"), array("i")
        for i, j, x, y in al.runs(a, b, left, right):
            assert (i, j) == at
            at = (i + x, j + (y or x))
            cuts += a[i : i + x].tolist() if y == 0 else [int(a[i + x - 1])]
        assert cuts == common and at == (len(a), len(b))
        ends = sorted(set(a.tolist()) | set(b.tolist()))
        assert left.tolist() == np.searchsorted(a, ends).tolist() and right.tolist() == np.searchsorted(b, ends).tolist()


def test_alignment_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert [df.count() for df in al.align(none)] == [0, 0]
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, al.align(blank)[0].collect())) == [(d, 0, 0, 0, 0, "", 0, 0) for d in (1, 2)]
