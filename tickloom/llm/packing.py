"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LENGTH = 2048
END = 1
#: Cost of a piece of n tokens: n + ATTENTION * n * n, attention being within pieces.
ATTENTION = 1 / 4096
#: Characters that are packed together; about 500 sequences.
BLOCK_CHARS = 2_000_000
#: What a row counts for beside its characters: empty texts are packed too.
ROW_CHARS = 64
_CACHE = 400_000


class ByteBpe:
    """Ids of byte_bpe_50k.json, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    Merges never cross a single space between two other characters, so that the
    parts between such spaces are encoded once and kept. Texts with other white
    space beside spaces, or with the vocabulary's special string, go whole.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str) -> None:
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(json_path)
        self.parts = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile(r"\s\s|^ | $|<\|endoftext\|>")
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 16-bit numbers."""
        if not text:
            return b""
        if self.odd.search(text):
            if "<|endoftext|>" in text:
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
            return np.array(self.parts.encode_ordinary(text), np.uint16).tobytes()
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        for p in set(parts).difference(cache):
            cache[p] = np.array(self.parts.encode_ordinary(p), np.uint16).tobytes()
        return b"".join(map(cache.__getitem__, parts))


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def _pieces(paths: tuple[str, str, str]):
    """Pieces of whole sequences, without their ids, and what is left of each document, with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ByteBpe(*paths)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(text if isinstance(text, str) else "") + END.to_bytes(2, "little")
                n, at = len(ids) // 2, 0
                while n - at >= LENGTH:
                    out.append((doc, at, LENGTH, _crc(ids[2 * at : 2 * (at + LENGTH)]), n, None))
                    at += LENGTH
                if at < n:
                    out.append((doc, at, n - at, None, n, ids[2 * at :]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).astype(
                {"doc_id": "Int64", "ids_crc32": "Int64"}
            )

    return run


def assign(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, first token in it, tokens, sequence, offset) for pieces of at most `capacity` tokens.

    As few sequences as can hold all. In descending order, each piece goes to the
    sequence of the lowest cost that has room; where none has, it is cut and
    fills the roomiest. Equal lengths and costs go by position.
    """
    total = int(lengths.sum())
    count = -(-total // capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        at, left = 0, int(lengths[i])
        while left:
            fits = room >= left
            s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[s]))
            out.append((int(i), at, n, s, capacity - int(room[s])))
            room[s] -= n
            cost[s] += n + ATTENTION * n * n
            at, left = at + n, left - n
    return out


def _packed(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["doc_id", "start", "length"], kind="stable").reset_index(drop=True)
    whole = g[g["ids"].isna()]
    rest = g[g["ids"].notna()].reset_index(drop=True)
    base = int(g["block"].iloc[0]) << 32
    out = [(d, s, n, c, t, base + k, 0) for k, (d, s, n, c, t) in enumerate(zip(whole.doc_id, whole.start, whole.length, whole.ids_crc32, whole.doc_tokens, strict=True))]
    base += len(whole)
    for i, at, n, sequence, offset in assign(rest["length"].to_numpy()):
        ids = rest["ids"][i][2 * at : 2 * (at + n)]
        out.append((rest.doc_id[i], int(rest.start[i]) + at, n, _crc(ids), rest.doc_tokens[i], base + sequence, offset))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "ids_crc32": "int64"})


def pack(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, any others) in sequences of at most 2048 tokens.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document's ids are those of its text, then id 1; a
    null text is empty. Full sequences are cut off first; the rest, less than one
    sequence a document, is dealt by row, whatever its id and text, into blocks of
    about BLOCK_CHARS, and each block is packed by descending length into the cheapest sequences with
    room, so that at most one sequence's worth of padding remains in a block.
    Repeated rows are packed each; a null doc_id is kept. An empty table gives an
    empty result. paths: tokenizer file, rank file, pattern.
    """
    if paths is None:
        import public_tokenizers

        paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars, rows = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    blocks = int((chars + ROW_CHARS * rows) // BLOCK_CHARS + 1)
    pieces = docs.mapInPandas(_pieces(paths), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return (
        pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
