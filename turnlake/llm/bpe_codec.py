"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that its encoding can end with: the token t such that the prefix
without t ends with a token p, and (p, t) is a pair that byte-pair merging would leave side by side. Keeping that last
token for every prefix makes appending exact (only new prefixes are filled in) and re-encoding after an edit local (the
prefixes before the edit stay). Each
Python worker remembers the pieces that it met and the last tokens of prefixes that many pieces share.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.shared import small_batches

#: Most pieces, prefixes and pairs that a worker remembers; beyond that it forgets them and starts anew (memory only, no effect on results).
PIECES_KEPT, HEADS_KEPT, PAIRS_KEPT = 120_000, 60_000, 200_000
#: Prefixes whose length is a multiple of this, a power of two, are remembered across pieces.
STRIDE = 4
#: Prefixes and pieces longer than this, a multiple of STRIDE, are not remembered but filled in anew (memory only, no effect on results).
LONGEST_KEPT = 256
NO_LIMIT = 1 << 40
#: Rows whose results a worker holds at once.
ROWS_AT_ONCE = 64


class _Kept(dict):
    """A dict that makes missing values by a function and forgets all when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder for one file of ranks (lines of base64 token and rank) and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.halves = [self._halves(x) for x in range(len(self.tokens))]
        self.merges = {(pair[0] << 32) | pair[1]: token for token, pair in enumerate(self.halves) if pair}
        #: Suffix tree of the tokens: node << 8 | byte before it gives the next node; ends gives the token that a node spells.
        self.suffixes: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in reversed(token):
                way = (node << 8) | byte
                node = self.suffixes.setdefault(way, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = rank
        self.fits = _Kept(self._fits, PAIRS_KEPT)
        self.splitter = regex.compile(pattern)
        self.heads = _Kept(self._head, HEADS_KEPT)
        self.pieces = _Kept(self._encode_piece, PIECES_KEPT)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that no merge makes."""
        parts = [self.ranks[bytes([x])] for x in self.tokens[token]]
        while len(parts) > 2:
            merged = [self.ranks.get(self.tokens[x] + self.tokens[y], NO_LIMIT) for x, y in zip(parts, parts[1:], strict=False)]
            least = min(merged)
            if least >= token:
                break
            at = merged.index(least)
            parts[at : at + 2] = [least]
        return tuple(parts) if len(parts) == 2 else None

    def _fits(self, pair: int) -> bool:
        """Whether merging would leave these two tokens, left << 32 | right, side by side.

        The merges of both tokens are undone, latest first. If at some point the two tokens that touch make a token of a
        lower rank than the merge undone last, merging would have joined them across the border.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        merges, halves, limit = self.merges, self.halves, NO_LIMIT
        while True:
            if merges.get((left << 32) | right, NO_LIMIT) < limit:
                return False
            undone = halves[left] if left > right else None
            if undone is None and (undone := halves[right]) is not None:
                limit, right = right + 1, undone[0]
            elif undone is not None or (undone := halves[left]) is not None:
                limit, left = left, undone[1]
            else:
                return True

    def fill(self, data: bytes, last: list[int]) -> list[int]:
        """Extend last, each prefix's last token, to all prefixes of data; len(last) prefixes are known already.

        Walking back from a prefix's end through the suffix tree meets all tokens that it can end with.
        """
        following, ends, fits = self.suffixes.get, self.ends, self.fits
        for end in range(len(last), len(data)):
            node, start = 0, end
            while (node := following((node << 8) | data[start])) is not None:
                token = ends[node]
                if token >= 0 and (not start or fits[(last[start - 1] << 32) | token]):
                    last.append(token)
                    break
                start -= 1
                if start < 0:
                    raise ValueError("no token ends this prefix")
            else:
                raise ValueError("no token ends this prefix")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the longest prefix in last."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def _head(self, head: bytes) -> list[int]:
        """Last tokens of a prefix of at most LONGEST_KEPT bytes that many pieces share; pieces append to it."""
        return self.fill(head, self.heads[head[:-STRIDE]].copy() if len(head) > STRIDE else [])

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.walk(self.fill(data, self.heads[data[: min(len(data) - 1, LONGEST_KEPT) & -STRIDE]].copy()))
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Give back the memory of remembered pieces and prefixes."""
        self.pieces.clear()
        self.heads.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        pieces, make = self.pieces, self._encode_piece
        return b"".join([pieces[x] if len(x) <= LONGEST_KEPT else make(x) for x in self.splitter.findall(text)]) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[x] for x in np.frombuffer(ids, "<u4").tolist()]) if ids else b""


class PieceState:
    """One piece of text with the last token of each of its prefixes, for appends and edits."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, data, codec.fill(data, [])

    def append(self, more: bytes) -> PieceState:
        """Exactly the encoding of data + more; the known prefixes are not filled in again."""
        self.data += more
        self.codec.fill(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PieceState:
        """Replace data[start:end]; prefixes up to start stay as they are."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        self.codec.fill(self.data, self.last)
        return self

    def ids(self) -> list[int]:
        whole = self.codec.ranks.get(self.data)
        return [whole] if whole is not None else self.codec.walk(self.last)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(ranks_path, pattern)


def encode_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of each whole text (binary, little-endian unsigned 32-bit integers); null and empty texts give none."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([own.encode(x) for x in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for values in batches:
            yield pd.Series([own.decode(x) for x in values], dtype=object)

    return decode(ids)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids, decoded) for each row of docs: its tokens and what they decode to, from one pass of a worker.

    Nulls: a null text is empty (no ids), a null id stays null. Repeated rows give repeated rows, an empty table an empty
    one; other columns of docs are not read, so their names cannot clash.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for texts in batches:
            for at in range(0, len(texts), ROWS_AT_ONCE):
                ids = [own.encode(x) for x in texts.iloc[at : at + ROWS_AT_ONCE]]
                yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]})
        own.forget()

    return docs.select(F.col(id_col), both(F.col(text_col)).alias("both")).select(id_col, "both.ids", "both.decoded")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
