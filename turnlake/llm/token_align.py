"""Alignment of two tokenizers over a corpus by distinct segments.

A text is split before single spaces between two words, where no token of either vocabulary can cross: the byte-level
splitting pattern never goes from a word on into white space, and no piece of the other vocabulary holds the character
before the space followed by a space (this is read off the vocabulary, and characters for which it is not so do not end a
segment). So a text's tokens are those of its segments in order. Each chunk of documents lists its distinct segments; all
lists are dealt by segment, so that every distinct one is tokenised once, and the tokens go back to the chunks that list it,
packed by chunk. There all segments are aligned at once and documents composed of them. Counts of linked id pairs by
documents are sums over chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.shared import small_batches, staged, unstaged

#: Characters of a chunk's texts, and its documents, after which another begins; a longer text is a chunk of its own.
CHUNK_CHARS, CHUNK_DOCS = 8 << 20, 8_000
#: Segments that a task tokenises at once, and those whose tokens it holds before it hands them on.
SEGMENTS, HELD = 5_000, 500_000
SPACE = "▁"
#: Effort at which tokens are compressed: they repeat each other, where numbers of segments are merely small.
LEVEL = 9
#: What follows an id in a list of groups.
SEPARATORS = ",|;"


class Pair:
    """The two tokenizers: byte-level tokens of one (A), pieces of the other (B), both as bytes."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        shown = {x: bytes([i]) for i, x in enumerate(byte_letters())}
        letters = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(letters.values()) + 1)
        for token, i in letters.items():
            self.a_bytes[i] = b"".join([shown[x] for x in token])
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.kind = "<u2" if max(len(self.a_bytes), len(pieces)) <= 1 << 16 else "<u4"
        self.a_length, self.b_length = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        #: An id with what follows it in a group list, by id and place in SEPARATORS.
        self.shown = [f"{i}{x}" for x in SEPARATORS for i in range(max(len(self.a_bytes), len(pieces)))]
        #: Characters that some piece has before a space inside it: after these a text is not split.
        self.joined = "".join(sorted({x for piece in pieces for x, y in zip(piece, piece[1:], strict=False) if y == SPACE}))
        odd = "  a   \u00c5A\u030a\ufb01  "  # spaces in a row, and letters with other forms
        plain = b"".join([self.b_bytes[i] for i in self.b.encode(odd)])
        with open(a_path) as file:
            said = json.load(file)
        splits = said["normalizer"] is None and said["pre_tokenizer"]["type"] == "ByteLevel" and said["pre_tokenizer"]["use_regex"]
        #: Tokenizers that change texts, or split them otherwise, could do so across a border, so with these texts stay whole.
        self.whole = not splits or plain != (" " + odd).encode()
        self.border = re.compile(rf" (?<=[^\s{re.escape(self.joined)}] )(?=\S)")

    def segments(self, text: str) -> list[str]:
        """The segments of a text; a space stands before each, the first included."""
        return [text] if self.whole else self.border.split(text)

    def codes(self, segments: list[str]) -> Iterator[bytes]:
        """Each segment's tokens with its space: the number of A's as 32 bits, then the ids of A and of B; no token where a side does not spell it."""
        for segment, a, b in zip(segments, self.a.encode_batch_fast([" " + x for x in segments], add_special_tokens=False), self.b.encode(segments, num_threads=1), strict=True):
            ids, own = a.ids, (" " + segment).encode()
            fits = b"".join([self.a_bytes[i] for i in ids]) == own == b"".join([self.b_bytes[i] for i in b])
            yield np.uint32(len(ids)).tobytes() + np.array(ids + b, dtype=self.kind).tobytes() if fits else bytes(4)


@lru_cache(maxsize=1)
def byte_letters() -> str:
    """The letters by which byte-level vocabularies show the bytes 0 to 255: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {x: 0x100 + i for i, x in enumerate(x for x in range(256) if x not in set(shown))}
    return "".join(chr(others.get(x, x)) for x in range(256))


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One pair for each Python worker."""
    return Pair(a_path, b_path)


def chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row (chunk, ids, lengths, order, segments) for each run of documents: the distinct segments, and for each document how many it has and which, in order."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("order", pa.binary()), ("segments", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base, n = pair(a_path, b_path), TaskContext.get().partitionId() << 33, 0
        ids, lengths, order, numbers, chars = [], [], [], {}, 0

        def chunk() -> pa.RecordBatch:
            row = {"chunk": base + n, "ids": ids, "lengths": lengths, "order": squeezed(np.concatenate(order)), "segments": list(numbers)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (chars + len(text or "") > CHUNK_CHARS or len(ids) == CHUNK_DOCS):
                    yield chunk()
                    ids, lengths, order, numbers, chars, n = [], [], [], {}, 0, n + 1
                found = own.segments(text) if text else []
                order.append(np.array([numbers.setdefault(x, len(numbers)) for x in found], dtype="<i4"))
                ids.append(doc_id)
                lengths.append(len(found))
                chars += len(text or "")
        if ids:
            yield chunk()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(split, "chunk long, ids array<long>, lengths array<int>, order binary, segments array<string>")


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest bytes first, compressed: most numbers are small."""
    width = numbers.dtype.itemsize
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


PACKED = "of long, places binary, sizes binary, codes binary"


def packed_codes(listed: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Tokens of the segments that chunks list (of, place, segment), packed: rows (of, places, sizes, codes), several for each chunk.

    Rows are dealt by segment and sorted, so each distinct segment is tokenised once. A chunk lists it once, so a segment
    has at most as many rows as there are chunks.
    """
    schema = pa.schema([("of", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, code = pair(a_path, b_path), None, b""
        of, places, held, codes, n = [], [], [], [], 0

        def flush() -> None:
            nonlocal last, code
            segments = pa.chunked_array(held).to_pylist()
            fresh = [x for x, before in zip(segments, [last, *segments], strict=False) if x != before]
            made = own.codes(fresh)
            for x in segments:
                if x != last:
                    last, code = x, next(made)
                codes.append(code)
            held.clear()

        def packs() -> Iterator[pa.RecordBatch]:
            chunk, place = np.concatenate(of), np.concatenate(places).astype("<i4")
            order = np.argsort(chunk, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(chunk[order])) + 1).tolist(), len(order)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                some = [codes[x] for x in order[i:j].tolist()]
                sizes = np.array([len(x) for x in some], dtype="<i4")
                row = [[int(chunk[order[i]])], [squeezed(place[order[i:j]])], [squeezed(sizes)], [zstandard.compress(b"".join(some), LEVEL)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                of.append(batch.column(0).to_numpy())
                places.append(batch.column(1).to_numpy())
                held.append(batch.column(2))
                n += batch.num_rows
                if sum(len(x) for x in held) >= SEGMENTS:
                    flush()
                if n >= HELD:
                    if held:
                        flush()
                    yield from packs()
                    of, places, codes, n = [], [], [], 0
        if n:
            if held:
                flush()
            yield from packs()

    return listed.select("of", "place", "segment").repartition("segment").sortWithinPartitions("segment").mapInArrow(encode, PACKED)


FULL = "chunk long, ids array<long>, lengths array<int>, order binary, n_a binary, n_b binary, a binary, b binary"
PAIRS = "chunk long, pair long, docs long"
DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def filled(row: pd.DataFrame, packs: pd.DataFrame, kind: str) -> pd.DataFrame:
    """A chunk's row with the tokens of its segments, in the order of its list; a segment that does not fit has none."""
    codes = [b""] * sum(len(unsqueezed(x, "<i4")) for x in packs["places"])
    for places, sizes, data in zip(packs["places"], packs["sizes"], packs["codes"], strict=True):
        whole, end = zstandard.decompress(data), 0
        for place, size in zip(unsqueezed(places, "<i4").tolist(), unsqueezed(sizes, "<i4").tolist(), strict=True):
            codes[place] = whole[end : end + size]
            end += size
    width = np.dtype(kind).itemsize
    n_a = [int.from_bytes(x[:4], "little") for x in codes]
    middle = [4 + n * width for n in n_a]
    return row[["chunk", "ids", "lengths", "order"]].assign(
        n_a=squeezed(np.array(n_a, dtype="<i4")),
        n_b=squeezed(np.array([(len(x) - m) // width for x, m in zip(codes, middle, strict=True)], dtype="<i4")),
        a=zstandard.compress(b"".join([x[4:m] for x, m in zip(codes, middle, strict=True)]), LEVEL),
        b=zstandard.compress(b"".join([x[m:] for x, m in zip(codes, middle, strict=True)]), LEVEL),
    )


class Chunk:
    """A chunk with the alignment of all its segments, one after the other.

    Both tokenizers spell the same bytes, so in the union of the offsets at which their tokens end every stretch between
    two offsets is one link, that of the tokens which cover it; where both end, a group ends, and so does every segment.
    """

    def __init__(self, row: dict, own: Pair):
        self.own, self.ids, self.lengths = own, row["ids"], np.asarray(row["lengths"], dtype=np.int64)
        self.order = unsqueezed(row["order"], "<i4")
        self.a, self.b = (np.frombuffer(zstandard.decompress(row[x]), own.kind).astype(np.int64) for x in ("a", "b"))
        self.n_a, self.n_b = (unsqueezed(row[x], "<i4").astype(np.int64) for x in ("n_a", "n_b"))
        self.ends_a, self.ends_b = np.cumsum(own.a_length[self.a]), np.cumsum(own.b_length[self.b])
        cuts = np.union1d(self.ends_a, self.ends_b)
        of_a, of_b = np.searchsorted(self.ends_a, cuts), np.searchsorted(self.ends_b, cuts)
        self.links = self.a[of_a] << 32 | self.b[of_b]
        both = (self.ends_a[of_a] == cuts) & (self.ends_b[of_b] == cuts)
        self.groups = cuts[both]
        last = np.concatenate([[0], self.ends_a])[np.cumsum(self.n_a)]
        self.link_ends = np.searchsorted(cuts, last, side="right")
        self.n_links = np.diff(self.link_ends, prepend=0)
        self.n_groups = np.diff(np.searchsorted(self.groups, last, side="right"), prepend=0)
        self.ends = np.cumsum(self.lengths)
        self.fits = (self.lengths > 0) & (self.over_docs(self.n_a == 0) == 0)

    def over_docs(self, of_segment: np.ndarray) -> np.ndarray:
        """Sums of a segment's values over the segments of each document."""
        total = np.concatenate([[0], np.cumsum(of_segment[self.order].astype(np.int64))])
        return total[self.ends] - total[self.ends - self.lengths]

    def docs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Place and segments of each document that fits."""
        for i in np.flatnonzero(self.fits):
            yield i, self.order[self.ends[i] - self.lengths[i] : self.ends[i]]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of the chunk and the number of its documents that hold each linked."""
        pairs, number = np.unique(self.links, return_inverse=True)
        counts = np.zeros(len(pairs), dtype=np.int64)
        for _, order in self.docs():
            held = np.unique(order)
            n = self.n_links[held]
            at = np.repeat(self.link_ends[held] - np.cumsum(n), n) + np.arange(n.sum())
            counts[np.unique(number[at])] += 1
        some = counts > 0
        return pairs[some], counts[some]

    def shown(self) -> list[str]:
        """The groups of each segment as a1,a2|b1;a3|b2,b3; with an end to each group."""
        of_a, of_b = np.searchsorted(self.groups, self.ends_a), np.searchsorted(self.groups, self.ends_b)
        sign_a, sign_b = np.isin(self.ends_a, self.groups).astype(np.int64), 2 * np.isin(self.ends_b, self.groups).astype(np.int64)
        many = len(self.own.shown) // len(SEPARATORS)
        place = np.concatenate([sign_a * many + self.a, sign_b * many + self.b])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        tokens = [self.own.shown[i] for i in place[order].tolist()]
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(tokens[i:j]) for i, j in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True)]

    def documents(self, pairs: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pd.DataFrame:
        """The documents' rows, given the corpus-wide counts of the chunk's pairs, sorted."""
        at = np.searchsorted(pairs, self.links)
        at[at == len(pairs)] = 0
        known = (pairs[at] == self.links) if len(pairs) else np.zeros(len(self.links), dtype=bool)
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(np.where(known, x[at], 0) if len(pairs) else known)])[self.link_ends], prepend=0)
        of = {"n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "n_links": self.n_links, "n_best": summed(best), "count_sum": summed(docs)}
        texts, hashes = self.shown(), [""] * len(self.ids)
        for i, order in self.docs():
            hashes[i] = hashlib.sha256("".join([texts[x] for x in order.tolist()])[:-1].encode()).hexdigest()
        sums = {k: np.where(self.fits, self.over_docs(x), 0) for k, x in of.items()}
        return pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in self.ids], dtype="Int64")} | sums | {"groups_sha256": hashes})


def chunk_pairs(full: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row (chunk, pair, docs) for each id pair that documents of a chunk hold linked; pair is A's id << 32 | B's id."""
    schema = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, docs = Chunk(row, pair(a_path, b_path)).pair_counts()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["chunk"])), pa.array(pairs), pa.array(docs)], schema=schema)

    return full.mapInArrow(count, PAIRS)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    n_links: pairs of an A and a B token whose byte ranges overlap; n_best: those whose pair is held linked by as many
    documents as any pair of its A id; count_sum: documents that hold the pair, over the links. Null and empty texts, and
    texts that the tokens of either side do not spell, have zeros and ''. A null id stays null, repeated rows are
    documents of their own, a very long text is a chunk of its own, an empty table gives an empty one; other columns are
    not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    split = staged(chunks(docs, a_path, b_path, id_col, text_col))
    own = split.select(F.col("chunk").alias("of"), F.posexplode("segments").alias("place", "segment"))
    kind = pair(a_path, b_path).kind
    heads = split.select("chunk", "ids", "lengths", "order")
    full = staged(heads.groupBy("chunk").cogroup(packed_codes(own, a_path, b_path).groupBy("of")).applyInPandas(lambda row, packs: filled(row, packs, kind), FULL))
    unstaged(split)
    held = staged(chunk_pairs(full, a_path, b_path))
    counts = staged(held.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)))
    judged = counts.join(counts.groupBy("a").agg(F.max("docs").alias("most")), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    known = held.select(F.col("chunk").alias("of"), "pair").join(judged, "pair")

    def finished(row: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        return Chunk(row.iloc[0].to_dict(), pair(a_path, b_path)).documents(*(known[x].to_numpy(dtype=np.int64) for x in ("pair", "docs", "best")))

    out = staged(full.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(finished, DOCS))
    unstaged(full, held, counts)
    return out


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
