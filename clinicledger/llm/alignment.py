"""Operator 11: alignment of two tokenizers over the same texts.

Both tokenizers cut a text (with a space before it) into byte ranges.  With
the byte axis shared, each is a token-byte incidence matrix in CSR form; the
row products of A and B-transposed (Gustavson: a row of the product merges the
rows of B-transposed that the row of A names) are the pairs of tokens whose
ranges overlap.  Bytes where tokens of both end cut the text into groups; a
token-group incidence matrix of each gives, column by column, how many token
pairs share a group.

Neither tokenizer has a token across the place where a word meets the space
or newline after it (checked on the files when they are opened), so that
groups end there and a text is the concatenation of its chunks.  A worker
encodes and multiplies each distinct chunk once; its table is emptied at
``MEMO`` chunks.  Files for which this doesn't hold are applied to whole texts.

Each document's distinct id pairs are written once with its digests; counting
in how many documents a pair stands, and summing these counts per document,
are joins on that table.  Pair counts are broadcast if few; else only the most
frequent are, and the others, which are rare each, meet by shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import BROADCAST_ROWS, small, stored
from clinicledger.llm.encoder import tokenizer_path
from clinicledger.llm.shingles import batches_by_bytes

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: chunks remembered by a worker (about 250 bytes each besides their text,
#: groups and pairs), and bytes of these
MEMO, MEMO_BYTES = 400_000, 100 << 20
#: white space and the word after it, up to a space or newline
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_SPACE = "▁"
_aligners: dict[tuple[str, str], "Aligner"] = {}


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (counts[0] of them), begin[1], .."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


def row_products(ap: np.ndarray, ai: np.ndarray, bp: np.ndarray, bi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two 0/1 matrices in CSR form (pointers, columns): row,
    column and value of its entries, by row and column."""
    reach = bp[ai + 1] - bp[ai]
    rows = np.repeat(np.repeat(np.arange(len(ap) - 1), np.diff(ap)), reach)
    cols = bi[ranges(bp[ai], reach)]
    if np.any((rows[1:] == rows[:-1]) & (cols[1:] < cols[:-1])):
        order = np.lexsort((cols, rows))
        rows, cols = rows[order], cols[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], cols[first], np.diff(np.r_[first, len(rows)])


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level tokenizers print bytes: those that
    are printable in Latin-1 as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        self.by_chunk = not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.pieces[k] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before texts itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(names)
        ]
        across = re.compile(f"[^{_SPACE}]{_SPACE}|\n")
        self.by_chunk = not any(across.search(p) for p in names)
        self.newline = self.model.encode("\n")
        self.by_chunk &= len(self.newline) == 2 and self.pieces[self.newline[1]] == b"\n"

    def encode(self, chunks: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return self.model.encode([c[1:] for c in chunks], num_threads=1)
        # after a newline no space is put, and no token reaches over it
        return [ids[2:] for ids in self.model.encode(["\n" + c for c in chunks], num_threads=1)]


def aligner(path_a: str, path_b: str) -> "Aligner":
    """This process's aligner of two files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.by_chunk = self.a.by_chunk and self.b.by_chunk
        self.shift = len(self.b.pieces).bit_length()  # an id pair is a << shift | b
        self.bytes = [np.frombuffer(b"".join(side.pieces), np.uint8) for side in (self.a, self.b)]
        self.spans = [np.r_[0, np.cumsum([len(p) for p in side.pieces])] for side in (self.a, self.b)]
        names = [str(k).encode() for k in range(max(len(self.a.pieces), len(self.b.pieces)))]
        self.digits = np.frombuffer(b"".join(names), np.uint8), np.r_[0, np.cumsum([len(x) for x in names])]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.numbers = np.zeros((0, 6), np.int64)  # n_a, n_b, n_groups, n_links, n_shared, whole
        self.groups: list[bytes] = []  # each with a semicolon after it
        self.first = np.zeros(1, np.int64)  # a chunk's range of pairs
        self.pairs = np.zeros(0, np.int64)
        self.size = 0

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.by_chunk else [" " + text]

    def spelled(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after another."""
        spans = self.spans[side]
        return self.bytes[side][ranges(spans[ids], spans[ids + 1] - spans[ids])]

    def align(self, chunks: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of each chunk: its six numbers, its groups' text, how many links,
        and the id pairs of all links."""
        n = len(chunks)
        data = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, data), np.int64, n)
        ids, of = [], []
        whole = np.ones(n, bool)
        for side, coder in enumerate((self.a, self.b)):
            coded = coder.encode(chunks)
            ids.append(np.fromiter(chain.from_iterable(coded), np.int64))
            of.append(np.repeat(np.arange(n), np.fromiter(map(len, coded), np.int64, n)))
            spans = self.spans[side]
            whole &= np.bincount(of[side], weights=spans[ids[side] + 1] - spans[ids[side]], minlength=n) == sizes
        for last in (False, True):  # texts of other lengths go first, then those of other bytes
            keep = [whole[rows] for rows in of]
            ids, of = [k[m] for k, m in zip(ids, keep)], [r[m] for r, m in zip(of, keep)]
            if not last:
                text = np.frombuffer(b"".join([d for d, w in zip(data, whole) if w]), np.uint8)
                byte_of = np.repeat(np.flatnonzero(whole), sizes[whole])
                for side in (0, 1):
                    whole[byte_of[self.spelled(side, ids[side]) != text]] = False
        ends = [np.cumsum(self.spans[side][k + 1] - self.spans[side][k]) for side, k in enumerate(ids)]
        n_bytes = int(ends[0][-1]) if len(ends[0]) else 0
        # A by its bytes; B transposed: a row per byte
        at_b = np.repeat(np.arange(len(ids[1])), np.diff(np.r_[0, ends[1]]))
        rows, cols, _ = row_products(np.r_[0, ends[0]], np.arange(n_bytes), np.arange(n_bytes + 1), at_b)
        cut = np.intersect1d(ends[0], ends[1], assume_unique=True)
        group = [np.searchsorted(cut, e) for e in ends]
        members = [np.bincount(g, minlength=len(cut)) for g in group]  # columns of the group incidence
        group_of = of[0][np.searchsorted(ends[0], cut)] if len(cut) else np.zeros(0, np.int64)
        count = lambda where, weight=None: np.bincount(where, weights=weight, minlength=n).astype(np.int64)
        links = count(of[0][rows])
        numbers = np.stack([
            count(of[0]), count(of[1]), count(group_of), links, count(group_of, members[0] * members[1]), whole.astype(np.int64),
        ], axis=1)
        # each token's id and the sign after it, by group, A before B
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        ident = np.concatenate(ids)[order]
        sign = np.full(len(ident), ord(","), np.uint8)
        stops = np.cumsum(np.stack(members, axis=1).ravel()) - 1
        sign[stops[0::2]], sign[stops[1::2]] = ord("|"), ord(";")
        width = self.digits[1][ident + 1] - self.digits[1][ident] + 1
        out = self.digits[0][np.minimum(ranges(self.digits[1][ident], width), len(self.digits[0]) - 1)]
        out[np.cumsum(width) - 1] = sign
        bounds = np.r_[0, np.cumsum(np.bincount(np.concatenate(of)[order], weights=width, minlength=n).astype(np.int64))].tolist()
        text = out.tobytes()
        return numbers, [text[x:y] for x, y in zip(bounds, bounds[1:])], links, ids[0][rows] << self.shift | ids[1][cols]

    def learn(self, chunks: list[str]) -> None:
        found = [(self.numbers, self.groups, np.diff(self.first), self.pairs)]
        for at in range(0, len(chunks), 16384):
            part = chunks[at:at + 16384]
            found.append(self.align(part))
            self.memo.update(zip(part, range(len(self.memo), len(self.memo) + len(part))))
            self.size += sum(map(len, part)) + sum(map(len, found[-1][1])) + 8 * len(found[-1][3])
        self.numbers, self.pairs = (np.concatenate([f[k] for f in found]) for k in (0, 3))
        self.groups = list(chain.from_iterable(f[1] for f in found))
        self.first = np.r_[0, np.cumsum(np.concatenate([f[2] for f in found]))]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links, n_shared; its groups'
        digest; and of all texts the offsets, id pairs and times of links."""
        if len(self.memo) > MEMO or self.size > MEMO_BYTES:
            self.clear()
        lists = [self.chunks(t) if t else [] for t in texts]
        every = [c for chunks in lists for c in chunks]
        self.learn([c for c in dict.fromkeys(every) if c not in self.memo])
        at = np.fromiter(map(self.memo.__getitem__, every), np.int64, len(every))
        row = np.repeat(np.arange(len(texts)), [len(c) for c in lists])
        missing = np.bincount(row, weights=1 - self.numbers[at, 5], minlength=len(texts)) > 0
        keep = ~missing[row]
        at, row = at[keep], row[keep]
        numbers = np.stack([np.bincount(row, weights=self.numbers[at, k], minlength=len(texts)) for k in range(5)], axis=1).astype(np.int64)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        names = at.tolist()
        digests = [
            hashlib.sha256(b"".join([self.groups[k] for k in names[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(bounds, bounds[1:])
        ]
        links = self.first[at + 1] - self.first[at]
        bits = 2 * self.shift + 2
        if len(texts) << bits >= 1 << 63 or len(self.a.pieces) >> (bits - self.shift):
            raise ValueError("batch or vocabulary too large for pair keys")
        found, times = np.unique(np.repeat(row, links) << bits | self.pairs[ranges(self.first[at], links)], return_counts=True)
        offsets = np.searchsorted(found, np.arange(len(texts) + 1) << bits)
        return numbers, digests, offsets, found & ((1 << bits) - 1), times


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                numbers, digests, offsets, pairs, times = both.documents(batch.column("text").to_pylist())
                lists = [pa.ListArray.from_arrays(offsets.astype(np.int32), v) for v in (pairs, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(5)], pa.array(digests, pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"],
                )
    return run


def link_rows(docs: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """A written row per row of ``docs`` (``doc_id``, ``text``): ``row``, the
    numbers and digest of its alignment, and its distinct linked id pairs
    (``pairs``, a << shift | b) with their ``times``."""
    path_a, path_b = file_a or tokenizer_path(FILE_A), file_b or tokenizer_path(FILE_B)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(
        _aligned(path_a, path_b),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, times array<int>",
    )
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame, shift: int) -> DataFrame:
    """Written: ``pair``, ``n_docs`` (rows of ``rows`` that hold it linked)
    and ``best`` (no pair of its A id has more)."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair-counts")
    ids = F.shiftright("pair", shift)
    highest = counts.groupBy(ids.alias("a")).agg(F.max("n_docs").alias("highest"))  # a row per id of A at most
    named = counts.withColumn("a", ids).join(F.broadcast(highest), "a")
    return stored(named.select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")), "pairs")


def _sums(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``row``, ``n_best``, ``count_sum`` of the rows with links."""
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    partial = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    total = lambda found: found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    if counts.count() <= most:
        return links.join(F.broadcast(counts), "pair").groupBy("row").agg(*partial)
    frequent = stored(counts.orderBy(F.desc("n_docs"), "pair").limit(most), "pairs-frequent")  # bounded by most
    known = links.join(F.broadcast(frequent), "pair").groupBy("row").agg(*partial)
    left = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
    others = counts.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
    return total(known.unionByName(left.join(others, "pair").groupBy("row").agg(*partial)))


def vocabulary_map(docs: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """Linked id pairs of two tokenizers over ``docs``: ``a_id``, ``b_id``,
    ``n_docs`` and ``best``."""
    shift = Pieces(file_b or tokenizer_path(FILE_B)).model.get_piece_size().bit_length()
    counts = pair_counts(link_rows(docs, file_a, file_b), shift)
    return counts.select(
        F.shiftright("pair", shift).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << shift) - 1)).alias("b_id"), "n_docs", "best"
    )


def alignments(docs: DataFrame, file_a: str | None = None, file_b: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``; other columns are
    ignored): tokens of A and B, groups, links, the links whose pair stands in
    no fewer documents than any pair of their A id (``n_best``), the sum of
    their pairs' documents, the digest of the groups' ids, and ``n_shared``
    (token pairs in one group).

    Null and empty texts, and texts whose tokens' bytes differ from the text
    (with a space before it) have no tokens: zeros and an empty digest.
    Repeated rows are documents of their own.  ``most``: pair counts that are
    broadcast at most; the result is the same for any.
    """
    shift = Pieces(file_b or tokenizer_path(FILE_B)).model.get_piece_size().bit_length()
    rows = link_rows(docs, file_a, file_b)
    sums = _sums(rows, pair_counts(rows, shift), most)
    none = F.lit(0).cast("long")
    return rows.join(small(stored(sums, "link-sums")), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", "n_shared",
    )
