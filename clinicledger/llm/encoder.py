"""Token ids of whole texts by a public tokenizer file, on Arrow columns.

Every pre-token of the tokenizer lies between two white spaces, so a text's
ids are those of its white-space separated chunks in order.  Three more facts
save work and change no id: in ASCII chunks A-Z may be lower-cased first where
the tokenizer lower-cases itself; a letter and following signs other than an
apostrophe are always different pre-tokens; and where each pre-token's last id
ends a word, new words of plain letters are encoded many to a line and cut
there.  So a batch's distinct chunks are cut into letters and signs by Arrow,
and each worker encodes a distinct piece once and looks it up afterwards; at
``MEMO`` pieces a new table is begun and the one before kept for what is still
met, so memory is bounded.  Per word of a text there is no Python step.
``tests/llm`` holds the result against the library's encoding of whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: file used unless another is given
TOKENIZER = "word_bpe_49k.json"
#: pieces remembered by a worker in each of two tables, about 200 bytes each,
#: and their ids
MEMO, MEMO_IDS = 250_000, 4_000_000
#: signs that end a run of letters, and the letters of Latin-1: no two of them
#: compose, so their normal form is themselves, and each has one lower case
_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = f"^{_LETTERS}[{re.escape(_SIGNS)}]*$"
#: words encoded at once
LINE = 64
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> "Encoder":
    """This process's encoder of a tokenizer file."""
    path = path or tokenizer_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _starts(sizes: np.ndarray) -> np.ndarray:
    """The n + 1 places at which parts of these sizes begin and end."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


class _Memo:
    """Rows of the pieces met, and each row's ids; row 0 has none."""

    def __init__(self, dtype: np.dtype):
        self.row: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, dtype)
        self.starts = np.zeros(2, np.int64)

    def full(self) -> bool:
        return len(self.row) > MEMO or len(self.ids) > MEMO_IDS

    def find(self, pieces: list[str]) -> np.ndarray:
        """Each piece's row, -1 if it isn't here."""
        return np.fromiter(map(self.row.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of distinct new pieces."""
        rows = np.arange(len(pieces)) + len(self.row)
        self.row.update(zip(pieces, rows.tolist()))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        return rows

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids back to back, and their sizes."""
        sizes = self.sizes(rows)
        to = _starts(sizes)
        return self.ids[np.arange(to[-1]) + np.repeat(self.starts[rows] - to[:-1], sizes)], sizes


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits_words = "\\s" in json.dumps(spec["pre_tokenizer"]) and any(
            n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"}
            for n in (spec.get("normalizer") or {}).get("normalizers", ())
        )
        self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", ()))
        suffix = spec["model"].get("end_of_word_suffix")
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.zeros(self.vocabulary, bool)
        if suffix and self.splits_words and self.lowers:
            self.ends_word[[k for piece, k in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.memo = self.older = _Memo(self.dtype)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts back to back, and their sizes."""
        parts = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), self.dtype, int(sizes.sum())), sizes

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``whole`` for words of plain letters, a line of them at a time."""
        if not self.ends_word.any():
            return self.whole(words)
        ids = self.whole([" ".join(words[k:k + LINE]) for k in range(0, len(words), LINE)])[0]
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self.whole(words)

    def rows(self, pieces: list[str], letters: np.ndarray) -> np.ndarray:
        """Rows of distinct pieces in ``memo``; ``letters`` marks those of
        plain letters only."""
        out = self.memo.find(pieces)
        new = np.flatnonzero(out < 0)
        if self.older is not self.memo:
            old = self.older.find([pieces[k] for k in new.tolist()])
            at = new[old >= 0]
            out[at] = self.memo.add([pieces[k] for k in at.tolist()], *self.older.take(old[old >= 0]))
            new = new[old < 0]
        for at, encode in ((new[letters[new]], self.words), (new[~letters[new]], self.whole)):
            for k in range(0, len(at), 1 << 15):
                some = at[k:k + (1 << 15)]
                part = [pieces[k] for k in some.tolist()]
                out[some] = self.memo.add(part, *encode(part))
        return out

    def chunks(self, chunks: list[str]) -> list[str]:
        """The piece to encode for each chunk that is looked up whole."""
        # special tokens are found before lower-casing
        return [c.lower() if c.isascii() and "<" not in c else c for c in chunks] if self.lowers else chunks

    def pairs(self, chunks: pa.Array) -> np.ndarray:
        """Rows of the two pieces of each distinct chunk (none holds white
        space), letters and signs, or the chunk and nothing; these hold until
        the next call."""
        if self.memo.full():
            self.memo, self.older = _Memo(self.dtype), self.memo
        out = np.zeros((len(chunks), 2), np.int64)
        plain = np.zeros(len(chunks), bool)
        if self.lowers:
            found = pc.match_substring_regex(chunks, _PLAIN)
            plain = found.to_numpy(zero_copy_only=False)
        if plain.any():
            lower = pc.utf8_lower(chunks.filter(found))
            # the same bytes with twice the offsets
            cuts = np.repeat(np.frombuffer(lower.buffers()[1], np.int32)[lower.offset:lower.offset + len(lower) + 1], 2)[:-1]
            cuts[1::2] += pc.binary_length(pc.ascii_rtrim(lower, characters=_SIGNS)).to_numpy()
            pieces = pa.StringArray.from_buffers(2 * len(lower), pa.py_buffer(cuts), lower.buffers()[2]).dictionary_encode()
            letters = pc.match_substring_regex(pieces.dictionary, f"^{_LETTERS}").to_numpy(zero_copy_only=False)
            rows = self.rows(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), letters)
            out[plain] = rows[pieces.indices.to_numpy()].reshape(-1, 2)
        rest = self.chunks(chunks.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
        names = list(dict.fromkeys(rest))
        row = dict(zip(names, self.rows(names, np.zeros(len(names), bool)).tolist()))
        out[~plain, 0] = np.fromiter(map(row.__getitem__, rest), np.int64, len(rest))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column and the n + 1 offsets of its texts;
        a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.splits_words:
            ids, sizes = self.whole(texts.to_pylist())
            return ids, _starts(sizes)
        lists = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(lists.flatten())
        pairs = self.pairs(words.dictionary)
        ids, sizes = self.memo.take(pairs.ravel())
        # ids of the distinct chunks once, as bytes that Arrow copies by place
        width = self.dtype.itemsize
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(pairs), [None, pa.py_buffer(_starts(sizes)[::2] * width), pa.py_buffer(ids)]
        ).take(words.indices)
        _, ends, data = parts.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(parts) + 1] // width
        offsets = lists.offsets.to_numpy()
        ends = ends[offsets - offsets[0]]
        return np.frombuffer(data or b"", self.dtype)[:ends[-1]], ends

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.splits_words:
            return np.diff(self.encode(texts)[1])
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = pc.dictionary_encode(lists.flatten())
        sizes = self.memo.sizes(self.pairs(words.dictionary)).sum(axis=1)
        offsets = lists.offsets.to_numpy()
        return np.diff(_starts(sizes[words.indices.to_numpy()])[offsets - offsets[0]])
