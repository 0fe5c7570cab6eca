"""Operator 12: secret scan by a linear-chain conditional random field.

Base rules find assignments to secret names, access keys and long lower-case
hexadecimal runs.  They are also the labels from which a conditional random
field learns what secrets look like, so that it adds those the rules' exact
forms miss (other alphabets and cases, values after other words).

A text's tokens are its runs of letters and digits and its single signs.  Each
is tagged as secret begin (B), inside (I) or outside (O).  Features: the
token's shape (length, digits, case, hexadecimal or not; which sign), the two
words before and the word after it (those tied to secrets in the sample), the
characters beside it, and the file (assignments, digits, capitals).  I can't
follow O.  The weights are fitted by maximum likelihood with an L2 penalty.

Decoding is exact Viterbi over whole texts.  A token whose score for O exceeds
the others by more than any change of tags around it could repay is O on every
best path; texts are cut there, and the stretches between, most of them short,
are decoded side by side.

The fit takes windows around tokens of a bounded sample of documents, those
with secrets also in capitals and without their neighbours; scanning
covers all rows and texts, and shuffles nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import stored
from clinicledger.llm.shingles import ALNUM, NON_SPACE, batches_by_bytes, span_hashes, text_bytes

#: fixed values: the base rules, as the contract of the query states them
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "added")

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_DIGIT, _UPPER, _ANY_HEX = np.zeros((3, 256), np.int32)
_DIGIT[0x30:0x3A] = _UPPER[0x41:0x5B] = 1
_ANY_HEX[[*range(0x30, 0x3A), *range(0x41, 0x47), *range(0x61, 0x67)]] = 1
#: classes of characters beside a token; 0: the text's begin or end
_BESIDE = np.full(256, 1, np.uint8)
for _k, _signs in enumerate((" ", "\n\r\t\x0b\x0c", "\"'`", "=", ":", "_-", "+/", ".,;", "()[]{}<>", "@#$%&*", "!?"), 2):
    _BESIDE[[ord(c) for c in _signs]] = _k
_BESIDE[ALNUM] = 13
_LENGTHS = np.array([4, 8, 12, 16, 24, 40])
B, I, O = 0, 1, 2  # noqa: E741
#: neighbouring words known to a model, and values of each feature
WORDS = 63
SIZES = (256, WORDS + 1, WORDS + 1, WORDS + 1, 16, 16, 8)


@dataclass
class Tokens:
    """Tokens of a batch of texts: byte ranges in ``data``, each text's range
    of tokens, and what their features are made of."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text: np.ndarray
    shape: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    words: np.ndarray  # hashes of the tokens that are words
    word: np.ndarray  # words up to and with each token
    is_word: np.ndarray

    def near(self, names: np.ndarray, step: int) -> np.ndarray:
        """``names`` (a value per word) of the word ``step`` words from each
        token, 0 outside its text."""
        at = self.word - 1 + np.where((step < 0) & ~self.is_word, step + 1, step)
        bounds = np.r_[0, self.word][self.first]
        inside = (at >= bounds[self.text]) & (at < bounds[self.text + 1])
        return np.where(inside, names[np.where(inside, at, 0)] if len(names) else 0, 0)


def tokenise(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    n = len(data)
    alnum = ALNUM[data]
    sign = NON_SPACE[data] & ~alnum
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = alnum.copy(), alnum.copy()
    begins[1:] &= ~alnum[:-1] | edge[1:-1]
    stops[:-1] &= ~alnum[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins | sign), np.flatnonzero(stops | sign) + 1
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    is_word = alnum[starts]
    size = ends - starts

    def count(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts], sums[offsets[1:]] - sums[offsets[:-1]]

    (digits, file_digits), (upper, file_upper), (hexes, _) = (count(t) for t in (_DIGIT, _UPPER, _ANY_HEX))
    letters = size - digits
    digit = np.where(digits == 0, 0, np.where(2 * digits < size, 1, np.where(digits < size, 2, 3)))
    case = np.where(upper == 0, 0, np.where((upper == letters) & (letters > 1), 1, np.where((upper == 1) & (_UPPER[data[starts]] > 0), 2, 3)))
    shape = ((np.searchsorted(_LENGTHS, size, side="right") * 4 + digit) * 4 + case) * 2 + (hexes == size)
    shape = np.where(is_word, shape, 224 + _BESIDE[data[starts]]).astype(np.uint8)
    before = np.where(edge[starts], 0, _BESIDE[data[starts - 1]]).astype(np.uint8) if n else np.zeros(0, np.uint8)
    after = np.where(edge[ends], 0, _BESIDE[data[np.minimum(ends, n - 1)]]).astype(np.uint8) if n else np.zeros(0, np.uint8)
    length = np.maximum(np.diff(offsets), 1)
    equals = np.zeros(len(length), bool)
    equals[np.searchsorted(offsets, np.flatnonzero(data == 0x3D), side="right") - 1] = True
    file = (equals * 1 + (50 * file_digits > length) * 2 + (4 * file_upper > length) * 4).astype(np.uint8)
    words = span_hashes(data, starts[is_word], ends[is_word])
    return Tokens(data, offsets, starts, ends, first, text, shape, before, after, file, words, np.cumsum(is_word), is_word)


def positions(text: np.ndarray) -> np.ndarray:
    """Byte position of each code point of a UTF-8 text, and its length."""
    return np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]


def base_spans(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of each text with any: (start, kind, end, start of the secret itself)
    of the base rules' matches in code points, in order."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    named = pc.match_substring_regex(texts, _HINT).to_numpy(zero_copy_only=False)
    keyed = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(named | keyed).tolist():
        text = texts[row].as_py()
        out = []
        if named[row]:
            out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
        if keyed[row]:
            out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        if out:
            found[row] = out
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEX[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(data) else cuts[:0]
    turns = np.sort(np.concatenate([turns, cuts, cuts]))  # a run ends where its text does
    long = turns[1::2] - turns[0::2] >= HEX_LEAST
    for start, end in zip(turns[0::2][long].tolist(), turns[1::2][long].tolist()):
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        here = np.count_nonzero((data[offsets[row]:start] & 0xC0) != 0x80)
        found.setdefault(row, []).append((here, 2, here + end - start, here))
    return {row: sorted(spans) for row, spans in found.items()}


@dataclass
class Model:
    """Weights (a table per feature, a column per tag), transitions from row
    to column, and the hashes of the known neighbouring words."""

    tables: list[np.ndarray]
    moves: np.ndarray
    known: np.ndarray

    def features(self, tokens: Tokens) -> list[np.ndarray]:
        names = np.zeros(len(tokens.words), np.uint8)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, tokens.words), len(self.known) - 1)
            names = np.where(self.known[at] == tokens.words, at + 1, 0).astype(np.uint8)
        return [
            tokens.shape, tokens.near(names, -1), tokens.near(names, -2), tokens.near(names, 1),
            tokens.before, tokens.after, tokens.file[tokens.text],
        ]

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(table[f] for table, f in zip(self.tables, features))

    def slack(self) -> float:
        """The most that the tags beside a token gain in transitions if it is
        B or I instead of O (an I after it turning to B)."""
        t = self.moves
        turn = [B, B, O]
        return max(
            (t[a, s] + t[s, b] + t[b, c]) - (t[a, O] + t[O, turn[b]] + t[turn[b], c])
            for a in (B, I, O) for s in (B, I) for b in (B, I, O) for c in (B, I, O)
            if min(t[a, s], t[s, b], t[b, c]) > _NEVER
        )

    def tags(self, features: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """The best tags of all tokens; ``first``: each text's range."""
        scores = self.scores(features)
        n = len(scores)
        tags = np.full(n, O, np.int8)
        if not n:
            return tags
        repay = np.r_[np.maximum(scores[1:, I] - scores[1:, B], 0), 0]
        sure = scores[:, O] - scores[:, :O].max(axis=1) > self.slack() + repay + 1e-3
        text_begins = np.zeros(n + 1, bool)
        text_begins[first] = True
        opens = ~sure & (np.r_[True, sure[:-1]] | text_begins[:-1])
        closes = ~sure & (np.r_[sure[1:], True] | text_begins[1:])
        at, length = np.flatnonzero(opens), np.flatnonzero(closes) - np.flatnonzero(opens) + 1
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(length) // 2_000_000)) + 1):
            if len(some):
                self._decode(scores, at[some], length[some], tags)
        return tags

    def _decode(self, scores: np.ndarray, at: np.ndarray, length: np.ndarray, tags: np.ndarray) -> None:
        """Viterbi over stretches between two O, longest first."""
        best = self.moves[O] + scores[at]
        ends = self.moves[:, O]
        back = []
        for step in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -step, side="left"))
            paths = best[:live, :, None] + self.moves
            from_ = paths.argmax(axis=1)
            back.append(from_.astype(np.int8))
            best[:live] = np.take_along_axis(paths, from_[:, None], axis=1)[:, 0] + scores[at[:live] + step]
        tag = (best + ends).argmax(axis=1)
        for step in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -step, side="left"))
            tags[at[:live] + step] = tag[:live]
            if step:
                tag[:live] = back[step - 1][np.arange(live), tag[:live]]


_NEVER = -1e8


def _no_model() -> Model:
    """Tags nothing."""
    tables = [np.zeros((size, 3), np.float32) for size in SIZES]
    tables[0][:, O] = 1e3
    moves = np.zeros((3, 3))
    moves[O, I] = 10 * _NEVER
    return Model(tables, moves, np.zeros(0, np.uint64))


def fit_crf(features: list[np.ndarray], tags: np.ndarray, mask: np.ndarray, known: np.ndarray, rounds: int = 60, l2: float = 2e-4) -> Model:
    """Maximum likelihood by Adam.  ``features``, ``tags`` and ``mask`` have a
    row per window; a window lies between two O."""
    n, width = tags.shape
    where = np.flatnonzero(mask.ravel())
    flat = [f.ravel()[where] for f in features]
    at = np.cumsum([0, *SIZES])
    p = np.zeros(at[-1] * 3 + 9)
    allowed = np.ones((3, 3), bool)
    allowed[O, I] = False
    gold = np.zeros((n * width, 3))
    gold[where, tags.ravel()[where]] = 1
    truth = np.where(mask, tags, O)
    moved = np.zeros((3, 3))
    last = mask.sum(axis=1)
    path = np.concatenate([np.full((n, 1), O), truth, np.full((n, 1), O)], axis=1)
    for step in range(width + 1):
        live = last >= step
        np.add.at(moved, (path[live, step], np.where(last[live] == step, O, path[live, step + 1])), 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for round_ in range(1, rounds + 1):
        w = p[:-9].reshape(-1, 3)
        t = np.where(allowed, p[-9:].reshape(3, 3), -50.0)
        score = np.zeros((n * width, 3))
        score[where] = sum(w[at[k] + f] for k, f in enumerate(flat))
        score = score.reshape(n, width, 3)
        forth, back = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        forth[:, 0] = t[O] + score[:, 0]
        for step in range(1, width):
            on = lse(forth[:, step - 1, :, None] + t, 1) + score[:, step]
            forth[:, step] = np.where(mask[:, step, None], on, forth[:, step - 1])
        back[:, -1] = t[:, O]
        for step in range(width - 2, -1, -1):
            on = lse(t + (score[:, step + 1] + back[:, step + 1])[:, None, :], 2)
            back[:, step] = np.where(mask[:, step + 1, None], on, t[:, O])
        total = lse(forth[:, -1] + t[:, O], 1)
        share = np.exp(np.minimum(forth + back - total[:, None, None], 0)).reshape(-1, 3)
        expected = np.zeros((3, 3))
        expected[O] += share.reshape(n, width, 3)[:, 0].sum(axis=0)
        np.add.at(expected[:, O], slice(None), share.reshape(n, width, 3)[np.arange(n), last - 1].sum(axis=0))
        for step in range(1, width):
            both = forth[:, step - 1, :, None] + t + (score[:, step] + back[:, step])[:, None, :] - total[:, None, None]
            expected += np.exp(np.minimum(both[mask[:, step]], 0)).sum(axis=0)
        wrong = (share - gold)[where]
        grad = np.concatenate([
            np.concatenate([np.stack([np.bincount(f, weights=wrong[:, s], minlength=size) for s in range(3)], axis=1) for f, size in zip(flat, SIZES)]).ravel(),
            np.where(allowed, expected - moved, 0).ravel(),
        ]) / n + l2 * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p - 0.15 * (m / (1 - 0.9 ** round_)) / (np.sqrt(v / (1 - 0.99 ** round_)) + 1e-12)
    w = p[:-9].reshape(-1, 3).astype(np.float32)
    return Model([w[a:b] for a, b in zip(at, at[1:])], np.where(allowed, p[-9:].reshape(3, 3), 10 * _NEVER), known)


#: documents of the sample, windows with and without secrets of it, and tokens
#: on each side of a window's middle
SAMPLE, WITH, WITHOUT, SIDE = 20_000, 800, 1_600, 8
_WINDOW = "secret boolean, raw binary, words binary, tags binary"


def _labels(tokens: Tokens, spans: dict[int, list[tuple[int, int, int, int]]]) -> np.ndarray:
    """Tags of all tokens by the base rules' secrets."""
    tags = np.full(len(tokens.starts), O, np.int8)
    for row, found in spans.items():
        text = tokens.data[tokens.offsets[row]:tokens.offsets[row + 1]]
        byte = positions(text) + tokens.offsets[row]
        reach = -1
        for _, _, end, start in sorted(found, key=lambda s: s[3]):
            low, high = byte[start], byte[end]
            a, b = np.searchsorted(tokens.ends, low, side="right"), np.searchsorted(tokens.starts, high)
            if low >= reach:
                tags[a:a + 1] = B
                tags[a + 1:b] = I
            else:  # it overlaps the one before
                tags[a:b] = np.where(tags[a:b] == O, I, tags[a:b])
            reach = max(reach, high)
    return tags


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around secrets, words with digits, long words, and some of the
    other tokens; texts with secrets a second time in capitals."""
    for whole in batches:
        for batch in batches_by_bytes(whole, "text"):
            texts = batch.column("text")
            data, offsets = text_bytes(texts)
            spans = base_spans(pc.fill_null(texts, ""), data, offsets)
            small_letters = (data >= 0x61) & (data <= 0x7A)
            rows: list[tuple[bool, bytes, bytes, bytes]] = []
            for shift in (0, 0x20):
                tokens = tokenise(data - (small_letters * shift).astype(np.uint8), offsets)
                tags = _labels(tokens, spans)
                raw = np.stack([tokens.shape, tokens.before, tokens.after, tokens.file[tokens.text]], axis=1)
                near = np.stack([np.where(tokens.near(np.ones(len(tokens.words), bool), k), tokens.near(tokens.words, k), np.uint64(0)) for k in (-1, -2, 1)], axis=1)
                striking = tokens.is_word & (((tokens.shape >> 3) % 4 > 0) | (tokens.ends - tokens.starts >= 16))
                ordinary = np.arange(len(tags)) % 101 == 50
                if shift:
                    keep = np.isin(tokens.text, list(spans))
                    striking, ordinary = striking & keep, ordinary & keep
                reach = -1
                for middle in np.flatnonzero((tags != O) | striking | ordinary).tolist():
                    if middle < reach:
                        continue
                    row = tokens.text[middle]
                    a, b = max(tokens.first[row], middle - SIDE), min(tokens.first[row + 1], middle + SIDE)
                    while a > tokens.first[row] and tags[a] == I and middle - a < 2 * SIDE:
                        a -= 1
                    if tags[a] != I and not (b < tokens.first[row + 1] and tags[b] == I):
                        rows.append((bool((tags[a:b] != O).any()), raw[a:b].tobytes(), near[a:b].astype("<u8").tobytes(), tags[a:b].tobytes()))
                    reach = b
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["secret", "raw", "words", "tags"])


def _vocabulary(windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted hashes of the words most tied to being beside a secret's begin."""
    beside, every = Counter(), Counter()
    for words, tags in windows:
        every.update(words[words != 0].ravel().tolist())
        near = words[tags == B]
        beside.update(near[near != 0].ravel().tolist())
    total, all_ = max(sum(beside.values()), 1), max(sum(every.values()), 1)
    ratio = {w: c * np.log(max(c / total / (every[w] / all_), 1e-9)) for w, c in beside.items() if c >= 5}
    best = [w for w, r in sorted(ratio.items(), key=lambda x: (-x[1], x[0])) if r > 10][:WORDS]
    return np.array(sorted(best), np.uint64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the base rules on at most ``sample`` documents (``doc_id``,
    ``text``; those of the smallest hashes of doc_id), at most ``WITH`` windows
    with and ``WITHOUT`` windows without secrets.  Without any secret in the
    sample the model tags nothing."""
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded by sample
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(chosen, "doc_id")
    found = stored(texts.select("text").mapInArrow(_windows, _WINDOW), "secret-windows")
    order = F.xxhash64("raw", "words", "tags")
    rows = [
        r for secret, most in ((True, WITH), (False, WITHOUT))
        for r in found.filter(F.col("secret") == secret).orderBy(order, "raw", "words", "tags").limit(most).toArrow().to_pylist()
    ]
    if not any(r["secret"] for r in rows):
        return _no_model()
    raw = [np.frombuffer(r["raw"], np.uint8).reshape(-1, 4) for r in rows]
    words = [np.frombuffer(r["words"], "<u8").reshape(-1, 3) for r in rows]
    tags = [np.frombuffer(r["tags"], np.int8) for r in rows]
    # windows with secrets once more without what stands around: shape alone
    bare = [k for k, r in enumerate(rows) if r["secret"]]
    raw += [np.where([True, False, False, True], raw[k], _BESIDE[0x20]) for k in bare]
    words, tags = words + [np.zeros_like(words[k]) for k in bare], tags + [tags[k] for k in bare]
    known = _vocabulary(list(zip(words, tags)))
    width = max(len(t) for t in tags)
    padded = lambda parts, fill: np.stack([np.r_[p, np.full(width - len(p), fill, p.dtype)] for p in parts])

    def named(column: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(column), np.int64)
        at = np.minimum(np.searchsorted(known, column), len(known) - 1)
        return np.where(known[at] == column, at + 1, 0)

    features = [
        padded([r[:, 0] for r in raw], 0), *[padded([named(w[:, k]) for w in words], 0) for k in range(3)],
        *[padded([r[:, k] for r in raw], 0) for k in (1, 2, 3)],
    ]
    mask = padded([np.ones(len(t), bool) for t in tags], False)
    return fit_crf([f.astype(np.int64) for f in features], padded(tags, O).astype(np.int64), mask, known)


def added_spans(model: Model, tokens: Tokens) -> dict[int, list[tuple[int, int]]]:
    """Of each text with any: byte ranges in it of the tagged secrets."""
    tags = model.tags(model.features(tokens), tokens.first)
    found: dict[int, list[tuple[int, int]]] = {}
    begins = np.flatnonzero(tags == B)
    outside = np.flatnonzero(np.r_[tags != I, True])
    text_ends = tokens.first[tokens.text[begins] + 1]
    for a, b in zip(begins.tolist(), np.minimum(outside[np.searchsorted(outside, begins + 1)], text_ends).tolist()):
        row = int(tokens.text[a])
        low = int(tokens.offsets[row])
        found.setdefault(row, []).append((int(tokens.starts[a]) - low, int(tokens.ends[b - 1]) - low))
    return found


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text"):
                texts = pc.fill_null(batch.column("text"), "")
                data, offsets = text_bytes(texts)
                base = base_spans(texts, data, offsets)
                added = added_spans(model.value, tokenise(data, offsets))
                counts = np.zeros((batch.num_rows, 4), np.int64)
                names = ["", *([""] * (batch.num_rows - 1))][:batch.num_rows]
                digests = [_EMPTY] * batch.num_rows
                for row in sorted({*base, *added}):
                    text = data[offsets[row]:offsets[row + 1]]
                    mine = base.get(row, [])
                    extra = []
                    if row in added:
                        at = positions(text)
                        for low, high in added[row]:
                            start, end = int(np.searchsorted(at, low)), int(np.searchsorted(at, high))
                            if all(end <= s or e <= start for s, _, e, _ in mine):
                                extra.append((start, 3, end))
                    spans = [(s, k, e) for s, k, e, _ in mine]
                    say = lambda part: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in part)
                    digests[row] = hashlib.sha256(say(spans).encode()).hexdigest()
                    names[row] = say(sorted(spans + extra))
                    counts[row] = np.bincount([k for _, k, _ in spans + extra], minlength=4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(3)],
                     pa.array(digests, pa.string()), pa.array(names, pa.string()), pa.array(np.ascontiguousarray(counts[:, 3]))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
                )
    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``; other columns are
    ignored): the number of base spans by kind, the digest of their list,
    ``spans`` (``kind:start:end`` in code points, base and ``added`` ones, by
    start) and ``n_added``.  A base span is the rule's whole match; an added
    span overlaps none.

    Null and empty texts have no spans; rows without doc_id and repeated rows
    are scanned like any; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(docs.sparkSession.sparkContext.broadcast(model)),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long",
    )


def secret_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``scan`` with a model fitted on ``docs``."""
    return scan(docs, fit(docs, sample))
