"""Byte-level BPE encoding and decoding over a public vocabulary file.

Short words are merged as contiguous arrays: one row per word holds its part
ids and the ranks of adjacent pairs; the lowest rank (leftmost on ties) is
merged, its boundary deleted by closing the gap, and the two neighbouring ranks
are looked up again.  Words of like length are rows of one matrix.  Long words
use a heap over linked parts, which gives the same merges in n log n."""

from __future__ import annotations

import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from drover.llm.common import map_texts

# Fixed values (the vocabulary's published split pattern; white space is the
# Unicode property) ------------------------------------------------------------
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# -------------------------------------------------------------------------------

NO_RANK = np.int32(2**31 - 1)
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1
    stands for itself, the other bytes for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder for one vocabulary (the JSON text of its file)."""

    def __init__(self, text: str, max_cached: int = 700_000, max_chars: int = 16_000_000):
        spec = json.loads(text)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(left * self.size + right)
        self.keys = (left * self.size + right)[order]
        self.ranks = order.astype(np.int32)
        self.pair = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(left, right))}
        self.of_byte = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.of_byte[b] = vocab[ch]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                        + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.bytes_of = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.cache: dict[str, bytes] = {}
        self.max_cached, self.max_chars, self.chars = max_cached, max_chars, 0

    # encoding -------------------------------------------------------------------
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def _merge_rows(self, ids: np.ndarray) -> None:
        """Merge every row of ``ids`` (parts, then -1) in place."""
        live = np.arange(len(ids))
        part, width = ids.copy(), ids.shape[1]
        rank = self._rank(part[:, :-1], part[:, 1:])
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(at))
            best = rank[row, at]
            go = best < NO_RANK
            if not go.all():
                ids[live[~go]] = part[~go]
                live, part, rank, at, best = live[go], part[go], rank[go], at[go], best[go]
                if not len(live):
                    return
                row = np.arange(len(at))
            part[row, at] = self.merged[best]
            cols = np.arange(width - 1)  # close the gap at the deleted boundary
            part[:, :-1] = np.take_along_axis(part, cols + (cols > at[:, None]), axis=1)
            part[:, -1] = -1
            if width > 2:
                cols = np.arange(width - 2)
                rank[:, :-1] = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            rank[:, -1] = NO_RANK
            after = np.minimum(at + 1, width - 1)
            fresh = self._rank(part[row, at], np.where(at + 1 < width, part[row, after], -1))
            has = at < width - 1
            rank[row[has], at[has]] = fresh[has]
            has = at > 0
            rank[row[has], at[has] - 1] = self._rank(part[row[has], at[has] - 1], part[row[has], at[has]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long word: a heap of (rank, position)."""
        n, pair, merged = len(ids), self.pair, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pair[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in pair]
        heapq.heapify(heap)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in pair:
                    heapq.heappush(heap, (pair[p], x, p))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        low = 0
        for width in WIDTHS:
            which = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            if len(which):
                flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in which), np.uint8)
                ids = self.of_byte[flat].reshape(-1, width)
                ids[np.arange(width) >= lens[which][:, None]] = -1
                self._merge_rows(ids)
                n = (ids >= 0).sum(axis=1) * 4
                packed = ids.astype("<u4").tobytes()
                for r, i in enumerate(which):
                    out[i] = packed[r * width * 4: r * width * 4 + n[r]]
        for i in np.flatnonzero(lens > WIDTHS[-1]):
            ids = self._merge_long(self.of_byte[np.frombuffer(raw[i], np.uint8)].tolist())
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.max_cached or self.chars + sum(map(len, new)) > self.max_chars:
            self.cache.clear()
            new, self.chars = list(words), 0
        self.chars += sum(map(len, new))
        self.cache.update(zip(new, self.encode_words(new)))

    def _words(self, text: str):
        """Blocks of words of a text (special tokens as ids), bounded in number."""
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                yield self.special[part]
            elif len(part) <= 1 << 20:
                yield self.split.findall(part)
            else:
                found = (m.group() for m in self.split.finditer(part))
                while block := list(itertools.islice(found, 1 << 17)):
                    yield block

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) > 1 << 20:  # a long text: block by block
            out = []
            for t in texts:
                ids = bytearray()
                for block in self._words(t):
                    if isinstance(block, int):
                        ids += block.to_bytes(4, "little")
                    else:
                        self._learn(set(block))
                        ids += b"".join(map(self.cache.__getitem__, block))
                out.append(bytes(ids))
            return out
        blocks = [list(self._words(t)) for t in texts]
        self._learn(set().union(*(b for doc in blocks for b in doc if not isinstance(b, int))))
        get = self.cache.__getitem__
        return [b"".join(b.to_bytes(4, "little") if isinstance(b, int) else b"".join(map(get, b)) for b in doc)
                for doc in blocks]

    # decoding -------------------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


_ENCODERS: dict[int, ByteBpe] = {}


def load(text: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    key = hash(text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(text)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                  keep_cols: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit token ids of the whole
    text), ``n_tokens`` and ``decoded`` (the text decoded from the ids).

    Null and empty texts have no tokens and decode to the empty string; rows
    repeat as they come; an empty table stays empty; input columns named like
    an output are replaced.  The vocabulary file (its path is a parameter) is
    read once on the driver and sent to the executors, a fixed 2 MB."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = load(spec.value)

        def run(texts: list) -> dict:
            ids = bpe.encode_texts([t or "" for t in texts])
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [bpe.decode(x) for x in ids]}
        return run

    out = {"ids": ("binary", pa.binary()), "n_tokens": ("bigint", pa.int64()), "decoded": ("string", pa.string())}
    return map_texts(docs, make, out, text_col, keep_cols)
