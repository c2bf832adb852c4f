"""Token counts of whole texts by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks.  Where two chunks
overlap, both give token starts; a start common to both at a position where no
token of any longer text can cross (a proven stable boundary) is the splice:
tokens before it are counted from the left chunk, the rest from the right one.
Without such a position the overlap is widened, then the chunk doubled.

Stable boundaries of the word vocabulary:

- next to white space, which is dropped before merging;
- before an ASCII character that is neither letter nor part of a special token's
  name when it follows a letter or digit, since runs of letters end there, digits
  stand alone, and ASCII never composes with what precedes it;
- between two letters that compose with nothing, if no entry of the vocabulary
  has the last byte of the one followed by the first byte of the other: merges
  only ever make entries, so none reaches across.  In scripts that the vocabulary
  spells by bytes this holds between most letters.
"""

from __future__ import annotations

import os
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from drover.llm.common import map_texts

SPACE = regex.compile(r"\p{White_Space}")
PIECE = regex.compile(r"\P{White_Space}+")
#: Characters str.split() takes for white space and the vocabulary does not.
NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
LAST_SPACE = regex.compile(r"(?r)\p{White_Space}")
#: Longer pieces (in characters) are not cached from text to text.
LONG = 256


def _composing() -> frozenset[str]:
    """Characters that can compose with one before them: second parts of
    canonical decompositions, and the Hangul vowels and finals."""
    second = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
              if len(d) == 2 and not d[0].startswith("<")}
    return frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCounter:
    """Counts tokens with the library that defines the vocabulary."""

    def __init__(self, spec: str, chunk: int, overlap: int, max_cached_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.names = {c for t in self.tok.get_added_tokens_decoder().values() for c in t.content}
        self.composing = _composing()
        byte_of = _bytes_of_symbols()
        self.joined: set[tuple[int, int]] = set()  # bytes that follow each other in some entry
        for entry in self.tok.get_vocab(with_added_tokens=False):
            known = [byte_of[c] for c in entry.removesuffix("</w>") if c in byte_of]
            self.joined.update(zip(known, known[1:]))
        self.counts: dict[str, int] = {}
        self.cached_chars, self.max_cached_chars = 0, max_cached_chars
        self.offsets: dict[str, list[int]] = {}  # token starts of the long pieces of the text in hand

    # Pieces between white space are encoded on their own: white space is a
    # stable boundary on both sides, so a piece has the same tokens anywhere.
    def _pieces(self, text: str) -> list[str]:
        return PIECE.findall(text) if NOT_SPACE.search(text) else text.split()

    def _learn(self, pieces: set[str]) -> None:
        """Counts of pieces; short ones are kept, as many as fit in the cache."""
        new = [p for p in pieces if p not in self.counts]
        chars = sum(map(len, new))
        if self.cached_chars + chars > self.max_cached_chars:
            self.counts.clear()
            new, self.cached_chars = list(pieces), 0
            chars = sum(map(len, new))
        self.cached_chars += chars
        for i in range(0, len(new), 4096):
            part = new[i: i + 4096]
            got = self.tok.encode_batch_fast(part, add_special_tokens=False)
            self.counts.update(zip(part, map(len, got)))

    def _encoded(self, piece: str) -> list[int]:
        """Token starts of a piece; a long one is encoded once for the counts and both its splices."""
        got = self.offsets.get(piece)
        if got is None:
            got = [a for a, _ in self.tok.encode(piece, add_special_tokens=False).offsets]
            if len(piece) > LONG:
                self.offsets[piece] = got
        return got

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Starts in [begin, end) of the tokens of ``text``, from the pieces
        that reach into that stretch."""
        last = LAST_SPACE.search(text, 0, begin)
        found = []
        for m in PIECE.finditer(text, last.end() if last else 0):
            if m.start() >= end:
                break
            found += [m.start() + a for a in self._encoded(m.group())]
        return found

    def _lone(self, c: str) -> bytes | None:
        """Bytes of a letter after normalisation, if it composes with nothing before it."""
        if not c.isalpha() or c in self.composing or unicodedata.combining(c):
            return None
        return unicodedata.normalize("NFC", c).lower().encode()

    def _stable(self, text: str, at: int) -> bool:
        here, last = text[at], text[at - 1]
        if SPACE.match(last) or SPACE.match(here):
            return True
        if here.isascii() and not here.isalnum():
            return last.isalnum() and here not in self.names and last not in self.names
        a, b = self._lone(last), self._lone(here)
        return bool(a and b) and (a[-1], b[0]) not in self.joined

    def _splice(self, text: str, lo: int, mid: int, hi: int, right_end: int):
        """(position, tokens of the left chunk [lo, hi) from it on, tokens of the
        right chunk [mid, right_end) before it), or None."""
        stable = [p for p in range(mid + 1, min(hi, right_end)) if self._stable(text, p)]
        if not stable:
            return None
        left = [lo + x for x in self._starts(text[lo:hi], mid - lo, hi - lo)]
        right = [mid + x for x in self._starts(text[mid:right_end], 0, hi - mid)]
        common = sorted(set(left).intersection(right).intersection(stable))
        if not common:
            return None
        p = common[len(common) // 2]
        return p, sum(x >= p for x in left), sum(x < p for x in right)

    def chunks(self, text: str) -> list[tuple[int, int, int]]:
        """Borders of overlapping chunks and the corrections at their splices."""
        n, out, lo, size = len(text), [], 0, self.chunk
        while True:
            hi = min(n, lo + size)
            if hi == n:
                out.append((lo, hi, 0))
                return out
            overlap, cut = self.overlap, None
            while cut is None and overlap < hi - lo:
                mid = hi - overlap
                cut = self._splice(text, lo, mid, hi, min(n, mid + max(self.chunk, 2 * overlap)))
                overlap *= 4  # no common stable boundary: look further back
            if cut is None:  # none in the whole chunk: let it grow
                size *= 2
                continue
            out.append((lo, hi, cut[1] + cut[2]))
            lo, size = mid, self.chunk

    def _long(self, text: str) -> int:
        """Tokens of a text of several chunks."""
        self.offsets.clear()
        total = 0
        for lo, hi, less in self.chunks(text):
            pieces = self._pieces(text[lo:hi])
            short = [p for p in pieces if len(p) <= LONG]
            self._learn(set(short))
            total += sum(map(self.counts.__getitem__, short)) - less
            total += sum(len(self._encoded(p)) for p in pieces if len(p) > LONG)
        self.offsets.clear()
        return total

    def count(self, texts: list[str]) -> list[int]:
        whole = [self._pieces(t) if len(t) <= self.chunk else None for t in texts]
        self._learn(set().union(*(p for p in whole if p is not None)))
        get = self.counts.__getitem__
        got = [sum(map(get, p)) if p is not None else None for p in whole]  # before the cache can turn over
        return [self._long(t) if n is None else n for t, n in zip(texts, got)]


_COUNTERS: dict[tuple, ChunkCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep_cols: list[str] | None = None,
                 chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text, as the
    tokenizers library counts them without added special tokens, truncation or
    padding; special strings inside a text follow the library's default.

    Null and empty texts have 0 of both; repeated rows count alike; an empty
    table stays empty; input columns named like an output are replaced.
    ``chunk`` and ``overlap`` are characters and don't change the result.  The
    vocabulary file is read on the driver and sent to the executors (2 MB)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        key = (hash(spec.value), chunk, overlap)
        if key not in _COUNTERS:
            _COUNTERS[key] = ChunkCounter(spec.value, chunk, overlap)
        counter = _COUNTERS[key]

        def run(texts: list) -> dict:
            texts = [t or "" for t in texts]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counter.count(texts)}
        return run

    out = {"n_bytes": ("bigint", pa.int64()), "n_tokens": ("bigint", pa.int64())}
    return map_texts(docs, make, out, text_col, keep_cols)
