"""Spelling variant grouping: blocked Gram matrices of letter counts find the
words that can be one edit apart, the edits are verified, and every word points
at its far more frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drover.llm.common import keep

#: Letters: a-z after lower-casing, and the Latin-1 letters as they are.
RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Left words of a tile, words of either side in one product, code points of one side in memory.
TILE, STEP, CHARS = 4096, 1024, 1 << 20
#: Longer words than this are handled apart from the others of a batch.
ORDINARY = 64
LETTERS = 26 + 64
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123], _LETTER[0xC0:] = np.arange(26), np.arange(26, LETTERS)


def count_words(docs: DataFrame, min_length: int = 7, thin: int | None = None, id_col: str = "doc_id",
                text_col: str = "text", held: int = 200_000) -> DataFrame:
    """``word, n``: the letter runs of whole texts, lower-cased in A-Z only, of
    at least ``min_length`` code points, with their occurrences overall.

    With ``thin``, a run whose crc32 h of ``<id>:<run>`` it divides loses its
    code point h % length before it is measured (a null id counts as empty).
    Null and empty texts have no words; repeated rows count each; an empty
    table gives no rows; other columns are ignored.  Tasks add up at most
    ``held`` different words at a time before the shuffle adds up the rest."""
    pattern = re.compile(RUN)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                                pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for b in batches:
            for i, text in zip(b.column("id"), b.column("text")):
                text, prefix = text.as_py(), f"{i.as_py() or ''}:".encode()
                if not text:
                    continue
                for word, n in Counter(m.group().translate(_LOWER) for m in pattern.finditer(text)).items():
                    if len(word) < min_length:
                        continue
                    if thin:
                        h = zlib.crc32(prefix + word.encode())
                        if h % thin == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1:]
                            if len(word) < min_length:
                                continue
                    total[word] += n
                if len(total) >= held:
                    yield out()
        if total:
            yield out()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _block(word: Column, classes: int) -> Column:
    """Length and letters of each class (code point modulo ``classes``) of a word."""
    letters = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
    sums = [F.length(F.translate(word, "".join(c for c in letters if ord(c) % classes != k), ""))
            for k in range(classes)]
    return F.array(F.length(word), *sums)


def _later(block: Column, classes: int) -> Column:
    """The blocks whose left words a word of ``block`` meets from the right: of
    its length with one letter moved to a later class, and one letter shorter."""
    def moved(less: int, more: int):
        return lambda x, i: x + F.when(i == more, 1).otherwise(0) - F.when(i == less, 1).otherwise(0)

    def shorter(less: int):
        return lambda x, i: x - F.when((i == 0) | (i == less), 1).otherwise(0)

    met = [F.transform(block, moved(a, b)) for a in range(1, classes + 1) for b in range(a + 1, classes + 1)]
    met += [F.transform(block, shorter(a)) for a in range(1, classes + 1)]
    return F.filter(F.array(*met), lambda x: F.forall(x, lambda c: c >= 0))


class _Words:
    """Words of one side as code matrices and letter counts."""

    def __init__(self, column: pa.Array, n: np.ndarray):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.n, self.size = n, np.diff(offsets)
        width = int(self.size.max(initial=0))
        inside = np.arange(width) < self.size[:, None]
        self.codes = np.zeros((len(column), width), np.uint8)
        self.codes[inside] = flat[offsets[0]: offsets[-1]]
        row = np.repeat(np.arange(len(column)), self.size)
        counts = np.bincount(row * LETTERS + _LETTER[self.codes[inside]], minlength=len(column) * LETTERS)
        self.letters = counts.reshape(len(column), LETTERS).astype(np.float32 if width < 1 << 11 else np.float64)
        self.square = (self.letters ** 2).sum(axis=1)

    def part(self, a: int, b: int) -> "_Words":
        out = object.__new__(_Words)
        out.n, out.size, out.letters, out.square = self.n[a:b], self.size[a:b], self.letters[a:b], self.square[a:b]
        out.codes = self.codes[a:b, : int(out.size.max(initial=0))]
        return out

    @staticmethod
    def joined(parts: list["_Words"]) -> "_Words":
        if len(parts) == 1:
            return parts[0]
        out, width = object.__new__(_Words), max(p.codes.shape[1] for p in parts)
        out.codes = np.concatenate([np.pad(p.codes, ((0, 0), (0, width - p.codes.shape[1]))) for p in parts])
        out.n, out.size, out.letters, out.square = (np.concatenate([getattr(p, x) for p in parts])
                                                    for x in ("n", "size", "letters", "square"))
        return out

    def words(self, at) -> list[str]:
        return [bytes(self.codes[i, :self.size[i]]).decode("latin-1") for i in at]


def near_pairs(a: _Words, b: _Words, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) that are one edit apart; ``inside``: both
    are the same words, and each pair is taken once."""
    left, right = [], []
    used = np.flatnonzero(a.letters.any(axis=0) & b.letters.any(axis=0))
    # |x - y|^2 as one product: (-2x, |x|^2, 1) by (y, 1, |y|^2)
    one = lambda s: np.ones((len(s), 1), s.dtype)
    am = np.concatenate([-2 * a.letters[:, used], a.square[:, None], one(a.letters)], axis=1)
    bm = np.concatenate([b.letters[:, used], one(b.letters), b.square[:, None]], axis=1)
    for i in range(0, len(am), STEP):
        for j in range(i if inside else 0, len(bm), STEP):
            gap = am[i: i + STEP] @ bm[j: j + STEP].T
            at = np.flatnonzero(gap <= 2)
            x, y = np.divmod(at, gap.shape[1])
            gap = gap.ravel()[at]
            x, y = x + i, y + j
            # one replaced letter: distance 2 at equal length; one more or less: distance 1
            differ = np.abs(a.size[x] - b.size[y])
            ok = (differ <= 1) & (gap == 2 - differ)
            if inside:
                ok &= x < y
            left.append(x[ok])
            right.append(y[ok])
    x = np.concatenate(left) if left else np.zeros(0, np.int64)
    y = np.concatenate(right) if right else np.zeros(0, np.int64)
    if not len(x):
        return x, y
    step = max(1, (1 << 22) // (1 + max(a.codes.shape[1], b.codes.shape[1])))
    ok = np.concatenate([_one_edit(a, b, x[k: k + step], y[k: k + step]) for k in range(0, len(x), step)])
    return x[ok], y[ok]


def _one_edit(a: _Words, b: _Words, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the words are equal but for one replaced, inserted or deleted
    code point: common beginning and end together cover the shorter word."""
    width = max(a.codes.shape[1], b.codes.shape[1])
    p, q = (np.pad(s.codes, ((0, 0), (0, width - s.codes.shape[1])))[at] for s, at in ((a, x), (b, y)))
    n, m = a.size[x], b.size[y]
    same = p == q
    at = np.arange(width)
    short = np.minimum(n, m)
    begin = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), short)
    # ends aligned: the longer word shifted by one
    ends = np.zeros_like(same)
    for d in (-1, 0, 1):
        rows = np.flatnonzero(m - n == d)
        if d == 0:
            ends[rows] = same[rows]
        elif d == 1:
            ends[rows, :-1] = p[rows, :-1] == q[rows, 1:]
        else:
            ends[rows, :-1] = p[rows, 1:] == q[rows, :-1]
    inside = at < short[:, None]
    broken = np.where(inside & ~ends, at + 1, 0).max(axis=1)  # after the last place that differs
    end = short - broken
    return np.where(n == m, (same | ~inside).sum(axis=1) == width - 1, begin + end >= short)


_FOUND = "word string, n_near bigint, best bigint, form string"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (tile, right): the left words of a tile come first and
    are held, at most a chunk of a block; its right words stream past them in
    pieces of bounded size."""
    tile, left, held = None, None, []

    def meet(a: _Words, b: _Words, inside: bool):
        x, y = near_pairs(a, b, inside)
        if not len(x):
            return
        names_a, names_b = dict(zip(u := np.unique(x), a.words(u))), dict(zip(w := np.unique(y), b.words(w)))
        for me, you, mine, yours, n in ((x, y, names_a, names_b, b.n), (y, x, names_b, names_a, a.n)):
            found: dict[str, list] = {}
            for i, j in zip(me.tolist(), you.tolist()):
                f, top, word = found.setdefault(mine[i], [0, -1, ""]), int(n[j]), yours[j]
                f[0] += 1
                if top > f[1] or top == f[1] and word < f[2]:
                    f[1:] = top, word
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                (list(found), *zip(*found.values())), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "n_near", "best", "form"])

    def closed():
        """The left words of the tile are complete: compare them with each other."""
        nonlocal left, held
        if held:
            left, held = _Words.joined(held), []
            if len(left.n) > 1:
                yield from meet(left, left, True)

    for b in batches:
        if not b.num_rows:
            continue
        t, right = b.column("tile").to_numpy(), b.column("right").to_numpy(zero_copy_only=False)
        code, n = b.column("code"), b.column("n").to_numpy()
        size = pc.binary_length(code).to_numpy()
        long = size > ORDINARY
        start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (right[1:] != right[:-1]) | (long[1:] != long[:-1])])
        ordinary = None if long.all() else _Words(code.filter(pa.array(~long)), n[~long])
        before = np.cumsum(~long) - ~long  # place among the ordinary words
        for s, e in zip(start, [*start[1:], len(t)]):
            if t[s] != tile:
                yield from closed()
                tile, left = t[s], None
            step = max(1, CHARS // int(size[s] + 2)) if long[s] else e - s
            for k in range(s, e, step):
                stop = min(e, k + step)
                part = _Words(code.slice(k, stop - k), n[k:stop]) if long[s] else \
                    ordinary.part(before[k], before[k] + stop - k)
                if not right[s]:
                    held.append(part)
                    continue
                yield from closed()
                if left is not None:
                    yield from meet(left, part, False)
    yield from closed()


def near_words(words: DataFrame, classes: int = 7, tile: int = TILE) -> DataFrame:
    """``word, n_near, best, form`` of the words of ``words(word, n)`` that have
    near words: their number, the largest n among them and the smallest such
    word.  Words are distinct; those with other letters than a-z and Latin-1
    have no near words here.

    A word's block is its length and its letters in each of ``classes`` classes
    of letters: one edit leads into the same block, or moves one letter to
    another class, or changes length and one class by one.  So a block's words
    only meet those of its neighbours, one direction each.  Neighbours are
    found among the blocks, not the words.  Blocks are cut in chunks of about
    ``tile`` left words, and right words stream past a chunk."""
    words = words.filter(F.col("word").rlike("^[a-zÀ-ÿ]+$"))
    shape = _block(F.col("word"), classes)
    coded = keep(words.select(F.encode("word", "ISO-8859-1").alias("code"), "n", shape.alias("shape"))
                 .withColumn("block", F.xxhash64("shape")), "variant-words")
    blocks = keep(coded.groupBy("block").agg(
        F.any_value("shape").alias("shape"),
        F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(F.length("code")) / CHARS)).cast("int").alias("chunks")),
        "variant-blocks")
    chunks = blocks.select(F.col("block").alias("left_block"), "chunks")
    near = blocks.select("block", F.explode(_later(F.col("shape"), classes)).alias("shape")) \
        .select("block", F.xxhash64("shape").alias("left_block")).join(chunks, "left_block")
    coded = coded.select("code", "n", "block")
    home = coded.join(chunks, F.col("block") == F.col("left_block")) \
        .withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))

    def tile_of(chunk: Column) -> Column:
        return F.xxhash64("left_block", chunk)

    left = home.select(tile_of(F.col("chunk")).alias("tile"), F.lit(False).alias("right"), "code", "n")
    # the block's other chunks, each pair of chunks once
    own = home.filter("chunk > 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1))) \
        .select(tile_of(F.col("to")).alias("tile"), F.lit(True).alias("right"), "code", "n")
    met = coded.join(near, "block").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .select(tile_of(F.col("to")).alias("tile"), F.lit(True).alias("right"), "code", "n")
    tiles = left.unionByName(own).unionByName(met).repartition("tile").sortWithinPartitions("tile", "right")
    found = tiles.mapInArrow(_tiles, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best")).alias("rank"), "form")).alias("first")) \
        .select("word", "n_near", (-F.col("first.rank")).alias("best"), "first.form")


def group_variants(words: DataFrame, factor: int = 10, classes: int = 7, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the distinct words of
    ``words(word, n)``: a word's form is its near word (one inserted, deleted or
    replaced code point) of largest n, ties to the smallest word, if that n is
    at least ``factor`` times the word's; ``root`` follows the forms to the last.

    Null words take no part; a repeated word's n add up (null n: 0); an empty
    table gives no rows; other columns are ignored."""
    words = keep(words.filter("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")),
                 "variant-counts")
    found = near_words(words, classes, tile)
    is_form = F.col("best") >= factor * F.col("n")
    out = keep(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("best")).alias("form_n")), "variant-forms")
    # n grows by the factor at each step, which bounds the chain; every round doubles what a hop covers
    top = out.agg(F.max("n")).head()[0] or 1
    hops = keep(out.filter("form is not null").select("word", F.col("form").alias("root")), "variant-hops")
    for _ in range(int(np.ceil(np.log2(max(2, 1 + np.log(max(2, top)) / np.log(max(2, factor))))))):
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = keep(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-hops")
    return out.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
