"""Token counts of texts without white space, in several scripts."""

import random
import time

import pytest
from tokenizers import Tokenizer

from drover.llm import bpe, tokencount
from drover.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
RANGES = {"chinese": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "jamo": (0x1100, 0x11FF), "kana": (0x3041, 0x3096),
          "arabic": (0x0620, 0x0655), "devanagari": (0x0900, 0x0950), "cyrillic": (0x0410, 0x044F), "latin": (0x61, 0x7A),
          "accents": (0xC0, 0x17F), "marks": (0x300, 0x310)}


def some(script, n, seed=0):
    r = random.Random(seed)
    lo, hi = RANGES[script]
    return "".join(chr(r.randint(lo, hi)) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(32, 4), (64, 16), (8192, 256)])
def test_counts_equal_the_library_in_any_script(chunk, overlap):
    lib, own = Tokenizer.from_file(WORD), tokencount.ChunkCounter(open(WORD, encoding="utf-8").read(), chunk, overlap)
    texts = [some(s, 700, i) for i, s in enumerate(RANGES)]
    r = random.Random(9)
    texts += ["".join(some(r.choice([*RANGES]), r.randint(1, 5), k) + r.choice(["", "", "'s", "7", "!", " ", "́"]) for k in range(200))
              for _ in range(20)]
    for t, n in zip(texts, own.count(texts)):
        assert n == len(lib.encode(t, add_special_tokens=False).ids), (chunk, t[:60])


@pytest.mark.parametrize("text", [some("chinese", 200_000), "a" * 200_000, some("latin", 200_000)])
def test_long_texts_without_white_space_take_linear_time(text):
    spec = open(WORD, encoding="utf-8").read()
    own, lib = tokencount.ChunkCounter(spec, 8192, 256), Tokenizer.from_file(WORD)
    t0 = time.process_time()
    assert own.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]
    t1 = time.process_time()
    own.count([text * 4])
    # four times the text, not sixteen times the work (the library's share above makes room)
    assert time.process_time() - t1 < 9 * (t1 - t0) + 1


def test_caches_are_bounded_in_characters():
    words = [some("latin", 100, i) for i in range(300)]
    own = tokencount.ChunkCounter(open(WORD, encoding="utf-8").read(), 8192, 256, max_cached_chars=5000)
    want = tokencount.ChunkCounter(open(WORD, encoding="utf-8").read(), 8192, 256).count(words)
    assert [own.count([w])[0] for w in words] == want and sum(map(len, own.counts)) <= 5000
    spec = open(BYTE, encoding="utf-8").read()
    a, b = bpe.ByteBpe(spec), bpe.ByteBpe(spec, max_chars=5000)
    assert [a.encode_texts([w]) for w in words] == [b.encode_texts([w]) for w in words] and sum(map(len, b.cache)) <= 5000
