"""BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import LONG, SF_SMALL, docs, empty, odd  # noqa: F401
from drover.llm import bpe, tokencount
from drover.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def texts(n=400):
    g = random.Random(4)
    pools = ["abc XYZ 'sré 're", "0123 .,!?-'", "́̀eé각가", "\t\n\r   　\x1c\x1d\x85", "中文字日本語",
             "\U0001F600\U0001F44D\U0001F3FD‍", "ΑΣσςß İı", "".join(chr(g.randrange(32, 0x2FFF)) for _ in range(30))]
    out = ["", " ", "<|endoftext|>", " <|endoftext|> a<|startoftext|>", "a" * 500, "ab" * 3000, "don't 'sabc I'll'd", LONG[:9000]]
    for _ in range(n):
        parts = []
        for _ in range(g.randrange(1, 60)):
            p = g.choice(pools)
            parts += [g.choice(p) for _ in range(g.randrange(1, 9))]
            if g.random() < 0.02:
                parts.append("<|endoftext|>")
        out.append("".join(parts))
    return out


def test_ids_and_decoding_equal_the_library():
    lib, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(open(BYTE).read())
    for t, ids in zip(texts(), own.encode_texts(texts())):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_long_texts_go_block_by_block():
    own = bpe.ByteBpe(open(BYTE).read())
    long = LONG * 6  # over the slice size
    [ids] = own.encode_texts([long])
    assert own.decode(ids) == long
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(BYTE).encode(long, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing():
    spec = open(BYTE).read()
    a, b = bpe.ByteBpe(spec), bpe.ByteBpe(spec, max_cached=5)
    assert [a.encode_texts([t]) for t in texts(40)] == [b.encode_texts([t]) for t in texts(40)]


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 16), (1024, 64), (8192, 256)])
def test_counts_equal_the_library_for_any_chunk(chunk, overlap):
    lib = Tokenizer.from_file(WORD)
    own = tokencount.ChunkCounter(open(WORD).read(), chunk, overlap)
    more = ["中" * 3000, "é!" * 900, "a1'" * 700, "<|endoftext|>" * 300, "x" * 2000 + "don't" * 300]
    every = texts(200) + more
    for t, n in zip(every, own.count(every)):
        assert n == len(lib.encode(t, add_special_tokens=False).ids), (chunk, t[:80])


def test_odd_rows(spark, odd, empty):
    got = bpe.encode_decode(odd, BYTE).collect()
    assert len(got) == odd.count()
    lib = Tokenizer.from_file(BYTE)
    for r in got:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert (np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) == (want, len(want), r["text"] or "")
    assert bpe.encode_decode(empty, BYTE).count() == 0
    lib = Tokenizer.from_file(WORD)
    for r in tokencount.count_tokens(odd, WORD).collect():
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids))
    assert tokencount.count_tokens(empty, WORD).count() == 0


def test_queries(spark, docs):
    from drover.llm import queries
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op5_bpe(spark, SF_SMALL).collect():
        ids = byte.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    rows = queries.op7_token_counts(spark, SF_SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(word.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 2048, len(text[r["doc_id"]].encode()))
