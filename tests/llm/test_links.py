"""Embedding near-duplicates, spelling variants and vector codes against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF_SMALL, docs, empty, odd  # noqa: F401
from drover.llm import neardup, quantize, queries, variants

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, key string, s string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "id", "key", "s", "row") for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# 11 embedding near-duplicates ---------------------------------------------------------
def brute_links(rows, least):
    """(id, links, component, kept) of rows (id, vector, label)."""
    ok = [lab is not None and usable(v) and any(v) for _, v, lab in rows]
    near = defaultdict(set)
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            b, lb = rows[j][1], rows[j][2]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                if sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    root = {}
    for i in range(len(rows)):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            root |= {j: min(ids) if ids else None for j in seen}
    return Counter((r[0], len(near[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows))


def linked_rows(seed=1, dim=16):
    """Groups of near copies, chains, exact copies and odd vectors."""
    g = np.random.default_rng(seed)
    near = lambda v, s: [float(np.float32(x)) for x in v + s * np.linalg.norm(v) / 4 * g.standard_normal(dim)]
    rows, at = [], 1
    for label in (0, 1, 2):
        for v in g.standard_normal((40, dim)):
            for k in range(int(g.integers(1, 4))):
                rows.append((at, near(v, 0.15 * k), label))
                at += 1
    centre = g.standard_normal(dim)
    rows += [(1000 + i, near(centre, 0.2), 1) for i in range(120)]
    rows += [(2000 + i, near(centre, 0)[:], 1) for i in range(60)]  # one vector many times
    rows += [(3000, [0.0] * dim, 1), (3001, None, 1), (3002, [None] * dim, 1), (3003, [float("nan")] * dim, 1), (3004, [], 1),
             (3005, rows[0][1], None), (3006, rows[0][1], None), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.1], 1),
             (None, rows[0][1], 0), (None, [float("inf")] * dim, 0), (5, rows[4][1], rows[4][2]), (3009, [1e30] * dim, 2), (3010, [1e-30] * dim, 2)]
    return rows


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_links_equal_brute_force(spark, shard_rows):
    rows = linked_rows()
    got = neardup.embedding_duplicates(vectors(spark, rows), shard_rows=shard_rows)
    assert got.columns == ["id", "label", "n_links", "component_id", "n_vectors", "kept"]
    assert Counter((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == brute_links(rows, 0.93)


def test_links_of_nothing(spark):
    assert neardup.embedding_duplicates(vectors(spark, [])).count() == 0
    alone = neardup.embedding_duplicates(vectors(spark, [(None, None, None), (1, None, 1)])).collect()
    assert sorted((r["id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in alone) == [(0, 0, None, True), (1, 0, 1, True)]


def test_graph_recall_and_audit():
    g = np.random.default_rng(4)
    v = g.standard_normal((4000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = neardup.SmallWorld(v, links=12, beam=40)
    beam = graph.widened(0.93, 0.98, 4)
    assert 4 < beam < 4000  # four are too few for the audit
    q = v[:300] + 0.04 * g.standard_normal((300, 48))
    ids, _ = graph.search(q / np.linalg.norm(q, axis=1, keepdims=True), beam)
    assert np.mean([i in row for i, row in enumerate(ids)]) >= 0.95
    assert (graph.layers[-1] >= 0).any(axis=1).all()  # every row is indexed


def test_rotated_query_reads_all_rows(spark):
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    got = queries.op11_embedding_duplicates(spark, SF_SMALL)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == n


# 12 spelling variants -------------------------------------------------------------------
def edits_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, factor=10):
    near = {w: [x for x in n if edits_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def some_words(seed=2):
    r = random.Random(seed)
    letters = "abcdeéèÿ÷"
    n = {}
    for _ in range(60):
        w = "".join(r.choice(letters) for _ in range(r.randint(7, 12)))
        n[w] = r.choice([1, 3, 40, 2000, 2000, 50_000])
        for _ in range(r.randint(0, 8)):
            i, kind = r.randrange(len(w)), r.randrange(4)
            v = w[:i] + r.choice(letters) * (kind > 0) + w[i + (kind != 1):]
            v = v if kind < 3 else "".join(r.sample(w, len(w)))  # an anagram is no edit
            n.setdefault(v, r.choice([1, 2, 30, 2000]))
            w = v if r.random() < 0.3 else w
    return n | {"aaaaaaaa": 100, "aaaaaaa": 5, "aaaaaaaaa": 5, "aaaaaaab": 100, "baaaaaaa": 7, "É" + "b" * 9: 3, "é" + "b" * 9: 40}


@pytest.mark.parametrize("classes,tile", [(5, 4096), (1, 7), (3, 2)])
def test_variants_equal_brute_force(spark, classes, tile):
    n = some_words()
    df = spark.createDataFrame([(w, k, "x", "y") for w, k in n.items()], "word string, n bigint, code string, block string")
    got = variants.group_variants(df, classes=classes, tile=tile).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == brute_variants(n)


def test_variants_of_odd_words(spark):
    rows = [(None, 4), ("привет", 3), ("приветы", 100), ("", 2), ("abcdefg", None), ("abcdefg", 2), ("abcdefgh", 20),
            ("a" * 5000, 1), ("a" * 4999, 50)]
    got = {r["word"]: tuple(r)[1:] for r in variants.group_variants(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefgh", 2, 1, 20) and got["a" * 5000][:2] == ("a" * 4999, "a" * 4999)
    assert got["привет"] == (None, "привет", 3, 0, None) and got[""][1] == "" and len(got) == 7
    assert variants.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def brute_words(rows, thin, least):
    import re
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return total


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_word_counts_equal_brute_force(which, request):
    df = request.getfixturevalue(which)
    want = brute_words([(r["doc_id"], r["text"]) for r in df.collect()], 31, 7)
    for held in (200_000, 50):
        assert {r["word"]: r["n"] for r in variants.count_words(df, 7, 31, held=held).collect()} == dict(want)


# 13 vector codes ---------------------------------------------------------------------------
def brute_codes(rows, parts, entries, rounds, scale=256):
    """The contract in plain integers; rows are (id, vector, label)."""
    kept = sorted(((i, v, lab) for i, v, lab in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) if kept else 0
    cut = [p * dim // parts for p in range(parts + 1)]
    whole = [[min(max(math.floor(float(x) * scale), -2 ** 52), 2 ** 52) for x in v] if v and len(v) == dim else None for _, v, _ in kept]
    split = [[tuple(w[a:b]) for a, b in zip(cut, cut[1:])] if w else None for w in whole]
    fit = [s for s in split if s]
    books = [[s[p] for s in fit[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            at = defaultdict(list)
            for s in fit:
                at[nearest(s[p], book)[1]].append(s[p])
            new.append([tuple(sum(c) // len(at[k]) for c in zip(*at[k])) if k in at else e for k, e in enumerate(book)])
        books = new
    found = [[nearest(s[p], books[p]) for p in range(parts)] if s else None for s in split]
    top = (1 << 63) - 1
    error = [min(sum(min(d, top) for d, _ in f), top) if f else None for f in found]
    by = defaultdict(list)
    for (_, _, lab), e in zip(kept, error):
        by[lab] += [e] if e is not None else []
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest() if dim else \
        hashlib.sha256(b"").hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f) if f else None, e, min(sum(by[lab]), top) if by[lab] else None, digest)
                   for (i, _, lab), f, e in zip(kept, found, error))


def code_rows(df):
    return Counter((r["id"], r["code"], r["error"], r["label_error"], r["codebooks"]) for r in df.collect())


@pytest.mark.parametrize("dim,parts,entries,owner", [(12, 4, 6, 2048), (10, 4, 6, 5), (3, 4, 3, 2048)])
def test_codes_equal_brute_force(spark, dim, parts, entries, owner):
    g = np.random.default_rng(dim)
    rows = [(int(i), [float(np.float32(x)) for x in g.standard_normal(dim)], int(g.integers(3)) or None) for i in g.permutation(120)]
    rows += [(500 + i, rows[7][1], 1) for i in range(60)]  # a third of the rows are one vector
    rows += [(700, None, 1), (701, [None] * dim, 1), (702, [float("inf")] + [0.0] * (dim - 1), 1), (703, [1.0, 2.0], 9), (704, [], 1),
             (None, rows[3][1], 2), (5, rows[9][1], 2), (5, rows[9][1], 2), (705, [0.0] * dim, 0)]
    got = quantize.compress(vectors(spark, rows), parts, entries, 2, owner_rows=owner)
    assert got.columns == ["id", "label", "code", "error", "label_error", "codebooks"]
    assert code_rows(got) == brute_codes(rows, parts, entries, 2)


def test_codes_of_extremes(spark):
    rows = [(i, [float(np.float32(s * 10.0 ** e)), 1.0], 0) for i, (s, e) in enumerate(((1, 30), (-1, 30), (1, 5), (1, 15), (-1, -30)))]
    assert code_rows(quantize.compress(vectors(spark, rows), 2, 2, 2)) == brute_codes(rows, 2, 2, 2)
    few = rows[2:3]
    assert code_rows(quantize.compress(vectors(spark, few), 2, 64, 2)) == brute_codes(few, 2, 64, 2)
    assert quantize.compress(vectors(spark, [])).count() == 0
    assert quantize.compress(vectors(spark, [(1, None, 1)])).count() == 0


def test_only_movers_migrate(spark, monkeypatch):
    """What a round sends through the shuffle are the parts whose entry changed."""
    kept = {}
    real = quantize.keep
    monkeypatch.setattr(quantize, "keep", lambda df, name, by=(): kept.setdefault(name, real(df, name, by)))
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    quantize.compress(df)
    rounds = kept["codes-round"]
    moved = rounds.filter("entry <> now").count()
    assert 0 < moved < rounds.count() == 16 * df.count() and kept["codes-moved"].count() == moved
    assert rounds.filter("moved").select(F.count(F.lit(1))).first()[0] == moved
