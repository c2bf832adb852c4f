"""N-gram Jaccard join over MinHash trees, joined on a prefix of fixed depth in
place of an LSH forest, with exact verification, and the near-duplicate filter
built on it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.common import components, keep, map_groups, map_texts, reduced, row_of, starts_of

TREES, LONGEST = 32, 8
#: Members of a bucket that are compared inside one task, and of a tile side.
SMALL, SIDE, SIDE_SHINGLES = 256, 128, 1 << 18
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prefix_length(similarity: float, recall: float) -> int:
    """Start from the longest prefix and shorten it until pairs of the given
    similarity share one in some tree with probability ``recall``."""
    k = LONGEST
    while k > 1 and 1 - (1 - similarity ** k) ** TREES < recall:
        k -= 1
    return k


class Shingler:
    """Shingle hashes of texts: runs of ``n`` white-space separated words (one
    shorter shingle if the text has fewer)."""

    def __init__(self, n: int, max_cached: int = 500_000):
        self.n, self.max_cached, self.words = n, max_cached, {}

    def _words(self, text: str) -> np.ndarray:
        words, known = text.split(), self.words
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.max_cached:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles of a text."""
        w = self._words(text or "")
        size = min(self.n, len(w))
        if not size:
            return np.zeros(0, np.uint64)
        m = len(w) - size + 1
        h = np.full(m, size, np.uint64)
        for i in range(size):
            h = (h ^ (h >> np.uint64(29))) * _P + w[i: i + m]
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return np.unique(h ^ (h >> np.uint64(31)))


class Signer:
    """Text class (hash of the shingle set), MinHash signature in bytes, and the
    prefix of every tree, for lists of texts."""

    def __init__(self, n: int, depth: int, seed: int = 3):
        g = np.random.default_rng(seed)
        self.shingle, self.depth = Shingler(n), depth
        self.a = (g.integers(0, 1 << 31, TREES * depth, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = g.integers(0, 1 << 32, TREES * depth, dtype=np.uint32)

    def __call__(self, texts: list[str | None]) -> dict:
        sets = [self.shingle(t) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        size = np.array([len(sets[i]) for i in full], np.int64)
        mins = np.zeros((len(self.a), len(full)), np.uint32)
        if full:
            first = np.cumsum(size) - size
            flat = np.concatenate([sets[i] for i in full])
            low = (flat >> np.uint64(17)).astype(np.uint32)
            for j, (a, b) in enumerate(zip(self.a, self.b)):
                mins[j] = np.minimum.reduceat(low * a + b, first)
        mins = mins.T.reshape(len(full), TREES, self.depth)
        key = np.zeros((len(full), TREES), np.uint64)
        for k in range(self.depth):
            key = (key ^ (key >> np.uint64(29))) * _P + mins[:, :, k]
        key = ((key ^ (key >> np.uint64(30))) * _M1 >> np.uint64(32)).astype(np.uint32).view(np.int32)
        sig = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(len(full), -1)
        out = {"cls": [None] * len(texts), "n": [0] * len(texts), "prefix": [None] * len(texts),
               "sig": [None] * len(texts)}
        for r, i in enumerate(full):
            out["cls"][i] = hashlib.blake2b(sets[i].astype("<u8").tobytes(), digest_size=16).digest()
            out["n"][i] = len(sets[i])
            out["prefix"][i] = key[r]
            out["sig"][i] = sig[r].tobytes()
        return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of ``n`` rows by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _bucket_edges(least: float):
    """Edges inside buckets: members whose signatures agree in a share of at
    least ``least`` of their values; one edge per member keeps them connected."""

    def run(t: pa.Table):
        bucket = t.column("bucket").to_numpy()
        cls = t.column("cls").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(bucket), -1)
        a, b, d = [], [], 1
        while d < len(bucket):
            at = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(at):
                break
            for k in range(0, len(at), 1 << 14):
                p = at[k: k + (1 << 14)]
                p = p[(sig[p] == sig[p + d]).mean(axis=1) >= least]
                a.append(p)
                b.append(p + d)
            d += 1
        label = _labels(len(bucket), np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64),
                        np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64))
        edge = sorted({(cls[i], cls[j]) for i, j in enumerate(label) if i != j})
        yield pa.table({"a": pa.array([x for x, _ in edge], pa.binary()),
                        "b": pa.array([y for _, y in edge], pa.binary())})
    return run


def _intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """|A & B| for A in ``rows``, B in ``cols``, by products of 0/1 matrices over
    blocks of the shingles that two members share."""
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[at]
    who, at = who[use], number[at[use]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    inter = np.zeros((len(rows), len(cols)), np.int64)
    step, total = 8192, int(shared.sum())
    for lo in range(0, total, step):
        x, y = np.searchsorted(at, (lo, lo + step))
        m = np.zeros((len(sets), min(step, total - lo)), np.float32)
        m[who[x:y], at[x:y] - lo] = 1
        inter += np.rint(m[rows] @ m[cols].T).astype(np.int64)
    return inter


def _verify(similarity: float):
    """Exact verification of one tile: all pairs between two sides of a group (or
    inside one).  Yields per class its links and linked documents in the tile
    and the smallest class it is connected to there."""

    def one(cls, side, copies, sets):
        rows = np.flatnonzero(side == 0)
        cols = np.flatnonzero(side == 1) if (side == 1).any() else rows
        inside = cols is rows
        size = np.array([len(s) for s in sets], np.int64)
        inter = _intersections(sets, rows, cols)
        union = size[rows][:, None] + size[cols][None, :] - inter
        hit = inter >= similarity * union - 1e-9
        if inside:
            np.fill_diagonal(hit, False)
        links, docs = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        links[rows] += hit.sum(axis=1)
        docs[rows] += hit @ copies[cols]
        if not inside:
            links[cols] += hit.sum(axis=0)
            docs[cols] += copies[rows] @ hit
        r, c = np.nonzero(hit)
        return links, docs, _labels(len(cls), rows[r], cols[c])

    def run(t: pa.Table):
        tile = t.column("tile").to_numpy()
        first = starts_of(tile)
        out = {"cls": [], "links": [], "docs": [], "to": []}
        for a, b in zip(first, np.r_[first[1:], len(tile)]):
            part = t.slice(a, b - a)
            cls = part.column("cls").to_pylist()
            side, copies = part.column("side").to_numpy(), part.column("copies").to_numpy()
            sets = [x.values.to_numpy().view(np.uint64) for c in part.column("shingles").chunks for x in c]
            diag = part.column("diag")[0].as_py()
            if not diag and not ((side == 0).any() and (side == 1).any()):
                continue
            links, docs, label = one(cls, np.zeros_like(side) if diag else side, copies, sets)
            for i in np.flatnonzero(links):
                out["cls"].append(cls[i])
                out["links"].append(int(links[i]))
                out["docs"].append(int(docs[i]))
                out["to"].append(cls[label[i]])
        yield pa.table({"cls": pa.array(out["cls"], pa.binary()), "links": pa.array(out["links"], pa.int64()),
                        "docs": pa.array(out["docs"], pa.int64()), "to": pa.array(out["to"], pa.binary())})
    return run


def similarity_join(docs: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.9999,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Self-join of the documents on the Jaccard similarity of their word
    shingles (white-space separated words, as they are).

    Returns one row per input row: the id; ``class_id``, the smallest id of the
    documents connected by links; ``copy_id``, the smallest id with the same
    shingles; ``n_links``, the number of other documents with similarity
    ``similarity`` or more (copies counted, not expanded); ``n_texts``, the
    number of other shingle sets linked; and ``text_key``, ``kept`` for
    ``drop_near_duplicates``.

    Texts without a word (null, empty) are no copies of each other: class_id and
    copy_id are their own id, n_links 0.  Shorter texts than a shingle make one
    shingle.  Null ids take part; they are a smallest id only among themselves.
    Repeated rows are copies.  An empty table gives no rows; other columns are
    ignored.

    Method: documents with one shingle set are a class; classes are joined
    on equal (tree, prefix) keys of their signatures; the prefixes' fixed depth
    follows from the threshold and the target recall.  Members of a bucket
    are connected if their signatures agree well below the threshold too; the
    members of a bucket over ``SMALL`` all are.  Each group connected so is
    verified exactly, in tiles of bounded size: pairs are counted, not emitted,
    and no group is gathered in one task."""
    depth = prefix_length(similarity, recall)
    text_key = F.xxhash64(F.col("text"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")) \
        .withColumn("text_key", text_key)

    def make():
        return Signer(words, depth)

    signed = keep(map_texts(base, make, {
        "cls": ("binary", pa.binary()), "n": ("int", pa.int32()), "prefix": ("array<int>", pa.list_(pa.int32())),
        "sig": ("binary", pa.binary())}, keep_cols=["id", "text_key"]), "join-signed")
    # null ids sort last, so that they lead a class only among themselves
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    classes = keep(signed.filter("cls is not null").groupBy("cls").agg(
        rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"),
        F.min("prefix").alias("prefix"), F.min("sig").alias("sig")), "join-classes")
    keys = classes.select("cls", F.posexplode("prefix").alias("tree", "key")) \
        .select("cls", F.xxhash64("tree", "key").alias("bucket"))
    full = keep(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "join-full")
    bucket = F.col("bucket")
    met = keep(reduced(keys, bucket, full, bucket).join(full, "bucket"), "join-buckets")
    # six standard errors below the threshold
    least = similarity - 6 * (similarity * (1 - similarity) / (TREES * depth)) ** 0.5
    small = met.filter(F.col("members") <= SMALL).select("bucket", "cls")
    small = small.join(reduced(classes.select("cls", "sig"), F.col("cls"), small, F.col("cls")), "cls")
    large = met.filter(F.col("members") > SMALL).select("bucket", "cls")
    large = large.join(large.groupBy("bucket").agg(F.min("cls").alias("lead")), "bucket").filter("cls <> lead")
    edges = map_groups(small, "bucket", _bucket_edges(least), "a binary, b binary", then_by=("cls",)) \
        .unionByName(large.select(F.col("cls").alias("a"), F.col("lead").alias("b"))).distinct()
    group = components(edges, "join-groups")
    sized = group.withColumnRenamed("node", "cls").join(classes.select("cls", "n", "copies", "rep"), "cls")
    chunks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SIDE),
                                                  F.ceil(F.sum("n") / SIDE_SHINGLES)).cast("int").alias("chunks"))
    sized = sized.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    sized = keep(sized, "join-members")
    # shingles of one row of each class that takes part, dealt to the tiles (a null id hashes like any other)
    row = F.xxhash64("id_key", "text_key")
    wanted = sized.select("root", "cls", "copies", "chunk", "chunks", F.xxhash64("rep.id").alias("id_key"),
                          F.col("rep.text_key").alias("text_key"))
    texts = reduced(base.select(F.xxhash64("id").alias("id_key"), "text_key", "text"), row, wanted, row) \
        .groupBy("id_key", "text_key").agg(F.any_value("text").alias("text")).join(wanted, ["id_key", "text_key"])

    def shingles():
        shingle = Shingler(words)
        return lambda part: {"shingles": [shingle(t).view(np.int64) for t in part]}

    sets = map_texts(texts, shingles, {"shingles": ("array<bigint>", pa.list_(pa.int64()))},
                     keep_cols=["root", "cls", "copies", "chunk", "chunks"])
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    tiles = sets.select("root", "cls", "copies", "chunk", "shingles", other.alias("other")) \
        .select(F.xxhash64("root", low, high).alias("tile"), "cls", "copies",
                (F.col("chunk") > F.col("other")).cast("int").alias("side"),
                (F.col("chunk") == F.col("other")).alias("diag"), "shingles")
    linked = keep(map_groups(tiles, "tile", _verify(similarity), "cls binary, links bigint, docs bigint, to binary",
                             then_by=("cls",)), "join-links")
    joined = components(linked.select(F.col("cls").alias("a"), F.col("to").alias("b")), "join-classes-linked")
    count = linked.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    info = classes.select("cls", "rep", "copies").join(joined.withColumnRenamed("node", "cls"), "cls", "left") \
        .join(count, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    head = info.groupBy("root").agg(F.min("rep").alias("head"))
    info = info.join(head, "root").select(
        "cls", F.col("rep.id").alias("copy_id"), "head",
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_texts"))
    alone = F.col("cls").isNull()
    return signed.select("id", "text_key", "cls").join(info, "cls", "left").select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "text_key",
        F.when(alone, "alone").when(F.col("id").eqNullSafe(F.col("head.id"))
                                    & (F.col("text_key") == F.col("head.text_key")), "head").alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each class of ``similarity_join`` stays, the one with the
    smallest id; texts without a word (null, empty) all stay.  Columns unchanged,
    whatever their names.  Rows repeated as a whole are copies, of which one
    stays; null ids lead a class only among themselves; an empty table stays
    empty."""
    joined = keep(similarity_join(docs, similarity, words, id_col=id_col, text_col=text_col)
                  .select(F.col(id_col).alias("of_id"), F.col("text_key").alias("of_key"), "kept"), "join-kept")
    heads = keep(joined.filter("kept is not null").groupBy("of_id", "of_key")
                 .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "join-heads")
    # texts none of which is dropped or repeated pass without a shuffle
    doubt = joined.filter("kept is null").select("of_key").unionByName(
        heads.filter("kept = 'head' and rows > 1").select("of_key"))
    keyed = docs.select(row_of(docs).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    sure = reduced(keyed, F.col("key"), doubt, F.col("of_key"), how="left_anti")
    rows = reduced(keyed, F.col("key"), doubt, F.col("of_key")).join(
        heads, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    single = (F.col("kept") == "alone") | (F.col("rows") == 1)
    again = rows.filter(~single).dropDuplicates(["key", "id"])  # rows repeated as a whole
    return sure.select("row").union(rows.filter(single).select("row")).union(again.select("row")).select("row.*")
