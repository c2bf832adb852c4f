"""Vector code compression: product codes trained by member-resident Lloyd.

The parts of all vectors live with their owners, the cells (position, entry,
salt) of one table in the shared folder.  A round reassigns the members where
they are, and only the parts whose entry changed go through a shuffle, to their
new owners; owners add up what resides with them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.common import keep
from drover.llm.vectors import by_dimension

#: Components beyond this count as this: doubles hold all whole numbers up to it, and
#: the square of half of it has left the range of a long.
LARGEST = float(1 << 52)
_LONG = (1 << 63) - 1
_PARTS = "row bigint, pos int, entry int, comps array<double>"
_PARTS_ARROW = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("entry", pa.int32()),
                          ("comps", pa.list_(pa.float64()))])


def cuts(dim: int, parts: int) -> list[int]:
    """Bounds of ``parts`` consecutive parts, as equal as the length allows."""
    return [i * dim // parts for i in range(parts + 1)]


def integers(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole doubles."""
    return np.clip(np.floor(m.astype(np.float64) * scale), -LARGEST, LARGEST)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry nearest to each row of ``x`` (ties: the lower index) and its squared
    distance.  Doubles are exact while every sum stays below 2^53; Python
    integers beyond, with distances saturated to the range of a long."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if x.shape[1] * (2 * top) ** 2 < 2.0 ** 53:
        d = np.zeros((len(x), len(book)))
        for j in range(x.shape[1]):
            d += (x[:, j, None] - book[None, :, j]) ** 2
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    whole = [[int(c) for c in row] for row in book]
    for i, row in enumerate(x):
        row = [int(c) for c in row]
        d = [sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in whole]
        at[i] = min(range(len(d)), key=d.__getitem__)
        best[i] = min(d[at[i]], _LONG)
    return at, best


def _listed(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()),
                                    pa.array(m.ravel(), pa.float64()))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield from by_dimension(pa.chunked_array([batch.column(column)]), np.float64)


def _part_rows(row, pos, entry, comps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(pos, pa.int32()),
                                       pa.array(entry, pa.int32()), comps], schema=_PARTS_ARROW)


def _cut(books: list[np.ndarray], dim: int, scale: float):
    """Vectors to parts, each with its nearest entry."""
    bounds = cuts(dim, len(books))

    def run(batches):
        for b in batches:
            for rows, m in _matrices(b, "vec"):
                if m.shape[1] != dim:
                    continue
                x, ids = integers(m, scale), b.column("row").to_numpy()[rows]
                for p, book in enumerate(books):
                    part = x[:, bounds[p]: bounds[p + 1]]
                    yield _part_rows(ids, np.full(len(ids), p), nearest_entries(part, book)[0], _listed(part))
    return run


def _reassign(books: list[np.ndarray]):
    """Members to their nearest entries, where they reside."""

    def run(batches):
        for b in batches:
            pos, entry = b.column("pos").to_numpy(), b.column("entry").to_numpy().copy()
            for rows, m in _matrices(b, "comps"):
                for p in np.unique(pos[rows]):
                    at = pos[rows] == p
                    entry[rows[at]] = nearest_entries(m[at], books[p])[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(entry, pa.int32())],
                                             names=[*b.schema.names, "now"])
    return run


def _sums(books: list[np.ndarray]):
    """Componentwise sums and counts of an owner's members: one row for each
    (position, entry, component) that a task holds."""

    def run(batches):
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            pos, entry = b.column("pos").to_numpy(), b.column("entry").to_numpy()
            for rows, m in _matrices(b, "comps"):
                whole = m.astype(np.int64) if np.abs(m).max(initial=0) < 1 << 40 else \
                    np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
                for p in np.unique(pos[rows]):
                    at = pos[rows] == p
                    e = entry[rows[at]]
                    part = np.zeros(books[p].shape, whole.dtype)
                    np.add.at(part, e, whole[at])
                    total[p] += part
                    count[p] += np.bincount(e, minlength=len(count[p]))
        out = [(p, int(e), j, str(total[p][e, j]), int(count[p][e])) for p in range(len(books))
               for e in np.flatnonzero(count[p]) for j in range(books[p].shape[1])]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))],
                names=["pos", "entry", "at", "total", "members"])
    return run


def _updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every used entry becomes the floored mean of its members.  The driver
    sees one number a component of the codebooks (entries x length), whatever
    the table's size."""
    sums = members.mapInArrow(_sums(books), "pos int, entry int, at int, total string, members bigint") \
        .groupBy("pos", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                           F.sum("members").alias("members"))
    new = [b.copy() for b in books]
    for r in sums.collect():
        new[r["pos"]][r["entry"], r["at"]] = float(int(r["total"]) // r["members"])
    return new


def train(vectors: DataFrame, dim: int, first: np.ndarray, rounds: int, scale: float,
          owner_rows: int) -> list[np.ndarray]:
    """Codebooks (one matrix a position) after ``rounds`` of Lloyd's iteration
    over ``vectors(row, vec)``, from the initial matrices in ``first``."""
    books = first
    if not rounds:
        return books
    salts = max(1, -(-vectors.count() // owner_rows))
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))

    def owned(parts: DataFrame) -> DataFrame:
        return parts.withColumn("salt", salt).repartition("pos", "entry", "salt").drop("salt")

    members = keep(owned(vectors.mapInArrow(_cut(books, dim, scale), _PARTS)), "codes-members")
    for r in range(rounds):
        if r:
            new = members.mapInArrow(_reassign(books), _PARTS + ", now int")
            new = keep(new.withColumn("moved", F.col("entry") != F.col("now")), "codes-round", by=("moved",))
            parts = new.withColumn("entry", F.col("now")).drop("now")
            stay, move = parts.filter("not moved").drop("moved"), parts.filter("moved").drop("moved")
            members = stay.unionByName(keep(owned(move), "codes-moved"))
        books = _updated(members, books)
    return books


def books_text(books: list[np.ndarray]) -> str:
    """All components by position, entry and place, comma-joined."""
    return ",".join(str(int(c)) for book in books for entry in book for c in entry)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             owner_rows: int = 1 << 11) -> DataFrame:
    """Product codes of floor(scale * x) vectors.

    Returns ``id, label, code, error, label_error, codebooks``: the entry of
    each part as two hex digits, the squared distances summed over the parts,
    that error summed over the rows of a label (null labels together), and the
    codebooks' SHA-256.  The codebooks start from the ``entries`` smallest ids
    (null ids last, equal ids by vector; fewer rows give fewer entries).

    Rows whose vector is null or holds null or non-finite components are left
    out.  Repeated rows each get a code, equal ones for equal vectors.  The
    length of the smallest id's vector counts: rows of another length, or an
    empty vector, take no part and have null code and error.  Lengths that
    ``parts`` doesn't divide are cut as evenly as they allow (an empty part is
    entry 00).  Integers beyond 2^52 count as 2^52; sums beyond a long saturate.  Null ids and labels are kept; an
    empty table gives no rows; other columns are ignored.

    Equal parts of a hot group share an entry: its owner is salted over the
    rows, ``owner_rows`` a salt on average."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    v = F.col(f"`{vec_col}`")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = keep(vectors.filter(v.isNotNull() & fit).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vec"),
        F.monotonically_increasing_id().alias("row")), "codes-rows")
    by_id = [F.col("id").asc_nulls_last(), F.col("vec")]
    lead = rows.orderBy(*by_id).limit(1).select(F.size("vec").alias("n")).collect()
    dim = lead[0]["n"] if lead else 0
    books = None
    if dim:
        first = rows.filter(F.size("vec") == dim).orderBy(*by_id).limit(entries).select("vec").collect()
        x, bounds = integers(np.array([r["vec"] for r in first], np.float64), scale), cuts(dim, parts)
        books = train(rows.select("row", "vec"), dim, [x[:, a:b] for a, b in zip(bounds, bounds[1:])],
                      rounds, scale, owner_rows)
    digest = hashlib.sha256(books_text(books or []).encode()).hexdigest()
    # with the codebooks at hand (entries x length numbers) each vector's task encodes it: no shuffle
    coded = rows.select("id", "label", "vec").mapInArrow(
        _encode(books, dim, scale), _out_schema(rows))
    coded = keep(coded, "codes-coded")
    # a hot label's rows are dealt over salts, each of which gets the label's sum
    salts = 16
    total = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") > 0, F.coalesce(F.try_sum("error"), F.lit(_LONG))).alias("label_error"))
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of")) & (coded["salt"] == total["salt"])) \
        .select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks"))


def _out_schema(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, " \
        "code string, error bigint"


def _encode(books, dim: int, scale: float):
    """Vectors to codes and errors; null for vectors of another length."""
    bounds = cuts(dim, len(books)) if books else []
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for b in batches:
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            for rows, m in _matrices(b, "vec"):
                if not dim or m.shape[1] != dim:
                    continue
                x = integers(m, scale)
                found = [nearest_entries(x[:, lo:hi], book) for book, lo, hi in zip(books, bounds, bounds[1:])]
                code[rows] = ["".join(t) for t in zip(*(hexes[at] for at, _ in found))]
                error[rows] = [min(sum(d), _LONG) for d in zip(*(d.tolist() for _, d in found))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code, pa.string()),
                                              pa.array(error, pa.int64())], names=["id", "label", "code", "error"])
    return run
