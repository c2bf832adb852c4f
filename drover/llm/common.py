"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drover.session import shared_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and
    read it back: later steps start from the table, not from the lineage.
    ``by`` names columns to lay the files out by (a filter on them then skips
    the others' files)."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it clash
    with none of them; ``select("row.*")`` unpacks a column ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def _complete(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = b.num_rows  # the last group may go on in the next batch
        while cut and k[cut - 1] == k[-1]:
            cut -= 1
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            continue
        if cut == 0:  # one group fills the batch: what is held ends here
            if held:
                yield pa.Table.from_batches(held)
            held = [b]
            continue
        yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.Table]], schema: str,
               then_by: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to tables holding whole groups of the integer column ``key``
    (many small groups per call, so there is no per-group overhead).  Groups
    must be bounded by the caller; rows are sorted by ``key, *then_by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _complete(batches, key):
            for out in fn(table):
                yield from out.combine_chunks().to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key, *then_by).mapInArrow(run, schema)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[tuple[int, list]]:
    """Slices of the column as Python strings with at most ``max_chars``
    characters each (a single longer text makes a slice of its own)."""
    col, begin, size, out = batch.column(column), 0, 0, []
    for i in range(batch.num_rows):
        t = col[i].as_py()
        n = len(t) if t else 0
        if out and size + n > max_chars:
            yield begin, out
            begin, size, out = i, 0, []
        out.append(t)
        size += n
    if out:
        yield begin, out


def reduced(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, cells: int = 1 << 20,
            how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key can be among the wanted ones: keys are hashed to
    ``cells`` cells and the wanted cells broadcast, at most ``cells`` numbers
    (8 MB).  A join on the key itself must follow; this only spares it rows
    (with ``left_anti``: the rows whose key is surely not among them)."""
    some = wanted.select(F.pmod(F.xxhash64(wanted_key, F.lit(5)), F.lit(cells)).alias("_cell")).distinct()
    return df.withColumn("_cell", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(cells))) \
        .join(F.broadcast(some), "_cell", how).drop("_cell")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: returns ``node, root`` for every
    node of an edge, ``root`` being the smallest node of the component.

    Each round hooks every node to its smallest neighbour, contracts the edges
    and goes on with what is left; the table at least halves its nodes a round.
    Every round is written to the shared folder.  Hot nodes are combined
    map-side; no component is ever gathered into one task or the driver."""
    edges = keep(edges.select("a", "b"), name)  # read several times below
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = keep(both.filter("a <> b").distinct(), name)
    roots = keep(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), name)
    hook = roots
    for _ in range(max_rounds):
        to_a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = keep(live.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
                    .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), name)
        if live.isEmpty():
            return roots
        hook = live.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        roots = keep(roots.join(up, "root", "left")
                     .select("node", F.coalesce("_up", "root").alias("root")), name)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], dict]], out: dict[str, tuple[str, pa.DataType]],
              text_col: str = "text", keep_cols: list[str] | None = None, max_chars: int = 1 << 20) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches.

    ``make()`` runs once per task and returns a function from a list of texts
    (null: None) to a dict of column values.  ``out`` gives each new column's
    SQL and Arrow type; ``keep_cols`` the input columns to keep (all).  An
    input column with the name of a new one is replaced.  Texts are handed over
    in slices of at most ``max_chars`` characters, or one longer text."""
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in out]
    # plain names inside, so that columns of any name pass through Arrow
    names = [f"c{i}" for i in range(len(kept))]
    source = names[kept.index(text_col)] if text_col in kept else "t"
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)],
                     *([] if source in names else [F.col(f"`{text_col}`").alias(source)]))
    schema = StructType([df.schema[n] for n in names]
                        + [StructType.fromDDL(f"n{i} {t[0]}")[0] for i, t in enumerate(out.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for begin, texts in text_slices(b, source, max_chars):
                got = fn(texts)
                part = b.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(got[c], t[1]) for c, t in out.items()],
                    names=schema.names)

    return df.mapInArrow(run, schema).toDF(*kept, *out)
