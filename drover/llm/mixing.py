"""Mixing sources to target weights by entropy balancing.

Each document i of source k gets a rate r_i, the mean number of times it is
taken.  Among all rates between 0 and ``cap`` that meet the source's token
constraint sum(size_i * r_i) = target_k, the chosen ones stay closest to 1 in
relative entropy.  Their form is an exponential tilt, r_i = min(cap,
exp(lambda_k * size_i)), with one multiplier per source, found by Newton
iterations on the convex dual; value and curvature are sums over all documents,
taken by Spark in each iteration.  The rates are then rounded into whole copies
so that every source's token total stays at its target."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.llm.common import keep, row_of

# Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: list[tuple], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Targets of the sources, given as (name, size) in order: ``weights``
    (repeating) share ``share`` times the total; no target exceeds ``cap`` times
    its source's size, and what is above is shared again by weight among the
    others until none is above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    limit = [float(cap * s) for _, s in sizes]
    total = share * sum(s for _, s in sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        room = total - sum(limit[i] for i in range(len(sizes)) if i not in open_)
        unit = room / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * unit > limit[i]]
        if not over:
            for i in open_:
                target[i] = w[i] * unit
            break
        open_.difference_update(over)
    return [target[i] if i in open_ else limit[i] for i in range(len(sizes))]


def _newton(bins: DataFrame, sources: list[dict], cap: float, tol: float, max_iter: int) -> dict[int, float]:
    """Multipliers per source.  Every iteration is one aggregation over the
    (source, size) table; Newton steps are kept inside a bracket of the root
    (the derivative of the dual is monotone), else halved."""
    spark = bins.sparkSession
    state = {s["k"]: {"lo": -math.inf, "hi": math.inf, "lam": 0.0} for s in sources}
    open_ = {s["k"]: s for s in sources if 0 < s["target"] < cap * s["size"] * (1 - 1e-12)}
    done = {s["k"]: (math.inf if s["target"] > 0 else -math.inf) for s in sources if s["k"] not in open_}
    for _ in range(max_iter):
        if not open_:
            break
        now = spark.createDataFrame([(k, state[k]["lam"] / open_[k]["scale"]) for k in open_], "k int, lam double")
        tilt = F.col("lam") * F.col("w")
        free = tilt < math.log(cap)
        r = F.when(free, F.exp(tilt)).otherwise(F.lit(cap))
        sums = bins.join(F.broadcast(now), "k").groupBy("k").agg(
            F.sum(F.col("n") * F.col("w") * r).alias("value"),
            F.sum(F.when(free, F.col("n") * F.col("w") * F.col("w") * r).otherwise(0.0)).alias("slope")).collect()
        for row in sums:
            k, s, st = row["k"], open_[row["k"]], state[row["k"]]
            gap = row["value"] - s["target"]
            if abs(gap) <= tol * s["target"]:
                done[k] = st["lam"] / s["scale"]
                continue
            st["hi" if gap > 0 else "lo"] = st["lam"]
            slope = row["slope"] / s["scale"]
            step = st["lam"] - gap / slope if slope > 0 else math.nan
            if not (st["lo"] < step < st["hi"]):
                if math.isinf(st["lo"]) or math.isinf(st["hi"]):
                    step = st["lam"] + (2.0 if gap < 0 else -2.0) * max(1.0, abs(st["lam"]))
                else:
                    step = (st["lo"] + st["hi"]) / 2
            st["lam"] = step
        open_ = {k: s for k, s in open_.items() if k not in done}
    return done | {k: state[k]["lam"] / open_[k]["scale"] for k in open_}


def _settle(w: np.ndarray, copies: np.ndarray, most: np.ndarray, short: float) -> np.ndarray:
    """Move single copies between size classes (sizes ``w`` descending, at most
    ``most`` copies) while that brings ``short``, the words still missing, nearer
    to 0: one copy more, one less, or one of each."""
    while True:
        more, less = np.flatnonzero(copies < most), np.flatnonzero(copies > 0)
        if not len(more):
            gain = np.zeros(1)
        else:
            gain = np.r_[0, w[more][::-1]]  # ascending
        loss = np.r_[0, w[less]]
        at = np.searchsorted(gain, loss + short)
        near = np.stack([np.clip(at - 1, 0, len(gain) - 1), np.clip(at, 0, len(gain) - 1)])
        left = np.abs(short - gain[near] + loss)
        side, b = np.unravel_index(int(left.argmin()), left.shape)
        a = near[side, b]
        if left[side, b] >= abs(short) - 1e-9:
            return copies
        if a:
            copies[more[::-1][a - 1]] += 1
        if b:
            copies[less[b - 1]] -= 1
        short -= gain[a] - loss[b]


def _round_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies per size class of one source, largest sizes first: the token error
    of each rounding is carried to the next class, and what the last class leaves
    is settled between classes."""
    pdf = pdf.sort_values("w", ascending=False, kind="stable")
    carry, copies = 0.0, []
    for w, n, r, cap in zip(pdf["w"], pdf["n"], pdf["rate"], pdf["cap"]):
        want = n * r + (carry / w if w else 0.0)
        c = min(max(math.floor(want + 0.5), 0), int(n * cap))
        carry += w * (n * r - c)
        copies.append(c)
    most = (pdf["n"] * pdf["cap"]).to_numpy(np.int64)
    copies = _settle(pdf["w"].to_numpy(np.int64), np.array(copies, np.int64), most, carry)
    return pdf.assign(copies=copies)[["k", "w", "n", "copies"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tol: float = 1e-9,
        max_iter: int = 60) -> DataFrame:
    """Copies of every document in a mix of the sources.

    Returns one row per input row: the id, ``source``, ``size`` (words of the
    whole text, null: 0), ``source_size``, ``target`` (its source's), ``copies``
    (0 to ``cap``), ``taken`` (copies * size).  Sources are weighed in code
    point order, the null source last, by ``weights``, repeating.  Rows with
    the same id, source and size are taken together (repeated rows get the same
    copies).  Documents without words, and sources of no size, get 0 copies.
    An empty table gives no rows.  Choices among documents of one source and
    size follow a hash of the id, so reruns agree.

    Scale: the text is read once into a table of sizes.  The driver holds one
    number per source (the dual variables); Newton iterations and rounding work
    on the (source, size) table, whose rows for one source cannot exceed the
    square root of twice its words.  A size class is cut by hash into about
    sqrt(n) cells of sqrt(n) documents, so no class is ranked in one task."""
    sized = keep(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                             word_count(f"`{text_col}`").alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
    rows = sorted(((r["source"], r["size"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    targets = source_targets(rows, weights, share, cap)
    spark = docs.sparkSession
    info = spark.createDataFrame([(i, s, n, t) for i, ((s, n), t) in enumerate(zip(rows, targets))],
                                 "k int, source string, source_size bigint, target double")
    # one row per id, source and size: m repeated rows are taken together
    keyed = sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")) \
        .withColumn("w", F.col("size") * F.col("m"))
    bins = keyed.filter("w > 0").groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    bins = keep(bins.join(F.broadcast(info.select("k", F.col("source").alias("_s"))),
                          F.col("source").eqNullSafe(F.col("_s"))).select("k", "source", "w", "n"), "mix-bins")
    scale = {r["k"]: r["x"] for r in bins.groupBy("k").agg(
        (F.sum(F.col("n") * F.col("w") * F.col("w").cast("double")) / F.sum(F.col("n") * F.col("w"))).alias("x")).collect()}
    lam = _newton(bins, [{"k": i, "size": n, "target": t, "scale": scale[i]} for i, ((_, n), t)
                         in enumerate(zip(rows, targets)) if n], float(cap), tol, max_iter)
    tilt = F.broadcast(spark.createDataFrame(list(lam.items()), "k int, lam double"))
    # exp() can pass the cap's logarithm by an ulp: least() holds the bound
    rate = F.when(F.col("lam") == math.inf, float(cap)).when(F.col("lam") == -math.inf, 0.0) \
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("w"), F.lit(700.0)))))
    rounded = bins.join(tilt, "k").withColumn("rate", rate).withColumn("cap", F.lit(float(cap))) \
        .groupBy("k").applyInPandas(_round_source, "k int, w bigint, n bigint, copies bigint")
    sources = F.broadcast(info.select("k", F.col("source").alias("_s"), "source_size", "target"))
    rounded = keep(rounded.join(sources, "k").withColumn("cells", F.ceil(F.sqrt("n")).cast("int")), "mix-copies")
    # cells of a size class, and their shares of its copies
    cell = keyed.join(rounded.select(F.col("_s"), F.col("w").alias("_w"), "cells"),
                      F.col("source").eqNullSafe(F.col("_s")) & (F.col("w") == F.col("_w"))) \
        .withColumn("cell", F.pmod(F.xxhash64("id", F.lit(11)), F.col("cells")).cast("int")) \
        .select("id", "source", "size", "m", "w", "cell")
    cell = keep(cell.withColumn("in_cell", F.xxhash64("source", "w", "cell")), "mix-cells")
    upto = Window.partitionBy("source", "w").orderBy("cell")
    shares = cell.groupBy("source", "w", "cell", "in_cell").agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("upto", F.sum("c").over(upto))
    shares = shares.join(rounded.select("_s", F.col("w").alias("_w"), "n", "copies"),
                         F.col("source").eqNullSafe(F.col("_s")) & (F.col("w") == F.col("_w")))
    part = lambda x: F.floor(x * F.col("copies") / F.col("n"))
    shares = shares.withColumn("cell_copies", part(F.col("upto")) - part(F.col("upto") - F.col("c"))) \
        .select(F.col("source").alias("_s"), F.col("w").alias("_w"), F.col("cell").alias("_c"), F.col("in_cell"), "c",
                "cell_copies")
    rank = F.row_number().over(Window.partitionBy("in_cell", "source", "w", "cell")
                               .orderBy(F.xxhash64("id", F.lit(12)), "id", "size"))
    picked = cell.join(shares, ["in_cell"]) \
        .filter(F.col("source").eqNullSafe(F.col("_s")) & (F.col("w") == F.col("_w")) & (F.col("cell") == F.col("_c"))) \
        .withColumn("rank", rank) \
        .withColumn("copies", F.floor(F.col("cell_copies") / F.col("c"))
                    + F.when(F.col("rank") <= F.col("cell_copies") % F.col("c"), 1).otherwise(0)) \
        .select("id", "source", "size", "m", F.col("copies").cast("bigint").alias("copies"))
    empty = keyed.filter("w = 0").select("id", "source", "size", "m", F.lit(0).cast("bigint").alias("copies"))
    every = picked.unionByName(empty).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m")))).drop("i", "m")
    return every.join(sources, F.col("source").eqNullSafe(F.col("_s"))) \
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as ``mix`` takes it
    (columns unchanged, whatever their names).

    Null and empty texts have no words and are never taken; null ids and sources
    count as values; repeated rows are taken equally often; ties go by a hash of
    the id; an empty table stays empty."""
    copies = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("copies > 0") \
        .groupBy(F.col(id_col).alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size")) \
        .agg(F.max("copies").cast("int").alias("copies"))
    out = docs.select(row_of(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                      word_count(f"`{text_col}`").alias("words"))
    out = out.join(copies, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("words") == F.col("of_size"))
                   & F.col("source").eqNullSafe(F.col("of_source")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).select("row.*")
