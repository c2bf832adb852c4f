"""Embedding near-duplicates: a navigable small-world graph for every shard,
every shard searched, beams widened until recall audits pass, cosines verified
on the original components and components united."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.common import components, keep
from drover.llm.jaccard import _labels
from drover.llm.vectors import by_dimension, exact_scale

_PAIRS = 1 << 22  # cosines held at a time


class SmallWorld:
    """Hierarchical navigable small-world graph over unit vectors, built and
    searched for many points at a time: a batch is searched in the graph of the
    points before it, linked to what it finds there and among itself, and its
    neighbours take it up, keeping links that lead in different directions."""

    def __init__(self, unit: np.ndarray, links: int = 12, beam: int = 48, seed: int = 5):
        self.unit, self.links, self.beam = unit.astype(np.float32), links, beam
        n = len(unit)
        g = np.random.default_rng([seed, n])
        height = np.minimum(np.floor(-np.log(1 - g.random(n)) / np.log(links)).astype(int), 6)
        # an insertion order that deals out what lies side by side; the top level leads
        order = np.lexsort((g.random(n), -height))
        self.layers: list[np.ndarray] = []
        self.entry = int(order[0]) if n else 0
        for level in range(int(height.max(initial=0)), -1, -1):
            members = order[height[order] >= level]
            self.layers.append(np.full((n, links * (2 if level == 0 else 1)), -1, np.int32))
            self._grow(members)

    def _grow(self, members: np.ndarray) -> None:
        done, net = 1, self.layers[-1]
        while done < len(members):
            batch = members[done: done + min(max(8, done), 512)]
            done += len(batch)
            ids, sims = self._beam(self.unit[batch], self._descend(self.unit[batch], len(self.layers) - 1), net,
                                   min(self.beam, done))
            own = self.unit[batch] @ self.unit[batch].T
            own[np.tri(len(batch), dtype=bool)] = -2  # each pair once: the later point links to the earlier
            mates = np.argsort(-own.T, axis=1)[:, : self.beam]
            near = np.take_along_axis(own.T, mates, axis=1)
            ids = np.concatenate([ids, np.where(near > -2, batch[mates], -1)], axis=1)
            sims = np.concatenate([sims, near], axis=1)
            net[batch, : self.links] = self._spread(batch, ids, sims, self.links)
            self._take_up(batch, net)

    def _spread(self, who: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` links of each row: nearest first, a candidate only if it
        is nearer to the point than to the links before it; the nearest others
        fill what is left."""
        rank = np.argsort(-np.where(ids < 0, -3, sims), axis=1, kind="stable")[:, : self.beam + most]
        ids, sims = np.take_along_axis(ids, rank, axis=1), np.take_along_axis(sims, rank, axis=1)
        out = np.full((len(who), most), -1, np.int32)
        step = max(1, _PAIRS // max(1, ids.shape[1] ** 2))
        for k in range(0, len(who), step):
            c, s = ids[k: k + step], sims[k: k + step]
            v = self.unit[c]
            between = v @ v.transpose(0, 2, 1)
            closest = np.full(c.shape, -2.0, np.float32)  # to a link taken so far
            taken, count = np.zeros(c.shape, bool), np.zeros(len(c), int)
            for j in range(c.shape[1]):
                ok = (c[:, j] >= 0) & (count < most - most // 4) & (s[:, j] > closest[:, j])
                taken[:, j] = ok
                count += ok
                closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
            first = np.argsort(np.where(c < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
            out[k: k + step, : first.shape[1]] = np.take_along_axis(c, first, axis=1)
        return out

    def _take_up(self, batch: np.ndarray, net: np.ndarray) -> None:
        """Neighbours of a batch link back to it."""
        src = np.repeat(batch, net.shape[1])
        dst = net[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("ij,ij->i", self.unit[src], self.unit[dst])
        order = np.lexsort((-sim, dst))
        src, dst, sim = src[order], dst[order], sim[order]
        who, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        ok = place < self.beam
        new = np.full((len(who), min(self.beam, int(count.max(initial=1)))), -1, np.int32)
        near = np.full(new.shape, -3.0, np.float32)
        row = np.repeat(np.arange(len(who)), count)[ok]
        new[row, place[ok]], near[row, place[ok]] = src[ok], sim[ok]
        old = net[who]
        have = np.where(old >= 0, np.einsum("ij,ikj->ik", self.unit[who], self.unit[old]), -3)
        room = (old >= 0).sum(axis=1) + np.minimum(count, self.beam) <= net.shape[1]
        ids, sims = np.concatenate([old, new], axis=1), np.concatenate([have, near], axis=1)
        if room.any():  # all fit: no choice to make
            rank = np.argsort(ids[room] < 0, axis=1, kind="stable")[:, : net.shape[1]]
            net[who[room]] = np.take_along_axis(ids[room], rank, axis=1)
        if not room.all():
            net[who[~room]] = self._spread(who[~room], ids[~room], sims[~room], net.shape[1])

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Greedy walk of each query through the first ``to`` layers."""
        at = np.full(len(q), self.entry)
        best = q @ self.unit[self.entry] if len(self.unit) else np.zeros(len(q))
        for net in self.layers[:to]:
            live = np.arange(len(q))
            while len(live):
                near = net[at[live]]
                sim = np.where(near >= 0, np.einsum("ij,ikj->ik", q[live], self.unit[near]), -3)
                j = sim.argmax(axis=1)
                top = sim[np.arange(len(live)), j]
                better = top > best[live]
                live = live[better]
                at[live], best[live] = near[better, j[better]], top[better]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, net: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points found for each query (-1 where fewer)."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -3.0, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("ij,ij->i", q, self.unit[start])
        opened = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.unit)), bool)
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while len(live):
            todo = np.where(opened[live] | (ids[live] < 0), -3, sims[live])
            j = todo.argmax(axis=1)
            more = todo[np.arange(len(live)), j] > -3
            live, j = live[more], j[more]
            if not len(live):
                break
            opened[live, j] = True
            near = net[ids[live, j]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, ids[live, j][:, None])] = True
            sim = np.where(fresh, np.einsum("ij,ikj->ik", q[live], self.unit[near]), -3).astype(np.float32)
            both = np.concatenate([sims[live], sim], axis=1)
            keep_at = np.argpartition(-both, beam - 1, axis=1)[:, :beam] if both.shape[1] > beam else \
                np.tile(np.arange(beam), (len(live), 1))
            names = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            opens = np.concatenate([opened[live], np.zeros(sim.shape, bool)], axis=1)
            ids[live], sims[live] = np.take_along_axis(names, keep_at, 1), np.take_along_axis(both, keep_at, 1)
            opened[live] = np.take_along_axis(opens, keep_at, 1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, beam = q.astype(np.float32), min(beam, len(self.unit))
        block = max(16, min(512, (1 << 25) // len(self.unit)))
        out = [self._beam(part, self._descend(part, len(self.layers) - 1), self.layers[-1], beam)
               for part in (q[k: k + block] for k in range(0, len(q), block))]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def widened(self, similarity: float, recall: float, beam: int, probes: int = 256, seed: int = 9) -> int:
        """The beam that passes the audit: probes are points turned away from
        members until the cosine is just the threshold, the hardest link there
        is; the member must be found for a share of ``recall`` of them.  The
        beam doubles until then; at the shard's size it holds everything."""
        n, d = self.unit.shape
        if n <= beam or d < 2:
            return min(n, beam)
        g = np.random.default_rng([seed, n])
        who = g.integers(0, n, probes)
        noise = g.standard_normal((probes, d))
        p = self.unit[who].astype(np.float64)
        noise -= np.einsum("ij,ij->i", noise, p)[:, None] * p
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        q = similarity * p + (1 - similarity ** 2) ** 0.5 * noise
        near = np.einsum("ij,ij->i", q, p)
        while beam < n:
            _, sims = self.search(q, beam)
            # found: the member itself or as near a one
            if (sims.max(axis=1) >= near - 1e-4).mean() >= recall:
                return beam
            beam *= 2
        return n


def exact_cosines(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (na[:, None] * nb[None, :])


def _lengths(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled rows (no overflow) and their lengths, in doubles."""
    m = exact_scale(m)
    return m, np.sqrt((m * m).sum(axis=1))


class Linker:
    """Links between the vectors of one shard, or of two.

    A graph is searched with every vector; what it finds is verified in double
    precision.  Then all pairs inside a found component, or between two
    components of which any two members met, are verified by matrix products,
    so a beam need not hold a large group of near copies.  Searches are audited:
    on the hardest probes, and on sampled vectors against all cosines; a failed
    audit doubles the beam."""

    def __init__(self, similarity: float, recall: float, beam: int, audit: int = 64):
        self.similarity, self.recall, self.beam, self.audit = similarity, recall, beam, audit

    def _hits(self, graph: SmallWorld, v, nv, q, nq, beam: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = graph.search(q / nq[:, None], beam)
        row, col = np.nonzero((ids >= 0) & (sims >= self.similarity - 1e-3))
        at = ids[row, col]
        cos = [np.einsum("ij,ij->i", q[r], v[c]) / (nq[r] * nv[c])
               for r, c in ((row[k: k + 65536], at[k: k + 65536]) for k in range(0, len(row), 65536))]
        ok = np.concatenate([*cos, np.zeros(0)]) >= self.similarity
        return row[ok], at[ok]

    def _sample(self, v, nv, q, nq) -> tuple[np.ndarray, np.ndarray]:
        """All links (row of q, row of v) of a bounded sample of ``q``."""
        at = np.unique(np.linspace(0, len(q) - 1, min(self.audit, len(q))).astype(int))
        r, c = np.nonzero(self._linked(q[at], nq[at], v, nv))
        return at[r], c

    def _linked(self, a, na, b, nb) -> np.ndarray:
        return (a @ b.T) / (na[:, None] * nb[None, :]) >= self.similarity

    def inside(self, graph: SmallWorld, v, nv, copies):
        """Of one shard: (links, copies linked, component as its first row)."""
        beam = graph.widened(self.similarity, self.recall, self.beam)
        x, y = self._sample(v, nv, v, nv)
        x, y = x[x != y], y[x != y]
        while True:
            group = _labels(len(v), *self._hits(graph, v, nv, v, nv, beam))
            if beam >= len(v) or not len(x) or (group[x] == group[y]).mean() >= self.recall:
                break
            beam *= 2
        links, docs = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            step = max(1, _PAIRS // len(own))
            for k in range(0, len(own) if len(own) > 1 else 0, step):
                part = own[k: k + step]
                hit = self._linked(v[part], nv[part], v[own], nv[own])
                hit[np.arange(len(part)), np.arange(k, k + len(part))] = False
                links[part], docs[part] = hit.sum(axis=1), hit @ copies[own]
        return links, docs, group

    def between(self, graph: SmallWorld, v, nv, group_v, copies_v, q, nq, group_q, copies_q):
        """Of two shards, the first with its graph: (links, copies linked) of
        either, and one linked pair of rows for each two components that met."""
        beam = graph.widened(self.similarity, self.recall, self.beam)
        x, y = self._sample(v, nv, q, nq)
        want = group_q[x].astype(np.int64) * (1 << 32) + group_v[y]
        while True:
            row, at = self._hits(graph, v, nv, q, nq, beam)
            met = np.unique(group_q[row].astype(np.int64) * (1 << 32) + group_v[at])
            if beam >= len(v) or not len(want) or np.isin(want, met).mean() >= self.recall:
                break
            beam *= 2
        of_v, of_q, pairs = np.zeros((2, len(v)), np.int64), np.zeros((2, len(q)), np.int64), []
        for c in met:
            a, b = np.flatnonzero(group_q == c >> 32), np.flatnonzero(group_v == c % (1 << 32))
            step, pair = max(1, _PAIRS // len(b)), None
            for k in range(0, len(a), step):
                part = a[k: k + step]
                hit = self._linked(q[part], nq[part], v[b], nv[b])
                of_q[:, part] += [hit.sum(axis=1), hit @ copies_v[b]]
                of_v[:, b] += [hit.sum(axis=0), copies_q[part] @ hit]
                if pair is None and hit.any():
                    r, j = np.unravel_index(hit.argmax(), hit.shape)
                    pair = (part[r], b[j])
            pairs += [pair] if pair else []
        return of_v, of_q, pairs


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two (no overflow) and their lengths, in doubles."""
    (_, m), = by_dimension(t.column("vec"), np.float64)
    m = exact_scale(m)
    return m, np.sqrt((m * m).sum(axis=1))


def _listed(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def _index(linker: Linker, links: int, beam: int):
    """One shard: its graph, components and links inside."""

    def run(key, t):
        t = t.sort_by("key")
        v, nv = _matrix(t)
        copies = t.column("copies").to_numpy()
        graph = SmallWorld(v / nv[:, None], links, beam)
        n_links, docs, group = linker.inside(graph, v, nv, copies)
        upper = [np.concatenate([net[i] for net in graph.layers[:-1] if i == graph.entry or (net[i] >= 0).any()]
                                or [np.zeros(0, np.int32)]) for i in range(len(v))]
        names = t.column("key").take(pa.array(group))
        return pa.table({**{c: t.column(c) for c in ("label", "dim", "s", "shards", "key", "copies", "vec")},
                         "pos": pa.array(np.arange(len(v)), pa.int32()), "grp": pa.array(group, pa.int32()),
                         "grp_key": names, "entry": pa.array(np.arange(len(v)) == graph.entry),
                         "net": _listed(list(graph.layers[-1])), "upper": _listed(upper),
                         "links": pa.array(n_links, pa.int64()), "docs": pa.array(docs, pa.int64())})
    return run


def _restored(t: pa.Table, unit: np.ndarray, links: int) -> SmallWorld:
    """The graph of a shard from its rows (in the order of ``pos``)."""
    graph = object.__new__(SmallWorld)
    graph.unit, graph.links = unit.astype(np.float32), links
    graph.entry = int(np.flatnonzero(t.column("entry").to_numpy())[0])
    upper = t.column("upper").to_pylist()
    height = [len(u) // links for u in upper]
    graph.layers = []
    for level in range(max(height), 0, -1):
        net = np.full((len(unit), links), -1, np.int32)
        for i, u in enumerate(upper):  # a point's lists end at level 1
            if height[i] >= level:
                net[i] = u[(height[i] - level) * links: (height[i] - level + 1) * links]
        graph.layers.append(net)
    graph.layers.append(np.array(t.column("net").to_pylist(), np.int32))
    return graph


_CROSS = "key string, links bigint, docs bigint, other string"


def _cross(linker: Linker, links: int):
    """Two shards of a label: the graph of the first searched with the second."""

    def run(key, a, b):
        out = {"key": [], "links": [], "docs": [], "other": []}
        if a.num_rows and b.num_rows:
            a, b = a.sort_by("pos"), b.sort_by("pos")
            (v, nv), (q, nq) = _matrix(a), _matrix(b)
            of_v, of_q, pairs = linker.between(
                _restored(a, v / nv[:, None], links), v, nv, a.column("grp").to_numpy(), a.column("copies").to_numpy(),
                q, nq, b.column("grp").to_numpy(), b.column("copies").to_numpy())
            names = a.column("key").to_pylist(), b.column("key").to_pylist()
            for keys, (n, d) in zip(names, (of_v, of_q)):
                for i in np.flatnonzero(n):
                    for c, x in zip(out, (keys[i], int(n[i]), int(d[i]), None)):
                        out[c].append(x)
            for y, x in pairs:
                for c, z in zip(out, (names[0][x], 0, 0, names[1][y])):
                    out[c].append(z)
        return pa.table({c: pa.array(x, pa.string() if c in ("key", "other") else pa.int64()) for c, x in out.items()})
    return run


def embedding_duplicates(vectors: DataFrame, similarity: float = 0.93, recall: float = 0.98, links: int = 12,
                         build_beam: int = 40, beam: int = 32, shard_rows: int = 1 << 13, id_col: str = "vec_id",
                         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Near-duplicates among the rows of one label: cosine (double precision) of
    ``similarity`` or more.

    Returns one row per input row: ``id, label, n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, its own included),
    ``n_vectors`` (other different vectors linked) and ``kept`` (the id is the
    component's).  Only pairs that a graph search led to are linked, all of
    them verified.

    Rows with a null label, and vectors that are null, empty, zero or hold null
    or non-finite components, link with nothing: own id, 0 links, kept.  Vectors
    of different lengths are not compared.  Repeated rows and equal vectors link
    with each other: they are one point of a graph and counted by their number.
    Null ids take part and are a component's id only if it has no other.  An
    empty table gives no rows; other columns are ignored.

    A label's points are dealt over shards of about ``shard_rows`` by a hash of
    the vector, each with one graph; every two shards meet in one tile.  Shards
    and tiles are bounded; work and copies grow with the square of a label's
    shards, so large labels want large shards."""
    v = F.col(f"`{vec_col}`")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`")
    takes = label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & fit & F.exists(v, lambda x: x != 0)
    # 128 hash bits stand for (label, vector)
    name = F.concat(F.hex(F.xxhash64(label, v)), F.lit(":"), F.hex(F.xxhash64(F.lit(11), v, label)))
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), v.alias("vec"),
                          F.when(takes, name).alias("key"))
    points = keep(base.filter("key is not null").groupBy("key").agg(
        F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("least")).withColumn("dim", F.size("vec")), "vectors-points")
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = points.join(sizes, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    linker = Linker(similarity, recall, beam)
    kind = points.schema["label"].dataType.simpleString()
    index = dealt.select("label", "dim", "s", "shards", "key", "copies", "vec").groupBy("label", "dim", "s").applyInArrow(
        _index(linker, links, build_beam),
        f"label {kind}, dim int, s int, shards int, key string, copies bigint, vec {points.schema['vec'].dataType.simpleString()}, "
        "pos int, grp int, grp_key string, entry boolean, net array<int>, upper array<int>, links bigint, docs bigint")
    index = keep(index, "vectors-index")
    many = index.filter("shards > 1")
    first = many.filter("s < shards - 1").withColumn("t", F.explode(F.sequence(F.col("s") + 1, F.col("shards") - 1)))
    second = many.filter("s > 0").select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"),
                                         F.col("s").alias("t"), "pos", "key", "copies", "grp", "vec")
    tile = ["label", "dim", "s", "t"]
    cross = keep(first.groupBy(*tile).cogroup(second.groupBy(*tile)).applyInArrow(_cross(linker, links), _CROSS),
                 "vectors-cross")
    edges = index.filter("key <> grp_key").select(F.col("key").alias("a"), F.col("grp_key").alias("b"))         .unionByName(cross.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    roots = components(edges, "vectors-components").withColumnRenamed("node", "key")
    counts = index.select("key", "links", "docs").unionByName(cross.filter("other is null").select("key", "links", "docs"))         .groupBy("key").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    # written, so that the join below can split a component that holds many rows
    heads = keep(points.select("key", "least").join(roots, "key").groupBy("root").agg(F.min("least").alias("head")),
                 "vectors-heads")
    info = points.select("key", "copies", "least").join(counts, "key").join(roots, "key", "left").join(heads, "root", "left") \
        .select("key", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("head")).alias("head"), "links",
                (F.col("copies") - 1 + F.col("docs")).alias("n"))
    alone = F.col("key").isNull()
    out = base.select("id", "label", "key").join(info, "key", "left").select(
        "id", "label", F.coalesce("n", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("head")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_vectors"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
