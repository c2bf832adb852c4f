"""Toxicity: a bidirectional gated recurrent network with attention pooling over
word and character inputs, trained in numpy on a bounded labelled sample; a
text's score is that of its worst window, over all overlapping windows."""

from __future__ import annotations

import itertools
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.common import crc_mod, keep, map_texts, text_slices

WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 12
DIM, HIDDEN = 12, 8
WINDOW, STRIDE = 64, 48
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—¡¿"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, character trigram rows, first trigram of each word)."""
    raw = [w.lower().strip(EDGES).encode() for w in words]
    row = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(b"\2" + w + b"\3\3" for w in raw), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 3
    code = flat[:-2] * 65599 * 65599 + flat[1:-1] * 65599 + flat[2:] if len(flat) else flat
    code = (code * 0x9E3779B1 >> 15) % CHAR_ROWS
    first = np.cumsum(size) - size
    inside = np.ones(len(flat), bool)
    inside[first + size - 1] = inside[first + size - 2] = False  # no trigram across two words
    return row, code[inside[: len(code)]], np.cumsum(size - 2) - (size - 2)


def words_of(text: str) -> list[str]:
    """Words of a text; a text without any holds one blank word, which the
    network learns like the others (an empty window would only tell its bias)."""
    return text.split() or [""]


def windows(n: int) -> list[tuple[int, int]]:
    """All overlapping windows of a text of ``n`` words."""
    last = -(-max(0, n - WINDOW) // STRIDE) * STRIDE
    return [(a, min(a + WINDOW, n)) for a in range(0, last + 1, STRIDE)]


class BiGru:
    """The network and its hand-written gradients."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (0.1 * g.standard_normal((WORD_ROWS, DIM))).astype(np.float32),
                  "char": (0.1 * g.standard_normal((CHAR_ROWS, DIM))).astype(np.float32),
                  "u": np.zeros(2 * HIDDEN, np.float32), "w": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(DIM, 3 * HIDDEN), f"h{d}": f(HIDDEN, 3 * HIDDEN),
                       f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0  # calibration of a text's worst logit
        self.constant: float | None = None  # score if no network could be trained

    def inputs(self, row, tri, first) -> np.ndarray:
        size = np.diff(np.r_[first, len(tri)]).astype(np.float32)
        return self.p["word"][row] + np.add.reduceat(self.p["char"][tri], first, axis=0) / size[:, None]

    def projected(self, words: list[str]) -> list[np.ndarray]:
        """Input parts of either direction's gates for each word."""
        x = self.inputs(*features(words))
        return [x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"]

    # scoring ----------------------------------------------------------------------
    def logits(self, fore: np.ndarray, back: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows of the input tables (sorted by size, longest
        first; only the first ``size`` ids of a row count)."""
        n, h = len(ids), HIDDEN
        steps = int(size.max(initial=0))
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        ids = np.ascontiguousarray(ids.T)
        ahead = np.zeros((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps):
            m = live[t]
            state[:m] = self._step(fore.take(ids[t, :m], axis=0), state[:m], "f")
            ahead[t] = state
        state = np.zeros((n, h), np.float32)
        top, den = np.zeros((n, 2 * h), np.float32), np.full(n, 1e-9, np.float32)
        uf, ub = self.p["u"][:h], self.p["u"][h:]
        for t in range(steps - 1, -1, -1):
            m = live[t]
            state[:m] = self._step(back.take(ids[t, :m], axis=0), state[:m], "b")
            e = np.exp(np.clip(ahead[t, :m] @ uf + state[:m] @ ub, -30, 30))
            top[:m, :h] += e[:, None] * ahead[t, :m]
            top[:m, h:] += e[:, None] * state[:m]
            den[:m] += e
        return (top / den[:, None]) @ self.p["w"] + self.p["c"][0]

    def _step(self, gx, state, d):
        h = HIDDEN
        gh = state @ self.p[f"h{d}"]
        zr = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
        new = np.tanh(gx[:, 2 * h:] + zr[:, h:] * gh[:, 2 * h:])
        return new + zr[:, :h] * (state - new)

    # training ---------------------------------------------------------------------
    def gradients(self, feats, ids, size, label, weight):
        """Loss and gradients for windows of word numbers into ``feats``."""
        row, tri, first = feats
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)
        last = np.r_[first, len(tri)]
        length = (last[used + 1] - last[used]).astype(np.int64)
        at = np.repeat(last[used] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        x = self.inputs(row[used], tri[at], np.cumsum(length) - length)
        n, steps = ids.shape
        mask = (np.arange(steps) < size[:, None]).astype(np.float32)
        saved, hs = {}, []
        for d in "fb":
            gx_all = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
            state, out, trace = np.zeros((n, HIDDEN), np.float32), [None] * steps, [None] * steps
            for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
                gh = state @ self.p[f"h{d}"]
                gx = gx_all[local[:, t]]
                zr = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gx[:, 2 * HIDDEN:] + r * gh[:, 2 * HIDDEN:])
                m = mask[:, t, None]
                trace[t] = (state, z, r, new, gh[:, 2 * HIDDEN:], m)
                state = m * (new + z * (state - new)) + (1 - m) * state
                out[t] = state
            saved[d] = trace
            hs.append(np.stack(out))
        hs = np.concatenate(hs, axis=2)  # steps, n, 2h
        e = np.where(mask.T > 0, np.clip(hs @ self.p["u"], -30, 30), -60)
        a = np.exp(e - e.max(axis=0))
        a = a * mask.T / np.maximum((a * mask.T).sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * hs).sum(axis=0)
        p = _sigmoid(pooled @ self.p["w"] + self.p["c"][0])
        loss = -(weight * np.where(label > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))).mean()
        dl = (weight * (p - label) / n).astype(np.float32)
        g = {"w": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["w"]
        da = (hs * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        g["u"] = np.einsum("tn,tnh->h", de, hs)
        dhs = a[:, :, None] * dp + de[:, :, None] * self.p["u"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = dhs[:, :, k * HIDDEN: (k + 1) * HIDDEN]
            dgx_all = np.zeros((len(used), 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(self.p[f"h{d}"]), np.zeros((n, HIDDEN), np.float32)
            for t in (range(steps - 1, -1, -1) if d == "f" else range(steps)):
                state, z, r, new, ghn, m = saved[d][t]
                dh = dh + part[t]
                dnew = dh * m
                back = dh * (1 - m) + dnew * z
                dan = dnew * (1 - z) * (1 - new * new)
                daz = dnew * (state - new) * z * (1 - z)
                dar = dan * ghn * r * (1 - r)
                dgh = np.concatenate([daz, dar, dan * r], axis=1)
                np.add.at(dgx_all, local[:, t], np.concatenate([daz, dar, dan], axis=1))
                du += state.T @ dgh
                dh = back + dgh @ self.p[f"h{d}"].T
            g[f"h{d}"], g[f"b{d}"] = du, dgx_all.sum(axis=0)
            g[f"x{d}"] = x.T @ dgx_all
            dx += dgx_all @ self.p[f"x{d}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], row[used], dx)
        np.add.at(g["char"], tri[at], np.repeat(dx / length[:, None], length, axis=0).astype(np.float32))
        return loss, g


class Scorer:
    """Scores whole texts; keeps the projected inputs of words seen before."""

    def __init__(self, net: BiGru, max_cached: int = 250_000):
        self.net, self.max_cached = net, max_cached
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.tables = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in "fb"]

    def _numbers(self, lists: list[list[str]]) -> np.ndarray:
        every = set().union(*lists)
        new = [w for w in every if w not in self.at]
        if len(self.at) + len(new) > self.max_cached:
            self._reset()
            new = list(every)
        if new:
            begin, end = len(self.at), len(self.at) + len(new)
            while len(self.tables[0]) < end:
                self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
            for t, rows in zip(self.tables, self.net.projected(new)):
                t[begin:end] = rows
            self.at.update(zip(new, range(begin, end)))
        get = self.at.__getitem__
        return np.fromiter(map(get, itertools.chain.from_iterable(lists)), np.int32, sum(map(len, lists)))

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, logit) of every window."""
        lists = [words_of(t) for t in texts]
        flat = np.r_[self._numbers(lists), np.zeros(WINDOW, np.int32)]
        doc, begin, size, at = [], [], [], 0
        for i, words in enumerate(lists):
            for a, b in windows(len(words)):
                doc.append(i)
                begin.append(at + a)
                size.append(b - a)
            at += len(words)
        doc, begin, size = np.array(doc), np.array(begin), np.array(size)
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(doc), np.float32)
        for k in range(0, len(order), 2048):  # what a step touches stays in the cache
            part = order[k: k + 2048]
            out[part] = self.net.logits(*self.tables, flat[begin[part][:, None] + np.arange(WINDOW)], size[part])
        return doc, out

    def worst(self, texts: list[str]) -> np.ndarray:
        top = np.full(len(texts), -np.inf, np.float32)
        for k in range(0, len(texts), 512):
            doc, logit = self.window_logits(texts[k: k + 512])
            np.maximum.at(top, k + doc, logit)
        return top

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        return 1 / (1 + np.exp(-(self.net.scale * self.worst([t or "" for t in texts]).astype(np.float64) + self.net.shift)))


def _word_rows(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.lower().strip(EDGES).encode()) % WORD_ROWS for w in words), np.int64, len(words))


def word_counts(texts: list[str], labels) -> np.ndarray:
    """Texts of either label that hold each hashed word."""
    seen = np.zeros((2, WORD_ROWS), np.int64)
    for t, y in zip(texts, labels):
        seen[int(y), np.unique(_word_rows(list(set(t.split()))))] += 1
    return seen


def word_odds(seen: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds per hashed word: where to look first, and a good start."""
    odds = np.log((1 + seen[1]) / (1 + n_toxic)) - np.log((1 + seen[0]) / (1 + n_clean))
    return odds * np.minimum(1, seen.sum(axis=0) / 20)


def choose(ids, texts: list[str], labels, rnd: int, odds: np.ndarray, scorer: Scorer | None, seed: int) -> list[list[str]]:
    """The windows of each text to train on, as words joined by blanks: the one
    that looks worst among all windows of the text (by word odds, later by the
    network) and one more, drawn by the id, of a clean text."""
    if scorer:
        doc, logit = scorer.window_logits(texts)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, (i, t, y) in enumerate(zip(ids, texts, labels)):
        words = words_of(t)
        spans = windows(len(words))
        if scorer:
            pick = [int(np.argmax(logit[ends[k]: ends[k + 1]]))]
        else:
            c = np.r_[0, np.cumsum(np.maximum(odds[_word_rows(words)], 0) ** 2)]
            pick = [int(np.argmax([c[b] - c[a] for a, b in spans]))]
        if not y:
            pick.append(zlib.crc32(f"{seed}.{rnd}.{i}".encode()) % len(spans))
        out.append([" ".join(words[slice(*spans[p])]) for p in pick])
    return out


class Fit:
    """A network in training; goes from round to round."""

    def __init__(self, odds: np.ndarray, n_toxic: int, n_clean: int, seed: int):
        self.net, self.seed, self.step = BiGru(seed), seed, 0
        self.blank = max(8, (n_toxic + n_clean) // 50)  # a text without words is clean
        n_clean += self.blank
        self.weight = (0.5 / n_clean * (n_clean + n_toxic), 0.5 / n_toxic * (n_clean + n_toxic))
        self.net.p["word"][:, 0] = np.clip(odds, -3, 3)
        self.mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.net.p.items()}

    def round(self, rnd: int, found: list[str], labels: list[int], epochs: int = 4, batch: int = 128,
              rate: float = 0.01) -> None:
        """Train on windows."""
        net, g = self.net, np.random.default_rng([self.seed, rnd])
        found, labels = [*found, *[""] * (2 * self.blank)], [*labels, *[0] * (2 * self.blank)]
        number: dict[str, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in found]
        feats = features([*number, ""])  # the last one pads
        for _ in range(epochs):
            order = g.permutation(len(found))
            for k in range(0, len(order), batch):
                part = order[k: k + batch]
                size = np.array([len(ids[i]) for i in part])
                win = np.full((len(part), max(1, size.max())), len(number), np.int64)
                for r, i in enumerate(part):
                    win[r, : size[r]] = ids[i]
                y = np.array([labels[i] for i in part], np.float32)
                w = np.array([self.weight[int(v)] for v in y], np.float32)
                _, grad = net.gradients(feats, win, size, y, w)
                self.step += 1
                step, norm = self.step, np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
                for name, v in grad.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m, s = self.mom[name]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    lr = rate / (1 + step / 400)
                    net.p[name] -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)

    def calibrate(self, worst: np.ndarray, labels: np.ndarray) -> BiGru:
        """Fit the worst logits of whole texts to their labels."""
        empty = Scorer(self.net).worst([""] * self.blank)
        x, labels = np.r_[worst, empty].astype(np.float64), np.r_[labels, np.zeros(self.blank, labels.dtype)]
        weight = np.array(self.weight)[labels]
        x0, sd = x.mean(), x.std() + 1e-9
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a two-parameter logistic fit
            p = 1 / (1 + np.exp(-(a * (x - x0) / sd + b)))
            f = np.stack([(x - x0) / sd, np.ones_like(x)])
            hess = (f * (weight * p * (1 - p))) @ f.T + 1e-3 * np.eye(2)
            a, b = np.array([a, b]) - np.linalg.solve(hess, f @ (weight * (p - labels)) + 1e-3 * np.array([a, b]))
        self.net.scale, self.net.shift = a / sd, b - a * x0 / sd
        return self.net


def train(texts: list[str], labels: np.ndarray, seed: int = 5, rounds: int = 3) -> BiGru:
    """Fit the network: a label holds for a text, so each round trains on the
    window of each text that looks worst so far (first by word odds) and on one
    more window of each clean text."""
    if not len(texts) or labels.min() == labels.max():
        net = BiGru(seed)
        net.constant = float(labels[0]) if len(texts) else 0.0
        return net
    n = int((labels == 1).sum()), int((labels == 0).sum())
    odds = word_odds(word_counts(texts, labels), *n)
    state = Fit(odds, *n, seed)
    for rnd in range(rounds):
        got = choose(range(len(texts)), texts, labels, rnd, odds, Scorer(state.net) if rnd else None, seed)
        state.round(rnd, [w for g in got for w in g], [int(y) for g, y in zip(got, labels) for _ in g])
    return state.calibrate(Scorer(state.net).worst(texts), labels)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        held_mod: int = 5, held_rest: int = 0, docs_per_class: int = 1200, seed: int = 5, rounds: int = 3) -> BiGru:
    """Train on about ``docs_per_class`` labelled documents of either class
    (chosen by a hash of the id, none held out), whole texts.

    Labels other than 0 and 1 (null too) and ids without a document are left
    out; of a repeated id one row counts, toxic if any of its labels says so;
    null and empty texts train as a blank word; without labels of both kinds
    the score is constant; other columns are ignored.

    The sample is written once.  Each pass over it runs in Spark tasks, which
    look at all windows of their texts and return only the chosen windows (at
    most two a text) or each text's worst logit; the windows of a round are
    trained on in one task, which Spark runs again if its executor is lost."""
    known = labels.filter(F.col(label_col).isin(0, 1) & (crc_mod(id_col, held_mod) != held_rest)) \
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, docs_per_class / max(1, n.get(1, 0))).otherwise(docs_per_class / max(1, n.get(0, 0)))
    some = known.filter(unit < share).groupBy("id").agg(F.max("y").alias("y"))
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")) \
        .join(F.broadcast(some), "id").dropDuplicates(["id"])
    sample = keep(sample.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "id"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return train([""] * len(n), np.array([*n], np.int64), seed)

    def parts(batches):
        for b in batches:
            for begin, texts in text_slices(b, "t", 1 << 20):
                rows = b.slice(begin, len(texts))
                yield rows.column("id").to_pylist(), texts, rows.column("y").to_pylist()

    def count(batches):
        seen = np.zeros((2, WORD_ROWS), np.int64)
        for _, texts, y in parts(batches):
            seen += word_counts(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])

    seen = np.zeros((2, WORD_ROWS), np.int64)
    for r in sample.mapInArrow(count, "seen binary").toLocalIterator():
        seen += np.frombuffer(r["seen"], np.int64).reshape(seen.shape)
    odds = word_odds(seen, n[1], n[0])
    state = Fit(odds, n[1], n[0], seed)
    for rnd in range(rounds):
        def look(batches, net=state.net, rnd=rnd):
            scorer = Scorer(net) if rnd else None
            for ids, texts, y in parts(batches):
                got = choose(ids, texts, y, rnd, odds, scorer, seed)
                yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(y, pa.int32()),
                                                  pa.array(got, pa.list_(pa.string()))], names=["id", "y", "w"])

        def learn(batches, state=state, rnd=rnd):
            rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "y", "w"))))
            state.round(rnd, [w for r in rows for w in r[2]], [r[1] for r in rows for _ in r[2]])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

        found = sample.mapInArrow(look, "id string, y int, w array<string>")
        state = pickle.loads(found.repartition(1).mapInArrow(learn, "state binary").first()["state"])

    def worst(batches, net=state.net):
        scorer = Scorer(net)
        for _, texts, y in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(scorer.worst(texts), pa.float32())], names=["y", "x"])

    got = sorted((r["y"], r["x"]) for r in sample.mapInArrow(worst, "y int, x float").collect())
    return state.calibrate(np.array([x for _, x in got]), np.array([y for y, _ in got], np.int64))


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, net: BiGru, text_col: str = "text", keep_cols: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """Add ``out``, the toxicity (0 to 1) of every whole text: that of its worst
    window among all overlapping ones.

    Null and empty texts count as one blank word and get its (low) score; a text
    shorter than a window is one window; repeated rows score alike; an empty
    table stays empty; an input column named like the output is replaced.  If
    the labels held a single class, every score is that class's label (no
    labels: 0).  The network is broadcast, a fixed 0.6 MB."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        if model.value is not None and id(model.value) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(model.value)] = Scorer(model.value)
        scorer = _SCORERS[id(model.value)]
        return lambda texts: {out: scorer.scores(texts)}

    return map_texts(docs, make, {out: ("double", pa.float64())}, text_col, keep_cols)


def drop_toxic(docs: DataFrame, net: BiGru, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, columns unchanged: null and
    empty texts stay, repeated rows stay or go together, an empty table stays
    empty, and columns of any name pass (the score takes a free one)."""
    name = "_toxic"
    while name in docs.columns:
        name += "_"
    return score(docs, net, text_col, out=name).filter(F.col(name) < threshold) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
