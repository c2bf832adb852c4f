"""Language identification by cross-parsing: each language's labelled sample is
held as a suffix automaton; a text is parsed greedily into the longest phrases
that occur in the sample, and the language with the fewest normalised phrases
wins."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drover.llm.common import crc_mod, map_texts

BREAK = 0  # anything but a letter
#: Symbols walked side by side in one stretch, and before it to come into step.
#: They change no result.
STRETCH, LEAD = 512, 64
#: Length of a match that nothing cuts, and the column of symbols in the hash table.
WHOLE, RARE = (1 << 24) - 1, -1


@functools.cache
def _folded() -> np.ndarray:
    """Symbol of every code point: a letter's lower-case form, else a break."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = ord(ch.lower()[:1])
    return table


def symbols(text: str) -> tuple[np.ndarray, int]:
    """Symbols of a text with runs of breaks collapsed; number of letters."""
    s = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != BREAK
    letters = int(keep.sum())
    keep[1:] |= s[:-1] != BREAK
    return s[keep], letters


def automaton(sequence: list[int]) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of a sequence: transitions, suffix links and lengths."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in sequence:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt, link, length


class Automata:
    """The automata of all languages, closed under suffix links: a row for each
    state, a column for each of a language's most frequent symbols, one for
    symbols that it lacks.  An entry holds the row that the match goes on in and
    the length that is left of it.  The symbols of large alphabets beyond the
    columns are looked up in a hash table and follow the links one by one."""

    def __init__(self, samples: dict[str, list[str]], columns: int = 64):
        self.langs, self.bits, built = [], [], []
        for lang in sorted(samples):
            s = np.concatenate([np.r_[symbols(t)[0], BREAK] for t in samples[lang]] or [np.zeros(0, np.int32)])
            if (s != BREAK).any():
                self.langs.append(lang)
                self.bits.append(math.log2(len(s) + 1))  # cost of a phrase: a place in the sample
                built.append((s, *automaton(s.tolist())))
        self.bits = np.array(self.bits)
        states = sum(len(nxt) for _, nxt, _, _ in built)
        self.width = columns + 1
        self.table = np.zeros((states, self.width), np.int64)
        self.column = np.full((len(built), 0x110000), columns, np.int16)
        self.roots, self.link, self.length = np.zeros(len(built), np.int64), np.zeros(states, np.int64), np.zeros(states, np.int64)
        keys, ends, base = [], [], 0
        for j, (s, nxt, link, length) in enumerate(built):
            known, count = np.unique(s, return_counts=True)
            often = known[np.argsort(-count, kind="stable")][:columns]
            self.column[j, known] = RARE
            self.column[j, often] = np.arange(len(often))
            self.roots[j] = base
            rows = slice(base, base + len(nxt))
            self.link[rows], self.length[rows] = np.array(link) + base, length
            self._close(self.table[rows], nxt, np.array(link), np.array(length), {c: i for i, c in enumerate(often.tolist())}, base)
            if len(known) > columns:
                own = set(often.tolist())
                found = [((base + v) << 21 | c, base + to) for v, edges in enumerate(nxt) for c, to in edges.items() if c not in own]
                keys += [k for k, _ in found]
                ends += [e for _, e in found]
            base += len(nxt)
        self.rare = dict(zip(keys, ends))

    def _close(self, table, nxt, link, length, place, base) -> None:
        """Rows by depth in the tree of links: that of the link, cut to its
        length, and a state's own transitions over it."""
        edges = [(v, place[c], to) for v, own in enumerate(nxt) for c, to in own.items() if c in place]
        edge = np.array(sorted(edges), np.int64).reshape(-1, 3)
        table[0] = (base * self.width) << 24  # back to the root, nothing left
        level = np.zeros(1, np.int64)
        order = np.argsort(link, kind="stable")
        by = link[order]
        while len(level):
            lo, hi = np.searchsorted(edge[:, 0], level), np.searchsorted(edge[:, 0], level, side="right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            v, c, to = edge[at].T
            table[v, c] = ((base + to) * self.width) << 24 | WHOLE
            lo, hi = np.searchsorted(by, level), np.searchsorted(by, level, side="right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            level = order[at]
            up = table[link[level]]
            table[level] = up & ~WHOLE | np.minimum(up & WHOLE, length[link[level], None] + 1)

    def step_rare(self, state: int, length: int, symbol: int, root: int) -> tuple[int, int]:
        """(state, length) after a symbol beyond the columns."""
        while (to := self.rare.get(state << 21 | symbol)) is None:
            state = int(self.link[state])
            if state < root:
                return root, 0
            length = int(self.length[state])
        return to, length + 1


class CrossParser:
    """Phrase counts of many texts against all languages at once.  What travels
    to the tasks are the samples; each worker builds the automata from them."""

    def __init__(self, samples: dict[str, list[str]]):
        self.samples = samples
        self._built: Automata | None = None

    def __getstate__(self):
        return {"samples": self.samples, "_built": None}

    @property
    def automata(self) -> Automata:
        if self._built is None:
            self._built = Automata(self.samples)
        return self._built

    @property
    def langs(self) -> list[str]:
        return self.automata.langs

    def _walk(self, flat, columns, some_rare: bool, begin: np.ndarray, steps: int) -> np.ndarray:
        """Longest match that ends at each of the ``steps`` symbols from ``begin``
        on, for every language: [steps, rows, languages].  Rows start without
        knowing what went before them."""
        a, langs = self.automata, len(self.langs)
        table, width = a.table.ravel(), a.width
        state = np.tile(a.roots * width, (len(begin), 1))
        length = np.zeros(state.shape, np.int64)
        out = np.zeros((steps, len(begin), langs), np.int32)
        for t in range(steps):
            at = np.minimum(begin + t, len(flat) - 1)
            column = columns[at]
            entry = table[state + column]
            new = entry >> 24
            now = np.minimum(length + 1, entry & WHOLE)
            if some_rare:
                for r, j in zip(*np.nonzero(column == RARE)):
                    to, n = a.step_rare(int(state[r, j]) // width, int(length[r, j]), int(flat[at[r]]), int(a.roots[j]))
                    new[r, j], now[r, j] = to * width, n
            state, length = new, now
            out[t] = length
        return out

    def matches(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Longest match that ends at each symbol of each text, [symbols,
        languages].  Texts are walked in stretches side by side, each after a
        lead; where the match in hand fills all of the lead, it may begin before
        it, and the stretch is walked again with a longer one."""
        first = np.cumsum(lens) - lens
        n_seg = -(-lens // STRETCH)
        doc = np.repeat(np.arange(len(lens)), n_seg)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        begin = first[doc] + nth * STRETCH
        size = np.minimum(STRETCH, (first + lens)[doc] - begin)
        before = begin - first[doc]
        out = np.zeros((len(flat), len(self.langs)), np.int32)
        columns = np.ascontiguousarray(self.automata.column[:, flat].T.astype(np.int64))
        some_rare = bool((columns == RARE).any())
        rows, lead = np.argsort(-size, kind="stable"), LEAD
        while len(rows):
            again = []
            for k in range(0, len(rows), step := max(1, (1 << 19) // (lead + STRETCH))):
                part = rows[k: k + step]
                back, n = np.minimum(lead, before[part]), size[part]
                got = self._walk(flat, columns, some_rare, begin[part] - back, int((back + n).max()))
                row = np.repeat(np.arange(len(part)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(begin[part], n) + at] = got[np.repeat(back, n) + at, row]
                full = (got[back, np.arange(len(part))] > back[:, None]).any(axis=1)
                again.append(part[full & (back < before[part])])
            rows, lead = np.concatenate(again), 4 * lead
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [texts, languages], symbols, letters).  A phrase is the
        longest run from where the last one ended that occurs in the sample; a
        symbol that the sample lacks ends a phrase and goes with the next one."""
        parts = [symbols(t) for t in texts]
        lens = np.array([len(s) for s, _ in parts], np.int64)
        letters = np.array([k for _, k in parts], np.int64)
        total = np.ones((len(texts), len(self.langs)), np.int64)
        if not len(self.langs) or not lens.sum():
            return total, lens, letters
        flat = np.concatenate([s for s, _ in parts])
        first, last = np.cumsum(lens) - lens, np.cumsum(lens)
        match = self.matches(flat, lens)
        place, ends = np.arange(len(flat)), np.repeat(last, lens)
        spans = list(zip(first.tolist(), last.tolist()))
        for j in range(len(self.langs)):
            # The longest match that ends here begins at a place that never falls, in a text or
            # from one to the next; so the match from here fails behind all that begin up to here.
            stop = np.cumsum(np.bincount(place + 1 - match[:, j], minlength=len(flat) + 1))[:-1]
            unknown = np.append(match[:, j] == 0, False)
            # to the next phrase, -1 in the last one
            hop = memoryview(np.where(stop < ends, stop + unknown[stop], -1))
            for i, (at, end) in enumerate(spans):
                n = 1
                while at < end and (at := hop[at]) >= 0:
                    n += 1
                total[i, j] = n
        return total, lens, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, lens, letters = self.phrases([t or "" for t in texts])
        lang, score = [], []
        for row, n, k in zip(total, lens, letters):
            if k == 0 or not self.langs:
                lang.append("und")
                score.append(0.0)
                continue
            cost = row * self.automata.bits / n  # bits per symbol
            best = int(cost.argmin())  # ties: first in code point order
            rest = np.delete(cost, best)
            lang.append(self.langs[best])
            score.append(float(rest.min() / (rest.min() + cost[best])) if len(rest) else 1.0)
        return lang, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_mod: int = 4,
        held_rest: int = 2, docs_per_lang: int = 64, longest: int = 1 << 13, chars: int = 1 << 17) -> CrossParser:
    """Samples of labelled texts, whole ones of at most ``longest`` characters: of
    each language those with the smallest id hashes among the documents not held
    out, at most ``docs_per_lang``, as far as they fit into its share of
    ``chars`` characters (the first always counts).

    Null languages, texts and ids teach nothing, nor do texts without a letter;
    repeated rows and equal hashes go by their text; an empty table gives a
    parser without languages; other columns are ignored."""
    label, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    learn = docs.filter(label.isNotNull() & (F.length(text) <= longest) & (crc_mod(id_col, held_mod) != held_rest))
    by = Window.partitionBy("lang").orderBy("h", "whole")
    rows = learn.select(label.alias("lang"), F.xxhash64(F.col(f"`{id_col}`")).alias("h"), text.alias("whole")) \
        .withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= docs_per_lang) \
        .orderBy("lang", "rank").collect()  # bounded: docs_per_lang * longest characters a language
    samples: dict[str, list[str]] = {r["lang"]: [] for r in rows}
    for r in rows:
        own = samples[r["lang"]]
        if not own or sum(map(len, own)) + len(r["whole"]) <= chars // len(samples):
            own.append(r["whole"])
    return CrossParser(samples)


_PARSERS: dict[int, CrossParser] = {}


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text",
             keep_cols: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) for every whole text.

    The language whose automaton needs the fewest bits (phrases times the cost
    of one, per symbol) wins, ties by code point order; the score compares it
    with the runner-up (0.5: as good).  Null texts and texts without a letter
    are ``und`` with score 0, as is everything if no language was learned; with
    one language the score is 1.  Repeated rows get equal results; an empty
    table stays empty; input columns named like an output are replaced.  The
    samples are broadcast; their size is bounded by ``fit``."""
    model = docs.sparkSession.sparkContext.broadcast(parser)

    def make():
        key = hash(str(sorted(model.value.samples.items())))
        if key not in _PARSERS:  # one parser a worker
            _PARSERS.clear()
            _PARSERS[key] = model.value
        return lambda texts: dict(zip(("lang_pred", "score"), _PARSERS[key].predict(texts)))

    out = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())}
    return map_texts(docs, make, out, text_col, keep_cols)
