"""Secret scan: base patterns, and random-looking strings found by comparing two
character Markov models.  Built from DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drover.llm.common import keep

# The base kinds in their listed order --------------------------------
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Maximal runs: the leftmost greedy matches of 20+ (24+) characters are exactly the
# long enough matches of the open-ended patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
# -------------------------------------------------------------------------------------
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{3,}"
#: Runs that may be secrets themselves: all but words joined by - or _.
UNKNOWN = (r"(?<![A-Za-z0-9+/_=-])(?![A-Za-z]?[a-z]{1,18}(?:[-_][A-Za-z]?[a-z]{1,18})+(?![A-Za-z0-9+/_=-]))"
           r"[A-Za-z0-9+/_=-]{20,}")
#: One pass finds the texts in which any pattern can match.
ANY = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}"""
       r"""|(?<![0-9a-f])[0-9a-f]{24}|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}""")


SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern in order, each with the length of what lies
    between it and the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    return F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(
        F.lit(kind).alias("kind"), F.length(b).alias("gap"), F.length(m).alias("len"), m.alias("text")))


def _spans(hits: DataFrame) -> DataFrame:
    """``row, start, kind, end, text, base`` of all matches in ``hits(row, t)``:
    the base kinds, and the runs that touch none of them.  Places are running
    sums over a text's matches, and what touches a run is a running maximum (or
    minimum) over its spans in order: one shuffle of the spans, linear in their
    number but for sorting."""
    t = F.col("t")
    kinds = [F.posexplode(_found(t, p, k)).alias("i", "m") for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN))]
    rows = [hits.select("row", e).select("row", "i", "m.*") for e in kinds]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = found.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("len"))
    # short values are no spans, but their places counted
    placed = placed.filter((F.col("kind") != 0) | (F.length(F.regexp_extract("text", ASSIGN, 2)) >= MIN_ASSIGNED))
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc(), F.col("end").desc())
    next_at = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("reach", reach).withColumn("next_at", next_at)
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce("next_at", F.lit(1 << 31)) < F.col("end"))
    return placed.filter(base | ~touched).select("row", "start", "kind", "end", "text")


def _pairs(token: Column) -> Column:
    """Adjacent characters of a token."""
    letters = F.split(token, "")
    n = F.length(token) - 1
    return F.zip_with(F.slice(letters, 1, n), F.slice(letters, 2, n), lambda a, b: F.concat(a, b))


def _bigrams(tokens: DataFrame) -> DataFrame:
    """Counts of adjacent character pairs of ``label, token``."""
    return tokens.filter(F.length("token") >= 2).select("label", F.explode(_pairs(F.col("token"))).alias("pair")) \
        .groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def _log_ratios(counts: list, smooth: float = 0.5, prior: float = 4.0) -> list[float]:
    """log P(next | last, random) - log P(next | last, ordinary) for each pair of
    the alphabet.  Ordinary pairs back off to how often the second character
    follows at all (a row never seen is no evidence of anything by itself, a
    character never seen is); the random model is an even mix of what was
    learned and the uniform one, so that unseen alphabets of random strings stay
    likely."""
    k = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    n = {label: [[0.0] * k for _ in range(k)] for label in (0, 1)}
    for label, pair, c in counts:
        if pair[0] in place and pair[1] in place:
            n[label][place[pair[0]]][place[pair[1]]] += c
    follows = [sum(row[b] for row in n[0]) for b in range(k)]
    single = [(f + smooth) / (sum(follows) + smooth * k) for f in follows]
    out = []
    for a in range(k):
        total = {label: sum(n[label][a]) for label in (0, 1)}
        for b in range(k):
            ordinary = (n[0][a][b] + prior * single[b]) / (total[0] + prior)
            random = (n[1][a][b] + smooth) / (total[1] + smooth * k)
            out.append(math.log((random + 1 / k) / 2) - math.log(ordinary))
    return out


def _llr(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: the sum over its adjacent pairs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded once
    k = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(token) - 1
    terms = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n),
                       lambda a, b: F.coalesce(F.try_element_at(table, (a - 1) * k + b), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _sample(df: DataFrame, rows: int, total: int, *cols: str) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``cols``."""
    unit = F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    return df.filter(unit < rows / max(1, total))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000,
         margin: float = 4.0) -> DataFrame:
    """Secrets of every whole text.

    Returns the id, ``base`` (array of start, kind, end, text: the base kinds,
    sorted) and ``found`` (the same with the random strings added); places are
    code points, ends exclusive, ``kind`` an index of ``KINDS``.

    The Markov models are fitted on a bounded, labelled sample: the values of as
    many base matches as about ``sample_docs`` documents with some have are the
    random strings; identifiers of about ``sample_docs`` documents outside base
    matches are the ordinary ones, without runs of 20+ characters that may be
    secrets themselves (that are not words joined by - or _).  A run of 20+ characters that touches no
    base match is reported if its log-likelihood ratio exceeds ``margin``.

    Null and empty texts have no spans; repeated rows are reported each; an
    empty table gives no rows; other columns are ignored.  Texts are scanned
    once; only those in which some pattern can match are looked at again, and
    their spans written once."""
    t = F.col("t")
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    marked = keep(seen.select("id", F.when(t.rlike(ANY), t).alias("t"), F.monotonically_increasing_id().alias("row")),
                  "secret-texts")
    spans = keep(_spans(marked.filter(t.isNotNull())), "secret-spans")
    held = spans.filter("kind < 3").select("row").distinct()
    size = marked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    value = F.when(F.col("kind") == 0, F.regexp_extract("text", ASSIGN, 2)).otherwise(F.col("text"))
    random = _sample(spans.filter("kind < 3"), sample_docs, held.count(), "text") \
        .select(F.lit(1).alias("label"), value.alias("token"))
    bare = t
    for pattern in (ASSIGN, ACCESS, HEX, UNKNOWN):
        bare = F.regexp_replace(bare, pattern, " ")
    ordinary = _sample(seen, sample_docs, size, "id").filter(t.isNotNull()).select(
        F.lit(0).alias("label"), F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("token"))
    # at most two counts per pair of the alphabet come to the driver
    alphabet = r"^[A-Za-z0-9+/_=.-]{2}$"
    ratios = _log_ratios([tuple(r) for r in _bigrams(random.unionByName(ordinary))
                          .filter(F.col("pair").rlike(alphabet)).collect()])
    kept = spans.filter((F.col("kind") < 3) | (_llr(F.col("text"), ratios) > margin))
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "text"))).alias("found"))
    none = F.array().cast(SPANS)
    out = marked.select("id", "row").join(lists, "row", "left").withColumn("found", F.coalesce("found", none))
    return out.select(F.col("id").alias(id_col), F.filter("found", lambda s: s["kind"] < 3).alias("base"), "found")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
