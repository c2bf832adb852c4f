"""Clashing column names, surrogates and triggers, and plain recomputations of the
random spans and of a whole text's toxicity."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import docs, empty, odd  # noqa: F401
from drover.llm import jaccard, mixing, pii, secrets, toxicity

#: Names that the operators have used or use inside.
INSIDE = ("_words _i _id _source _size _copies _text_key _key _cell _kept _rows _text _tries _both _toxic row id key words "
          "copies kept rows t both tries new n i of_id of_key of_source of_size __text _where Size odd.name").split()


def with_all_names(odd):
    own = [c for c in INSIDE if c.lower() not in {x.lower() for x in odd.columns}]
    return odd.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in own]), own


def check_kept(out, names, columns):
    assert out.columns == columns
    for r in out.collect():
        i = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert [r[c] for c in names] == [f"{c}:{i}" for c in names]


def test_stages_keep_columns_of_internal_names(odd):
    df, names = with_all_names(odd)
    net = toxicity.train(["good text here", "bad awful text"] * 20, np.array([0, 1] * 20))
    check_kept(toxicity.drop_toxic(df, net), names, df.columns)
    check_kept(jaccard.drop_near_duplicates(df), names, df.columns)
    private = pii.replace_private(df)
    check_kept(private, names, [*df.columns, "n_entities"])
    assert all("a.b@c.example.org" not in (r["text"] or "") for r in private.collect())
    check_kept(mixing.take_mix(df), names, df.columns)
    # what they do doesn't depend on further columns
    assert Counter(r["doc_id"] for r in jaccard.drop_near_duplicates(df).collect()) == \
        Counter(r["doc_id"] for r in jaccard.drop_near_duplicates(odd).collect())
    assert Counter(r["doc_id"] for r in mixing.take_mix(df).collect()) == Counter(r["doc_id"] for r in mixing.take_mix(odd).collect())


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_has_a_trigger(data):
    kind = data.draw(st.sampled_from(sorted(pii.PATTERNS)))
    text = data.draw(st.from_regex(re.compile(pii.PATTERNS[kind]), fullmatch=True))
    around = data.draw(st.sampled_from(["", "x ", " (", "\n", "é"]))
    for m in pii.FIND.finditer(around + text):
        assert re.search(pii.TRIGGER, m.group(), re.ASCII), m.group()


def test_triggers_reach_the_texts(spark):
    df = spark.createDataFrame([(1, "+123456"), (2, "call +123456 now"), (3, "Mr. Smith"), (4, "nothing")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_entities"] for r in pii.replace_private(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_no_surrogate_is_an_entity(spark):
    mail = [("email", f"{c}@mail3.example.com") for c in "abcdefghijklmnopqrstuvwxyz"]  # a full space
    most = [("email", f"{i}@x.example.org") for i in range(9)]
    lan = [("ip", f"192.168.0.{i}") for i in range(1, 255)]
    rows = pii.attempts(spark.createDataFrame(mail + most + lan, "kind string, canon string"), "k", 3).collect()
    s = pii.Surrogates("k", {(r["kind"], r["canon"]): r["attempt"] for r in rows})
    made, entities = {(r["kind"], r["made"]) for r in rows}, set(mail + most + lan)
    assert len(rows) == len(entities) == len(made) and not made & entities
    assert all(s.make(r["kind"], r["canon"], r["attempt"]) == r["made"] for r in rows)
    for r in rows:
        if r["kind"] == "email":
            assert r["made"].split("@")[1] == s._host(r["canon"].split("@")[1])
        else:
            assert pii._PRIVATE.match(r["made"])
    text = "a@mail3.example.com and B@MAIL3.EXAMPLE.COM, c@mail3.example.com"
    new, n = s.replace(text)
    assert n == 3 and not re.search(r"\b[a-z]@mail3", new, re.I) and len(set(re.findall(r"\S+@\S+\w", new.lower()))) == 3


def plain_secrets(texts):
    """kind:start:end of all spans of each text, in plain Python."""
    assign = re.compile(secrets.ASSIGN.replace("(?i:(", "((?i:").replace("api_?key))", "api_?key))"))
    base, random, ordinary = [], Counter(), Counter()
    for t in texts:
        t = t or ""
        spans = [(m.start(), 0, m.end(), m.group(2)) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        spans += [(m.start(), k, m.end(), m.group()) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, t)]
        base.append(sorted(spans))
        for *_, value in spans:
            random.update(a + b for a, b in zip(value, value[1:]))
        if re.search(secrets.ANY, t):
            bare = t
            for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.UNKNOWN):
                bare = re.sub(p, " ", bare)
            for w in re.findall(secrets.IDENTIFIER, bare):
                ordinary.update(a + b for a, b in zip(w, w[1:]))
    ratios = secrets._log_ratios([(1, p, n) for p, n in random.items()] + [(0, p, n) for p, n in ordinary.items()])
    k, place = len(secrets.ALPHABET), {c: i for i, c in enumerate(secrets.ALPHABET)}
    out = []
    for t, spans in zip(texts, base):
        found = [s[:3] for s in spans]
        for m in re.finditer(secrets.RUN, t or ""):
            if not any(s[0] < m.end() and m.start() < s[2] for s in spans):
                llr = sum(round(ratios[place[a] * k + place[b]], 6) for a, b in zip(m.group(), m.group()[1:]))
                if llr > 4:
                    found.append((m.start(), 3, m.end()))
        out.append(",".join(f"{secrets.KINDS[q]}:{a}:{b}" for a, q, b in sorted(found)))
    return out


def test_random_spans_equal_a_plain_ratio(spark, docs):
    g = np.random.default_rng(5)
    alphabet = np.array(list(secrets.ALPHABET))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    texts += [f"see {''.join(g.choice(alphabet, int(n)))} end" for n in g.integers(18, 60, 40)]
    texts += ["secret = abcdefgh12 " + "x" * 30 + " secret=" + "Zq7" * 12 + "-and-more-words-here", None, "",
              " ".join(f"token={''.join(g.choice(alphabet[:62], 24))} look {''.join(g.choice(alphabet[:62], 24))}" for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan(df).select("doc_id", secrets.span_text(F.col("found")).alias("s")).collect()}
    want = plain_secrets(texts)
    assert [got[i] for i in range(len(texts))] == want and any("random" in w for w in want)


def plain_score(net, text):
    """The score of a whole text, word by word and window by window."""
    words = text.split() or [""]
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, p = toxicity.HIDDEN, {k: v.astype(np.float64) for k, v in net.p.items()}
    x = []
    for w in words:
        row, tri, _ = toxicity.features([w])
        x.append(p["word"][row[0]] + p["char"][tri].mean(axis=0))
    worst = -math.inf
    begin = 0
    while True:
        part = x[begin: begin + toxicity.WINDOW]
        states = {}
        for d in "fb":
            s, out = np.zeros(h), []
            for v in part if d == "f" else reversed(part):
                gx, gh = v @ p[f"x{d}"] + p[f"b{d}"], s @ p[f"h{d}"]
                z, r = sig(gx[:h] + gh[:h]), sig(gx[h: 2 * h] + gh[h: 2 * h])
                new = np.tanh(gx[2 * h:] + r * gh[2 * h:])
                s = (1 - z) * new + z * s
                out.append(s)
            states[d] = out if d == "f" else out[::-1]
        both = np.array([np.r_[a, b] for a, b in zip(states["f"], states["b"])])
        e = np.exp(both @ p["u"])
        worst = max(worst, (e / e.sum()) @ both @ p["w"] + p["c"][0])
        if begin + toxicity.WINDOW >= len(words):
            return sig(net.scale * worst + net.shift)
        begin += toxicity.STRIDE


def test_scores_equal_a_plain_network():
    g = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)] + ["Über,", "naïve!", "..."]
    texts = [" ".join(g.choice(words, int(n))) + (" awful thing" if i % 2 else "") for i, n in enumerate(g.integers(3, 150, 60))]
    net = toxicity.train(texts, np.arange(60) % 2, rounds=1)
    tried = [*texts[:6], " ".join(g.choice(words, 400)), "", "one", " ".join(["awful"] * 65), " ".join(words * 3)]
    got = toxicity.Scorer(net).scores(tried)
    assert np.allclose(got, [plain_score(net, t) for t in tried], atol=1e-4)
