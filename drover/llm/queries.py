"""The queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drover.llm import ann, bpe, jaccard, langid, mixing, neardup, pii, quantize, secrets, tokencount, topk, toxicity, variants
from drover.llm.common import crc_mod, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), keep_cols=["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(read(spark, sf_dir, "documents")) \
        .select("doc_id", "class_id", "copy_id", "n_links", "n_texts")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"),
                             tokenizer_path("byte_bpe_50k.json"), keep_cols=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, net, keep_cols=["doc_id"]).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                      tokenizer_path("word_bpe_49k.json"), keep_cols=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.span_text(F.col("found")).alias("spans"))


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.embedding_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(read(spark, sf_dir, "documents"), min_length=7, thin=31)
    return variants.group_variants(words.filter("n >= 2"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compress(read(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.col("codebooks").alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_language, op3_ngram_join, op4_nearest, op5_bpe, op6_toxicity, op7_token_counts,
    op8_private_data, op9_secrets, op10_top_products, op11_embedding_duplicates, op12_spelling_variants,
    op13_vector_codes)}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds of op13 written out one after another."""
    steps = [f"""
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                      FROM embeddings WHERE embedding IS NOT NULL
                          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS c
                  FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)),
        book0 AS (SELECT p, r - 1 AS e, c FROM parts WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS (SELECT r, x.p, x.c, min(list_sum(list_transform(range(1, len(x.c) + 1),
                        lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i]))) * {entries} + e) AS d
                    FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY r, x.p, x.c)""")
        if k < rounds:
            steps.append(f"""
        mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
                    FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                          FROM (SELECT p, CAST(d % {entries} AS BIGINT) AS e, unnest(c) AS x, unnest(range(len(c))) AS i FROM near{k})
                          GROUP BY p, e, i) GROUP BY p, e),
        book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    return ",".join(steps) + f""",
        codes AS (SELECT r, string_agg(printf('%02x', CAST(d % {entries} AS BIGINT)), '' ORDER BY p) AS code,
                      CAST(sum(d // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
        digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
                   FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM book{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN codes USING (r), digest"""


ORACLES = {
    "op10_top_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op11_embedding_duplicates": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
                   coalesce(label IS NOT NULL AND len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
        link AS (SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
                 WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
        least AS (SELECT x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON least.x = v.r LEFT JOIN n ON n.x = v.r""",
    "op12_spelling_variants": """
        WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
        runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS raw FROM documents)
                 WHERE length(raw) >= 7 GROUP BY ALL),
        bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM runs),
        hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
                       lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS h FROM bytes, bits),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
                  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) ||
                                    substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed)
                  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
                FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                 UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
                 UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word),
        formed AS (SELECT w.word, CASE WHEN top >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
                          CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
        walk AS (SELECT word, word AS at FROM formed
                 UNION SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.at WHERE formed.form IS NOT NULL)
        SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
        FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.at WHERE e.form IS NULL""",
    "op13_vector_codes": _codes_sql(),
}
