"""U1/U2: batch inference over a request table and pluggable token counting.

``with_completions`` runs a user-supplied client over each partition with
``mapInPandas``: the client is built once per partition, requests run with
bounded concurrency and the retry policy of the generation client, and a
request that still fails yields a null response (the row is kept, with the
error and the number of tries).  The output is non-deterministic, so persist
it (``persist_completions``) before it feeds more than one branch: a re-read
of the written table never repeats the calls.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from drover.functions import text as T
from drover.session import shared_path


def retry_wait(error: str, attempt: int) -> float:
    """Seconds to wait after a failed try (generation policy, see ``planned_wait``)."""
    e = error.lower()
    if "rate" in e:
        return float(min(2 ** (attempt + 2), T.RATE_LIMIT_WAIT_CAP))
    if "timeout" in e:
        return float(T.TIMEOUT_WAIT)
    return float(2 ** attempt)


def pending_requests(requests: DataFrame, completed: DataFrame | None, key: str = "request_id") -> DataFrame:
    """Resume: only requests without a stored completion (an anti-join on the
    request key), so a re-run never repeats a call."""
    if completed is None:
        return requests
    return requests.join(completed.filter("response IS NOT NULL").select(key), key, "left_anti")


def with_completions(requests: DataFrame, client_factory: Callable, messages: str = "messages",
                     max_concurrency: int = 8, max_retries: int = T.GENERATE_MAX_RETRIES,
                     sleep: Callable[[float], None] = time.sleep,
                     num_partitions: int | None = None) -> DataFrame:
    """Adds ``response``, ``error`` and ``attempts``.  ``client_factory()`` must
    return a callable ``client(messages: list[dict]) -> str``.  With
    ``num_partitions`` the requests are spread over that many tasks first, which
    caps the calls in flight at ``num_partitions * max_concurrency``."""
    schema = TY.StructType(requests.schema.fields + [
        TY.StructField("response", TY.StringType()), TY.StructField("error", TY.StringType()),
        TY.StructField("attempts", TY.IntegerType())])

    def one(client, msgs):
        last = None
        for attempt in range(max_retries):
            try:
                return client(msgs), None, attempt + 1
            except Exception as e:  # noqa: BLE001 - any client failure is retried
                last = str(e)
                if attempt < max_retries - 1:
                    sleep(retry_wait(last, attempt))
        return None, last, max_retries

    def run(batches):
        client = client_factory()
        with ThreadPoolExecutor(max_workers=max_concurrency) as pool:
            for pdf in batches:
                msgs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf[messages]]
                res = list(pool.map(lambda m: one(client, m), msgs))
                out = pdf.copy()
                out["response"] = [r[0] for r in res]
                out["error"] = [r[1] for r in res]
                out["attempts"] = pd.array([r[2] for r in res], dtype="Int32")
                yield out

    source = requests if num_partitions is None else requests.repartition(num_partitions)
    return source.mapInPandas(run, schema)


def persist_completions(df: DataFrame, spark: SparkSession | None = None, name: str = "completions") -> DataFrame:
    """Write the (non-deterministic) completions once to the shared checkpoint
    folder and continue from the written table."""
    spark = spark or df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def count_tokens(tokenizer_factory: Callable):
    """Iterator pandas UDF counting tokens with a tokenizer built once per task.
    ``tokenizer_factory()`` returns ``encode(text) -> list``."""
    from collections.abc import Iterator

    def _count(it):
        encode = tokenizer_factory()
        for s in it:
            yield s.map(lambda x: 0 if x is None else len(encode(x))).astype("int64")

    # real (not postponed) hints so Spark picks the iterator-of-series form
    _count.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(_count, TY.LongType())
