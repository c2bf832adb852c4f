"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (coalescing, skew joins,
# runtime broadcast of small build sides), UTC session time and Arrow batches
# for the few Python crossings.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


MB = 1 << 20


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * MB,
               min_partitions: int = 200) -> dict:
    """Partition sizing for a job reading ``input_bytes``: shuffle partitions
    so each holds about ``target_partition_bytes`` (AQE coalesces small ones
    and splits skewed ones at runtime), file splits of the same size, and skew
    thresholds a few times the target.  At 100 TB this gives ~400k partitions;
    a larger target gives fewer."""
    parts = max(min_partitions, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * MB),
    }


def get_session(master: str | None = None, app: str = "drover",
                shuffle_partitions: int | None = None,
                extra: dict | None = None, input_bytes: int | None = None) -> SparkSession:
    """Session with the defaults above; ``input_bytes`` sizes partitions for
    the data volume (see ``scale_conf``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if input_bytes:
        conf.update(scale_conf(input_bytes))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is read from the session; only where it is unset
    (local runs and tests) a private folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set at all
            configured = None
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="drover-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if "://" not in root:  # a local folder, possibly written as "file:/..."
        os.makedirs(root[len("file:"):] if root.startswith("file:") else root, exist_ok=True)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``drover`` importable on the executors' Python workers (UDFs,
    ``mapInPandas``, streaming state, table functions): the package is zipped
    in memory, written once into the shared folder and added with
    ``addPyFile`` (what ``--py-files`` does at submit time).  Idempotent per
    application."""
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = shared_path(spark, "pyfiles") + "/drover.zip"
    from pyarrow import fs as pafs
    uri = target if "://" in target else "file://" + os.path.abspath(target[len("file:"):] if target.startswith("file:") else target)
    filesystem, path = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(path) as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(uri)
    _SHIPPED.add(app)
