"""Session helpers: partition sizing and the shared folder."""

import os

from drover.session import scale_conf, shared_path


def test_scale_conf_bounds():
    assert scale_conf(10**9)["spark.sql.shuffle.partitions"] == "200"
    assert scale_conf(100 * 2**40)["spark.sql.shuffle.partitions"] == "409600"
    mid = int(scale_conf(10 * 2**40)["spark.sql.shuffle.partitions"])
    assert mid == 10 * 2**40 // (256 * 2**20)


def test_shared_path_is_under_checkpoint_dir_and_creates_no_local_uri_folder(spark):
    before = set(os.listdir("."))
    p = shared_path(spark, "probe")
    root = spark.sparkContext.getCheckpointDir()
    assert p.startswith(root.rstrip("/") + "/probe-")
    assert "file:" not in set(os.listdir(".")) - before
