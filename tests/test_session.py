"""Where intermediates go."""

import os
import subprocess
import sys

import pytest

from marklens.session import configure, remove_folder, scratch_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from marklens.session import cut_lineage, scratch_folder

spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
)
assert cut_lineage(spark.range(10)).count() == 10
print(scratch_folder(spark))
"""


def test_intermediates_are_in_the_folder_the_cluster_names(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, str(shared)], capture_output=True, text=True, timeout=120, check=True, cwd=tmp_path
    )
    assert done.stdout.strip().splitlines()[-1].startswith(str(shared))
    assert any(shared.rglob("rdd-*"))


def test_configure_leaves_sizes_to_the_cluster(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert configure(spark).conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


class Cluster:
    """As much of a session as tells where it runs."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Cluster)


def test_intermediates_can_be_deleted(spark):
    folder = scratch_folder(spark)
    spark.range(3).write.parquet(folder)
    remove_folder(spark, folder)
    assert not os.path.exists(folder.removeprefix("file:"))
