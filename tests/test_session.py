from types import SimpleNamespace

import pytest

from quern.session import checkpoint_root, materialise


def test_tables_go_to_the_session_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    table = materialise(df, "numbers")
    assert root in table.inputFiles()[0] and sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]


def bare(master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(applicationId="a1", master=master)
    )


def test_unset_folder():
    """One process may use its own disk, a cluster may not."""
    folder = checkpoint_root(bare("local[4]"))
    assert folder == checkpoint_root(bare("local")) and "quern-" in folder
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(bare(master))
