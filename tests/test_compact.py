"""Compaction of batch folders: bounded, repeatable, and the same rows at every moment."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import compact as K


def summed(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))


def total(spark, out):
    return {r["k"]: r["n"] for r in summed(K.read_batches(spark, out)).collect()}


def write(spark, out, batch):
    spark.range(1).select((F.lit(batch) % 3).alias("k"), F.lit(1).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch}")


def folders(out):
    runs = os.listdir(f"{out}/runs") if os.path.exists(f"{out}/runs") else []
    return len([n for n in os.listdir(out) if n.startswith("batch=")]) + len(runs)


def want(batches):
    return {k: n for k in range(3) if (n := len(range(k, batches, 3)))}


def test_folders_stay_few_over_a_hundred_batches(spark, tmp_path):
    out, most = str(tmp_path / "t"), 0
    for batch in range(100):
        write(spark, out, batch)
        if batch % 5 == 4:
            before = K.read_batches(spark, out)
            K.compact(spark, out, summed, fan=5)
            K.compact(spark, out, summed, fan=5)
            most = max(most, folders(out))
            if batch % 20 == 4:
                # A reader that had begun before the compaction ends with the same rows.
                assert {r["k"]: r["n"] for r in summed(before).collect()} == total(spark, out) == want(batch + 1)
    assert total(spark, out) == want(100) and most <= 30
    # The last batch again, as after a restart.
    write(spark, out, 99)
    assert total(spark, out) == want(100)


@pytest.mark.parametrize("stop", ["write", "manifest", "delete"])
def test_a_compaction_that_stops_changes_nothing(spark, tmp_path, monkeypatch, stop):
    out = str(tmp_path / "t")
    for batch in range(7):
        write(spark, out, batch)

    def broken(*args):
        raise RuntimeError("lost")

    if stop == "write":
        with pytest.raises(RuntimeError):
            K.compact(spark, out, broken, fan=3)
    else:
        K.compact(spark, out, summed, fan=3)
        if stop == "manifest":
            # The run is written, its manifest is not complete.
            os.remove(f"{out}/manifests/{1:012d}/_SUCCESS")
        else:
            for batch in range(7, 14):
                write(spark, out, batch)
            monkeypatch.setattr(K.Folder, "delete", broken)
            with pytest.raises(RuntimeError):
                K.compact(spark, out, summed, fan=3)
            monkeypatch.undo()
    batches = 14 if stop == "delete" else 7
    assert total(spark, out) == want(batches)
    K.compact(spark, out, summed, fan=3)
    assert total(spark, out) == want(batches)
    shutil.rmtree(out)
