"""What queries leave on disk: compressed bundles, no shuffle files of steps that are over."""

import random
import time
from pathlib import Path

from kgspark.operators import blocks as B
from kgspark.operators import paths as P
from kgspark.sources import files as S
from kgspark.sources.graph import order_graph
from kgspark.sources.scratch import CLEANUP, write_out

SF_DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for k in range(held.size()) if held.apply(k).getName().startswith("shuffle_"))


def settled(spark, most):
    """Files are deleted by a thread of Spark's, so a while may pass."""
    for _ in range(100):
        if shuffle_files(spark) <= most:
            return True
        time.sleep(0.1)
    return False


def test_a_bundle_is_compressed_and_leaves_no_shuffle_files(spark, tmp_path):
    folder, g, before = str(tmp_path / "bundle"), order_graph(spark, SF_DIR), shuffle_files(spark)
    S.write_bundle(g, folder)
    assert settled(spark, before)
    for name in S.TABLES:
        parts = [p for p in Path(folder, name).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.name.endswith(".json.gz") for p in parts)
    back, report = S.read_bundle(spark, folder)
    assert {r["ok"] for r in report.collect()} == {True} and report.count() == len(S.TABLES)
    assert back.relations.exceptAll(g.relations).isEmpty() and g.relations.exceptAll(back.relations).isEmpty()


def test_stored_tables_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP)
    assert write_out(order_graph(spark, SF_DIR).relations, "relations").count()
    assert settled(spark, before + 1) and spark.conf.get(CLEANUP) == was  # one of the count


def test_damaged_bundles_are_told(spark, tmp_path):
    folder, g = str(tmp_path / "bundle"), order_graph(spark, SF_DIR)
    S.write_bundle(g, folder)
    g.phases.limit(3).write.mode("overwrite").json(f"{folder}/phases", compression="gzip")
    assert {r["table"] for r in S.read_bundle(spark, folder)[1].collect() if not r["ok"]} == {"phases"}


def test_closeness_in_waves(spark, monkeypatch):
    """Slices that go one after the other, in rounds that end at different times, give what all at once do; a round moves what it may."""
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(600)}", f"n{rng.randrange(600)}") for _ in range(9000)] + [("c0", "c1"), ("c1", "c2")] + [("n1", "c0"), ("x", "y")]
    relations = spark.createDataFrame(pairs, "src string, dst string")
    want = sorted(map(tuple, P.closeness(relations, 8).collect()))
    sent, plain = [], B.Cells.exchange

    def counted(cells, message, *rest, **more):
        sent.append(message.select("slice").distinct().count())
        return plain(cells, message, *rest, **more)

    monkeypatch.setattr(B.Cells, "exchange", counted)
    monkeypatch.setattr(P, "SLICE", 128)
    monkeypatch.setattr(P, "ROUND_BYTES", 1)
    assert sorted(map(tuple, P.closeness(relations, 8).collect())) == want
    assert max(sent) == 1 and len(sent) >= 2 * 4


def test_slices_that_move_least():
    """Few nodes: widest slices. Many: a round of all slices moves less than with slices of 256 registers, parts of which are held by tasks."""
    assert P._widest(20_000, 900_000, 2048) == 2048
    moved = lambda n, e, width: n * 2048 * -(-n * width // B.PART_BYTES) + P.CELL_BYTES * e * (2048 // width)
    n, e = 7_200_000, 324_000_000
    assert P._widest(n, e, 2048) == 64 and moved(n, e, 64) < moved(n, e, 256) / 2
