"""Findings of round 4 on training-data operators."""

import os
import random
import time

from panelforge.llm import suffixtree


def test_suffix_tree_lets_go_of_the_shuffle_files_of_its_steps(spark, monkeypatch):
    """As soon as a step is written, whatever the driver's garbage collection does."""
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(200))) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    to_java, disk = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getPath(): f.length() for f in to_java(disk.getAllFiles()) if f.getName().startswith("shuffle") and f.getName().endswith(".data")}
    key, write, left = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", suffixtree.materialise, {}
    setting = spark.conf.get(key)

    def written(df, name, **options):
        before, out = files(), write(df, name, **options)
        for _ in range(20):  # files are removed in the background
            left[name] = sum(size for path, size in files().items() if path not in before)
            if not left[name]:
                break
            time.sleep(0.25)
        assert spark.conf.get(key) == setting
        return out

    monkeypatch.setattr(suffixtree, "materialise", written)
    assert suffixtree.score(frame).count() == 400
    assert left == dict.fromkeys(("counted", "sequences", "entries", "weights", "scored"), 0)


def test_suffix_tree_lets_go_of_what_it_broadcast(spark, monkeypatch):
    """The files that a broadcast has on the driver; executors' copies go with them."""
    kind, paths = type(spark.sparkContext), []
    make = kind.broadcast

    def kept(self, value):
        made = make(self, value)
        paths.append(made._path)
        return made

    monkeypatch.setattr(kind, "broadcast", kept)
    scores = suffixtree.score(spark.createDataFrame([(i, "one two three four") for i in range(40)], "doc_id long, text string"))
    assert len(paths) == 2 and not any(map(os.path.exists, paths))
    assert scores.count() == 40
