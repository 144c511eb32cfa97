"""Findings of round 3 on research queries."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import both, connection

from pyspark.sql import functions as F

from panelforge import catalog
from panelforge.operators import decision, registries


@pytest.mark.parametrize("longest", [100_000, 130_000])
def test_probability_metrics_of_long_documents(spark, tmp_path, longest):
    """Probabilities within 1e-12 of one, and one itself, whose logarithms the SQL does not clip."""
    size = [500, 2500, 9000, 90_000, longest, longest]
    pq.write_table(pa.table({"doc_id": range(6), "n_chars": size}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": range(6), "quality": pa.array([0, 1, 0, 0, 1, 0], pa.int32())}), tmp_path / "labels.parquet")
    name = "K09_probability_metrics"
    ours, theirs = both(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], connection(str(tmp_path)))
    assert ours == theirs


def counted(frame, column, kind):
    """The frame, and a counter of how often a value of the column was made."""
    made = frame.sparkSession.sparkContext.accumulator(0)

    def same(x):
        made.add(1)
        return x

    return frame.withColumn(column, F.udf(same, kind)(column)), made


def test_a_logistic_fit_reads_its_rows_once(spark):
    rows = [(float(k % 7), float(k * k % 5 > 1), 1.0) for k in range(60)]
    frame, made = counted(spark.createDataFrame(rows, "score double, event double, mass double"), "score", "double")
    model = decision.fit_logistic(frame, ["score"], ridge=0.01)
    assert made.value == 60
    again = decision.fit_logistic(spark.createDataFrame(rows, "score double, event double, mass double").repartition(3), ["score"], ridge=0.01)
    assert abs(model.slopes[0] - again.slopes[0]) < 1e-9 and abs(model.intercept - again.intercept) < 1e-9


def test_literature_reads_its_documents_once(spark):
    entry = '{"paperId": "p-%d", "status": "implemented", "repositorySurfaces": ["s1", "s%d"], "odd": 1}'
    rows = [(entry % (k % 9, k % 3),) for k in range(10)] + [(None,), ("[]",), ("{",)]
    frame, made = counted(spark.createDataFrame(rows, "document string"), "document", "string")
    found = registries.literature(frame, spark.createDataFrame([("s1",), ("s2",)], "surface string"))
    got = [(r["paper_id"], [x for x in r["reasons"] if x in ("no JSON object", "id repeats", "unknown surfaces: s0")]) for r in found.collect()]
    assert made.value == len(rows)
    expected = [(f"p-{k % 9}", ["unknown surfaces: s0"] * (k % 3 == 0) + ["id repeats"] * (k % 9 == 0)) for k in range(10)] + [(None, ["no JSON object"])] * 3
    assert sorted(got, key=str) == sorted(expected, key=str)
