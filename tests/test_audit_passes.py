"""The audit reads each text once for its detectors, although findings are numbered by a range shuffle."""

from pyspark.sql import functions as F

from lintlake.plans import audit


def test_findings_are_detected_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("r", f"rule{i}", f"src/f{i}.ts", i) for i in range(20)]
    found = spark.createDataFrame(rows, "repo string, rule string, file string, line int").select(
        "repo", F.lit("security").alias("domain"), "rule", F.lit("high").alias("severity"), F.lit(0.9).alias("confidence"),
        F.col("rule").alias("title"), F.array(F.struct("file", "line", F.lit(None).cast("string").alias("snippet"))).alias("evidence"),
    )
    found = found.mapInArrow(look, found.schema)
    done = audit.complete(found).collect()
    assert sorted(r.seq for r in done) == list(range(1, 21))
    assert {r.id for r in done} == {f"SEC-{i:03d}" for i in range(1, 21)}
    assert seen.value == 20
