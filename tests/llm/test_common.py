import pyarrow as pa

from folio.llm.common import written


def test_python_gets_few_rows_at_once(spark):
    """A table that is written by Python: its workers get a few hundred rows at once, before 10,000."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = written(spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert rows.agg({"n": "sum"}).first()[0] == 5_000 and rows.agg({"n": "max"}).first()[0] <= 256
