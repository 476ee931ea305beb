import pyarrow as pa
import pytest
from relpredict.llm import common as C

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batches(spark):
    """Rows and bytes of every Arrow batch that 18 MB of text in one partition come in."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([[batch.num_rows], [batch.nbytes]], ["n", "size"])

    texts = spark.range(0, 9_000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    return texts.mapInArrow(sizes, "n bigint, size bigint")


def test_scratch_jobs_get_batches_of_few_bytes(spark, batches):
    found = C.stored(batches, "sizes").collect()
    assert sum(r["n"] for r in found) == 9_000 and max(r["size"] for r in found) < 5_000_000
    assert spark.conf.get(NAME, None) is None


def test_a_named_batch_size_stays(spark, batches):
    spark.conf.set(NAME, "8m")
    try:
        found = C.stored(batches, "sizes").collect()
        assert 7_000_000 < max(r["size"] for r in found) < 9_000_000 and spark.conf.get(NAME) == "8m"
    finally:
        spark.conf.unset(NAME)


def test_settings_are_put_back_after_a_failed_job(spark):
    with pytest.raises(Exception, match="no such thing"):
        C.stored(spark.range(1).selectExpr("raise_error('no such thing') AS x"), "none")
    assert spark.conf.get(NAME, None) is None
