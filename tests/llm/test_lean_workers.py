"""What Python workers are sent and hold doesn't depend on how long a table's texts are."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skytally import session
from skytally.llm import columnar, toxicity


def test_batches_end_after_so_many_bytes(spark):
    docs = spark.createDataFrame([(0, "good words here"), (1, "bad words there")], "doc_id long, text string")
    toxicity.fit(spark, docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    rows = spark.range(4000).select(F.repeat(F.lit("some text "), 300).alias("text")).coalesce(1)
    found = rows.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n").alias("n"), F.max("bytes").alias("most")).first()
    assert found.n == 4000
    assert found.most < 1.5 * session.BATCH_BYTES


def test_tables_of_powers_grow_with_the_step():
    columnar._HELD.clear()
    small = columnar.powers(1000)[0]
    assert len(small) <= columnar.SMALL + (1 << 17) + 1
    large, inverse = columnar.powers(columnar.PIECE)
    assert len(large) > columnar.PIECE
    assert np.array_equal(large[: len(small)], small)
    assert (large[:1000] * inverse[:1000] == 1).all()
    assert columnar.powers(1000)[0] is large
