"""The registered queries of the operators against their SQL, on the smallest tables and on rows at the edges."""

from __future__ import annotations

import duckdb
import pytest

from skytally import llm

TABLES = "documents benchmark conversations".split()


def compare(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != TINY else ''}')")
    got = llm.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, TINY, name)


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_edge_rows_equal_sql(spark, tmp_path, name):
    passage = " ".join(f"word{i}" for i in range(40))
    texts = [None, "", "short", passage, passage.upper(), f"é {passage} ü", passage[:99], passage[:100], "x" * 350, "\\ <| \\| <|im_end|>\n", "ab" * 400]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [("a", passage), ("b", "word3 word4"), ("c", None), ("d", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(c, t, ["user", "assistant", None, "a\nb", "<|im_start|>", "system"][(c + t) % 6], texts[(3 * c + t) % len(texts)]) for c in range(12) for t in range(6)]
    turns += [(3, 2, "user", "a tie"), (3, 2, "user", "a tie"), (3, None, "assistant", "no turn")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, str(tmp_path), name)
