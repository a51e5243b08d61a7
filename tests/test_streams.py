"""Streams over tables that are stored as one file or as a directory of files."""

import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("directory", [False, True])
def test_stream_reads_the_whole_table(spark, tmp_path, directory):
    parts = [[(1, "a"), (2, "b")], [(5_000_000, "a"), (3, None)], [(9_000_000, "c"), (9_000_001, "b")]]
    table = tmp_path / "documents.parquet"
    if directory:
        table.mkdir()
        for i, rows in enumerate(parts):
            pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(table / f"part-{i}.parquet")
    else:
        pd.DataFrame(sum(parts, []), columns=["doc_id", "text"]).to_parquet(table)
    got = [r["sha256"] for r in entry.queries()["t02_stream_dedup"](spark, str(tmp_path)).collect()]
    want = {r[0] for r in spark.read.parquet(str(table)).selectExpr("sha2(text, 256)").distinct().collect()}
    assert len(got) == 4 and set(got) == want
