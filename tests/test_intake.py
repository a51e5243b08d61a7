"""Files, layout and streams on small inputs."""

import datetime

from pyspark.sql import functions as F

from lexfolio.operators import ir, layout, spans
from lexfolio.sources import files
from lexfolio.streaming import jobs


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x /Encrypt 1 0 R")
    (tmp_path / "c.txt").write_text("plain text")
    (tmp_path / "d.bin").write_bytes(b"\x00\x01\x02\x03\x04")
    (tmp_path / "e.txt").write_bytes(b"ab")
    rows = {r["path"][-5:]: r["error_code"] for r in files.admit(files.read_files(spark, str(tmp_path))).collect()}
    assert rows == {"a.pdf": None, "b.pdf": "ENCRYPTED_DOCUMENT", "c.txt": None, "d.bin": "UNSUPPORTED_MEDIA_TYPE", "e.txt": "CORRUPT_DOCUMENT"}


def test_ocr_words_from_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    body = "1\t1\t0\t0\t0\t0\t0\t0\t1000\t1000\t-1\t\n5\t1\t1\t1\t1\t1\t100\t100\t50\t20\t95\tSECTION\n5\t1\t1\t1\t1\t2\t160\t100\t40\t20\t85\t1\n"
    (tmp_path / "w.tsv").write_text(head + body)
    words = files.read_ocr_words(spark, str(tmp_path / "w.tsv")).withColumn("version_id", F.lit("v"))
    block = layout.ocr_blocks(words).first()
    assert (block["text"], block["confidence"], block["bbox_x"], block["bbox_width"]) == ("SECTION 1", 0.9, 0.1, 0.1)


def test_two_columns(spark):
    items = [("v", 1, i, f"w{i}", 50.0 if i % 2 else 350.0, 700.0 - 20 * (i // 2), 100.0, 10.0, 612.0, 792.0) for i in range(10)]
    df = spark.createDataFrame(items, "version_id string, page_number int, item_no int, str string, x double, y double, width double, height double, page_width double, page_height double")
    assert layout.page_columns(df).first()["column_count"] == 2
    order = [r["item_no"] for r in layout.reading_order(df).orderBy("order").collect()]
    assert order == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]


def test_overlaps_of_long_spans_reported_once(spark):
    smap = spark.createDataFrame([("v", "b0", 1, 0, 5000, False, 1.0), ("v", "b1", 1, 5000, 5100, False, 1.0)], "version_id string, block_id string, page_number int, start int, end int, is_ocr boolean, confidence double")
    s = spark.createDataFrame([("v", "s", 10, 5050)], "version_id string, span_id string, start int, end int")
    assert sorted(r["b_block_id"] for r in spans.overlapping_blocks(s, smap).collect()) == ["b0", "b1"]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src + "/one.parquet")
    stream = spark.readStream.schema("id long").parquet(src + "/one.parquet")
    out = jobs.run_batches(stream, lambda b: b.select((F.col("id") * 2).alias("x")), "test")
    assert sorted(r["x"] for r in out.collect()) == [0, 2, 4, 6, 8]


def test_each_task_is_published_once_over_batches_and_restarts(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "task_id string, fencing_token int, published_at timestamp, run_id string"
    tasks = spark.createDataFrame([(f"t{i}", 1) for i in range(6)], "task_id string, fencing_token int")

    def rows(ids, hour, token=1):
        return [(f"t{i}", token, datetime.datetime(2024, 1, 1, hour, i), f"r{hour}") for i in ids]

    files_ = [rows(range(3), 1) + rows([0], 0), rows(range(2, 5), 2), rows(range(2, 5), 2), rows(range(6), 3) + rows([5], 2, token=2) + [(None, 1, None, "none")], []]
    for arrived in files_:  # each file repeats tasks of earlier ones; the job is stopped and started again on one folder
        spark.createDataFrame(arrived, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = jobs.publish_stream(stream, tasks, folder=folder)
    got = sorted((r["task_id"], r["run_id"]) for r in out.collect())
    assert got == [("t0", "r0"), ("t1", "r1"), ("t2", "r1"), ("t3", "r2"), ("t4", "r2"), ("t5", "r3")]


def test_a_forgotten_task_counts_as_new(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    tasks = spark.createDataFrame([("t", 1)], "task_id string, fencing_token int")
    row = spark.createDataFrame([("t", 1, datetime.datetime(2024, 1, 1), "r")], "task_id string, fencing_token int, published_at timestamp, run_id string")
    for keep_days, want in ((None, 1), (None, 1)):
        row.write.mode("append").parquet(src)
        out = jobs.publish_stream(spark.readStream.schema(row.schema).parquet(src), tasks, folder=folder, keep_days=keep_days)
        assert out.count() == want
    for want in (1, 2):  # kept for no time at all
        row.write.mode("append").parquet(src + "0")
        stream = spark.readStream.schema(row.schema).parquet(src + "0")
        assert jobs.publish_stream(stream, tasks, folder=folder + "0", keep_days=0.00000002).count() == want


def test_rewrites_touch_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "t")

    def canonical(rows):
        return ir.canonical_documents(spark.createDataFrame(rows, "workspace_id string, version_id string, text string"))

    def stored():
        versions = spark.read.parquet(path + "/versions").select("version_id", "canonical_text")
        return {r[0]: (r[1], r[2]) for r in versions.join(spark.read.parquet(path + "/documents"), "version_id").select("version_id", "canonical_text", "is_deleted").collect()}

    def files_of(workspace):
        return sorted(p.name for p in (tmp_path / "t" / "versions" / f"workspace_id={workspace}").glob("*.parquet"))

    files.write_documents(canonical([("1", "a", "one"), ("1", "b", "two\n\nthree"), ("2", "c", "four")]), path)
    others = files_of("2")
    gone = spark.createDataFrame([("1", "b"), ("1", "b"), ("2", "nobody"), ("9", "a")], "workspace_id string, version_id string").withColumn("deleted_at", F.current_timestamp())
    for _ in range(2):
        files.republish_documents(canonical([("1", "a", ""), ("3", "d", "new")]), path)  # no text, and a new partition
        files.delete_documents(gone, path)
        files.republish_documents(canonical([]), path)
        assert stored() == {"a": ("", False), "b": ("two\n\nthree", True), "c": ("four", False), "d": ("new", False)}
        assert sorted(r["version_id"] for r in files.read_blocks(spark, path).collect()) == ["b", "b", "c", "d"]
    assert files_of("2") == others
    files.republish_documents(canonical([("1", "b", "back")]), path)
    assert stored()["b"] == ("back", False)
