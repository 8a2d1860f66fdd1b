from pyspark.sql import functions as F

from convolens.operators.sessionize import chunk_messages
from convolens.streaming.sync import latest_version, sync_batches, window_stream

SCHEMA = "chat_id long, msg_id long, ts double, tokens int"


def test_windows_of_a_stream_in_order(spark, tmp_path):
    rows = [(c, c * 100 + i, float(i * (3000 if i == 5 else 60)), 1) for c in range(3) for i in range(9)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 100 // 3 == part], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = window_stream(stream, max_messages=4).writeStream.outputMode("update").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.msg_id for r in spark.table("grown").select(F.explode("msg_ids").alias("msg_id")).collect()}
    assert last == {r[1] for r in rows}


def test_late_messages_rewrite_history(spark, tmp_path):
    schema = "chat_id long, msg_id long, ts double, text string, has_attachment boolean, version int"
    log, out = str(tmp_path / "log"), {}
    batches = [[(1, 2, 100.0, "b", False, 1), (2, 9, 5.0, "z", False, 1)], [(1, 1, 50.0, "a", False, 1)], [(1, 2, 100.0, "b edited", False, 2)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))

    def rebuild(rows, batch_id):
        out.update({(batch_id, r.chat_id): r.msg_ids for r in chunk_messages(latest_version(rows)).collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = sync_batches(stream, lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(log), lambda b, n: b.write.mode("overwrite").parquet(f"{log}/n={n}"), rebuild, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    final = {}
    for (n, chat), ids in sorted(out.items()):
        final[chat] = ids
    assert final == {1: [1, 2], 2: [9]}


def test_windows_of_a_stream_stay_off_the_driver(spark):
    """The query's batches are written; no table of the driver's memory holds them."""
    from convolens.plans.registry import QUERIES

    before = {t.name for t in spark.catalog.listTables()}
    out = QUERIES["stateful_chunks_stream"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.agg(F.min("n_windows")).first()[0] >= 1
    assert {t.name for t in spark.catalog.listTables()} == before
