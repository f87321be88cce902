"""The exchange loop: documents arrive with the vocabularies they are wanted for, are read once and ground many times.

State lives in tables in the checkpoint folder, so a restarted query repeats nothing: the file source remembers
its files, and a batch that is retried writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.messages import normal_id
from strandline.session import scratch_path, scratched, ship, table


class ReadOnceGroundMany:
    """``foreachBatch`` sink: reads each new document id once and grounds every new (document, vocabulary) pair once.

    ``read(documents) -> DataFrame`` and ``ground(pairs) -> DataFrame`` are the caller's; a failure of ``read`` for
    a document must come out as an empty reading, never as a lost row. Tables: ``readings`` and ``groundings``.
    """

    def __init__(self, spark: SparkSession, path: str, read: Callable[[DataFrame], DataFrame], ground: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.read, self.ground = spark, path, read, ground

    def _earlier(self, name: str, batch: int, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").where(F.col("batch") < batch)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        wanted = batch.select("doc_id", F.explode_outer("ontologies").alias("ontology")).where("doc_id IS NOT NULL").distinct()
        new_docs = wanted.select("doc_id").distinct().join(self._earlier("readings", number, "doc_id binary, batch int").select("doc_id"), "doc_id", "left_anti")
        self.read(new_docs).select("doc_id").write.mode("overwrite").parquet(f"{self.path}/readings/batch={number}")
        pairs = wanted.where("ontology IS NOT NULL").join(self._earlier("groundings", number, "doc_id binary, ontology string, batch int").select("doc_id", "ontology"), ["doc_id", "ontology"], "left_anti")
        self.ground(pairs).select("doc_id", "ontology").write.mode("overwrite").parquet(f"{self.path}/groundings/batch={number}")


def run_exchange(spark: SparkSession, notices_path: str, path: str, files_per_batch: int = 5000) -> None:
    """Processes all notices that are there (trigger ``availableNow``) with readers that pass ids through."""
    ship(spark)
    schema = spark.read.parquet(notices_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(notices_path)
    notices = stream.select(normal_id(F.col("document_id")).alias("doc_id"), "ontologies")
    sink = ReadOnceGroundMany(spark, path, lambda d: d, lambda p: p)
    notices.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_once_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents, pairs``: what one run over ``notices`` read and ground. Whole table, by file stream."""
    path = scratch_path(spark, "exchange")
    source = f"{sf_dir}/notices.parquet"
    import os

    if os.path.isfile(source):  # the file source takes folders; a single file is written to one first
        folder = scratch_path(spark, "exchange-in")
        table(spark, sf_dir, "notices").select("document_id", "ontologies").write.parquet(folder)
        source = folder
    run_exchange(spark, source, path)
    r, g = spark.read.parquet(f"{path}/readings"), spark.read.parquet(f"{path}/groundings")
    return r.agg(F.count("*").alias("documents")).join(F.broadcast(g.agg(F.count("*").alias("pairs"))))  # one row each


def kafka_notices(spark: SparkSession, servers: str, topic: str, options: dict[str, str] | None = None) -> DataFrame:
    """``document_id, payload`` of a topic from its earliest record on; a record with the id of an earlier one comes as well. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").options(**(options or {}))
    return reader.load().select(F.col("key").cast("string").alias("document_id"), F.col("value").cast("string").alias("payload"))


def file_notices(spark: SparkSession, path: str, files_per_batch: int = 5000) -> DataFrame:
    """The same from a folder of JSON files, one notice each: stands in for the topic in tests and replays."""
    files = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("wholetext", "true").text(path)
    return files.select(F.get_json_object("value", "$.document_id").alias("document_id"), F.col("value").alias("payload"))


def guarded(documents: DataFrame, read: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """``doc_id, found array<struct<schema>>, error``: what ``read(doc_id, text)`` finds in each document.

    A document whose reading fails comes out with an empty list and the error, so every document gives one row and a
    failure never ends the loop. ``documents(doc_id, text)``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructType

    item = StructType.fromDDL(schema)
    kind = to_arrow_type(ArrayType(item))

    def run(batches):
        for batch in batches:
            found, errors = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    one = read(doc, text)
                    pa.array([one], kind)
                    error = None
                except Exception as e:  # noqa: BLE001 - any failure of a reader is the document's own
                    one, error = [], f"{type(e).__name__}: {e}"
                found.append(one)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(errors, pa.string())], names=["doc_id", "found", "error"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text")).mapInArrow(run, StructType.fromDDL(f"doc_id string, found array<struct<{_inner(schema)}>>, error string"))


def _inner(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


class Uploads:
    """``foreachBatch`` sink that hands each new file to ``send(path, payload) -> key`` and logs the result.

    ``rows(path, payload)``. The log ``path, storage_key, batch`` has ``<failed>`` for a failed one, which is tried again when
    it comes again; a file that was sent is not sent twice. Each task sends its own rows. A retried batch replaces its part of the log.
    """

    FAILED = "<failed>"

    def __init__(self, spark: SparkSession, path: str, send: Callable[[str, str], str]):
        self.spark, self.path, self.send = spark, path, send

    def log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        schema = "path string, storage_key string, batch int"
        try:
            return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def __call__(self, rows: DataFrame, number: int) -> None:
        import pyarrow as pa

        send, failed = self.send, self.FAILED

        def run(batches):
            for batch in batches:
                keys = []
                for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        keys.append(send(path, payload))
                    except Exception:  # noqa: BLE001 - an endpoint may fail in any way
                        keys.append(failed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["path", "storage_key"])

        sent = self.log().where((F.col("batch") < number) & (F.col("storage_key") != failed)).select("path").distinct()
        new = rows.select("path", "payload").dropDuplicates(["path"]).join(sent, "path", "left_anti")
        new.mapInArrow(run, "path string, storage_key string").write.mode("overwrite").parquet(f"{self.path}/batch={number}")


class Vocabularies:
    """Vocabularies by id, each loaded once with ``load(id) -> DataFrame`` and kept in memory of the driver's plan; at most ``size`` of them."""

    def __init__(self, load: Callable[[str], DataFrame], size: int = 100):
        self.load, self.size, self.held = load, size, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.held:
            while len(self.held) >= self.size:
                self.held.pop(next(iter(self.held)))
            self.held[name] = self.load(name)
        return self.held[name]


def restarted(start: Callable[[], object], attempts: int = 5, pause: float = 5.0) -> int:
    """Starts a query and waits for its end, again after a failure, and returns how often it failed; beyond ``attempts`` the failure is raised."""
    import time

    failures = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except Exception:  # noqa: BLE001 - whatever ended the query, its checkpoint says where to go on
            failures += 1
            if failures > attempts:
                raise
            time.sleep(pause)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark: rows later than ``late`` behind the newest are left out of their closed window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def streamed_windows(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total``: the windows of all ``events``, read as a file stream to its end; late rows count in their window.

    The state is the windows so far; each micro-batch replaces the written result, so a retried one changes nothing.
    """
    import os

    ship(spark)
    source, only = (f"{sf_dir}/events.parquet", "*") if not os.path.isfile(f"{sf_dir}/events.parquet") else (sf_dir, "events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = scratch_path(spark, "windows")
    events = spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(source)
    counted = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    scratched(spark, path)
    return spark.read.parquet(f"{path}/out")
