"""Exactly one copy of messages that were delivered at least once.

:class:`MessageStore` keeps the winners of all batches so far in history partitions of bounded size. Every partition
has an identifier index of its own (the hashes of its messages) and the range of its instants. A new batch is looked
up in the indexes of the partitions whose range it touches; only partitions that hold one of its messages are read,
combined with the batch, reduced to single winners and overwritten, together with their indexes. Messages that no
partition holds go to new partitions. All of it becomes visible with the next manifest: manifests are numbered, and
a number can be taken only once, so of two writers one has to start again from the other's result.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.operators.timestamps import normalise
from strandline.session import BROADCAST_ROWS, broadcast_if_small, scratch_path, scratched, written

_ROWS = "id binary, instant bigint, arrival bigint, copies bigint, home string"
_INDEX = "key bigint, home string"
#: Rows of a history partition; a batch with more new rows is spread over several.
PART_ROWS = 4_000_000
#: Times a batch is taken up again after another writer came first.
ATTEMPTS = 5


def _size():
    return F.count("*").alias("n"), F.min("instant").alias("low"), F.max("instant").alias("high")


class Overtaken(RuntimeError):
    """Another writer published the version this one was preparing."""


def normal_id(raw: Column) -> Column:
    """Identifier without letter case, dashes and white space; 32 hex digits become 16 bytes. Null stays null."""
    text = F.lower(F.regexp_replace(raw, r"[-\s\x{a0}]+", ""))
    return F.when(text.rlike("^[0-9a-f]{32}$"), F.unhex(text)).otherwise(text.cast("binary"))


class MessageStore:
    """Deduplicated messages under ``path`` (a folder all executors share, with atomic renames).

    ``ingest`` takes rows ``id binary, instant bigint, arrival bigint``: two rows are one message if ``id`` and
    ``instant`` are equal; the lowest ``arrival`` (unique) wins. Rows with a null ``id`` or ``instant`` are no
    message: they are neither stored nor reported. Other columns are not read; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, part_rows: int = PART_ROWS):
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _hadoop(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def manifest(self) -> dict:
        """The newest version: ``{"version", "parts": {home: {"data", "index", "low", "high"}}, "surplus": [folder, ...]}``."""
        path, fs = self._hadoop("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        newest = max((n for n in names if n.startswith("v")), default=None)
        if newest is None:
            return {"version": 0, "parts": {}, "surplus": []}
        stream = fs.open(self._hadoop(f"manifests/{newest}")[0])
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest aside and renames it to its number; fails with :class:`Overtaken` where that number is taken."""
        aside, fs = self._hadoop(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._hadoop(f"manifests/v{manifest['version']:012d}")[0]
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                raise Overtaken(f"version {manifest['version']}") from e
            raise

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def ingest(self, incoming: DataFrame, size=None) -> None:
        """Adds one batch, whole or not at all. ``incoming`` is read several times: write a dear one first.

        ``size`` is a row with the number ``n`` of its messages and the range ``low, high`` of their instants, where they
        are known. Copies are combined map-side per message, so a message with a third of all rows is no hot task.
        """
        rows = incoming.where(F.col("id").isNotNull() & F.col("instant").isNotNull()).select("id", "instant", "arrival")
        size = size or rows.agg(*_size()).first()
        if not size.n:
            return
        for attempt in range(ATTEMPTS):
            try:
                return self._publish(self._next(self.manifest(), rows, size))
            except Overtaken:
                if attempt == ATTEMPTS - 1:
                    raise

    def _affected(self, parts: dict, rows: DataFrame, size) -> list[str]:
        """Partitions that hold a message of the batch, by the identifier indexes of those whose instants it touches."""
        near = [p["index"] for p in parts.values() if p["low"] <= size.high and p["high"] >= size.low]
        if not near:
            return []
        keys = rows.select(F.xxhash64("id", "instant").alias("key"))
        keys = F.broadcast(keys) if size.n <= BROADCAST_ROWS else keys
        # at most as many rows as there are partitions
        return [r.home for r in self._read(near, _INDEX).join(keys, "key", "left_semi").select("home").distinct().collect()]

    def _next(self, manifest: dict, rows: DataFrame, size) -> dict:
        """Writes the folders of the next version and returns its manifest."""
        parts, tag = dict(manifest["parts"]), uuid.uuid4().hex[:16]
        root = f"{self.path}/v{manifest['version'] + 1:012d}-{tag}"
        affected = self._affected(parts, rows, size)
        history = self._read([parts[h]["data"] for h in affected], _ROWS)
        spread = max(1, math.ceil(size.n / self.part_rows))
        new_home = F.concat(F.lit(f"{tag}-"), F.pmod(F.xxhash64("id", "instant"), F.lit(spread)).cast("string"))
        every = history.unionByName(rows.withColumn("copies", F.lit(1).cast("bigint")).withColumn("home", F.lit(None).cast("string")))
        # a message lies in one partition at most, so its home is the only one that is not null
        winners = every.groupBy("id", "instant").agg(F.min("arrival").alias("arrival"), F.sum("copies").alias("copies"), F.max("home").alias("home"), F.count("*").alias("seen"))
        winners = winners.withColumn("home", F.coalesce("home", new_home)).withColumn("folder", F.col("home"))
        watch = Observation()
        winners.observe(watch, F.count_if(F.col("seen") > 1).alias("again")).write.partitionBy("folder").parquet(f"{root}/data")
        kept = self._read([f"{root}/data"], _ROWS + ", seen bigint, folder string")
        again = watch.get["again"]
        keys = kept.select(F.xxhash64("id", "instant").alias("key"), "home", "folder")
        writes = [lambda: keys.write.partitionBy("folder").parquet(f"{root}/index")]
        if again:
            writes.append(lambda: self._losers(every, kept.where("seen > 1"), again).write.parquet(f"{root}/surplus"))
        with ThreadPoolExecutor(2) as both:  # neither needs the other
            for done in [both.submit(w) for w in writes]:
                done.result()
        data, fs = self._hadoop(f"{root[len(self.path) + 1 :]}/data")
        for home in (f.getPath().getName()[len("folder=") :] for f in fs.listStatus(data) if f.isDirectory()):
            old = parts.get(home, {"low": size.low, "high": size.high})
            parts[home] = {"data": f"{root}/data/folder={home}", "index": f"{root}/index/folder={home}", "low": min(old["low"], size.low), "high": max(old["high"], size.high)}
        return {"version": manifest["version"] + 1, "parts": parts, "surplus": manifest["surplus"] + ([f"{root}/surplus"] if again else [])}

    @staticmethod
    def _losers(every: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
        """``arrival`` of the rows that lost. Few repeated messages are broadcast; many are joined on the unique arrival, which has no hot key."""
        if n <= BROADCAST_ROWS:
            best = F.broadcast(repeated.select("id", "instant", F.col("arrival").alias("best")))
            return every.join(best, ["id", "instant"]).where("arrival <> best").select("arrival")
        once = repeated.select(F.xxhash64("id", "instant").alias("key")).distinct()
        mine = every.select("arrival", F.xxhash64("id", "instant").alias("key"))
        # rows of repeated messages by a semi-join that is salted by arrival on the side of the rows
        salted = once.select("key", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        copies = mine.withColumn("salt", F.pmod("arrival", F.lit(16)).cast("int")).join(salted, ["key", "salt"], "left_semi")
        return copies.join(repeated.select("arrival"), "arrival", "left_anti").select("arrival")

    def messages(self) -> DataFrame:
        """The winners: ``id, instant, arrival, copies`` (the number of deliveries so far)."""
        return self._read([p["data"] for p in self.manifest()["parts"].values()], _ROWS).drop("home")

    def surplus(self) -> DataFrame:
        """``arrival`` of every row that lost against another of the same message: it loses once, so there are no repeats."""
        return self._read(self.manifest()["surplus"], "arrival bigint")

    def vacuum(self) -> int:
        """Deletes folders and manifests that the newest version does not name, and returns their number; no reader of an older version and no writer may be at work."""
        manifest = self.manifest()
        used = {f for p in manifest["parts"].values() for f in (p["data"], p["index"])} | set(manifest["surplus"])
        path, fs = self._hadoop("")
        deleted = 0
        for version in fs.listStatus(path):
            name = version.getPath().getName()
            if name == "manifests":
                old = [f.getPath() for f in fs.listStatus(version.getPath()) if f.getPath().getName() != f"v{manifest['version']:012d}"]
            else:
                kinds = [k.getPath() for k in fs.listStatus(version.getPath())]
                leaves = [f.getPath() for k in kinds if k.getName() != "surplus" for f in fs.listStatus(k) if f.isDirectory()] + [k for k in kinds if k.getName() == "surplus"]
                old = [f for f in leaves if "/".join([self.path, *str(f.toString()).split("/")[-2 if f.getName() == "surplus" else -3 :]]) not in used]
            for f in old:
                fs.delete(f, True)
                deleted += 1
        return deleted


def keyed(notices: DataFrame, teams: DataFrame) -> DataFrame:
    """``id, instant, arrival, batch_no`` of every notice; ``timestamp`` is read as in p6."""
    n = normalise(notices.select("delivery_no", "batch_no", "team", "document_id", "timestamp"), "timestamp", "team", teams)
    return n.select(normal_id(F.col("document_id")).alias("id"), F.col("utc_us").alias("instant"), F.col("delivery_no").alias("arrival"), "batch_no")


def stored(notices: DataFrame, teams: DataFrame, loads: int = 16) -> MessageStore:
    """A fresh store that the notices were fed to in ``loads`` batches of neighbouring ``batch_no`` (a null one comes first).

    The keys are computed and written once, by load; an empty table leaves an empty store.
    """
    spark = notices.sparkSession
    rows = keyed(notices, teams)
    edge = notices.agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).first()
    lo, hi = (edge.lo or 0), (edge.hi or 0)
    load = F.floor((F.coalesce("batch_no", F.lit(lo)) - lo) * loads / (hi - lo + 1)).cast("int")
    path = scratch_path(spark, "loads")
    rows.withColumn("load", load).drop("batch_no").write.partitionBy("load").parquet(path)
    scratched(spark, path)
    fed = spark.read.schema("id binary, instant bigint, arrival bigint, load int").parquet(path)
    store = MessageStore(spark, scratch_path(spark, "messages"))
    sizes = {r.load: r for r in fed.where("id IS NOT NULL AND instant IS NOT NULL").groupBy("load").agg(*_size()).collect()}  # one row per load
    for i in sorted(sizes):
        store.ingest(fed.where(F.col("load") == i), sizes[i])
    scratched(spark, store.path)
    return store


def surplus_rows(notices: DataFrame, teams: DataFrame, loads: int = 16) -> DataFrame:
    """p4: ``delivery_no`` of the surplus rows, by feeding the notices to a fresh store in ``loads`` batches.

    Null or empty ids and timestamps that denote no instant never count; an empty table gives none. Extra and
    clashing columns of ``notices`` are not touched: only the five needed ones are read.
    """
    return stored(notices, teams, loads).surplus().select(F.col("arrival").alias("delivery_no"))


def kept_rows(notices: DataFrame, teams: DataFrame, loads: int = 16) -> DataFrame:
    """``delivery_no, copies``: the one row that stays of every message, with the number of its deliveries."""
    return stored(notices, teams, loads).messages().select(F.col("arrival").alias("delivery_no"), "copies")
