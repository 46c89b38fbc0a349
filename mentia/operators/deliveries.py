"""Problem 6: messages delivered more than once.

Identifiers are encoded exactly by a dictionary, (shard, code) with dense codes in each shard, and what
was seen is kept as one bitmap a shard and container of 32,768 codes. Containers exist only where codes
do and are stored compressed. A batch selects one arrival per unseen bit and then adds its new bits as a
part of their own; parts are merged now and then. A batch counts from the moment its mark exists. The mark is
created without overwriting, so that of two runs one is refused, and names the batch, so that a batch that
is run again after a loss is given what it accepted the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mentia.session import cut

#: Shards of the dictionary, and parts of a shard that are numbered beside each other.
SHARDS, PARTS = 64, 256
#: Versions after which the bitmaps are merged.
MERGE = 16
DICT_SCHEMA = "name string, ident string, shard int, code bigint"
SEEN_SCHEMA = "name string, shard int, bucket bigint, bits binary"


def canonical_id(ident: Column) -> Column:
    """An identifier in one spelling: lower case, no white space, braces, hyphens or URN prefix; null where nothing is left."""
    bare = F.regexp_replace(F.lower(ident), r"[\s   ﻿{}()]", "")
    bare = F.regexp_replace(bare, r"^(?:urn:)?(?:uuid:)?", "")
    plain = F.regexp_replace(bare, "-", "")
    ident = F.when(plain.rlike(r"^[0-9a-f]{32}$"), plain).otherwise(bare)
    return F.when(ident != "", ident)


class SeenStore:
    """What was accepted so far, below ``path`` in a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(self.path))

    def marks(self) -> list[tuple[str, str]]:
        """(mark, batch) of every version, in order."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path)) if s.getPath().getName().startswith("current-"))
        return [tuple((self.spark.read.text(f"{self.path}/{n}").first()[0] + " ").split(" ", 1)) for n in names]

    def version(self) -> int:
        """Number of versions whose commit mark exists; 0 for an empty store."""
        return len(self.marks())

    def dictionary(self) -> DataFrame:
        """(name, ident, shard, code) of every identifier accepted."""
        marks = self.marks()
        return self.spark.read.schema(DICT_SCHEMA).parquet(*(f"{self.path}/dict-{m}" for m, _ in marks)) if marks else self.spark.createDataFrame([], DICT_SCHEMA)

    def _parts(self, marks: list[tuple[str, str]]) -> list[str]:
        # a version divisible by MERGE holds all bits up to it
        return [f"{self.path}/seen-{m}" for m, _ in marks[max(0, len(marks) // MERGE * MERGE - 1) :]]

    def seen(self) -> DataFrame:
        """(name, shard, bucket, bits): the bitmaps of the current version."""
        marks = self.marks()
        if not marks:
            return self.spark.createDataFrame([], SEEN_SCHEMA)
        parts = self.spark.read.schema(SEEN_SCHEMA).parquet(*self._parts(marks))
        return parts.groupBy("name", "shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def accepted(self, batch: str) -> DataFrame | None:
        """What ``accept`` returned for a batch of this name; None where no such batch was committed."""
        found = [m for m, b in self.marks() if b.strip() == batch]
        return self.spark.read.parquet(f"{self.path}/dict-{found[0]}").select("name", "message_id") if found else None

    def accept(self, batch: DataFrame, batch_name: str = "") -> DataFrame:
        """(name, message_id) of the one arrival of each identifier not seen before; its bits are added.

        ``batch`` has (name, ident, received_at, message_id): the earliest arrival wins, then the lowest
        message. Null and blank identifiers are no deliveries of one thing and never come out. A batch of a name that was
        accepted before is given the same rows again.
        """
        if batch_name and (again := self.accepted(batch_name)) is not None:
            return again
        marks = self.marks()
        v = len(marks)
        # partial aggregation before the shuffle: a hot identifier sends one row a map task
        arrivals = batch.withColumn("ident", canonical_id(F.col("ident"))).filter("ident is not null").groupBy("name", "ident").agg(F.min(F.struct("received_at", "message_id")).alias("first"))
        arrivals = arrivals.withColumn("shard", F.pmod(F.xxhash64("name", "ident"), F.lit(self.shards)).cast("int"))
        base = None
        if v:
            unit, bit = F.col("code") % 32768, F.bitmap_bit_position("code")
            coded = arrivals.join(self.dictionary().drop("shard"), ["name", "ident"], "left").withColumn("bucket", F.bitmap_bucket_number("code")).join(self.seen(), ["name", "shard", "bucket"], "left")
            byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(code) div 8 as int) + 1, 1)")), 16, 10).cast("int")
            is_seen = F.coalesce(F.expr("pmod(shiftright(b, cast(bitmap_bit_position(code) % 8 as int)), 2)") == 1, F.lit(False))
            arrivals = coded.withColumn("b", byte).filter(~is_seen).select("name", "ident", "first", "shard")
            base = self.dictionary().groupBy("name", "shard").agg(F.max("code").alias("last"))
        # numbers in two steps: within parts of a shard, and over the parts, of which there are few
        # read twice, so kept: the spelling of identifiers is most of the work
        arrivals = cut(arrivals.withColumn("part", F.pmod(F.shiftright(F.xxhash64("name", "ident"), 20), F.lit(PARTS)).cast("int")))
        sizes = arrivals.groupBy("name", "shard", "part").agg(F.count("*").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("name", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select("name", "shard", "part", before.alias("offset"))
        if base is not None:
            offsets = offsets.join(base, ["name", "shard"], "left").select("name", "shard", "part", (F.col("offset") + F.coalesce("last", F.lit(0))).alias("offset"))
        numbered = arrivals.withColumn("n", F.row_number().over(Window.partitionBy("name", "shard", "part").orderBy("ident"))).join(offsets, ["name", "shard", "part"])
        mark = uuid.uuid4().hex
        at_new = f"{self.path}/dict-{mark}"
        numbered.select("name", "ident", "shard", (F.col("n") + F.col("offset")).cast("bigint").alias("code"), F.col("first.message_id").alias("message_id")).write.parquet(at_new)
        new = self.spark.read.parquet(at_new)
        bits = new.groupBy("name", "shard", F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        if (v + 1) % MERGE == 0:
            bits = self.seen().unionByName(bits).groupBy("name", "shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.parquet(f"{self.path}/seen-{mark}")
        self._commit(v + 1, f"{mark} {batch_name}".strip())
        return new.select("name", "message_id")

    def _commit(self, version: int, text: str) -> None:
        """Create the mark of a version, which exists either whole or not at all; an error where it does already."""
        try:
            out = self._fs.create(self._Path(f"{self.path}/current-{version:08d}"), False)
        except Exception as e:
            raise RuntimeError(f"version {version} of {self.path} was committed by another run") from e
        out.write(bytearray(text.encode()))
        out.close()


def surplus(batch: DataFrame, store: SeenStore) -> DataFrame:
    """(name, message_id) of the deliveries of a batch that must go: all but the accepted of each identifier.

    Rows with null or blank identifiers aren't surplus. An empty batch gives an empty result. Repeated
    rows are deliveries like any other; messages are told apart by ``message_id`` within ``name``.
    """
    kept = store.accept(batch)
    known = batch.filter(canonical_id(F.col("ident")).isNotNull()).select("name", "message_id")
    return known.join(kept, ["name", "message_id"], "left_anti")
