"""A catalog of tables in versions: a write makes new files, then a manifest names them.

Readers of an older version are not disturbed, and a write that fails leaves the last one in place.
All files go through Spark's readers and writers and Hadoop's file systems, so the root may be in any store that renames a file once.
"""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.schemas import ALLOWED, KEYS, PLACED, TABLES

#: Buckets of a table with a key while it is small, and bytes of one; segments that an append leaves; tries of a write.
BUCKETS, BUCKET_BYTES = 8, 256 << 20
SEGMENTS, ATTEMPTS = 16, 8


def settled(df: DataFrame) -> DataFrame:
    """``df`` read back from files in the shared folder, which ends its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(root)
    path = f"{root}/quillgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def no_automatic_broadcast(spark: SparkSession):
    """Joins that are run inside meet by shuffles; ``F.broadcast`` still counts.

    Settled tables are small as files, so Spark would take nodes of a graph together in the driver, again and again, until they are some
    times larger than its threshold.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upsert(current: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``current`` with ``rows`` in place of those of the same keys; the last of equal keys in ``rows`` isn't chosen: they must be unique."""
    return current.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def update(current: DataFrame, rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """``current`` with the given columns of ``rows``, where the keys are known; others of ``rows`` are ignored."""
    new = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = current.join(new, list(keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def replace_group(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of a group are replaced by those of ``rows``."""
    return current.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


class ConcurrentWrite(Exception):
    """Another writer was first; what was read before it doesn't hold any more."""


class Catalog:
    """Tables under ``root``.

    A version of a table is a manifest, a small file that names the table's pieces. Rows of a table with a key are dealt to buckets by a
    hash of it, and a piece is a bucket; a keyed write reads and rewrites the buckets that hold its keys and takes the others over
    from the version before. A table without a key is a list of segments: an append adds one, and after ``SEGMENTS`` of them one holds all.

    A manifest is made once: of two writers with the same version before them one fails. Keyed writes and appends then start again from
    the new version; ``write``, which replaces a table, raises ``ConcurrentWrite`` if the version that the caller read (``base``) isn't the last.
    Readers keep the pieces of the version that they have read, until ``vacuum`` removes pieces that no late version names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self, table: str) -> list[int]:
        fs, at = self._fs(f"{self.root}/_versions/{table}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] not in "._")

    def version(self, table: str) -> int:
        """0 for a table that was never written."""
        return max(self._versions(table), default=0)

    def _manifest(self, table: str, version: int) -> dict:
        if not version:
            return {"buckets": BUCKETS, "pieces": {}}
        fs, at = self._fs(f"{self.root}/_versions/{table}/{version:020d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, table: str, base: int, manifest: dict) -> None:
        """Make version ``base`` + 1, unless there is one: a whole file gets a name that must be free."""
        folder = f"{self.root}/_versions/{table}"
        fs, target = self._fs(f"{folder}/{base + 1:020d}.json")
        _, draft = self._fs(f"{folder}/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if fs.getScheme() == "file":  # renaming would replace there, linking doesn't
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
            fs.delete(draft, False)
        else:
            won = fs.rename(draft, target)
        if not won:
            fs.delete(draft, False)
            raise ConcurrentWrite(f"{table} has a version {base + 1} already")

    # Rows

    def _own(self, table: str, rows: DataFrame) -> DataFrame:
        target = StructType.fromDDL(TABLES[table])
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])

    def _bucket(self, table: str, manifest: dict):
        return F.pmod(F.xxhash64(*[F.col(c) for c in PLACED[table]]), F.lit(manifest["buckets"])).cast("int")

    def _pieces(self, table: str, paths) -> DataFrame:
        schema = StructType.fromDDL(TABLES[table])
        paths = sorted(set(paths))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._pieces(table, self._manifest(table, self.version(table) if version is None else version)["pieces"].values())

    def _checked(self, table: str, made: DataFrame) -> None:
        for (name, column), values in ALLOWED.items():
            if name == table and made.filter(~F.col(column).isin(*values)).limit(1).count():
                raise ValueError(f"{table}.{column} has a value out of {values}")
        if table in KEYS and made.groupBy(*KEYS[table]).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{table} has rows with the same {KEYS[table]}")

    def _written(self, table: str, manifest: dict, rows: DataFrame) -> dict[str, str]:
        """New pieces with ``rows``, checked."""
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        if table not in PLACED:
            rows.write.parquet(folder)
            self._checked(table, self._pieces(table, [folder]))
            return {folder: folder}
        placed = rows.withColumn("__bucket", self._bucket(table, manifest))
        # Tasks are of bounded size, so a large bucket is written, as several files, by several of them.
        placed.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(folder)
        fs, at = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        made = {n.partition("=")[2]: f"{folder}/{n}" for n in names}
        self._checked(table, self._pieces(table, made.values()))
        return made

    def _size(self, paths) -> int:
        return sum(fs.getContentSummary(at).getLength() for fs, at in map(self._fs, set(paths)))

    # Writes

    def write(self, table: str, rows: DataFrame, base: int | None = None) -> None:
        """All rows anew; refuses values out of their set and repeated keys. Large tables get more buckets."""
        at = self.version(table)
        if base is not None and base != at:
            raise ConcurrentWrite(f"{table} is at version {at}, not {base}")
        buckets = BUCKETS
        if table in PLACED:
            size = self._size(self._manifest(table, at)["pieces"].values())
            while buckets * BUCKET_BYTES < size:
                buckets *= 2
        manifest = {"buckets": buckets, "pieces": {}}
        manifest["pieces"] = self._written(table, manifest, self._own(table, rows))
        self._commit(table, at, manifest)

    def _retried(self, work) -> None:
        for left in reversed(range(ATTEMPTS)):
            try:
                return work()
            except ConcurrentWrite:
                if not left:
                    raise
                time.sleep(random.random() * 0.2)

    def merge(self, table: str, rows: DataFrame | None = None, gone: DataFrame | None = None, new: bool = False) -> None:
        """Rows with the placing columns of ``gone`` or of ``rows`` are removed, then ``rows`` are added; only buckets with such keys are rewritten.

        With ``new``, nothing is removed for ``rows``, whose keys must be free.
        """
        keys = list(PLACED[table])
        given = None if rows is None else settled(self._own(table, rows))
        named = [x.select(*keys) for x in ([] if given is None or new else [given]) + ([] if gone is None else [gone])]
        out = None
        for x in named:
            out = x if out is None else out.unionByName(x)
        out = None if out is None else settled(out.distinct())

        def work():
            base = self.version(table)
            manifest = self._manifest(table, base)
            hit: set[str] = set()
            for x in (given, out):
                if x is not None:
                    hit |= {str(r["b"]) for r in x.select(self._bucket(table, manifest).alias("b")).distinct().collect()}  # at most a row for each bucket
            kept = {b: p for b, p in manifest["pieces"].items() if b not in hit}
            current = self._pieces(table, [p for b, p in manifest["pieces"].items() if b in hit])
            result = current if out is None else current.join(out, keys, "left_anti").select(*current.columns)
            result = result if given is None else result.unionByName(given)
            made = self._written(table, manifest, result) if hit else {}
            self._commit(table, base, {**manifest, "pieces": kept | made})

        self._retried(work)

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.merge(table, rows)

    def append(self, table: str, rows: DataFrame) -> None:
        if table in PLACED:
            return self.merge(table, rows, new=True)
        made = self._written(table, {}, self._own(table, rows))

        def work():
            base = self.version(table)
            manifest = self._manifest(table, base)
            pieces = manifest["pieces"] | made
            if len(pieces) > SEGMENTS:
                pieces = self._written(table, {}, self._pieces(table, pieces.values()))
            self._commit(table, base, {**manifest, "pieces": pieces})

        self._retried(work)

    def delete(self, table: str, condition) -> None:
        hit = F.coalesce(condition, F.lit(False))
        if table in KEYS:
            return self.merge(table, gone=settled(self.read(table).filter(hit).select(*KEYS[table])))

        def work():
            base = self.version(table)
            self.write(table, self.read(table, base).filter(~hit), base)

        self._retried(work)

    def truncate(self, *tables: str) -> None:
        for table in tables or TABLES:
            self._retried(lambda table=table: self._commit(table, self.version(table), {"buckets": BUCKETS, "pieces": {}}))

    def vacuum(self, table: str, keep: int = 10) -> int:
        """Removes pieces and manifests that none of the last ``keep`` versions needs; the number of folders removed.

        Only to be used where no write of the table is under way and no reader has an older version.
        """
        versions = self._versions(table)
        named = {p.rsplit("/__bucket", 1)[0] for v in versions[-keep:] for p in self._manifest(table, v)["pieces"].values()}
        fs, at = self._fs(f"{self.root}/{table}")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        gone = [p for p in found if p.getName() not in {n.rsplit("/", 1)[1] for n in named}]
        for p in gone:
            fs.delete(p, True)
        for v in versions[:-keep]:
            fs.delete(self._fs(f"{self.root}/_versions/{table}/{v:020d}.json")[1], False)
        return len(gone)

    def counts(self, *tables: str) -> DataFrame:
        every = None
        for table in tables or TABLES:
            own = self.read(table).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "rows")
            every = own if every is None else every.unionByName(own)
        return every
