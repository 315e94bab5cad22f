"""Versions of files that arrive as a stream, with keyed state instead of a look at the table of documents.

The first operator is keyed by content hash. It keeps the earliest file of each text, waits for the watermark to pass that
file's time, and passes it on once; other files of the text are duplicates. The second one is keyed by filename and counts versions.
Files therefore get the versions that ``operators.versions.track`` gives to the whole table, in whatever order and batches they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State that is larger than memory, timers and several columns of state need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = "content_hash string, seq long, filename string, at timestamp"
VERSION = "filename string, version long, seq long, content_hash string, at timestamp"
_EPOCH, _TOLD = datetime(1970, 1, 1, tzinfo=timezone.utc), Row("content_hash", "seq", "filename", "at")
_COUNTED = Row("filename", "version", "seq", "content_hash", "at")


def _millis(micros: int) -> int:
    """A time in whole milliseconds, rounded up, so that a timer is never early."""
    return -(-micros // 1000)


class FirstOfText(StatefulProcessor):
    """Of the files of one text the earliest, by time and then ``seq``; a single row of state, however many copies come.

    Rows are plain ones, and a key is asked for its state once: most keys have a single file, for which a data frame each way costs far more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "seq long, filename string, micros long, told boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.best.update((-1, None, None, True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have = self.best.get()
        if have is not None and have[3]:
            return
        first = min(((r["micros"], r["seq"], r["filename"]) for r in rows), key=lambda x: x[:2])
        if have is None or first[:2] < (have[2], have[0]):
            if have is not None:
                self.handle.deleteTimer(_millis(have[2]))
            self.handle.registerTimer(_millis(first[0]))
            self.best.update((first[1], first[2], first[0], False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, filename, micros, _ = self.best.get()
        self.best.update((seq, filename, micros, True))
        yield _TOLD(key[0], seq, filename, _EPOCH + timedelta(microseconds=micros))

    def close(self) -> None:
        pass


class CountVersions(StatefulProcessor):
    """The next versions of a filename. What comes in one batch is later than all that came before, so a count is state enough."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "version long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.top.update((initialState["version"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = sorted(rows, key=lambda r: (r["at"], r["seq"]))
        have = self.top.get()
        top = 0 if have is None else have[0]
        self.top.update((top + len(own),))
        for turn, r in enumerate(own, top + 1):
            yield _COUNTED(r["filename"], turn, r["seq"], r["content_hash"], r["at"])

    def close(self) -> None:
        pass


def version_stream(files: DataFrame, late: str, known: DataFrame | None = None) -> DataFrame:
    """(filename, version, seq, content_hash, at) of each new text among ``files``, a stream with seq, filename, content_hash and at.

    ``known`` holds documents from before the stream (filename, content_hash, version); it is read by the first batch only.
    A file is told once the watermark, ``late`` behind the latest file, has passed it, so the last ones need a later file to follow.
    Spark drops files that come later than that and counts them in the query's progress; ingest those by table.
    Rows without a name, hash or time have no version and are left out. One task holds the new texts that a batch has
    of one filename, so the source's limit for a batch bounds it.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = files.select("seq", "filename", "content_hash", "at").filter("filename is not null and content_hash is not null and at is not null")
    texts = names = None
    if known is not None:
        texts = known.filter("content_hash is not null").select("content_hash").distinct().groupBy("content_hash")
        names = known.filter("filename is not null").groupBy("filename").agg(F.max("version").cast("long").alias("version")).groupBy("filename")
    own = own.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    first = own.groupBy("content_hash").transformWithState(FirstOfText(), FIRST, "Append", "EventTime", texts, "at")
    return first.groupBy("filename").transformWithState(CountVersions(), VERSION, "Append", "EventTime", names, "at")
