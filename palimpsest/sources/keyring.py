"""Keys by subject: minted on first use, destroyed for good.

A key is a small file of its own, so destroying it leaves no older version of a table behind. A
marker stays: a subject whose key is gone never gets another.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import HistoryError
from .store import instant

SIZE = 32
_SCHEMA = "subject string, key string, created_at string, destroyed_at string"


class Keyring:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("keys", "destroyed"):
            self._fs.mkdirs(self._path(f"{self.path}/{part}"))

    def _file(self, part: str, subject: str):
        if not subject:
            raise HistoryError("invalid_field", "a key belongs to a subject")
        return self._path(f"{self.path}/{part}/{hashlib.sha256(subject.encode()).hexdigest()}.json")

    def _put(self, path, row: dict) -> None:
        """Create the file, or leave the one that is there."""
        part = self._path(f"{path.toString()}.{os.urandom(8).hex()}.tmp")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(row).encode()))
        stream.close()
        if self._fs.exists(path) or not self._fs.rename(part, path):
            self._fs.delete(part, False)

    def key(self, subject: str) -> bytes:
        """The subject's key; a new one on first use."""
        if self._fs.exists(self._file("destroyed", subject)):
            raise HistoryError("key_destroyed", subject)
        path = self._file("keys", subject)
        if not self._fs.exists(path):
            self._put(path, {"subject": subject, "key": base64.b64encode(os.urandom(SIZE)).decode(), "created_at": instant().isoformat()})
        stream = self._fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return base64.b64decode(json.loads(text)["key"])

    def destroy(self, subject: str) -> None:
        """For good; a subject may be unknown, and the first time stays on record."""
        self._put(self._file("destroyed", subject), {"subject": subject, "destroyed_at": instant().isoformat()})
        self._fs.delete(self._file("keys", subject), False)

    def frame(self) -> DataFrame:
        """(subject, key, created_at, destroyed_at): a destroyed key is null."""
        made, gone = (self.spark.read.schema(_SCHEMA).json(f"{self.path}/{p}", pathGlobFilter="*.json") for p in ("keys", "destroyed"))
        out = made.select("subject", F.unbase64("key").alias("key"), "created_at").join(gone.select("subject", "destroyed_at"), "subject", "full")
        time = lambda c: F.col(c).cast("timestamp_ntz")
        return out.select("subject", F.when(F.col("destroyed_at").isNull(), F.col("key")).alias("key"), time("created_at").alias("created_at"), time("destroyed_at").alias("destroyed_at"))


class MemoryKeyring:
    """The same for tests and single sessions."""

    def __init__(self, spark: SparkSession):
        self.spark, self.keys, self.gone = spark, {}, {}

    def key(self, subject: str) -> bytes:
        if not subject:
            raise HistoryError("invalid_field", "a key belongs to a subject")
        if subject in self.gone:
            raise HistoryError("key_destroyed", subject)
        return self.keys.setdefault(subject, (os.urandom(SIZE), instant()))[0]

    def destroy(self, subject: str) -> None:
        if not subject:
            raise HistoryError("invalid_field", "a key belongs to a subject")
        self.keys.pop(subject, None)
        self.gone.setdefault(subject, instant())

    def frame(self) -> DataFrame:
        none: tuple[bytes | None, datetime | None] = (None, None)
        rows = [(s, *self.keys.get(s, none), self.gone.get(s)) for s in self.keys.keys() | self.gone.keys()]
        return self.spark.createDataFrame([(s, k and bytearray(k), c, d) for s, k, c, d in rows], "subject string, key binary, created_at timestamp_ntz, destroyed_at timestamp_ntz")
