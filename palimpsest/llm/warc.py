"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are sorted by page id and payload digest, cut into shards of about equal bytes by a tree
of histograms (so the cut depends on the rows alone), and written to gzip members in files that
roll at a compressed size. Every file is written under a temporary name and renamed when complete, and
counts only if the manifest, written last and renamed too, lists it; a lost or doubled task
leaves at most a temporary file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import re
import uuid
import zlib
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Settled, big_batches

DATE = "2000-01-01T00:00:00Z"  # a fixed capture date: the same rows give the same bytes
ROLL, SHARD_BYTES = 32 << 20, 64 << 20
SHARDS = 1 << 14  # shards at most, but for single rows that are larger; a shard of a larger table is larger
FAN = 1 << 14  # cells of a histogram
LEAST = 1000  # bytes of a payload that is worth a revisit record


def _named(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark would give it, so executors open the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; schemes of Hadoop's connectors are read as the stores they name."""
    scheme = urlparse(folder).scheme
    if scheme == "file":
        return fs.LocalFileSystem(), urlparse(folder).path
    if scheme in ("s3a", "s3n"):
        folder = "s3" + folder[len(scheme) :]
    return fs.FileSystem.from_uri(folder)


def _publish(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Whole content or nothing under ``path``, whoever else writes the same."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None, url: str, payload: str, twin: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {payload} {twin}')}>"


def record(page: int | None, url: str | None, html: bytes, refers_to: int | None, revisit: bool, twin: int) -> bytes:
    """One gzip member. The block is an HTTP response head and, but for a revisit, the payload."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    payload = _digest(html)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = head if revisit else head + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page, url, payload, twin)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {payload}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"WARC-Source-Page: {'' if page is None else page}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + coder.flush()


def _info() -> bytes:
    body = b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_name(None, 'info', '', 0)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(head + body + b"\r\n\r\n") + coder.flush()


def plan(light: DataFrame) -> DataFrame:
    """(page_id, digest, best): of equal payloads of LEAST bytes or more in several rows, the page to revisit.

    light(page_id, digest, size): no payload moves, and rows of a digest are counted before the shuffle.
    """
    worth = light.where(F.col("size") >= LEAST).select("page_id", "digest")
    groups = worth.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").select("digest", "best")
    return worth.distinct().join(groups, "digest")


class Cells:
    """Where the rows of (page_id, digest) lie: a tree of histograms whose leaves are in order.

    The first histogram has FAN cells of equal width between the smallest and the largest id, and
    a cell ahead of them for null ids. A cell of more than half a shard's bytes is cut again,
    between the ids it really holds, so an outlier or a dense stretch costs one level more; a cell
    of a single id is cut by its payloads' digests. What remains in one cell are rows of one id
    and one payload (or digests that share 32 bits). Levels follow the ids' 64 bits, cells the
    table's bytes divided by a shard's: FAN + 16 * SHARDS at most, which bounds the charts sent out.
    """

    def __init__(self, light: DataFrame, shard_bytes: int):
        self.spark = light.sparkSession
        self.levels: list[tuple[list, list]] = []
        low, high, total = light.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("size") + 500)).first()
        self.shard_bytes = max(shard_bytes, -(-(total or 0) // SHARDS))
        leaves: dict[tuple, int] = {}  # the path of a cell, and its bytes
        todo = {0: ((), low or 0, high or 0, FAN, False)}  # node: path, ids from and to, cells, one id
        while todo:
            spec = []
            for node, (_, lo, hi, fan, single) in todo.items():
                width = -(-(1 << 32) // fan) if single else -(-(hi - lo + 1) // fan)
                spec.append((node, "digest" if single else "id" if hi - lo < 1 << 62 else "wide", lo, float(width), min(width, (1 << 63) - 1)))
            at = self._cell(light, [*self.levels, (spec, [])])
            got = at.groupBy("node", "cell").agg(F.sum(F.col("size") + 500), F.min("page_id"), F.max("page_id")).collect()  # one row a cell
            chart, later = [], {}
            for node, cell, size, lo, hi in sorted(got, key=lambda r: (r[0], r[1])):
                path, _, _, _, single = todo[node]
                path = (*path, cell)
                if size * 2 > self.shard_bytes and not single:
                    later[n := len(later)] = (path, lo or 0, hi or 0, max(2, min(FAN, 8 * -(-size // self.shard_bytes))), lo == hi)
                    chart.append((node, cell, n, path))
                else:
                    leaves[path] = size
                    chart.append((node, cell, None, path))
            self.levels.append((spec, chart))
            todo = later
        self.shard_of, shard, full = {}, 0, 0
        for path in sorted(leaves):
            if full and full + leaves[path] > self.shard_bytes:
                shard, full = shard + 1, 0
            full += leaves[path]
            self.shard_of[path] = shard
        self.shards = shard + 1

    def _cell(self, rows: DataFrame, levels: list, with_leaf: bool = False) -> DataFrame:
        """rows at the last level's nodes with their cells, or with_leaf all rows with their shards."""
        out, done = rows.withColumn("node", F.lit(0)), []
        if with_leaf:
            out = out.withColumn("shard", F.lit(None).cast("int"))
        for depth, (spec, chart) in enumerate(levels):
            names = ("node", "how", "low", "wide", "width")
            if depth:
                specs = self.spark.createDataFrame(spec, "node int, how string, low long, wide double, width long")
                out = out.join(F.broadcast(specs), "node", "left" if with_leaf else "inner")
            else:  # all rows are at the root
                out = out.withColumns({k: F.lit(v) for k, v in zip(names[1:], spec[0][1:])})
            by_digest = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.col("width"))
            by_id = F.when(F.col("how") == "id", F.expr("(page_id - low) div width")).otherwise(F.floor((F.col("page_id").cast("double") - F.col("low").cast("double")) / F.col("wide")))
            by_id = F.when(F.col("page_id").isNull(), F.lit(0)).otherwise(by_id + 1)
            out = out.withColumn("cell", F.when(F.col("how") == "digest", by_digest).otherwise(by_id).cast("long")).drop("how", "low", "wide", "width")
            if chart:
                known = [(n, c, to, self.shard_of[p] if with_leaf and to is None else None) for n, c, to, p in chart]
                charts = self.spark.createDataFrame(known, "node int, cell long, to int, leaf int")
                out = out.join(F.broadcast(charts), ["node", "cell"], "left").drop("node", "cell").withColumnRenamed("to", "node")
                out = out.withColumn("shard", F.coalesce("shard", "leaf")).drop("leaf") if with_leaf else out.drop("leaf")
        return out

    def dealt(self, rows: DataFrame) -> DataFrame:
        return self._cell(rows, self.levels, True).drop("node")


def write(pages: DataFrame, folder: str, settle: Settled | None = None, roll: int = ROLL, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write pages(page_id, url, html) as WARC files under ``folder`` and return the manifest.

    Of equal payloads of LEAST bytes or more, the record of the largest page_id is the response
    and the others revisit it; rows that repeat that page_id as well are revisits too, but one.
    Null html is an empty payload, a null url an empty one, a null page_id sorts first; where
    all rows of a group have a null page_id, each is a response. Any 64-bit id will do. An empty
    table gives a manifest without files. Other columns of pages are not written.
    """
    spark = pages.sparkSession
    big_batches(spark)
    settle = (settle or Settled(spark, "warc")).part()
    folder = _named(spark, folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    light = settle(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")))
    cells = Cells(light, shard_bytes)
    n = cells.shards
    # What a page revisits travels as rows of its own, ahead of it, so payloads are shuffled once.
    told = plan(light).select("page_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "best")
    both = told.unionByName(rows.select("page_id", F.lit(1).alias("place"), "url", "payload", "digest", F.lit(None).cast("long").alias("best")))
    # A key for each shard that hash partitioning sends to a partition of its own.
    keys = spark.range(30 * n + 100).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
    key_of = spark.createDataFrame([(r["p"], r["id"]) for r in keys], "shard int, key long")
    dealt = cells.dealt(both).join(F.broadcast(key_of), "shard", "left").withColumn("key", F.coalesce("key", "shard"))
    placed = dealt.repartition(n, "key").sortWithinPartitions("shard", "page_id", "digest", "place", "url")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        store, root = _store(folder)
        state = {"shard": None}

        def close():
            name = f"part-{state['shard']:06d}-{state['file']:04d}.warc.gz"
            data = state["out"].getvalue()
            _publish(store, f"{root}/{name}", data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)]), pa.array([state["n"]]), pa.array([hashlib.sha256(data).hexdigest()])], names=["name", "bytes", "records", "sha256"])

        last, twin, of, best, first = None, 0, None, None, True
        for batch in batches:
            for digest, page, url, html, told, shard in zip(*(batch.column(c).to_pylist() for c in ("digest", "page_id", "url", "payload", "best", "shard"))):
                if (page, digest) != of:
                    of, best, first = (page, digest), None, True
                if html is None:
                    best = told
                    continue
                if state["shard"] is not None and (state["shard"] != shard or state["out"].tell() >= roll):
                    yield close()
                    state = {"shard": shard, "file": state["file"] + 1 if state["shard"] == shard else 0, "out": io.BytesIO(_info()), "n": 0}
                    state["out"].seek(0, os.SEEK_END)
                elif state["shard"] is None:
                    state = {"shard": shard, "file": 0, "out": io.BytesIO(_info()), "n": 0}
                    state["out"].seek(0, os.SEEK_END)
                here = (page, url, digest)
                twin = twin + 1 if here == last else 0
                last = here
                state["out"].write(record(page, url, html, best, best is not None and not (best == page and first), twin))
                first = False
                state["n"] += 1
        if state["shard"] is not None:
            yield close()

    done = placed.select("digest", "page_id", "url", "payload", "best", "shard").mapInArrow(run, "name string, bytes long, records long, sha256 string").collect()  # one row per file
    manifest = {"files": [r.asDict() for r in sorted(done, key=lambda r: r.name)]}
    _publish(store, f"{root}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def _records(stream, size: int = 1 << 20):
    """The gzip members of a file, one at a time."""
    rest = b""
    while True:
        coder, parts = zlib.decompressobj(31), []
        while not coder.eof:
            rest = rest or stream.read(size)
            if not rest:
                if parts:
                    raise ValueError("a gzip member ends early")
                return
            parts.append(coder.decompress(rest))
            rest = coder.unused_data
        yield b"".join(parts)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, html) of the files that
    the manifest under ``folder`` lists. Block digests, and payload digests of responses, are
    verified; a record that does not agree with its header raises ValueError."""
    folder = _named(spark, folder)
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    files = spark.createDataFrame([(n,) for n in names], "name string")  # one row a file, as many as the manifest lists
    files = files.repartition(max(1, len(names)), F.xxhash64("name"))
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html binary"

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _records(stream):
                        top, _, rest = data.partition(b"\r\n\r\n")
                        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode().split("\r\n")[1:])
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        block = rest[: int(head["Content-Length"])]
                        if _digest(block) != head["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block does not have its digest")
                        http, _, html = block.partition(b"\r\n\r\n")
                        if head["WARC-Type"] == "response" and _digest(html) != head["WARC-Payload-Digest"]:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        number = lambda s: int(s) if s else None
                        rows.append((number(head["WARC-Source-Page"]), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("WARC-Refers-To-Page", "")), length, digest, html))
                        size += len(html)
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
