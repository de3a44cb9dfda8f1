"""A deterministic, sharded WARC writer and its reader.

Records are ordered by id and payload digest. Running sums of their sizes in that order name the shard of each, so
a shard holds about ``shard_bytes`` whatever the pages are, and shards do not depend on how Spark cuts the input. A
task writes a shard in order, each record a gzip member of its own, and starts a new file once ``roll_bytes``
compressed bytes are reached. HTTP and WARC headers, record ids and digests are made anew from the row alone, with a
given date, so a task that is run again writes the same bytes. Files get a temporary name first and their own one when
they are whole; the manifest lists files, sizes and records, and the reader checks the folder against it.

Of records with equal payloads the one of the largest id is a response, the others are revisits of it. Only the
payload of a response is shuffled to its shard. Rows that are equal in id, payload and URL are counted first and written
out in runs of ``RUN`` copies, each a place of its own in the order.

Defined results: a null page is an empty payload, and empty payloads are equal ones. A null id is before
all and is referred to only where no other id has the payload. Of repeated rows one is the response and
the others revisit it. An empty table writes no file. A URL is written with unsafe characters escaped, a
null one as ``urn:page:`` and the id. One record is one value in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.llm.common import checkpointed, no_text
from logloom.operators.indexing import with_order_index
from logloom.operators.skew import spread_join
from logloom.session import scratch_path

SHARD_BYTES, ROLL_BYTES, DATE = 32 << 20, 8 << 20, "2024-01-01T00:00:00Z"
#: Copies of a row that are written in a row, and rows whose sizes one task adds up.
RUN, ADDED = 10_000, 65_536
#: Sizes of a record, by which shards are cut: its headers, and how far its payload shrinks.
HEAD_BYTES, SHRINKS = 600, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, part long, bytes long, records long, sha1 string"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, file string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, ':'.join(map(str, parts)))}>"


def page_record(page_id: str, url: str | None, digest: str, size: int, nth: int, refers_to: str | None, payload: bytes | None, date: str) -> bytes:
    """A response with its payload, or without one a revisit of the record of page ``refers_to``; ``nth`` tells repeated rows apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", record_id(page_id, digest, nth)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id)]
    fields += [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if payload is not None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", fields, http)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Roller:
    """Writes the files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.at = _filesystem(folder)
        self.shard, self.roll_bytes, self.date, self.part = shard, roll_bytes, date, 0
        self.done: list[tuple] = []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:08d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.at}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            info = f"software: logloom\r\nformat: WARC File Format 1.1\r\nshard: {self.shard}\r\npart: {self.part}\r\n".encode()
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.at}/{self.name}")  # the same bytes, if an earlier attempt has put them there
            self.done.append((self.name, self.shard, self.part, self.size, self.records, self.hash.hexdigest()))
            self.out, self.part = None, self.part + 1


def _packed(pages: pd.Series) -> pd.Series:
    return pd.Series([None if page is None else zlib.compress(page.encode("utf-8", "surrogatepass"), 1) for page in pages], dtype=object)


def _deflated(page: Column) -> Column:
    """Pages in UTF-8, packed before they are shuffled."""
    return F.pandas_udf(_packed, "binary")(page)


def _writer(folder: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                if roller is None or row["shard"] != roller.shard:
                    if roller is not None:
                        roller.close()
                        yield _manifest(roller.done)
                    roller = _Roller(folder, row["shard"], roll_bytes, date)
                digest = base64.b32encode(row["sha1"]).decode()
                for nth in range(row["nth"], row["nth"] + row["copies"]):
                    payload = None
                    if row["response"] and nth == 0:
                        payload = zlib.decompress(row["payload"]) if row["payload"] else b""
                        if len(payload) != row["size"]:
                            raise ValueError(f"page {row['id']} came without its payload")
                    roller.add(page_record(str(row["id"]), row["url"], digest, row["size"], nth, row["refers_to"], payload, date))
        if roller is not None:
            roller.close()
            yield _manifest(roller.done)

    return write


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "shard", "part", "bytes", "records", "sha1"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + name.removeprefix("file:") if name.startswith("file:/") and not name.startswith("file:///") else name


def _shards(items: DataFrame, shard_bytes: int) -> DataFrame:
    """Items (rows with ``bytes``) in order of id, digest, URL and copy, with their place ``at`` and ``shard``."""
    placed = with_order_index(items, ["id", "sha", "url", "nth"], name="at").withColumn("part", F.floor(F.col("at") / ADDED))
    placed = checkpointed(placed)
    sums = placed.groupBy("part").agg(F.sum("bytes").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per ADDED items
    sums = sums.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("before") + F.coalesce(F.sum("bytes").over(upto), F.lit(0))
    return placed.join(sums, "part").withColumn("shard", F.floor(whole / shard_bytes).cast("long")).drop("part", "before", "bytes")


def write(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write the archives into a new folder; returns the manifest, which is kept in the folder as ``_manifest``."""
    spark = pages.sparkSession
    folder = _qualified(spark, folder)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    # Digests are bytes, half as long as their digits: each row is shuffled with them several times.
    sha = F.unhex(F.sha2(no_text(html).cast("binary"), 256)).alias("sha")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), no_text(html).cast("binary").alias("body"), sha)
    told = rows.select("id", "url", "sha", F.unhex(F.sha1("body")).alias("sha1"), F.octet_length("body").cast("long").alias("size"))
    counted = checkpointed(told.groupBy("id", "sha", "url", "sha1", "size").agg(F.count(F.lit(1)).alias("times")))
    groups = counted.groupBy("sha").agg(F.max("id").alias("refers_to"))
    earlier = Window.partitionBy("id", "sha").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
    plans = spread_join(counted.withColumn("first", F.coalesce(F.sum("times").over(earlier), F.lit(0))), groups, ["sha"])
    plans = plans.withColumn("response", F.col("id").eqNullSafe(F.col("refers_to")))
    runs = plans.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    body_bytes = F.when(F.col("response") & (F.col("nth") == 0), F.col("size") / SHRINKS).otherwise(0)
    items = runs.select(
        "id", "url", "sha", "sha1", "size", "response", F.col("refers_to").cast("string").alias("refers_to"),
        (F.col("first") + F.col("run") * RUN).alias("nth"), F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("run") * RUN).alias("copies"),
    ).withColumn("bytes", (F.col("copies") * HEAD_BYTES + body_bytes).cast("long"))
    items = checkpointed(_shards(items, shard_bytes))
    # Packed pages meet the first copy of their response by the key that repeated ones are dropped by, so they are shuffled once for both.
    key = F.coalesce(F.col("id").cast("string"), F.lit("\x00")).alias("key")
    bodies = pages.select(F.col(page_id).alias("id"), _deflated(F.col(html)).alias("payload"), sha)
    bodies = bodies.select(key, "sha", "payload").groupBy("key", "sha").agg(F.first("payload").alias("payload"))
    is_head = F.col("response") & (F.col("nth") == 0)
    heads = items.where(is_head).withColumn("key", key).join(bodies, ["key", "sha"]).drop("key", "sha")
    others = items.where(~is_head).drop("sha").withColumn("payload", F.lit(None).cast("binary"))
    ordered = heads.unionByName(others).repartition("shard").sortWithinPartitions("shard", "at")
    ordered.mapInArrow(_writer(folder, roll_bytes, date), MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def records(data: bytes, step: int = 16_384) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of the gzip members of an archive, which are fed to the inflater in steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + step]
            parts.append(opened.decompress(piece))
            at += len(piece) - len(opened.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"], strict=True):
            rows: dict[str, list] = {name: [] for name in names}
            name = file.as_py().rpartition("/")[2]
            for fields, block in records(content.as_py()):
                if fields["warc-type"] == "warcinfo":
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length: "))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                response = fields["warc-type"] == "response"
                if response and (len(body) != size or base32_sha1(body) != digest):
                    raise ValueError(f"damaged payload {fields['warc-record-id']}")
                page, refers = fields["warc-page-id"], fields.get("warc-refers-to-page-id")
                values = (None if page == "None" else page, fields["warc-target-uri"], size, digest, fields["warc-type"], None if refers == "None" else refers, body if response else None, name)
                for key, value in zip(names, values, strict=True):
                    rows[key].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of a folder of archives, after a check of its files against the manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(_qualified(spark, folder))
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    odd = there.join(listed, "file", "full").where("NOT coalesce(length = bytes, false)")
    if not odd.isEmpty():
        raise ValueError(f"files and manifest of {folder} differ: {odd.first()}")
    return files.select("path", "content").mapInArrow(_parsed, RECORD)


def archived(pages: DataFrame, **settings: object) -> DataFrame:
    """Write the pages to a new folder of the shared one and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder, **settings)
    return read(spark, folder)


__all__ = ["archived", "read", "record", "records", "write"]
