"""WARC records in ZIP packages, read by byte ranges.

A package is a ZIP file whose members are stored without compression: the archive
(``archive/data.warc.gz``, one gzip member per record) and its index
(``indexes/index.cdx``, one line per record with offset and length). As the members are
stored, a record's bytes lie at a known place of the package: the reader takes the end
record (and its ZIP64 form) from the tail, the central directory, the index, and then only
ranges of the records. Nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.llm.common import HOT_ROWS
from crosstie.operators.joins import spread_join
from crosstie.session import scratch_path, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Packages are closed at this size, so readers have many of bounded size.
PACKAGE_BYTES = 64 << 20
# Payloads from this size on are written once and revisited by equal ones.
LEAST_REVISIT = 1000
# Names of object stores in Hadoop's connectors and in pyarrow.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
# Fixed values of the ZIP format: signatures and the marks for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def warc_record(kind: str, url: str | None, record_id: str, payload: bytes, sha1: str, refers_to: str | None = None) -> bytes:
    """A WARC 1.1 record; a revisit has no block and names the record that has it."""
    block = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", url),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1}"),
            ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class PackageWriter:
    """One package: records are streamed, index and directories follow on ``close``."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members, self.index = out, 0, [], []
        self._begin(ARCHIVE)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        """Local header with a data descriptor; sizes are ZIP64, as they are unknown at this time."""
        self.members.append([name, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        raw = name.encode()
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, MARK32, MARK32, len(raw), len(extra)) + raw + extra)

    def _data(self, data: bytes) -> None:
        self.members[-1][2] = zlib.crc32(data, self.members[-1][2])
        self.members[-1][3] += len(data)
        self._write(data)

    def _finish(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))

    def add(self, key: str, record: bytes) -> None:
        packed = gzip_member(record)
        self.index.append(json.dumps({"key": key, "offset": self.members[0][3], "length": len(packed)}))
        self._data(packed)

    def close(self) -> None:
        self._finish()
        self._begin(INDEX)
        self._data("\n".join(self.index).encode())
        self._finish()
        first = self.at
        for name, at, crc, size in self.members:
            raw = name.encode()
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, MARK32, MARK32,
                                    len(raw), len(extra), 0, 0, 0, 0, MARK32) + raw + extra)
        size, end = self.at - first, self.at
        self._write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(self.members), len(self.members), size, first))
        self._write(struct.pack("<4sIQI", LOCATOR, 0, end, 1))
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, MARK16, MARK16, MARK32, MARK32, 0))
        self.out.close()


def _range(source, at: int, size: int) -> bytes:
    source.seek(at)
    data = source.read(size)
    if len(data) != size:
        raise ValueError("the package ends early")
    return data


def directory(source, size: int) -> dict[str, tuple[int, int]]:
    """Place and length of each stored member, from the central directory (plain or ZIP64)."""
    tail_at = max(0, size - 22 - MARK16)
    tail = _range(source, tail_at, size - tail_at)
    found = tail.rfind(END)
    while found >= 0 and (found + 22 > len(tail) or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory")
    count, length, first = struct.unpack_from("<HII", tail, found + 10)
    if MARK16 == count or MARK32 in (length, first):
        mark, _, at, _ = struct.unpack("<4sIQI", _range(source, tail_at + found - 20, 20))
        if mark != LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = _range(source, at, 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, first = struct.unpack_from("<QQQ", end, 32)
    data, at, members = _range(source, first, length), 0, {}
    for _ in range(count):
        mark, method, packed, plain, n_name, n_extra, n_note, where = struct.unpack_from("<4s6xH8xIIHHH8xI", data, at)
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name = data[at + 46:at + 46 + n_name].decode()
        extra, e = data[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == MARK32 else plain
                packed = next(wide) if packed == MARK32 else packed
                where = next(wide) if where == MARK32 else where
            e += 4 + n
        if method == 0:  # only stored members can be read by ranges
            n_name2, n_extra2 = struct.unpack_from("<HH", _range(source, where, 30), 26)
            members[name] = (where + 30 + n_name2 + n_extra2, packed)
        at += 46 + n_name + n_extra + n_note
    return members


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of Hadoop's default file system where it names none, as Spark itself reads it.

    Schemes that only Hadoop's connectors know are given the names pyarrow has for them.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    scheme, _, rest = system.makeQualified(hadoop).toUri().toString().partition(":")
    return f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def write_packages(records: DataFrame, path: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows (``key``, ``url``, ``payload``, ``sha1``, ``record_type``, ``refers_to``) and list the packages.

    A task writes packages of its own names, with its attempt in the name; only those of the
    attempts that succeeded are listed, so a task that is run again or twice does no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, writer = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.zip"
                    writer = PackageWriter(files.open_output_stream(f"{root}/{name}"))
                    done.append(name)
                payload = r["payload"] or b""
                writer.add(r["key"] or "", warc_record(r["record_type"], r["url"], f"urn:page:{r['key'] or ''}", payload, r["sha1"],
                                                       f"urn:page:{r['refers_to']}"))
                if writer.at >= package_bytes:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["package"])

    return stored(records.mapInArrow(run, "package string"), "packages")


def read_packages(packages: DataFrame, path: str) -> DataFrame:
    """One row per record of the listed packages: header values and the payload's length and digest.

    Packages are dealt over the tasks; a task keeps one record in memory.
    """
    names = ["key", "url", "record_type", "refers_to", "sha1", "declared_bytes", "block_bytes", "block_sha1"]
    schema = ("key string, url string, record_type string, refers_to string, sha1 string, declared_bytes bigint, "
              "block_bytes bigint, block_sha1 string")
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string()]

    def bare(mark: str | None) -> str | None:
        return mark.strip("<>").removeprefix("urn:page:") if mark else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for package in batch.column(0).to_pylist():
                where = f"{root}/{package}"
                with files.open_input_file(where) as source:
                    members = directory(source, source.size())
                    first, _ = members[ARCHIVE]
                    lines = _range(source, *members[INDEX]).decode().splitlines()
                    for i in range(0, len(lines), 500):
                        rows = []
                        for entry in map(json.loads, lines[i:i + 500]):
                            raw = zlib.decompress(_range(source, first + entry["offset"], entry["length"]), 31)
                            head, block = parse_record(raw)
                            rows.append((bare(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"],
                                         bare(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                         int(head["WARC-Payload-Length"]), len(block), hashlib.sha1(block).hexdigest()))
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.repartition(tasks).mapInArrow(run, schema)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST_REVISIT) -> DataFrame:
    """The records of all pages: of equal payloads of at least ``least`` bytes, the largest id is the response.

    Equal means equal SHA-1 and length. Digests are combined before their shuffle and a
    payload with many copies is dealt over several tasks of the join. Rows without id have
    an empty key and never are the response of others unless all copies lack one; repeated
    rows of the largest id are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = (pages.select(F.col(page_id).cast("string").alias("key"), F.col(page_id).alias("_id"), F.col(url).alias("url"),
                         payload.alias("payload"))
            .withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint")))
    firsts = (rows.where(F.col("size") >= least).groupBy("sha1", "size")
              .agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    judged = spread_join(rows, firsts, ["sha1", "size"], "left", HOT_ROWS, ["key", "url"])
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return judged.select("key", "url", "payload", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("_first").cast("string")).alias("refers_to"))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages into packages in the shared folder and describe the records as read back.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    Digest and length of a response are those of the block that was read, those of a revisit
    the ones it declares. A missing page is empty; an empty table gives an empty result;
    other columns are ignored.
    """
    path = qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))
    packages = write_packages(with_revisits(pages, page_id, url, html, least), path, package_bytes)
    records = read_packages(packages, path)
    kind = pages.schema[page_id].dataType
    own = F.col("record_type") == "response"
    return records.select(
        F.nullif(F.col("key"), F.lit("")).cast(kind).alias("page_id"),
        F.when(own, F.col("block_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("block_sha1")).otherwise(F.col("sha1")).alias("payload_digest"), "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
