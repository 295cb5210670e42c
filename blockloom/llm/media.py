"""Media columns: payloads in archives, read through a Spark data source of byte ranges.

Payloads are stored losslessly as 8-bit greyscale PNG images, 64 samples a row,
in zip archives of the shared folder: one archive for each task, written under
a temporary name and then moved, so that a task that runs again leaves one
whole archive.

The source ``media_archive`` plans byte ranges from the archives' sizes alone.
Each range's task reads the archive's directory, takes the members that start
in its range and streams them in Arrow batches.  A member that can't be read is
tried again at its own offset, ``retries`` times, without the others; then its
row carries the error instead of data.

Defined cases: a null text counts as empty; every payload has at least 64
bytes; a null doc_id is stored and comes back null; repeated rows are members
of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from blockloom.llm.common import own_dir, ship, table
from blockloom.llm.words import slices

#: Samples of an image row; payloads are padded to a multiple of it.
WIDTH = 64
#: Bytes of an archive that one task reads, and of a batch.
RANGE_BYTES, BATCH_BYTES = 8 << 20, 2 << 20
#: Deflate level of the images.
LEVEL = 1
RETRIES = 3

#: Fixed value: the signature of PNG files.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "archive string, offset long, name string, media binary, error string"


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8 with bytes 0 up to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8")
    return len(data), data + b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Each byte a sample, WIDTH samples a row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image (rows x WIDTH) that ``to_png`` made; checks every chunk."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, body = 8, b"", []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            header = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", header)
    if (width, depth, colour, interlace) != (WIDTH, 8, 0, 0):
        raise ValueError("not an 8-bit greyscale image of the set width")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """8x8 difference hash of an image (8 bands of rows, 9 of 7 columns), mean and deviation: hex digits and decimals."""
    cut = np.linspace(0, len(samples), 9).astype(int)
    sums = np.add.reduceat(samples[:, :63], cut[:-1], axis=0, dtype=np.int64).reshape(8, 9, 7).sum(2)
    bits = np.packbits((sums[:, 1:] > sums[:, :-1]).ravel()).tobytes().hex()
    return f"{bits}:{samples.mean():.4f}:{samples.std():.4f}"


def opened(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def archived(df: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """Write every row's payload into archives under ``folder``; returns when all are in place."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        part = TaskContext.get().partitionId()
        final, n = f"{path}/part-{part:06d}.zip", 0
        mine = f"{path}/.part-{part:06d}-{uuid.uuid4().hex}"
        archive = None
        for batch in slices(batches, "text"):
            if archive is None:
                stream = fs.open_output_stream(mine)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size, payload = padded(text)
                info = zipfile.ZipInfo(f"{n:08d}.png")
                info.comment = json.dumps({"doc_id": doc, "n_bytes": size}).encode()
                archive.writestr(info, to_png(payload))
                n += 1
        if archive is not None:
            archive.close()
            stream.close()
            if fs.get_file_info(final).type == pafs.FileType.NotFound:
                fs.move(mine, final)
            else:  # an earlier run of this task has put the same archive there
                fs.delete_file(mine)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


class Range(InputPartition):
    """Members of one archive that start at or after ``start`` and before ``end``."""

    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class MediaArchives(DataSource):
    """Members of the zip archives in a folder; options path, retries, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.retries = int(options.get("retries", RETRIES))
        self.range_bytes = int(options.get("range_bytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Range]:
        fs, path = opened(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(".zip"))
        # Spark wants one partition at least.
        return [Range(p, at, at + self.range_bytes) for p, size in files for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def member(self, f, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """(bytes, error) of one member, read at its own offset."""
        error = None
        for attempt in range(self.retries + 1):
            try:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                name, extra = struct.unpack("<HH", head[26:30])
                f.seek(info.header_offset + 30 + name + extra)
                data = f.read(info.compress_size)
                if info.compress_type != zipfile.ZIP_STORED or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise ValueError("damaged member")
                return data, None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return None, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = opened(self.folder)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.archive) as f:
            with zipfile.ZipFile(f) as z:
                infos = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
            for info in infos:
                data, error = self.member(f, info)
                rows.append((partition.archive, info.header_offset, info.comment.decode("utf-8", "replace") or info.filename, data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MEMBERS.split(", ")])


def members(spark: SparkSession, folder: str, retries: int = RETRIES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``MEMBERS`` rows of the archives in ``folder``."""
    ship(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").option("retries", str(retries)).option("range_bytes", str(range_bytes)).load(folder)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def described(stored: DataFrame) -> DataFrame:
    """``RESULT`` columns of stored members; where a member has an error, what hangs on its data is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            out = []
            for name, media, error in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
                about = json.loads(name)
                row = [about["doc_id"], about["n_bytes"], None, None, None, None, None, None, error]
                if media is not None:
                    samples = from_png(media)
                    payload = samples.tobytes()
                    row[2:8] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)
                out.append(row)
            if out:
                kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return stored.select("name", "media", "error").mapInArrow(run, RESULT)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image in an archive, read back and described; ``error`` is null unless a member couldn't be read."""
    folder = f"{own_dir(spark)}/media-{uuid.uuid4().hex}"
    archived(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    return described(members(spark, folder))
