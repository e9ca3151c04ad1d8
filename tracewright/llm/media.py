"""Media columns: lossless images of payloads in archives, and a data source that reads them by byte ranges.

Writing stores each payload as an 8-bit grey PNG, 64 samples wide, in ZIP archives, one for each task. A manifest of finished archives is
written when the job commits, so files of lost or repeated tasks are never read. Reading plans partitions of byte
ranges over the archives; a task reads an archive's directory, takes the members whose offset lies in its range and streams them in bounded Arrow
batches. Each member is fetched by its own offset and retried on its own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .common import shared_folder, with_columns

WIDTH = 64
#: Bytes of an archive that a task reads; bytes of media in an Arrow batch; attempts for a member.
RANGE, BATCH, ATTEMPTS = 16 << 20, 8 << 20, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes | None) -> bytes:
    """The payload of a text: its bytes, then zeros up to a positive multiple of WIDTH."""
    t = text or b""
    return t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b"\0")


def png(payload: bytes) -> bytes:
    """A payload, a positive multiple of WIDTH bytes, as an 8-bit grey image without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 2)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that ``png`` made, row by row; ValueError for anything else or damaged data."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, size = len(SIGNATURE), [], None
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].reshape(-1)


def describe(x: np.ndarray) -> str:
    """Features of an image: mean, deviation, entropy in bits, mean step along a row, share of the commonest sample."""
    h = np.bincount(x, minlength=256)
    p = h[h > 0] / len(x)
    v = np.arange(256)
    mean = float((h * v).sum() / len(x))
    dev = float(np.sqrt((h * (v - mean) ** 2).sum() / len(x)))
    step = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1)).sum() / len(x)
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={float(step):.4f};top={float(p.max()):.4f}"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        name, files, n = f"part-{uuid.uuid4().hex}.zip", [], 0
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            for row in iterator:
                text = bytes(row[1]) if row[1] is not None else b""
                # zip entries carry a fixed date, so that equal input gives equal archives
                archive.writestr(zipfile.ZipInfo(f"{'' if row[0] is None else row[0]}/{len(text)}/{n}.png"), png(padded(text)))
                n += 1
        if n:
            files.append([name, fs.get_file_info(f"{root}/{name}").size])
        return Written(files)

    def commit(self, messages):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_archives.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages):
        """Unlisted archives are never read; nothing to undo."""


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self):
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/_archives.json") as f:
            files = json.loads(f.read())
        return [ByteRange(name, at, at + self.step) for name, size in files for at in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, part):
        def batch(rows):
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "media", "error"])

        if not part.file:
            return
        fs, root = _open(self.path)
        uri = f"{root}/{part.file}"
        with fs.open_input_file(uri) as f, zipfile.ZipFile(f) as archive:
            members = sorted((i for i in archive.infolist() if part.start <= i.header_offset < part.stop), key=lambda i: i.header_offset)
        rows, held = [], 0
        f = fs.open_input_file(uri)
        for m in members:
            doc, n, _ = m.filename.split("/")
            media, error = None, None
            for _ in range(ATTEMPTS):
                try:
                    media, error = member(f, m), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error = f"{part.file}@{m.header_offset}: {e}"
                    f = fs.open_input_file(uri)
            rows.append((int(doc) if doc else None, int(n), media, error))
            held += len(media or b"")
            if held >= BATCH:
                yield batch(rows)
                rows, held = [], 0
        f.close()
        if rows:
            yield batch(rows)


def member(f, info: zipfile.ZipInfo) -> bytes:
    """The stored bytes of one member, fetched by its offset and checked."""
    f.seek(info.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member here")
    names = sum(struct.unpack_from("<HH", head, 26))
    f.seek(info.header_offset + 30 + names)
    data = f.read(info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise ValueError("damaged member")
    return data


class ArchiveSource(DataSource):
    """``spark.read.format("tracewright_archive").load(folder)``: doc_id, n_bytes, media, error (null, or why every attempt at the member failed)."""

    @classmethod
    def name(cls):
        return "tracewright_archive"

    def schema(self):
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE))))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"])


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the texts of ``docs`` (null: empty) as images into archives below a folder that all executors reach; gives the folder."""
    spark = docs.sparkSession
    spark.dataSource.register(ArchiveSource)
    folder = folder or shared_folder(spark, "archives")
    payload = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("payload"))
    payload.write.format("tracewright_archive").mode("append").save(folder)
    return folder


def load(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tracewright_archive").load(folder)


def features(media: DataFrame, strict: bool = False) -> DataFrame:
    """Per member: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error. The payload is what
    the stored image decodes to. A member that could not be read or decoded has nulls and its error; with ``strict`` it fails the job."""

    def row(image: bytes | None, error: str | None):
        if image is None:
            return (None, None, None, None, None, None, error)
        try:
            x = samples(image)
        except (ValueError, struct.error, zlib.error) as e:
            return (None, None, None, len(image), hashlib.sha256(image).hexdigest(), None, str(e))
        payload = x.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), describe(x), None)

    names = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def run(batches):
        for b in batches:
            got = [row(m, e) for m, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            if strict and (bad := [g[-1] for g in got if g[-1] is not None]):
                raise ValueError(f"{len(bad)} members cannot be read, the first: {bad[0]}")
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            new = {n: pa.array(c, t) for (n, t), c in zip(names.items(), cols, strict=True)}
            yield with_columns(b.select(["doc_id", "n_bytes"]), new)

    types = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, types)
