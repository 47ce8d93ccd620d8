"""Media columns: payloads in archives, read through a Spark data source that plans byte ranges.

An archive is one file of concatenated members (8-bit greyscale PNG, 64 samples a row, written losslessly) and a
directory file beside it: 40 bytes for each member with its doc_id, offset, length, number of text bytes and checksum, by offset.
The reader cuts each archive into byte ranges; a partition finds its part of the directory by binary search, reads the members that
begin in its range in Arrow batches of bounded size, and opens the archive anew at a member's offset when reading it fails or its
checksum differs.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import finished, in_blocks, table_path, texts_of

SAMPLES = 64
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
ENTRY = "<qqqqq"
ENTRY_BYTES = 40
#: Fixed by the PNG format.
MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG of SAMPLES columns whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    raw = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; ValueError if it's damaged."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and an 8x8 average hash of the picture."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    cut = np.linspace(0, len(a), 9).astype(int)
    cells = np.array([a[min(i, len(a) - 1) : max(j, i + 1)].reshape(-1, 8, 8).mean(axis=(0, 2), dtype=np.float64) for i, j in zip(cut, cut[1:])])
    bits = np.packbits(cells.ravel() > cells.mean()).tobytes().hex()
    return f"{len(a)}x{SAMPLES}:{a.mean(dtype=np.float64):.3f}:{a.std(dtype=np.float64):.3f}:{bits}"


# ------------------------------------------------------------------ files in any store that pyarrow opens
def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file://" + uri.removeprefix("file:")))


def write_archives(docs: DataFrame, folder: str) -> str:
    """One archive for each partition of docs under folder; returns the path of the manifest (archive, members, bytes), written once.

    Each attempt of a task writes under a name of its own, and only the archives in the result are read. A null text is
    an empty payload of SAMPLES zero bytes.
    """

    def write(batches):
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        entries, at, out = [], 0, None
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            raw = buf.tobytes()
            if out is None:
                out = files.open_output_stream(f"{root}/{name}.arc")
            for i, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                media = encode(raw[a:b] + bytes(SAMPLES - (b - a) % SAMPLES if (b - a) % SAMPLES or a == b else 0))
                out.write(media)
                entries.append((i if i is not None else -(1 << 63), at, len(media), b - a, zlib.crc32(media)))
                at += len(media)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.dir") as d:
                d.write(b"".join(struct.pack(ENTRY, *e) for e in entries))
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder.rstrip('/')}/{name}"], "members": [len(entries)], "bytes": [at]})

    manifest = f"{folder.rstrip('/')}/manifest"
    docs.select("doc_id", "text").mapInArrow(write, "archive string, members long, bytes long").write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        options = {k.lower(): v for k, v in options.items()}  # Spark gives them in lower case
        self.folder = options["path"]
        self.manifest = options.get("manifest")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        """Byte ranges of the archives that the manifest names, or else of all in the folder. Only names and sizes are read."""
        files, root = _fs(self.folder)
        if self.manifest:
            import pyarrow.dataset as ds

            at, path = _fs(self.manifest)
            table = ds.dataset(path, filesystem=at, format="parquet", schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])).to_table()
            sizes = zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist())
        else:
            from pyarrow import fs

            found = files.get_file_info(fs.FileSelector(root))
            sizes = [(f"{self.folder.rstrip('/')}/{x.base_name[:-4]}", x.size) for x in found if x.base_name.endswith(".arc")]
        return [ByteRange(a, i, min(i + self.split, n)) for a, n in sorted(sizes) for i in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def _member(self, files, path, handle, at, size, check=None):
        """A member's bytes, and the handle to go on with: on an error, or a checksum that differs, the archive is opened anew at
        its offset."""
        for attempt in range(self.retries + 1):
            try:
                if handle is None:
                    handle = files.open_input_file(path)
                handle.seek(at)
                data = handle.read(size)
                if len(data) != size:
                    raise OSError("the archive ends within a member")
                if check is not None and zlib.crc32(data) != check:
                    raise OSError("the member's checksum differs")
                return data, handle, None
            except OSError as e:
                handle, error = None, str(e)
                if attempt < self.retries:
                    time.sleep(0.05 * 2**attempt)
        return None, None, error

    def _entries(self, files, path, begin, end):
        """The directory's entries of the members that begin in begin:end. Only they are read, and a few to find them."""
        for attempt in range(self.retries + 1):
            try:
                with files.open_input_file(path) as d:
                    n = d.size() // ENTRY_BYTES

                    def at(k):
                        d.seek(k * ENTRY_BYTES)
                        return struct.unpack(ENTRY, d.read(ENTRY_BYTES))[1]

                    lo, hi = (bisect.bisect_left(range(n), x, key=at) for x in (begin, end))
                    d.seek(lo * ENTRY_BYTES)
                    return np.frombuffer(d.read((hi - lo) * ENTRY_BYTES), np.int64).reshape(-1, 5).tolist()
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)

    def read(self, partition):
        if not partition.archive:
            return
        files, path = _fs(partition.archive)
        handle, rows, held = None, [], 0
        for doc, at, size, n, check in self._entries(files, path + ".dir", partition.begin, partition.end):
            data, handle, error = self._member(files, path + ".arc", handle, at, size, check)
            rows.append((None if doc == -(1 << 63) else doc, n, data, error))
            held += size
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): doc_id, n_bytes, media, error. Options: manifest, splitBytes, retries."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema):
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, manifest: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("path", folder)
    for k, v in {**({"manifest": manifest} if manifest else {}), **options}.items():
        reader = reader.option(k, str(v))
    return reader.load()


def media_features(media: DataFrame) -> DataFrame:
    """Decodes each member and computes its digests and feature. A member that couldn't be read or is damaged has nulls
    there and its error stays."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, n, data, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error"))):
                try:
                    payload = decode(data) if data is not None else None
                except (ValueError, struct.error, zlib.error, TypeError) as e:
                    payload, error = None, str(e)
                if payload is None:
                    rows.append((doc, n, None, None, None, None, None, None, error))
                else:
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLES:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, _KINDS)], names=_NAMES)

    return media.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(_NAMES, _KINDS)))


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


@finished
def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text; other columns are ignored) as media and reads the features back.

    One row for each row of docs; null and empty texts are SAMPLES zero bytes with n_bytes 0; equal texts give equal
    values; an empty table gives an empty result; a null doc_id stays null.
    """
    spark = docs.sparkSession
    folder = table_path(spark, "media")
    manifest = write_archives(docs, folder)
    return media_features(read_archives(spark, folder, manifest))
