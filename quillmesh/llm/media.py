"""Media columns: content-addressed payloads in tar shards.

Payloads are stored as 8-bit grey PNG images, WIDTH samples a row, named by the SHA-256 of
the stored bytes, in uncompressed tar shards in the shared folder. Rows carry digest,
shard, offset and length; a range read of HEADER bytes at the offset fills the metadata
columns, and a read of the whole range gives the payload back.

Scale: writing is one narrow pass; a task keeps one payload at a time, starts a new shard
every SHARD_BYTES, and stores equal payloads once per shard set. No text is shuffled. The
index (about 150 bytes a row) is written as a table before it is read, so a lost executor
makes its task write a new shard while the committed index stays valid; shards of failed
attempts are never referred to. Reading deals the index by shard and block of BLOCK bytes.

Defined cases: null is empty; empty texts become one row of spaces; equal texts get equal
values; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, shared_dir, text_of

WIDTH, HEADER = 192, 33
SHARD_BYTES, BLOCK = 64 << 20, 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + b" " * (-len(raw) % width or (0 if raw else width))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    marked = np.zeros((len(rows), width + 1), np.uint8)
    marked[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(marked.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> np.ndarray:
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:]


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    head[: len(name)] = name.encode()
    for at, value in ((100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    # sizes from 8 GiB on use the binary form
    head[124:136] = b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str):
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(folder)
        store.create_dir(root, recursive=True)
        out, shard, at = None, "", 0
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                key = hashlib.sha256(raw).digest()
                place = seen.get(key)
                if place is None:
                    data = encode_png(pad(raw))
                    if out is None or at + len(data) > SHARD_BYTES and at:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                            seen = {}
                        shard, at = f"{uuid.uuid4().hex}.tar", 0
                        out = store.open_output_stream(f"{root}/{shard}")
                    digest = hashlib.sha256(data).hexdigest()
                    out.write(_tar_header(f"{digest}.png", len(data)))
                    out.write(data)
                    out.write(bytes(-len(data) % 512))
                    place = seen[key] = (digest, shard, at + 512, len(data))
                    at += 512 + len(data) + -len(data) % 512
                found.append((doc_id.as_py(), len(raw), *place))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 6, kind.types, strict=True)], schema=kind)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return write


def store_payloads(docs: DataFrame) -> tuple[DataFrame, str]:
    """(index with doc_id, n_bytes, digest, shard, offset, length; folder of the shards)."""
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(text_of(docs), "utf-8").alias("raw"))
    index = rows.mapInArrow(_writer(folder), "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(index), folder


def _ranges(folder: str, whole: bool, types: list[pa.DataType], names: list[str]):
    schema = pa.schema(list(zip(names, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(folder)
        name, file, last, kept = None, None, None, ()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    name, last = row["shard"], None
                    file = store.open_input_file(f"{root}/{name}")
                if row["offset"] != last:
                    last = row["offset"]
                    width, height, depth = png_header(file.read_at(HEADER, last))
                    kept = (width, height, depth)
                    if whole:
                        data = file.read_at(row["length"], last)
                        media = hashlib.sha256(data).hexdigest()
                        if media != row["digest"]:
                            raise ValueError(f"{name} is damaged at {last}")
                        grey = decode_png(data)
                        payload = grey.tobytes()
                        used = np.bincount(grey.ravel(), minlength=256)
                        feature = f"png {width}x{height}x{depth} mean {grey.mean():.4f} levels {np.count_nonzero(used)} mode {used.argmax()}"
                        kept += (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), media, feature)
                rows.append((row["doc_id"], row["n_bytes"], row["digest"], row["shard"], row["offset"], row["length"], *kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], schema=schema)

    return read


BASE = ["doc_id", "n_bytes", "digest", "shard", "offset", "length", "width", "height", "depth"]
BASE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
BASE_SQL = "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width long, height long, depth long"
MORE = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
MORE_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
MORE_SQL = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _dealt(index: DataFrame) -> DataFrame:
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and depth, from range reads of the headers only."""
    return _dealt(index).mapInArrow(_ranges(folder, False, BASE_TYPES, BASE), BASE_SQL)


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """The index with metadata, digests of payload and medium, and a feature of the samples."""
    return _dealt(index).mapInArrow(_ranges(folder, True, BASE_TYPES + MORE_TYPES, BASE + MORE), BASE_SQL + MORE_SQL)


def media_report(docs: DataFrame) -> DataFrame:
    out = with_features(*store_payloads(docs))
    return out.select("doc_id", "n_bytes", *MORE, "digest", "offset", "length", "width", "height", "depth")
