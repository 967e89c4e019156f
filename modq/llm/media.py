"""Content-addressed media payloads in tar shards."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq.llm.linking import matching
from modq.session import fresh_path, prepare, written

BLOCK = 64
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the IHDR chunk: all that metadata needs.
HEADER_BYTES = len(SIGNATURE) + 12 + 13


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG, BLOCK samples wide, whose samples are the payload (a multiple of BLOCK)."""
    height = len(payload) // BLOCK
    lines = np.zeros((height, BLOCK + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """width, height, bits from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png wrote."""
    width, height, _ = png_header(media)
    at, data = 8, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or BLOCK * (not raw))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads of docs' texts as members of tar shards under folder, and return the index:
    digest (SHA-256 of the payload), shard, offset, length (of the member's bytes), one row per digest.

    Each task appends to shards of its own (any file system that pyarrow opens, shared by all
    executors), with a content once a shard; where shards hold the same content, the index keeps one place for
    all. Names are new for each attempt: what a lost task wrote is named by no row.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, name, at, known = None, "", 0, set()
        rows: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out is not None:
                out.write(bytes(2 * tarfile.BLOCKSIZE))
                out.close()
                out = None
                known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "shard", "offset", "length"])
                rows.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                payload = payload_of(text or "")
                digest = hashlib.sha256(payload).hexdigest()
                if digest in known:
                    continue
                if out is None:
                    name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                    out = system.open_output_stream(f"{root}/{name}")
                known.add(digest)
                media = to_png(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head)
                out.write(media)
                out.write(bytes(-len(media) % tarfile.BLOCKSIZE))
                rows.append((digest, name, at + len(head), len(media)))
                at += len(head) + len(media) + -len(media) % tarfile.BLOCKSIZE
                if at >= shard_bytes:
                    yield from close()
        yield from close()

    places = written(docs.select("text").mapInArrow(write, "digest string, shard string, offset long, length long"), "places")
    one = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return one.select("digest", "place.*")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height, bits: range reads of HEADER_BYTES at each member's offset, no payload."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for b in batches:
            found, open_name, file = [], None, None
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                if shard != open_name:
                    if file is not None:
                        file.close()
                    open_name, file = shard, system.open_input_file(f"{root}/{shard}")
                file.seek(offset)
                found.append(png_header(file.read(HEADER_BYTES)))
            if file is not None:
                file.close()
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*b.schema.names, "width", "height", "bits"])

    rows = index.select("digest", "shard", "offset", "length").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(scan, "digest string, shard string, offset long, length long, width long, height long, bits long")


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, share of padding, and a histogram of eight brightness levels."""
    x = np.frombuffer(payload, np.uint8)
    levels = ",".join(str(n) for n in np.bincount(x >> 5, minlength=8))
    return f"mean={x.mean():.4f};std={x.std():.4f};zero={np.count_nonzero(x == 0)};levels={levels}"


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per digest, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height.

    The digest is checked against what was read; a differing payload is an error.
    """
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for b in batches:
            out, open_name, file = [], None, None
            for digest, shard, offset, length, height in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "height")), strict=True):
                if shard != open_name:
                    if file is not None:
                        file.close()
                    open_name, file = shard, system.open_input_file(f"{root}/{shard}")
                file.seek(offset)
                media = file.read(length)
                payload = from_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest or len(payload) != height * BLOCK:
                    raise ValueError(f"{shard} at {offset} isn't {digest}")
                out.append((digest, len(payload), sha, zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            if file is not None:
                file.close()
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = index.select("digest", "shard", "offset", "length", "height")
    return rows.mapInArrow(scan, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length, width, height, bits and read_back()'s columns for every row of docs.

    A text's payload: its UTF-8 bytes, 0 appended up to a positive multiple of BLOCK. It is stored as
    the samples of an 8-bit greyscale PNG, one tar member per content (more where rows of one doc_id repeat it); equal texts share digest, place
    and all values. Metadata come from header-only range reads, the rest from the bytes read back.

    Null text: empty. Null doc_id: kept. Repeated rows: one result each. Empty table: no rows. Other
    columns are ignored. A text is held in memory whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or fresh_path(spark, "media")
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    padded = F.when(n == 0, BLOCK).otherwise(F.ceil(n / BLOCK) * BLOCK).cast("int")
    # the payload's digest without Python: its bytes are the text's and zeros
    digest = F.sha2(F.concat(F.encode(text, "utf-8"), F.encode(F.repeat(F.lit("\0"), padded - n), "utf-8")), 256)
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = written(docs.select("doc_id", at.alias("at"), n.cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    # light rows choose one of each content's rows; the others, few as a rule, keep theirs from being stored
    first = rows.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    spare = written(rows.select("digest", "at").join(first, "digest").where("at <> first").select("digest", "at").distinct(), "copies")
    once = matching(docs.select("text", at.alias("at"), digest.alias("digest")), spare, ["digest", "at"], "left_anti")
    index = store(once, folder)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    headed = written(read_headers(index.repartition(parts, "shard"), folder), "index")
    read = written(read_back(headed, folder), "read")
    return rows.select("doc_id", "n_bytes", "digest").join(headed, "digest").join(read, "digest")
