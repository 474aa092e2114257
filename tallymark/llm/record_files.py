"""Token ids in length-delimited binary record files, with a separate index of offsets.

A record is framed as: payload length (8 bytes), masked CRC-32C of these 8 bytes (4), payload,
masked CRC-32C of the payload (4), all little-endian. This is the public framing of TFRecord
files. A payload holds the document id (8), whether it is not null (1), the bytes of each token
id, 2 or 4 (1), and the ids. The index, a Parquet table, has a row per record: its file, the
file's number in the order of document ids, the record's offset and length in bytes, and the
ids before it in the file, so that records can be read in any order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.packing import _slices
from tallymark.llm.vocab import encoder

# The reversed Castagnoli polynomial, and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8

BLOCK = 256
HEAD = "<qBB"
#: Bytes read at once when records lie side by side.
SPAN = 4_000_000

INDEX = "file string, file_no long, position long, size long, n_tokens long, start_in_file long"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by byte at four distances, and by byte of a state moved on by one block."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(POLYNOMIAL), low >> 1).astype(np.uint32)
    near = [low]
    for _ in range(3):
        near.append(low[near[-1] & 255] ^ (near[-1] >> 8))
    far = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(BLOCK):
        far = low[far & 255] ^ (far >> 8)
    return np.stack(near), far


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each string of at least 4 bytes, all at once.

    The remainder is linear: each string is cut in blocks from its end, all blocks are divided
    side by side, and the remainders are moved on block by block and added.
    """
    near, far = _tables()
    blocks = np.array([-(-len(p) // BLOCK) for p in parts], np.int64)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * BLOCK if len(parts) else 0, np.uint8)
    for part, end in zip(parts, ends, strict=True):
        at = int(end) * BLOCK - len(part)
        flat[at : at + len(part)] = np.frombuffer(part, np.uint8)
        flat[at : at + 4] ^= 255  # the initial state of all ones
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for word in words:
        state ^= word
        state = near[3][state & 255] ^ near[2][state >> 8 & 255] ^ near[1][state >> 16 & 255] ^ near[0][state >> 24]
    begins = ends - blocks
    out = state[begins] if len(parts) else state
    for step in range(1, int(blocks.max(initial=0))):
        more = blocks > step
        s = out[more]
        s = far[0][s & 255] ^ far[1][s >> 8 & 255] ^ far[2][s >> 16 & 255] ^ far[3][s >> 24]
        out[more] = s ^ state[begins[more] + step]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(MASK)).astype("<u4")


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and both checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [
        b"".join((n, head.tobytes(), p, body.tobytes()))
        for n, head, p, body in zip(lengths, heads, payloads, bodies, strict=True)
    ]


def unframe(records: list[bytes], where: str = "") -> list[bytes]:
    """The payloads of framed records; a wrong length or checksum raises."""
    lengths, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    if any(len(r) < 26 or struct.unpack("<Q", n)[0] != len(r) - 16 for r, n in zip(records, lengths, strict=True)):
        raise ValueError(f"broken record length {where}")
    for parts, stored in ((lengths, [r[8:12] for r in records]), (payloads, [r[-4:] for r in records])):
        if masked(crc32c(parts)).tobytes() != b"".join(stored):
            raise ValueError(f"broken record checksum {where}")
    return payloads


def _payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    if int(ids.max()) >> 8 * width:
        raise ValueError(f"token id {ids.max()} does not fit {width} bytes")
    return struct.pack(HEAD, doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def write_records(
    docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, id_column: str = "doc_id", text: str = "text",
    vocabulary: int | None = None,
) -> DataFrame:
    """Write the ids of all documents in ascending order of their ids; returns the index, written to ``folder``/index.

    Documents are dealt out by ranges of their ids, one file each; nulls come first, and rows
    with the same id are ordered by text. A null text is empty and holds ``end_id`` alone; empty
    input writes an empty index. Other columns are ignored whatever their names. Ids take 2
    bytes if the vocabulary, by default the tokenizer's with ``end_id``, is at most 65,536, or
    else 4; an id that does not fit raises. A task run again writes a file with a new name
    and the index lists only files of tasks that ended, so a half-written file is never read.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).alias("text"))
    ordered = bare.repartitionByRange(id_column, F.xxhash64("text")).sortWithinPartitions(id_column, F.xxhash64("text"))
    if vocabulary is None:
        vocabulary = max(encoder(tokenizer).largest_id(), end_id) + 1
    width = 2 if vocabulary <= 1 << 16 else 4
    names = [part.split()[0] for part in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        files, path = _open(folder)
        file = f"part-{number:06d}-{uuid.uuid4().hex}.rec"
        encode = encoder(tokenizer).ids
        end = np.array([end_id], np.uint32)
        out, position, before = None, 0, 0
        try:
            for batch in batches:
                for some in _slices(batch):
                    out = out or files.open_output_stream(f"{path}/{file}")
                    ids = [np.concatenate([x, end]) for x in encode(some.column("text").to_pylist())]
                    keys = some.column(id_column).to_pylist()
                    records = frame([_payload(k, x, width) for k, x in zip(keys, ids, strict=True)])
                    out.write(b"".join(records))
                    rows = []
                    for record, x in zip(records, ids, strict=True):
                        rows.append((file, number, position, len(record), len(x), before))
                        position, before = position + len(record), before + len(x)
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=names)
        finally:
            if out:
                out.close()

    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def read_records(index: DataFrame, folder: str, id_column: str = "doc_id") -> DataFrame:
    """The documents of the index's records, in its order: id, start (ids before it), n_tokens, ids (unsigned 32-bit).

    Records that lie side by side are read together, others one by one, and each record's length
    and checksums are verified. Any order or part of the index will do; ``start`` counts the ids
    of all records of the files that the whole index lists.
    """
    spark = index.sparkSession
    totals = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    firsts = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_of_file"))

    def spans(rows: list[dict]) -> Iterator[list[dict]]:
        span: list[dict] = []
        size = 0
        for row in rows:
            last = span[-1] if span else None
            if last and (last["file"] != row["file"] or last["position"] + last["size"] != row["position"] or size > SPAN):
                yield span
                span, size = [], 0
            span.append(row)
            size += row["size"]
        if span:
            yield span

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        name, source = None, None
        for batch in batches:
            for span in spans(batch.to_pylist()):
                if span[0]["file"] != name:
                    if source:
                        source.close()
                    name = span[0]["file"]
                    source = files.open_input_file(f"{path}/{name}")
                at = span[0]["position"]
                source.seek(at)
                data = source.read(span[-1]["position"] + span[-1]["size"] - at)
                records = [data[r["position"] - at : r["position"] - at + r["size"]] for r in span]
                keys, ids = [], []
                for payload in unframe(records, f"in {name} at {at}"):
                    key, given, width = struct.unpack_from(HEAD, payload)
                    keys.append(key if given else None)
                    ids.append(np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4"))
                yield pa.record_batch(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array([r["start_in_file"] for r in span], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array([r["file_no"] for r in span], pa.int64()),
                    ],
                    names=[id_column, "start_in_file", "n_tokens", "ids", "file_no"],
                )
        if source:
            source.close()

    found = index.mapInArrow(read, f"{id_column} long, start_in_file long, n_tokens long, ids binary, file_no long")
    start = (F.col("start_in_file") + F.col("start_of_file")).alias("start")
    return found.join(F.broadcast(firsts), "file_no").select(id_column, start, "n_tokens", "ids")
