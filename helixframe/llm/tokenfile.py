"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart.

Ids are replaced by their rank among all ids of the corpus (the most frequent is
0), so most take one byte. A file has blocks of whole documents; a block has a
header (documents, those of them without a doc_id, ids, bytes of data), the doc_ids, the lengths, then two-bit
byte counts, four to a control byte, then the data bytes. Decoding is a numpy
table lookup: each control byte gives the sizes of its four integers, whose sums
place their bytes.

The corpus is tokenised once into a table in the shared folder, counted, dealt by
ranges of doc_id, and written one file a task, in ascending order of doc_id from
file to file and within. A file is written under another name and then moved,
so a task that is run again replaces it whole.

Nulls: a null text is an empty one with the end id alone; null doc_ids come
first. Rows of the same doc_id stay apart, ordered by length and content. An empty
table gives no files and no rows. A text of any length is one document of one block.
Folders must be in a store that both Spark and ``pyarrow.fs`` reach.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, shared_dir
from .tokens import encoder

MAGIC = b"HXTOK2\0\0"
BLOCK_IDS = 1 << 17
PART = 1 << 22


#: Bytes of each of the four integers that a control byte stands for.
SIZES = ((np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    width = 1 + int(values.max(initial=0) > 0xFF) + 2 * int(values.max(initial=0) > 0xFFFF)
    v = np.zeros(-(-len(values) // 4) * 4, f"<u{width if width < 3 else 4}")
    v[: len(values)] = values
    more = np.zeros(len(v), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF)[: v.itemsize - 1]:
        more += v > limit
    four = more.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(v.itemsize, dtype=np.uint8) <= more[:, None]
    data = v.view(np.uint8).reshape(-1, v.itemsize)[used]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """``n`` integers from their control and data bytes."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes, dtype=np.int64)
    at -= sizes
    d = np.zeros(len(data) + 4, np.uint8)
    d[: len(data)] = np.frombuffer(data, np.uint8)
    out = d[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        own = np.flatnonzero(sizes > k)
        out[own] |= d[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out, names: list[int | None], docs: list[np.ndarray], rank: np.ndarray) -> int:
    """Write documents, those without a doc_id first; returns how many ids they have."""
    ids = np.concatenate(docs)
    control, data = encode(rank[ids])
    out.write(struct.pack("<QQQQ", len(docs), names.count(None), len(ids), len(data)))
    out.write(np.array([x or 0 for x in names], "<i8").tobytes())
    out.write(np.array([len(d) for d in docs], "<u8").tobytes())
    out.write(control)
    out.write(data)
    return len(ids)


def read_blocks(path: str):
    """``(doc_ids, which are null, lengths, ranks)`` of each block of a file."""
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_stream(where) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        while head := f.read(32):
            n, none, ids, size = struct.unpack("<QQQQ", head)
            names = np.frombuffer(f.read(8 * n), "<i8")
            lengths = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
            control = f.read(-(-ids // 4))
            yield names, np.arange(n) < none, lengths, decode(control, f.read(size), ids)


def parts(batches):
    """The batches in parts of about ``PART`` bytes of text (a longer text is one part), which are encoded at once; unused Arrow memory goes back at the end."""
    for b in batches:
        if not b.num_rows:
            continue
        part = np.cumsum(pc.binary_length(b.column(1)).to_numpy(), dtype=np.int64) // PART
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(at, at[1:]):
            yield b.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def tokenise(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids of each text and the end id, as little-endian integers of two bytes where the vocabulary fits, else four.

    One more row a task has ``counts`` alone: how often each id came.
    """
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches):
        enc = encoder(path, True)
        width = int(enc.kind[-1])
        tail = np.array([end], enc.kind).tobytes()
        total = np.zeros(1 << 16, np.int64)
        for b in parts(batches):
            ids = enc.packed(b.column(1), tail)
            where = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)
            counts = np.bincount(np.frombuffer(ids.buffers()[2], enc.kind, int(where[-1]) // width), minlength=len(total))
            counts[: len(total)] += total
            total = counts
            n = pa.array(np.diff(where) // width, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, ids, pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4")


def rank_table(ids: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by id; the driver gets one row for each id of the vocabulary in use."""

    def run(batches):
        for b in batches:
            for packed in b.column(0).to_pylist():
                total = np.frombuffer(packed, "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = ids.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write(docs: DataFrame, path: str, folder: str, end: int = 0) -> list[dict]:
    """Write ``docs`` as token files in ``folder``; returns one entry a file, in order: path, documents, ids.

    ``folder/ranks`` has the ids by rank as 32-bit integers.
    """
    spark = docs.sparkSession
    ids = materialise(tokenise(docs, path, end))
    by_rank = rank_table(ids)
    store, where = fs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)
    with store.open_output_stream(f"{where}/ranks") as f:
        f.write(by_rank.astype("<u4").tobytes())
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def run(batches):
        rank = sent.value
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.tok"
        store, where = fs.FileSystem.from_uri(folder)
        temp = f"{where}/.{name}.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with store.open_output_stream(temp) as out:
            out.write(MAGIC)
            names, own, held = [], [], 0
            for b in batches:
                for doc_id, n, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
                    names.append(doc_id)
                    own.append(_wide(packed, n))
                    held += n
                    if held >= BLOCK_IDS:
                        n_ids += write_block(out, names, own, rank)
                        n_docs += len(names)
                        names, own, held = [], [], 0
            if names:
                n_ids += write_block(out, names, own, rank)
                n_docs += len(names)
        if n_docs:
            store.move(temp, f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [f"{folder}/{name}"], "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})
        else:
            store.delete_file(temp)

    keys = ["doc_id", "n_tokens", "_tie"]
    dealt = ids.filter("counts is null").withColumn("_tie", F.crc32("ids")).repartitionByRange(*keys).sortWithinPartitions(*keys, "ids").select("doc_id", "n_tokens", "ids")
    files = dealt.mapInArrow(run, "part long, path string, docs long, ids long").collect()
    return [r.asDict() for r in sorted(files, key=lambda r: r["part"])]


def read(spark, folder: str, files: list[dict], ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and (``ids``) the ids of each document in the files, one task a file."""
    starts = np.cumsum([0, *(f["ids"] for f in files)]).tolist()
    todo = [(f["path"], s) for f, s in zip(files, starts)]

    def run(batches):
        store, where = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{where}/ranks") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for i in b.column(0).to_pylist():
                path, at = todo[i]
                for names, none, lengths, ranks in read_blocks(path):
                    own = by_rank[ranks]
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                    cols = {
                        "doc_id": pa.array(names, pa.int64(), mask=none),
                        "start": pa.array(begins + at, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(own[a:e].tobytes()) for a, e in zip(begins, ends)], pa.int64()),
                    }
                    if ids:
                        cols["ids"] = pa.array([own[a:e].astype(np.int32) for a, e in zip(begins, ends)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)
                    at += int(ends[-1])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return spark.range(len(todo), numPartitions=max(1, len(todo))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return their digests, read back from the files."""
    folder = shared_dir(docs.sparkSession) + "/tokens"
    files = write(docs, path, folder, end)
    return read(docs.sparkSession, folder, files, ids=False)
