"""Token ids of a corpus as compact binary files, and back.

Documents are dealt in ranges of ascending id; each task encodes its whole texts, codes the ids in blocks with the
context-mixing range coder (``mixing_coder``) and writes files to a folder that driver and executors share. A manifest,
one row a file, names the files of the attempts that counted, so tasks may be tried again or twice. Reading goes file by
file; every block is checked twice, as coded and as decoded.

A file, all numbers little-endian: magic, vocabulary size u32, ids in a block u32; the blocks' payloads; the index; offset
of the index u64, documents u64, blocks u64, crc32 of the index u32, magic. The index: documents' ids i64, a byte
each for a null id, their numbers of ids u64; then for each block the number of ids u32, bytes u32, crc32 of the ids as u32
numbers, crc32 of the payload.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import mixing_coder
from ledgerlens.llm.common import require, shared_dir, stored
from ledgerlens.llm.pretokens import Encoder, character_classes

MAGIC = b"LLTOK\x01\r\n"
HEAD, TAIL, BLOCK = "<8sII", "<QQQI8s", "<IIII"
#: Ids in a block, blocks coded side by side, ids in a file (a document stays in one file).
BLOCK_IDS, LANES, FILE_IDS = 2048, 2048, 4_000_000
END = 2


def open_folder(folder: str):
    """(file system, path) of a folder; any store that Arrow reaches."""
    from pyarrow.fs import FileSystem

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(folder)


def lanes(n: int) -> Iterator[slice]:
    """Even groups of at most LANES of ``n`` blocks."""
    groups = -(-n // LANES)
    for g in range(groups):
        yield slice(n * g // groups, n * (g + 1) // groups)


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocabulary: mixing_coder.Vocabulary) -> bytes:
    """The bytes of a file of these documents: their ids in a row, ``sizes`` of each."""
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    coded: list[bytes] = []
    for part in lanes(len(blocks)):
        coded += mixing_coder.encode(blocks[part], vocabulary)
    index = [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), sizes.astype("<u8").tobytes()]
    index += [struct.pack(BLOCK, len(b), len(c), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(c)) for b, c in zip(blocks, coded)]
    told = b"".join(index)
    head = struct.pack(HEAD, MAGIC, vocabulary.size, BLOCK_IDS)
    tail = struct.pack(TAIL, len(head) + sum(map(len, coded)), len(doc_ids), len(blocks), zlib.crc32(told), MAGIC)
    return b"".join([head, *coded, told, tail])


def unpack(data: bytes, name: str = "data") -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(documents' ids, their numbers of ids, the ids in a row) of a file's bytes; an error if anything in them was changed."""
    head, tail, block = map(struct.calcsize, (HEAD, TAIL, BLOCK))
    if len(data) < head + tail:
        raise ValueError(f"{name}: too short for a token file")
    magic, vocabulary, _ = struct.unpack_from(HEAD, data)
    at, n_docs, n_blocks, crc, end = struct.unpack_from(TAIL, data, len(data) - tail)
    told = data[at : len(data) - tail]
    if magic != MAGIC or end != MAGIC or zlib.crc32(told) != crc or len(told) != 17 * n_docs + block * n_blocks:
        raise ValueError(f"{name}: no token file, or its index is damaged")
    null = told[8 * n_docs : 9 * n_docs]
    doc_ids = [None if z else d for d, z in zip(np.frombuffer(told, "<i8", n_docs).tolist(), null)]
    sizes = np.frombuffer(told, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    table = np.frombuffer(told, "<u4", 4 * n_blocks, 17 * n_docs).astype(np.int64).reshape(-1, 4)
    edge = head + np.r_[0, np.cumsum(table[:, 1])]
    payload = [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    for i, p in enumerate(payload):
        if zlib.crc32(p) != table[i, 3]:
            raise ValueError(f"{name}: block {i} is damaged")
    known = mixing_coder.Vocabulary(vocabulary)
    blocks = [b for part in lanes(n_blocks) for b in mixing_coder.decode(payload[part], table[part, 0], known)]
    for i, b in enumerate(blocks):
        if zlib.crc32(b.astype("<u4").tobytes()) != table[i, 2]:
            raise ValueError(f"{name}: block {i} decodes to other ids")
    return doc_ids, sizes, np.concatenate(blocks) if blocks else np.zeros(0, np.int32)


def write_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, folder: str | None = None, part_bytes: int = 128_000_000, least_bytes: int = 8_000_000) -> DataFrame:
    """Writes the ids of every whole text, each followed by ``end_id``, in files of ascending document id; returns the manifest ``part, seq, file, n_docs, n_ids, n_bytes``.

    Ids are those of the ``tokenizers`` library for the byte-level vocabulary at ``vocabulary`` (read on the driver),
    without special tokens added. A null text counts as empty, so holds ``end_id`` alone; null document ids come first;
    rows of equal id follow each other in order of their texts' hash; texts of any length stay whole, one in one
    file; an empty table gives no file; other columns are ignored whatever their names. A task takes some ``part_bytes`` of text,
    less where that leaves cores idle, but not under ``least_bytes``. ``folder`` is one that Arrow can write to and all
    executors share, by default a new one in ``spark.checkpoint.dir``; files that no manifest names are leftovers.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with open(vocabulary, encoding="utf-8") as f:
        told = f.read()
    kinds = character_classes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes), min(-(-size // least_bytes), 4 * spark.sparkContext.defaultParallelism))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(int(parts), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        encoder = Encoder(told, kinds, end_id)
        sizes_of = mixing_coder.Vocabulary(max(encoder.library.get_vocab_size(with_added_tokens=True), end_id + 1))
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data = pack(doc_ids, np.concatenate(sizes), np.concatenate(ids), sizes_of)
            name = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.tokens"
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            values = {"part": (part, pa.int32()), "seq": (seq, pa.int32()), "file": (name, pa.string()), "n_docs": (len(doc_ids), pa.int64()), "n_ids": (held, pa.int64()), "n_bytes": (len(data), pa.int64())}
            return pa.record_batch({k: pa.array([v], t) for k, (v, t) in values.items()})

        for batch in batches:
            of, done = batch.column(0).to_pylist(), 0
            for flat, n in encoder.encode(batch.column(1).to_pylist()):
                doc_ids += of[done : done + len(n)]
                done += len(n)
                ids.append(flat)
                sizes.append(n)
                held += len(flat)
                if held >= FILE_IDS:
                    yield flush()
                    doc_ids, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    manifest = dealt.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long, n_bytes long")
    return stored(manifest.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file")), "token-files")


def read_tokens(spark: SparkSession, manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the manifest's files: the ids before it, how many it has, and its ids as little-endian unsigned 32-bit numbers.

    The driver sees one row a file, for the sums before it. A damaged or missing file is an error that names it; a manifest
    without files gives no rows.
    """
    files = [(r["file"], r["n_ids"]) for r in manifest.select("part", "seq", "file", "n_ids").orderBy("part", "seq").collect()]
    schema = f"{id_col} long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *(n for _, n in files)])[:-1].tolist()
    todo = spark.createDataFrame([(f, b) for (f, _), b in zip(files, before)], "file string, before long").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, file = name.rpartition("/")
                fs, path = open_folder(folder)
                with fs.open_input_stream(f"{path}/{file}") as f:
                    data = f.read()
                doc_ids, sizes, ids = unpack(data, name)
                stop = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                first = 0
                while first < len(doc_ids):  # some million ids a batch, one document at least
                    last = max(first + 1, int(np.searchsorted(stop, (stop[first - 1] if first else 0) + 1_000_000, side="right")))
                    begin = (stop - sizes)[first:last]
                    texts = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), stop[first:last].tolist())]
                    yield pa.record_batch({id_col: pa.array(doc_ids[first:last], pa.int64()), "start": pa.array(begin + base, pa.int64()), "n_tokens": pa.array(sizes[first:last], pa.int64()), "ids": pa.array(texts, pa.binary())})
                    first = last

    return todo.mapInArrow(run, schema)
