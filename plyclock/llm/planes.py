"""Token ids in files of compressed bit or byte planes.

A file holds whole documents.  Its ids are cut into blocks of a fixed number; a block
is transposed, so that plane k holds bit (or byte) k of every id, and each plane is
compressed by itself with zstandard.  The head of the file is its chunk index: the
length of every compressed plane of every block, from which any block is found and
read alone.

    4 bytes   "BPL1"
    1 byte    1 for byte planes, 8 for bit planes (planes per byte)
    3 bytes   zero
    uint32    ids per block
    uint64    ids in the file
    uint32    lengths of the planes, 4 (or 32) per block, in order
    ...       the planes

All numbers are little-endian.  The last block is filled up with zeros.

The files of a table lie in a Parquet table, one row each, in the order of the
documents: the container gives writing that survives lost executors, on any store.
Beside a file's bytes stand its number, its documents' ids and their lengths.
"""

import struct

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plyclock.llm.common import shared_folder, text_slices
from plyclock.llm.tokens import kept_encoder, tokenizer_path

MAGIC = b"BPL1"
HEAD = "<4sB3xIQ"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 20
END_ID = 2


def pack_ids(ids, block=BLOCK_IDS, bits=False, level=3):
    """The file of an array of ids."""
    import numpy as np
    import zstandard

    if block % 8:
        raise ValueError("a block must hold a multiple of eight ids")
    compress = zstandard.ZstdCompressor(level=level).compress
    lengths, planes = [], []
    for at in range(0, len(ids), block):
        part = np.zeros(block, dtype="<u4")
        part[:len(ids[at:at + block])] = ids[at:at + block]
        columns = part.view(np.uint8).reshape(block, 4).T
        if bits:
            columns = np.packbits(
                np.unpackbits(columns, axis=0, bitorder="little").reshape(32, block),
                axis=1, bitorder="little")
        for plane in columns:
            planes.append(compress(np.ascontiguousarray(plane).tobytes()))
            lengths.append(len(planes[-1]))
    return b"".join([struct.pack(HEAD, MAGIC, 8 if bits else 1, block, len(ids)),
                     np.array(lengths, dtype="<u4").tobytes(), *planes])


def chunk_index(data):
    """(bits, ids per block, ids in all, place of each plane with the end)."""
    import numpy as np

    magic, per_byte, block, count = struct.unpack_from(HEAD, data)
    if magic != MAGIC or per_byte not in (1, 8):
        raise ValueError("not a file of planes")
    planes = -(-count // block) * 4 * per_byte
    lengths = np.frombuffer(data, "<u4", planes, struct.calcsize(HEAD))
    first = struct.calcsize(HEAD) + 4 * planes
    return per_byte == 8, block, count, first + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def read_block(data, number, index=None):
    """The ids of one block, by way of the chunk index alone."""
    import numpy as np
    import zstandard

    bits, block, count, at = index or chunk_index(data)
    expand, per = zstandard.ZstdDecompressor().decompress, 32 if bits else 4
    view = memoryview(data)
    planes = np.stack([
        np.frombuffer(expand(view[at[k]:at[k + 1]]), np.uint8)
        for k in range(number * per, (number + 1) * per)])
    if bits:
        planes = _bytes_of(planes, block)
    ids = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return ids[:count - number * block]


def _bytes_of(planes, block):
    """Byte planes from bit planes."""
    import numpy as np

    ones = np.unpackbits(planes, axis=1, bitorder="little").reshape(4, 8, block)
    return np.packbits(ones, axis=1, bitorder="little").reshape(4, block)


def unpack_ids(data):
    """All ids of a file."""
    import numpy as np

    index = chunk_index(data)
    blocks = -(-index[2] // index[1])
    parts = [read_block(data, i, index) for i in range(blocks)]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_token_files(docs, folder=None, path=None, end_id=END_ID, bits=False,
                      block=BLOCK_IDS, file_ids=FILE_IDS):
    """Encode texts and write them in ascending doc_id order; returns the folder.

    Null and empty texts hold only the end id.  Equal doc_ids are ordered by text.  A
    null doc_id comes first.  A file takes whole documents until it has ``file_ids``
    ids, so it is longer only by its last document.  An empty table gives no files.
    """
    path = path or tokenizer_path()
    folder = folder or shared_folder(docs.sparkSession)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        encoder, shard = kept_encoder(path), TaskContext.get().partitionId()
        held, keys, lengths, count, number = [], [], [], 0, 0

        def file():
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "number": pa.array([number], pa.int32()),
                "n_ids": pa.array([count], pa.int64()), "doc_ids": pa.array([keys], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "data": pa.array([pack_ids(np.concatenate(held), block, bits)], pa.binary())})

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, texts in text_slices(batch.column("text")):
                flat, sizes = encoder.encode(texts)
                ends = np.cumsum(sizes)
                flat, sizes = np.insert(flat, ends, end_id), sizes + 1
                edges = np.concatenate([[0], np.cumsum(sizes)])
                first = 0
                while first < len(sizes):
                    last = int(np.searchsorted(edges, edges[first] + file_ids - count))
                    last = min(max(last, first + 1), len(sizes))
                    held.append(flat[edges[first]:edges[last]])
                    keys += names[at + first:at + last]
                    lengths += sizes[first:last].tolist()
                    count += int(edges[last] - edges[first])
                    first = last
                    if count >= file_ids:
                        yield file()
                        held, keys, lengths, count, number = [], [], [], 0, number + 1
        if keys:
            yield file()

    (
        docs.select("doc_id", "text").repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "shard int, number int, n_ids long, doc_ids array<long>, "
                         "lengths array<long>, data binary")
        .write.option("compression", "none").parquet(folder)
    )
    return folder


def read_token_files(spark, folder):
    """The documents of the files: ``doc_id, start, n_tokens, ids`` (binary).

    ``start`` counts the ids of all documents before, over all files.
    """
    files = spark.read.parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard, so the running sum in one task is short.
    shards = totals.select(
        F.col("shard").alias("_shard"),
        (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_before"))
    inner = files.select(
        F.col("shard").alias("_shard"), F.col("number").alias("_number"),
        (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("number"))
         - F.col("n_ids")).alias("_within"))
    places = inner.join(shards, "_shard").select(
        "_shard", "_number", (F.col("_before") + F.col("_within")).alias("first"))
    placed = files.join(
        places, (files.shard == places._shard) & (files.number == places._number)
    ).select("first", "doc_ids", "lengths", "data")

    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                flat = unpack_ids(batch.column("data")[i].as_py())
                sizes = np.asarray(batch.column("lengths")[i].values, dtype=np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                if edges[-1] != len(flat):
                    raise ValueError("a file and its documents do not match")
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values,
                    pa.array(batch.column("first")[i].as_py() + edges[:-1]), pa.array(sizes),
                    pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)],
                             pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
