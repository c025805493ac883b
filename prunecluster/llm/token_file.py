"""Token ids in files of fixed-width packed bits, with block offsets for random access.

A file: blocks of packed ids, each of BLOCK_IDS ids (the last may be shorter), lowest bit first; the
index: per document its id (0 if null), a null flag, the number of its ids; per block its byte
offset; the tail: index offset, documents, ids, blocks, ids per block, bits per id, magic. The bits
are the fewest that hold the vocabulary, so any id is found from its number alone, and a block
unpacks to a numpy array in one go. Files are written through pyarrow's file systems and so go
wherever the shared folder lies. A task writes a name of its own; the manifest, a table, holds the
names of those that Spark counted, so repeated or lost attempts leave nothing in the result.
"""

from __future__ import annotations

import struct
import zlib
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prunecluster.llm.batches import doc_texts, id_and_text, map_rows, task_number, word_ids
from prunecluster.storage import RunTables

MAGIC = b"FWBITS01"
TAIL = struct.Struct("<QQQQII8s")
#: Ids of a block; a multiple of 8, so that blocks end at whole bytes for any width.
BLOCK_IDS = 1 << 16
MANIFEST = "part int, path string, n_docs long, n_ids long"


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flags[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = flags
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def opened(uri: str):
    """File system and path of a folder or file; a path without a scheme is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenWriter:
    """Appends documents to a stream; only one block and the index are held in memory."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.held, self.n_held, self.at, self.n_ids = [], 0, 0, 0
        self.offsets, self.docs, self.missing, self.sizes = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {ids.max()} needs more than {self.bits} bits")
        self.docs.append(doc_id or 0)
        self.missing.append(doc_id is None)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for start in range(0, count, self.block_ids):
            data = pack(ids[start : min(count, start + self.block_ids)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.n_held)
        for values, kind in ((self.docs, "<i8"), (self.missing, "u1"), (self.sizes, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(TAIL.pack(self.at, len(self.docs), self.n_ids, len(self.offsets), self.block_ids, self.bits, MAGIC))


class TokenFile:
    """Reads a file of ids: any range of them, or the documents in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < TAIL.size:
            raise ValueError("not a file of packed ids")
        index_at, n_docs, self.n_ids, n_blocks, self.block_ids, self.bits, magic = TAIL.unpack(
            source.read_at(TAIL.size, size - TAIL.size)
        )
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        index = source.read_at(size - TAIL.size - index_at, index_at)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs)
        self.missing = np.frombuffer(index, "u1", n_docs, 8 * n_docs)
        self.sizes = np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", n_blocks, 17 * n_docs)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _block(self, b: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - b * self.block_ids)
        return unpack(self.source.read_at((count * self.bits + 7) // 8, int(self.offsets[b])), self.bits, count)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids number ``start`` to ``start + count``, from the blocks that hold them."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        found = np.concatenate([self._block(b) for b in range(first, last + 1)])
        return found[start - first * self.block_ids :][:count]

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.starts[n]), int(self.sizes[n]))

    def checksums(self):
        """(doc_id, start in this file, ids, crc32) of each document; each block is unpacked once."""
        at, block, number = 0, np.zeros(0, "<u4"), -1
        for n, size in enumerate(self.sizes.tolist()):
            crc, left = 0, size
            while left:
                if at // self.block_ids != number:
                    number = at // self.block_ids
                    block = self._block(number)
                inside = at - number * self.block_ids
                part = block[inside : inside + left]
                crc, left, at = zlib.crc32(part.tobytes(), crc), left - len(part), at + len(part)
            yield None if self.missing[n] else int(self.doc_ids[n]), int(self.starts[n]), size, crc


def write_tokens(documents: DataFrame, folder: str, tokenizer_file: str, end_id: int, run: RunTables) -> DataFrame:
    """Writes the ids of all documents in ascending order of doc_id; returns the manifest of the files."""
    # The hash parts rows that share an id; sorting by the text makes their order certain.
    ordered = (
        id_and_text(documents).withColumn("part_key", F.xxhash64("text"))
        .repartitionByRange("doc_id", "part_key").sortWithinPartitions("doc_id", "part_key", "text")
    )

    def make(batches):
        words = word_ids(tokenizer_file)
        bits = id_bits(max(words.tokenizer.get_vocab_size(), end_id + 1))
        end = int(end_id).to_bytes(4, "little")
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{task_number():06d}-{uuid4().hex}.ids"
        writer = None
        for doc_id, ids in words.encode_all(doc_texts(batches)):
            if writer is None:
                sink = system.open_output_stream(f"{path}/{name}")
                writer = TokenWriter(sink, bits)
            writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            yield task_number(), f"{folder}/{name}", len(writer.docs), writer.n_ids

    return run.write(map_rows(ordered, make, MANIFEST, keeps="ids"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    One row per file says how many ids lie before it; that is the only global sum.
    """
    files = manifest.withColumn(
        "base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )

    def make(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                system, inside = opened(path)
                with system.open_input_file(inside) as source:
                    for doc_id, start, size, crc in TokenFile(source).checksums():
                        yield doc_id, base + start, size, crc

    count = max(1, manifest.count())
    return map_rows(
        files.select("path", "base").repartition(count), make,
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def token_output(documents: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Writes all documents as ids and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id only. A null doc_id comes before all others; rows that share
    a doc_id lie together, ordered by a hash of their texts. An empty table gives no files and no
    rows. Other columns are not read.
    """
    run = RunTables(documents.sparkSession)
    return read_tokens(write_tokens(documents, f"{run.root}/ids", tokenizer_file, end_id, run))
