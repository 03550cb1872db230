"""Token-ID output: blocks of concatenated ids with Elias-Fano coded document boundaries.

A block is one self-contained binary value:

    magic "EFT2" | id width in bytes (2 or 4) | 3 zero bytes | u64 how many documents have a null doc_id |
    i64 least doc_id | u64 length of the doc_id code | u64 length of the boundary code |
    doc_id code (each doc_id less the least; nulls, which come first, aren't coded) |
    boundary code (ends of documents, in ids) | ids, little-endian, all documents one after another

Offsets and doc_ids are never tables of 64-bit numbers: both codes answer by select. Blocks are rows of a
Parquet table, so that Spark's commit protocol, any file system it can write and the retry of lost tasks hold
for them. A row also names its part (the range of doc_id it belongs to), its number there and the ids before
it in its part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.llm.common import shared_dir, python_ready, text_of
from sluice.llm.elias_fano import EliasFano
from sluice.llm.token_ids import END_ID, encoder

MAGIC = b"EFT2"
_HEAD = struct.Struct("<4sB3xQqQQ")
#: Ids of a block, unless its last document has more; doc_ids of a block lie less than DOC_ID_SPAN apart; documents read at a time.
BLOCK_IDS, DOC_ID_SPAN, STEP = 1 << 20, 1 << 62, 4096
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_base", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
DOCUMENTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def pack_block(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """keys: doc_ids in ascending order, nulls first, less than 2^62 apart; ids: each document's as little-endian
    unsigned 32-bit integers."""
    nulls = sum(k is None for k in keys)
    least = keys[nulls] if nulls < len(keys) else 0
    named = EliasFano.of([k - least for k in keys[nulls:]]).to_bytes()
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes()
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return _HEAD.pack(MAGIC, width, nulls, least, len(named), len(ends)) + named + ends + body


class Block:
    """A block's documents by number: `block[i]` is an array of ids, found by two selects."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token block")
        _, width, self.nulls, self.least, named, ends = _HEAD.unpack_from(data)
        at = _HEAD.size + named
        self.named, self.ends = EliasFano.from_bytes(data[_HEAD.size : at]), EliasFano.from_bytes(data[at : at + ends])
        self.ids = np.frombuffer(data, f"<u{width}", offset=at + ends)

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents of these numbers begin and end in the block's ids."""
        return np.where(at > 0, self.ends.select_many(np.maximum(at - 1, 0)), 0), self.ends.select_many(at)

    def doc_ids(self, at: np.ndarray) -> list[int | None]:
        named = iter(((self.named.select_many(at[at >= self.nulls] - self.nulls)) + self.least).tolist())
        return [next(named) if i >= self.nulls else None for i in at.tolist()]

    def find(self, doc_id: int) -> int | None:
        """The number of the first document of that doc_id, by binary search over selects."""
        low, high = 0, self.named.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.named.select(mid) + self.least < doc_id else (low, mid)
        return self.nulls + low if low < self.named.n and self.named.select(low) + self.least == doc_id else None

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        (start,), (end,) = self.bounds(np.array([i]))
        return self.ids[start:end]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs (doc_id, text) and writes them in ascending doc_id order.

    A null text is empty (only the end id), rows of one doc_id stay apart and are ordered by text, a null
    doc_id comes first, other columns aren't read, an empty table writes no block. One range shuffle of
    the texts; a task holds one block at a time.
    """
    python_ready(docs.sparkSession)
    end = np.asarray([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        width = 2 if tok.vocabulary <= 1 << 16 else 4
        part, block, base, held, keys, size, least = TaskContext.get().partitionId(), 0, 0, [], [], 0, None

        def row() -> pa.RecordBatch:
            values = [part], [block], [base], [size], [pack_block(keys, held, width)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for key, ids in zip(batch["doc_id"].to_pylist(), tok.encode(batch["text"].to_pylist())):
                if key is not None and least is not None and key - least >= DOC_ID_SPAN:
                    yield row()
                    block, base, held, keys, size, least = block + 1, base + size, [], [], 0, None
                least = key if least is None else least
                held.append(ids + end)
                keys.append(key)
                size += len(ids) // 4 + 1
                if size >= block_ids:
                    yield row()
                    block, base, held, keys, size, least = block + 1, base + size, [], [], 0, None
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, from_arrow_schema(BLOCKS)).write.option("compression", "zstd").parquet(path)


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in blocks, by select.

    Parts are as many as the shuffle had partitions, so the table of their totals may be broadcast.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, data in zip(*(batch[k] for k in ("part", "part_base", "data"))):
                block = Block(data.as_py())
                for first in range(0, len(block), STEP):
                    at = np.arange(first, min(first + STEP, len(block)))
                    starts, ends = block.bounds(at)
                    crc = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    columns = [np.full(len(at), part.as_py(), np.int32), block.doc_ids(at), starts + base.as_py(), ends - starts, crc]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DOCUMENTS)], schema=DOCUMENTS)

    python_ready(blocks.sparkSession)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = blocks.select("part", "part_base", "data").mapInArrow(decode, from_arrow_schema(DOCUMENTS))
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes docs as blocks under path (a new folder of the shared one by default) and reads them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/token-blocks-{uuid.uuid4().hex}"
    write_blocks(docs, path, tokenizer)
    return read_documents(docs.sparkSession.read.parquet(path))
