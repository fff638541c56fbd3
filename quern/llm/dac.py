"""Token-ID output as directly addressable codes.

Ids are split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap that
tells whether the id goes on at the next level, and a rank directory (ones before each 512 bits). Reading id i takes
one chunk and one rank per level, whatever its position: no block is decoded. A run of ids, such as a document, takes
one rank per level, too: at each level its chunks lie side by side from there on.

File image (little-endian): magic, counts, document ids, document starts, then the levels. Documents are range-sorted
by doc_id and written in segments, one image a row of an uncompressed Parquet table (part, seq, payload), so that any
store Spark can write holds them; `export` writes plain files, which may be mapped into memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import TOKENIZER, Encoder, batches, materialise

MAGIC = b"QDAC0001"
END_ID = 2
BLOCK = 512
#: A segment is closed once it holds so many ids; a longer document makes a segment of its own.
SEGMENT_IDS = 2_000_000
#: Offsets of segments are broadcast up to so many segments (24 bytes each), joined otherwise.
MAX_BROADCAST_SEGMENTS = 500_000


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The image of documents with these lengths; a document id of None is kept as the smallest 64-bit integer."""
    levels, rest = [], np.ascontiguousarray(ids, "<u4")
    while True:
        more = rest > 0xFF
        levels.append((rest.view(np.uint8)[::4].copy(), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<QQQ", len(ids), len(doc_ids), len(levels)), doc_ids.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out += [struct.pack("<QQ", len(chunks), len(rank)), chunks.tobytes(), bits.tobytes(), rank.tobytes()]
    return b"".join(out)


class Image:
    """Reads an image, of which it takes only what it is asked for: `self[i]` one id, `slice(x, y)` a run of them,
    `document(k)` those of a document, `find(doc_id)` a document's number.

    data: bytes, a mapped file, or anything whose slices are bytes.
    """

    def __init__(self, data):
        self.data = memoryview(data) if isinstance(data, bytes | bytearray) else data
        head = bytes(self.data[0:32])
        if head[:8] != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        self.n, self.n_docs, n_levels = struct.unpack_from("<QQQ", head, 8)
        at = 32 + 8 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels = []  # where each level's chunks, bitmap and rank directory are
        for _ in range(n_levels):
            n, r = struct.unpack("<QQ", self.data[at : at + 16])
            bits = at + 16 + n
            rank = bits + (r - 1) * (BLOCK // 8)
            self.levels.append((at + 16, bits, rank))
            at = rank + 4 * r

    def _read(self, kind: str, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.data[at : at + n * np.dtype(kind).itemsize], kind)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._read("<i8", 32, self.n_docs)

    def starts(self, k: int = 0, n: int | None = None) -> np.ndarray:
        """Where documents k to k + n begin; one more entry for the end of the last."""
        n = self.n_docs - k if n is None else n
        return self._read("<u8", 32 + 8 * self.n_docs + 8 * k, n + 1).astype(np.int64)

    def _rank(self, bits: int, rank: int, i: int) -> int:
        """Ones before bit i: the directory's entry, and those of the bytes since."""
        block = i // BLOCK
        before = self._read("u1", bits + block * BLOCK // 8, (i >> 3) + 1 - block * BLOCK // 8)
        return int(self._read("<u4", rank + 4 * block, 1)[0]) + int(np.bitwise_count(before[:-1]).sum()) + (int(before[-1]) & ((1 << (i & 7)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, x: int, y: int) -> np.ndarray:
        """Ids x to y - 1."""
        out, where = np.zeros(max(0, y - x), np.uint32), None
        for k, (chunks, bits, rank) in enumerate(self.levels):
            if y <= x:
                break
            part = self._read("u1", chunks + x, y - x)
            more = np.unpackbits(self._read("u1", bits + (x >> 3), ((y + 7) >> 3) - (x >> 3)), bitorder="little")[x & 7 : (x & 7) + y - x].view(bool)
            if where is None:
                out[:] = part
                where = np.flatnonzero(more)
            else:
                out[where] |= part.astype(np.uint32) << np.uint32(8 * k)
                where = where[more]
            if not len(where):
                break
            x = self._rank(bits, rank, x)
            y = x + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        x, y = self.starts(k, 1).tolist()
        return self.slice(x, y)

    def find(self, doc_id: int) -> int | None:
        """The number of the first document with this id, by bisection; None if there is none."""
        lo, hi = 0, self.n_docs
        while lo < hi:
            mid = (lo + hi) // 2
            if self._read("<i8", 32 + 8 * mid, 1)[0] < doc_id:
                lo = mid + 1
            else:
                hi = mid
        return lo if lo < self.n_docs and self._read("<i8", 32 + 8 * lo, 1)[0] == doc_id else None


def segments(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """part int, seq int, n_docs long, n_tokens long, payload binary; documents in ascending doc_id order, nulls first.

    A null text is an empty one; each document ends with end_id. Repeated rows are documents of their own, in any order
    among themselves; as rows of one id may be many, ranges part them, too.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), Encoder.get(tokenizer), 0
        docs_held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def image() -> pa.RecordBatch:
            lengths = np.concatenate(sizes)
            payload = pack(np.concatenate(held), np.concatenate(docs_held), lengths)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(lengths), pa.int64()), (int(lengths.sum()), pa.int64()), (payload, pa.binary()))], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for big in it:
            for b in batches(big, 4096, 4 << 20):
                doc_ids = b.column("doc_id").fill_null(-(2**63)).to_numpy()
                ids, at = encoder.flat(b.column("text"), end_id)
                x = 0
                while x < len(doc_ids):
                    # up to the document that fills the segment
                    y = min(len(doc_ids), int(np.searchsorted(at[1:], at[x] + segment_ids - n, "left")) + 1)
                    docs_held.append(doc_ids[x:y])
                    sizes.append(np.diff(at[x : y + 1]))
                    held.append(ids[at[x] : at[y]])
                    n += int(at[y] - at[x])
                    x = y
                    if n >= segment_ids:
                        yield image()
                        docs_held, sizes, held, n, seq = [], [], [], 0, seq + 1
        if held:
            yield image()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    return rows.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, payload binary")


def write(docs: DataFrame, **options) -> DataFrame:
    """Writes the segments to the shared folder and returns the written table."""
    return materialise(segments(docs, **options), "dac", compression="none")


def with_starts(table: DataFrame) -> DataFrame:
    """Adds first long, the ids before each segment: sums within a part, and of the parts before."""
    small = table.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    here = Window.partitionBy("part").orderBy("seq")
    firsts = small.join(before, "part").select("part", "seq", (F.col("base") + F.sum("n_tokens").over(here) - F.col("n_tokens")).alias("first"))
    if small.count() <= MAX_BROADCAST_SEGMENTS:
        firsts = F.broadcast(firsts)
    return table.join(firsts, ["part", "seq"])


def read(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row per document, each read from the written images by its ranks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload"), strict=True):
                image = Image(memoryview(payload.as_buffer()))
                at, doc_ids = image.starts(), image.doc_ids
                crc = [zlib.crc32(image.slice(x, y)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ids = pa.array(doc_ids, mask=doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(table).select("first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(table: DataFrame, folder: str) -> list[str]:
    """Writes each image as a plain file part-seq.dac to a folder that every executor sees; returns the paths.

    The files' names are few (one a segment), their contents stay on the executors.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in it:
            paths = []
            for part, seq, payload in zip(*(batch.column(n).to_pylist() for n in ("part", "seq", "payload")), strict=True):
                paths.append(os.path.join(folder, f"{part:06d}-{seq:06d}.dac"))
                with open(paths[-1] + ".tmp", "wb") as f:
                    f.write(payload)
                os.replace(paths[-1] + ".tmp", paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return sorted(r[0] for r in table.select("part", "seq", "payload").mapInArrow(run, "path string").collect())


def query(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, one row per row of docs, from the written images.

    A null text is an empty one and has the end id alone. Rows without a doc_id come first. Repeated rows are documents
    of their own. Very long texts are encoded whole and make a segment of their own. An empty table gives no rows. Other
    columns, of whatever name, are ignored.
    """
    return read(write(docs))
