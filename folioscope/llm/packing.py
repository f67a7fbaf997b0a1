"""Packing along a space-filling curve.

Each document's token counts are hashed to a vector, projected to a few dimensions and placed on a Hilbert curve;
documents are range-sorted by that place, and each range is cut into sequences in one stream, so that neighbours share
sequences. Documents are tokenised once; their ids travel as 16- or 32-bit binaries.

Nulls: a null text is empty (its only id is the end id), a null doc_id stays null. Repeated rows are packed once each. A very long text is
tokenised as a whole, and its row goes from sequence to sequence piece by piece.
Ties on the curve are dealt by a hash of doc_id, so that a large group of copies is split over ranges. Only the id and
text columns are read; others are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, mix64, table, written

SIZE, DIMS, BITS, HASHED = 2048, 3, 8, 256
#: Bytes of ids in a range of the curve, which a task sorts and cuts; with more than so many ranges, they grow instead (tasks sort on disk).
RANGE_BYTES, MOST_RANGES = 16_000_000, 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of `bits`-bit coordinates (the transpose form turned into one number)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the top bit down
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def places(vectors: np.ndarray) -> np.ndarray:
    """Curve index of hashed count vectors (rows): damped, normalised, projected, and quantised by a bell-shaped scale."""
    v = np.log1p(vectors)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    plane = np.random.default_rng(7).standard_normal((HASHED, DIMS))
    scaled = 1 / (1 + np.exp(-1.7 * (v @ plane)))
    return hilbert(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encode(vocabulary: str | None, end: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        slot = None
        for batch in batches:
            ids, texts = batch.column(id_col), batch.column(text_col)
            for lo in range(0, len(texts), 512):
                arrays = [np.array([*(bpe.ids(t) if t else ()), end], np.uint32) for t in texts[lo : lo + 512].to_pylist()]
                if slot is None:
                    slot = (mix64(np.arange(1 << 17)) % np.uint64(HASHED)).astype(np.int64)
                vectors = np.zeros((len(arrays), HASHED))
                for k, a in enumerate(arrays):
                    vectors[k] = np.bincount(slot[a & 0x1FFFF], minlength=HASHED)
                own = ids.slice(lo, 512)
                ties = mix64(np.array([x if x is not None else -1 for x in own.to_pylist()], np.int64).view(np.uint64)) >> np.uint64(33)
                wide = [a.size == 0 or int(a.max()) > 0xFFFF for a in arrays]
                yield pa.RecordBatch.from_arrays(
                    [own.cast(pa.int64()), pa.array((places(vectors) << 31) | ties.astype(np.int64)), pa.array(wide), pa.array([a.tobytes() if w else a.astype(np.uint16).tobytes() for a, w in zip(arrays, wide)], pa.binary())],
                    ["doc_id", "place", "wide", "ids"],
                )

    return run


def powers(n: int) -> list[int]:
    """n as powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held: list[tuple] = []  # pieces of the sequence that is being filled: doc_id, start, ids, doc_tokens
        room = size

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], [x.split()[0] for x in PIECES.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, wide, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + room]
                    held.append((doc, at, piece, len(ids)))
                    at += len(piece)
                    room -= len(piece)
                    if not room:
                        emit(held)
                        held, room = [], size
            if len(rows) >= 20_000:
                yield flush()
        # what is left of this range is cut at powers of two, which need no padding
        for n in powers(size - room):
            part = []
            while n:
                doc, start, ids, total = held.pop(0)
                part.append((doc, start, ids[:n], total))
                if len(ids) > n:
                    held.insert(0, (doc, start + n, ids[n:], total))
                n -= min(n, len(ids))
            emit(part)
        yield flush()

    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `size` ids; see PIECES for the columns.

    Every id of a document (those of its text, then `end`) lies in exactly one piece. All sequences of a range are full
    but its last ones, whose lengths are powers of two.
    """
    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(vocabulary, end, "doc_id", "text"), "doc_id long, place long, wide boolean, ids binary")
    coded = written(coded, "packing")
    size_of_all = coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    ranges = 1 + size_of_all // max(RANGE_BYTES, size_of_all // MOST_RANGES)
    return coded.repartitionByRange(ranges, "place").sortWithinPartitions("place", "doc_id").mapInArrow(_pack(size), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
