"""What the operators of this package share: written intermediate tables, ranges of ids, tokenizers, hashes."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, plan_bytes, remove_written, shared_dir, written  # noqa: F401

#: White space that separates words: blank and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows of a batch that goes to Python, for the whole session, since plans run after the call: texts are large, and each worker holds a
    few batches at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def range_buckets(df: DataFrame, key: str, buckets: int, segments: int = 32) -> DataFrame:
    """Add `bucket`: ranges of the whole-number key, ascending, of about the same number of rows; null keys go first, to bucket -1.

    Segments end at approximate percentiles over all rows (at most `segments` numbers on the driver); each is divided evenly.
    """
    low, high, points = df.agg(F.min(key), F.max(key), F.percentile_approx(key, [i / segments for i in range(1, segments)], 10_000)).first()
    if low is None:
        return df.withColumn("bucket", F.lit(-1).cast("long"))
    ends = sorted({int(x) for x in points} | {int(high)})
    starts = [int(low), *(e + 1 for e in ends[:-1])]
    parts = -(-buckets // len(ends))
    k = F.col(key).cast("long")

    def place(lo: int, hi: int) -> Column:
        if lo < hi:
            mid = (lo + hi) // 2
            return F.when(k <= F.lit(ends[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))
        within = F.floor((k - F.lit(starts[lo])).cast("double") * F.lit(parts / (ends[lo] - starts[lo] + 1)))
        return F.lit(lo * parts) + F.least(within, F.lit(parts - 1))

    return df.withColumn("bucket", F.when(k.isNull(), F.lit(-1)).otherwise(place(0, len(ends) - 1)).cast("long"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each integer."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def packed(a: np.ndarray) -> bytes:
    """An array as compressed bytes, its numbers' first bytes together, then their second ones, and so on."""
    body = np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes, dtype: type) -> np.ndarray:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[str | None, object] = {}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (tokenizers' JSON), encoded by tiktoken: the same merges, several times as fast.

    As with tokenizers, the strings of special tokens inside a text give the special ids.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level pre-tokenizer's
        self.special = special
        self._find = re.compile("|".join(map(re.escape, special))) if special else None
        self._encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text whose special tokens' strings are text like other."""
        return self._encoding.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        if self._find and self._find.search(text):
            return self._encoding.encode(text, allowed_special=set(self.special), disallowed_special=())
        return self._encoding.encode_ordinary(text)


def encoder(path: str | None = None) -> ByteBpe:
    """The encoder of a vocabulary file, kept by each Python worker. None: the public byte-level vocabulary of 50,257 ids."""
    if path not in _ENCODERS:
        if path is None:
            import public_tokenizers

            _ENCODERS[path] = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
