"""Problem 3: exactly one copy of each message, by a Bloom filter per time bucket.

A message's identity is its id, or, where the id is unusable (0 or null), its
timestamp and text. Rows are reduced to identity, created_at and delivery_id:

1. While scanning, each Arrow batch is reduced to the hashes of its identities with
   their time bucket (a day of created_at) and whether it holds them more than once,
   so that an identity that holds a third of all rows shuffles a few rows a batch.
2. These are spread by hash and sorted by bucket. Each task reads its part as a
   stream and keeps a Bloom filter for all identities so far and one for each bucket.
   What the first hasn't seen is new, definitely, if its batch holds it once. A
   possible repeat is looked up in the filters of the buckets, which name those that
   may hold another copy.
3. Only possible repeats are verified, exactly, against the stored rows of the buckets
   named: dropped is each row for which an earlier row with the same identity is
   there. False positives of the filters, and different identities with one hash,
   find no such row and stay.

No row is dropped without having been named by a filter, and no step depends on how
rows are batched or on their order within a bucket. A filter has no false negatives,
so no repeat is missed. Both filters together take 4 to 8 bytes an identity of the
part, as they double when full; parts follow spark.sql.shuffle.partitions.

Defined results: of each message the row with the least created_at stays, then the
least delivery_id; null created_at counts as later than all others, null
delivery_id as greater. Fully equal rows with one delivery_id can't be told apart:
they are dropped or kept together. Null timestamp or text of unusable ids are
values of their own, equal only to themselves. Empty tables give empty results;
columns other than the five named are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.sources.tables import micros, shuffle_width

BUCKET_US = 86_400_000_000
LAST = (1 << 63) - 1
NARROW = "kh bigint, bucket bigint, again boolean"


class Bloom:
    """A scalable Bloom filter over 64-bit hashes: a new slice of twice the size whenever one is full."""

    def __init__(self, capacity: int = 4096, bits_each: int = 16, probes: int = 7):
        self.capacity, self.bits_each, self.probes = capacity, bits_each, probes
        self.slices: list[np.ndarray] = []
        self.left = 0

    def _at(self, hashes: np.ndarray, size: int) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        k = np.arange(self.probes, dtype=np.uint64)
        return (low[:, None] + k * high[:, None]) & np.uint64(size - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for bits in self.slices:
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            at = self._at(hashes[rest], len(bits) * 8)
            out[rest] = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if not self.left:
                self.slices.append(np.zeros(1 << (self.capacity * self.bits_each - 1).bit_length() - 3, np.uint8))
                self.left, self.capacity = self.capacity, self.capacity * 2
            now, hashes = hashes[: self.left], hashes[self.left :]
            bits = self.slices[-1]
            at = self._at(now, len(bits) * 8).ravel()
            np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            self.left -= len(now)


def identity(id_col: str = "id", ts_col: str = "timestamp", text_col: str = "raw_text") -> Column:
    """A string that is equal exactly for copies: the id, or the timestamp with the text's digest."""
    unusable = F.col(f"`{id_col}`").isNull() | (F.col(f"`{id_col}`") == 0)
    part = lambda c: F.coalesce(c, F.lit("null"))
    return F.when(unusable, F.concat(F.lit("t:"), part(micros(f"`{ts_col}`").cast("string")), F.lit(":"), part(F.sha2(F.col(f"`{text_col}`"), 256)))).otherwise(F.concat(F.lit("i:"), F.col(f"`{id_col}`").cast("string")))


def repeats(messages: DataFrame, id_col: str = "id", ts_col: str = "timestamp", text_col: str = "raw_text", created_col: str = "created_at", delivery_col: str = "delivery_id", bucket_us: int = BUCKET_US) -> DataFrame:
    """(delivery_id): the rows to be dropped."""
    spark = messages.sparkSession
    created = F.coalesce(micros(f"`{created_col}`"), F.lit(LAST))
    rows = messages.select(identity(id_col, ts_col, text_col).alias("identity"), created.alias("created"), F.coalesce(F.col(f"`{delivery_col}`").cast("bigint"), F.lit(LAST)).alias("delivery")).select(
        F.xxhash64("identity").alias("kh"), "identity", F.floor(F.col("created") / bucket_us).cast("bigint").alias("bucket"), "created", "delivery"
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kh, bucket = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((kh, bucket))
            kh, bucket = kh[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], (kh[1:] != kh[:-1]) | (bucket[1:] != bucket[:-1])])) if len(kh) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(kh)))
            yield pa.RecordBatch.from_arrays([pa.array(kh[starts]), pa.array(bucket[starts]), pa.array(n > 1)], ["kh", "bucket", "again"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, of = Bloom(), {}
        for batch in batches:
            kh = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bucket, again = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            hashes, named = [], []
            for a, b in zip(starts, [*starts[1:], len(bucket)]):  # bucket by bucket, so that a filter knows those before
                mine, day = kh[a:b], int(bucket[a])
                _, first, back = np.unique(mine, return_index=True, return_inverse=True)
                twice = again[a:b] | (first[back] != np.arange(b - a))
                seen = every.has(mine)
                look = np.flatnonzero(seen | twice)
                if len(look):
                    hashes.append(mine[look])
                    named.append(np.full(len(look), day))
                    doubt = mine[look]
                    for d, bloom in of.items():
                        hit = doubt[bloom.has(doubt)]
                        hashes.append(hit)
                        named.append(np.full(len(hit), d))
                new = mine[np.sort(first)]
                of.setdefault(day, Bloom(512)).add(new)
                every.add(new[~every.has(new)])
            out = (np.concatenate(hashes), np.concatenate(named)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), pa.array(out[1].astype(np.int64))], ["kh", "bucket"])

    reduced = rows.select("kh", "bucket").mapInArrow(reduce, NARROW)
    wanted = reduced.repartition(shuffle_width(spark), "kh").sortWithinPartitions("bucket").mapInArrow(screen, "kh bigint, bucket bigint").distinct()
    # Exact verification: only rows of the buckets named, and only of the identities in doubt.
    stored = rows.join(wanted, ["kh", "bucket"], "left_semi")
    least = stored.groupBy("kh", "identity").agg(F.min(F.struct("created", "delivery")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = stored.join(least, ["kh", "identity"]).where(F.struct("created", "delivery") > F.col("least"))
    return late.select(F.nullif(F.col("delivery"), F.lit(LAST)).alias(delivery_col))


def unique(messages: DataFrame, delivery_col: str = "delivery_id", **columns: str) -> DataFrame:
    """The messages without the rows to be dropped; rows without delivery_id stay."""
    return messages.join(repeats(messages, delivery_col=delivery_col, **columns), delivery_col, "left_anti")
