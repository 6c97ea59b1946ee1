"""Packing documents into sequences: shortest-pack-first over the length histogram, joined back by rank."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written
from .tokens import word_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Pattern:
    """`count` sequences that all hold `copies` pieces of each `length`, longest first."""

    count: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(length * copies for length, copies in self.runs)


def patterns(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Shortest-pack-first: lengths are placed longest first, each into the emptiest pattern that has room.

    The work depends on the number of distinct lengths (at most size), not on the number of documents: a step places one
    length into all sequences of a pattern at once, or splits the pattern if fewer pieces are left.
    """
    heap: list[tuple[int, int]] = []  # (-room, number of the pattern)
    made: list[Pattern] = []

    def push(count: int, runs: list[tuple[int, int]]) -> None:
        made.append(Pattern(count, runs))
        heapq.heappush(heap, (made[-1].used() - size, len(made) - 1))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not between 1 and {size}")
        while left:
            if heap and -heap[0][0] >= length:
                pattern = made[heapq.heappop(heap)[1]]
                taken = min(left, pattern.count)
                runs = pattern.runs
                grown = [*runs[:-1], (length, runs[-1][1] + 1)] if runs[-1][0] == length else [*runs, (length, 1)]
                if taken < pattern.count:
                    push(pattern.count - taken, runs)
                pattern.count = 0
                push(taken, grown)
                left -= taken
            else:
                push(left, [(length, 1)])
                left = 0
    return [p for p in made if p.count]


def slots(found: list[Pattern]) -> pd.DataFrame:
    """One row for each pattern and length in it: pieces of rank first, first + 1, ... of that length go there."""
    rows, base = [], 0
    for p in found:
        offset = 0
        for length, copies in p.runs:
            rows.append((length, p.count * copies, base, copies, offset))
            offset += length * copies
        base += p.count
    out = pd.DataFrame(rows, columns=["length", "n", "sequence", "copies", "offset"]).astype("int64").sort_values(["length", "sequence"], kind="stable")
    out["first"] = out.groupby("length")["n"].cumsum() - out["n"]
    return out


def pieces(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096) -> DataFrame:
    """PIECES of all docs (doc_id, text): each document's ids and the end id, cut at multiples of size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, mark = word_bpe(tokenizer), int(end).to_bytes(4, "little")
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part, out = pdf.iloc[s : s + 256], []
                for at, ids in enumerate(bpe.ids(list(part["text"]))):
                    ids += mark
                    total = len(ids) // 4
                    out += [(at, i, min(size, total - i), zlib.crc32(ids[4 * i : 4 * (i + size)]), total) for i in range(0, total, size)]
                frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                frame["doc_id"] = part["doc_id"].to_numpy()[frame["doc_id"]]
                yield frame

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096, bucket: int = 2048) -> DataFrame:
    """One row per piece: PIECES with sequence_id and offset (gapless from 0 in each sequence of at most size tokens).

    Null text counts as empty (the end id alone). Null doc_ids and repeated rows are packed like others; other columns
    aren't read. An empty table gives no rows.

    The histogram (at most `size` rows) goes to the driver; the patterns, whose number depends on it alone, come back as
    sorted slots. Pieces are ranked within their length in two levels: by hash bucket of about `bucket` rows, and
    within the bucket, so that a length that a third of all pieces share is no single task.
    """
    found = written(pieces(docs, tokenizer, end, size))
    histogram = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(patterns(histogram, size))
    spark = found.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // bucket)) for k, n in histogram.items()], "length long, buckets long")
    dealt = found.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "buckets")).drop("buckets")
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    lengths, first, sequence, copies, offset = (table[c].to_numpy(np.int64) for c in ("length", "first", "sequence", "copies", "offset"))
    low, high = np.searchsorted(lengths, np.arange(size + 2)), np.searchsorted(lengths, np.arange(size + 2), "right")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = lengths * (1 << 40) + first
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["base"] + pdf["rank"]).to_numpy()
            at = np.searchsorted(key, length * (1 << 40) + rank, "right") - 1
            assert ((low[length] <= at) & (at < high[length])).all()
            inner = rank - first[at]
            yield pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence[at] + inner // copies[at], offset=offset[at] + inner % copies[at] * length)

    return in_batches(ranked, place, f"{PIECES}, sequence_id long, offset long")
