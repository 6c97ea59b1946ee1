"""Token alignment across two tokenizers: each distinct text is tokenised and aligned once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, met, small, written
from .tokens import ByteBpe, byte_signs

#: A pair is one number: the first tokenizer's id times this, plus the second's (whose ids are smaller).
SECOND = 2**15
#: Texts of a batch are encoded together up to so many characters.
TOGETHER = 200_000

SCHEMA = "key string, times long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, counts array<int>"


class Aligner:
    """Tokens of space + text by a byte-level BPE file (A) and of text by a sentencepiece model (B), cut into groups where both end."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = ByteBpe(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {sign: b for b, sign in byte_signs().items()}
        names = {i: t for t, i in self.a.whole.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if len(self.b_bytes) > SECOND or len(self.a_bytes) * SECOND > 2**31:
            raise ValueError("pairs of these vocabularies don't fit 31 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # how each id is written: A's inside and at the end of its part of a group, then B's
        self.written = [f"{i}{end}" for many, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(many)]

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The ids of both tokenizers; special tokens' strings are plain text."""
        for part in _together(texts):
            yield from zip(map(self.a.ids, part), self.b.encode(part, num_threads=1))

    def aligned(self, text: str, a: np.ndarray, b: list[int]) -> tuple[int, int, int, str, np.ndarray]:
        """n_a, n_b, n_groups, the groups as text, the pairs; nothing if a tokenizer doesn't give back the text's bytes."""
        whole = f" {text}".encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return 0, 0, 0, "", np.zeros(0, np.int32)
        b = np.array(b)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(len(whole) + 1, np.int8)
        ends[a_end] = 1
        ends[b_end] += 1
        a_ends, b_ends = ends[a_end] == 2, ends[b_end] == 2
        a_last, b_last = np.flatnonzero(a_ends), np.flatnonzero(b_ends)
        # the written order: a group's A ids come after the B ids of the groups before it, its B ids after its A ids
        a_code, b_code = a.copy(), b + 2 * len(self.a_bytes)
        a_code[a_last] += len(self.a_bytes)
        b_code[b_last] += len(self.b_bytes)
        line = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        line[np.arange(len(a)) + np.concatenate(([0], b_last + 1))[a_group]] = a_code
        line[np.arange(len(b)) + a_last[b_group] + 1] = b_code
        groups = "".join(map(self.written.__getitem__, line.tolist()))[:-1]
        return len(a), len(b), len(a_last), groups, (a[a_last] * SECOND + b[b_last]).astype(np.int32)


def _together(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


def _measured(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        for batch in batches:
            texts, rows, pairs, counts = batch["text"].to_pylist(), [], [], []
            for text, (a, b) in zip(texts, known.encoded(texts)):
                n_a, n_b, n_groups, groups, links = known.aligned(text, a, b)
                kinds, many = np.unique(links, return_counts=True)
                rows.append((n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
                pairs.append(kinds)
                counts.append(many.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (pairs, counts)]
            n_a, n_b, n_groups, digest = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch["key"], batch["times"], *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest, pa.string()), *lists], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each distinct non-empty text of docs: no, key (sha256), times (its number of rows), measures, its distinct pairs and their counts; written.

    The rows are shuffled by the text itself, after equal texts of a task have become one row.
    """
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    batched(docs.sparkSession)
    rows = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text", "times").mapInArrow(_measured(a_path, b_path), SCHEMA)
    return written(rows.withColumn("no", F.monotonically_increasing_id()))


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold each pair, and whether that is the most of its second id; written."""
    each = texts.select("times", F.inline(F.arrays_zip("pairs", "counts")))
    pairs = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("times") * F.col("counts")).alias("count")))
    second = (F.col("pair") % SECOND).alias("second")
    most = pairs.groupBy(second).agg(F.max("count").alias("most"))
    return written(pairs.withColumn("second", second).join(F.broadcast(most), "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    Every distinct text is tokenised and aligned once. A link is a pair of tokens that end together, so there is one at the end
    of each group; a text's links count as often as the text occurs. The measures of the few texts that hold more than a thousandth of
    the rows are sent to all tasks, the others meet their rows by the text's digest. Null and empty texts, and those that a
    tokenizer doesn't give back byte by byte, have zeros and an empty groups_sha256. Repeated rows keep their number, further
    columns are ignored, an empty table gives no rows.
    """
    texts = aligned_texts(docs, a_path, b_path)
    pairs = pair_counts(texts)
    links = texts.select("no", F.inline(F.arrays_zip("pairs", "counts"))).join(small(pairs), F.col("pairs") == F.col("pair"))
    sums = links.groupBy("no").agg(F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"), F.sum(F.col("counts") * F.col("count")).alias("count_sum"))
    of_text = texts.select("no", "key", "times", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "no", "left").drop("no")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    found = met(keyed, written(of_text), "key", "times")
    return found.select("doc_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
