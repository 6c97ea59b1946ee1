"""Token counts under edits: pre-token segment trees, re-encoding only what an edit and its boundary context touch."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: The pre-token pattern of the byte-level tokenizer files (fixed by them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)


class Counter:
    """How many tokens a pre-token has; at most `most` answers are cached, then dropped."""

    def __init__(self, path: str, most: int = 500_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= self.most:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n


@cache
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """A text's pre-tokens in leaf blocks under a segment tree of (characters, tokens) sums; only the blocks' sums are kept."""

    LEAF = 16

    def __init__(self, text: str, leaves: list[tuple[int, int]], count: Counter):
        self.text, self.count, self.reencoded = text, count, 0
        self._build(leaves)

    @classmethod
    def of(cls, text: str, count: Counter) -> TokenTree:
        return cls(text, cls._blocks([(len(p), count(p)) for p in _SPLIT.findall(text)], cls.LEAF), count)

    @staticmethod
    def _blocks(items: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        parts = (items[i : i + size] for i in range(0, len(items), size))
        return [(sum(n for n, _ in part), sum(t for _, t in part)) for part in parts] or [(0, 0)]

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.size = len(leaves)
        self.width = 1 << (self.size - 1).bit_length()
        self.sums = [(0, 0)] * self.width + leaves + [(0, 0)] * (self.width - self.size)
        for i in range(self.width - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def leaves(self) -> list[tuple[int, int]]:
        return self.sums[self.width : self.width + self.size]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at this place (the last leaf, if none does), and where that leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.sums[i][0] and self.sums[i + 1][0]:
                start += self.sums[i][0]
                i += 1
        return min(i - self.width, self.size - 1), start

    def _set(self, leaf: int, value: tuple[int, int]) -> None:
        i = leaf + self.width
        self.sums[i] = value
        while i > 1:
            i //= 2
            self._pull(i)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop] (clipped to the text) by new.

        Where a pre-token ends is settled by its own characters and at most two behind it (an apostrophe looks for `re`);
        nothing before it matters. So leaves that end three characters before the edit stay, and scanning ends behind the edit
        at the first old leaf boundary that it meets again.
        """
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        moved = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        low, at = self._find(max(0, start - 3))
        leaf, old = low, at + self.sums[self.width + low][0]  # the last leaf to replace, and where it ended
        fresh, scan = [], at
        while True:
            while (old < stop or old + moved < scan) and leaf + 1 < self.size:
                leaf += 1
                old += self.sums[self.width + leaf][0]
            if scan >= len(text) or (old >= stop and old + moved == scan and scan >= start + len(new)):
                break
            piece = _SPLIT.match(text, scan).group()
            fresh.append((len(piece), self.count(piece)))
            scan += len(piece)
        self.reencoded += scan - at
        if scan >= len(text):
            leaf = self.size - 1
        self.text = text
        room = leaf - low + 1
        if len(fresh) <= 4 * self.LEAF * room:
            parts = self._blocks(fresh, max(1, -(-len(fresh) // room)))
            for i in range(room):
                self._set(low + i, parts[i] if i < len(parts) else (0, 0))
        else:
            leaves = self.leaves
            self._build(leaves[:low] + self._blocks(fresh, self.LEAF) + leaves[leaf + 1 :])


TREE = "struct<chars:array<int>,tokens:array<int>>"
COUNTS = ("tokens_before", "tokens_after", "edited_chars", "reencoded_chars")


def with_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with the column token_tree: characters and tokens of each leaf of the text's tree, in order (null text: no characters).

    To be kept with the texts, for instance by written(): edited_counts() then encodes nothing but what edits touch.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for texts in batches:
            leaves = [TokenTree.of(t or "", count).leaves for t in texts]
            yield pd.DataFrame({"chars": [[n for n, _ in x] for x in leaves], "tokens": [[t for _, t in x] for x in leaves]})

    batched(docs.sparkSession)
    return docs.drop("token_tree").withColumn("token_tree", F.pandas_udf(run, TREE, F.PandasUDFType.SCALAR_ITER)("text"))


def edited(docs: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """docs (text, token_tree, edits) without edits, with text and token_tree after them (keep; else without them) and COUNTS.

    token_tree comes from with_trees(), or from here. edits is array<struct<start long, stop long, new string>>, applied in
    order; each one's places refer to the text after those before it (code points, clipped to the text). Null text is empty; null
    edits, or null in one: left out. Counts are those of the byte-level tokenizer on the whole text; reencoded_chars is what the
    edits made it read again. Columns named like COUNTS are replaced; the others and repeated rows stay. An empty table gives no rows.
    """
    numbers = ", ".join(f"{c}:bigint" for c in COUNTS)

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for texts, trees, edits in batches:
            out = []
            for text, chars, tokens, changes in zip(texts, trees["chars"], trees["tokens"], edits):
                tree = TokenTree(text or "", list(zip(chars.tolist(), tokens.tolist())), count)
                before = tree.tokens
                for e in changes if changes is not None else ():
                    if e is not None and all(e[x] is not None for x in ("start", "stop", "new")):
                        tree.edit(int(e["start"]), int(e["stop"]), e["new"])
                made = (before, tree.tokens, len(tree.text), tree.reencoded)
                out.append((*made, tree.text, [n for n, _ in tree.leaves], [t for _, t in tree.leaves]) if keep else made)
            yield pd.DataFrame(out, columns=[*COUNTS, *(("text", "chars", "tokens") if keep else ())])

    batched(docs.sparkSession)
    schema = f"struct<{numbers}{', text:string, chars:array<int>, tokens:array<int>' if keep else ''}>"
    done = docs.drop(*COUNTS).withColumn("edits", F.pandas_udf(run, schema, F.PandasUDFType.SCALAR_ITER)("text", "token_tree", "edits"))
    others = [f"`{c}`" for c in docs.columns if c not in ("text", "token_tree", "edits", *COUNTS)]
    after = [F.col("edits.text").alias("text"), F.struct("edits.chars", "edits.tokens").alias("token_tree")] if keep else []
    return done.select(*others, *after, *(f"edits.{c}" for c in COUNTS))


def edited_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs without text, token_tree and edits, with COUNTS: see edited()."""
    return edited(docs, vocabulary, keep=False)


def derived_edits(docs: DataFrame, edits: int = 4) -> DataFrame:
    """docs (doc_id, text) with edits drawn from a hash of doc_id and the edit's number, as a stand-in for an edit log.

    Each replaces up to 40 characters anywhere in the text by up to 60 characters copied from another place of it.
    """
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    draw = lambda k, name, most: F.pmod(F.xxhash64("doc_id", k, F.lit(name)), most)

    def one(k):
        start = draw(k, "start", size)
        new = F.substring(F.coalesce("text", F.lit("")), (draw(k, "from", size) + 1).cast("int"), draw(k, "long", F.lit(61)).cast("int"))
        return F.struct(start.alias("start"), (start + draw(k, "cut", F.lit(41))).alias("stop"), new.alias("new"))

    return docs.withColumn("edits", F.transform(F.sequence(F.lit(1), F.lit(edits)), one))
