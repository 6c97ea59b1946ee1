"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check, star components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_batches, small, written
from .graph import components, forest
from .shingles import MinHash, digest, shingle_set

SKETCH = "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"
SETS = "doc_id long, size long, items binary"
GUESSED = "u long, v long, est double"
#: Buckets of up to so many members are compared pair by pair; larger ones in blocks of about so many rows and bytes.
SMALL_BUCKET, BLOCK_ROWS, BLOCK_BYTES = 24, 256, 4_000_000
CHECKED = "u long, v long, linked boolean, far double"


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(bands, rows)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                items = shingle_set(text, k)
                if len(items):
                    sig = hashes.signature(items)
                    out.append((doc_id, len(items), digest(items), sig.astype("<u2").tobytes(), hashes.keys(sig)))
                else:
                    out.append((doc_id, 0, None, None, None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "sketch", "bands"])
            frame["doc_id"] = pdf["doc_id"].to_numpy()
            yield frame

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [shingle_set(t, k).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "size": [len(x) for x in items], "items": items})

    return run


def _guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The share of places in which two signatures agree."""
    for pdf in batches:
        est = [float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2"))) for a, b in zip(pdf["a"], pdf["b"])]
        yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "est": est})


def _exact(percent: int):
    """Links by whole numbers: 100 * intersection >= percent * union; far is the Jaccard distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked, far = [], []
            for a, b in zip(pdf["a"], pdf["b"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - both
                linked.append(100 * both >= percent * whole)
                far.append(1 - both / whole)
            yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "linked": linked, "far": far})

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs (u, v) with the value of u as a and of v as b; a hot u is split by Spark's skew handling."""
    left = values.select(F.col("doc_id").alias("v"), F.col(name).alias("b"))
    right = values.select(F.col("doc_id").alias("u"), F.col(name).alias("a"))
    return pairs.join(left, "v").join(right, "u").select("u", "v", "a", "b")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, repeats: bool) -> DataFrame:
    """SETS of the documents whose doc_id is in ids (each may come often there); rows that repeat a doc_id and a set count once."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.distinct()
    sets = in_batches(docs.join(ids, "doc_id", "left_semi"), _sets(k), SETS)
    if repeats:
        sets = sets.groupBy("doc_id", "size", F.sha2("items", 256)).agg(F.first("items").alias("items")).select("doc_id", "size", "items")
    return written(sets)


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, k: int, percent: int, places: int, repeats: bool) -> DataFrame:
    """u, v, linked and the bounds lo, hi of their Jaccard distance.

    Signatures first: pairs six deviations below the threshold aren't linked, and get bounds six deviations wide.
    The others are compared by the full shingle sets of their documents, and only those documents are read again.
    """
    s = percent / 100
    slack = 6 * math.sqrt(s * (1 - s) / places)
    guessed = written(in_batches(_with_both(pairs, sketches, "sketch"), _guess, GUESSED))
    close = guessed.where(F.col("est") >= s - slack).select("u", "v")
    sets = _sets_of(docs, close.select(F.explode(F.array("u", "v")).alias("doc_id")), k, repeats)
    exact = in_batches(_with_both(close, sets, "items"), _exact(percent), CHECKED)
    wide = 6 * 0.5 / math.sqrt(places)
    far = guessed.where(F.col("est") < s - slack).select("u", "v", F.lit(False).alias("linked"), F.greatest(F.lit(1 - s), 1 - F.col("est") - wide).alias("lo"), F.least(F.lit(1.0), 1 - F.col("est") + wide).alias("hi"))
    return written(exact.select("u", "v", "linked", F.col("far").alias("lo"), F.col("far").alias("hi")).union(far))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of distinct k-word shingles (A-Z lower-cased;
    fewer words: the whole sequence as one) is at least percent / 100, confirmed on the full sets.

    1. Documents with equal sets form a class; its least doc_id stands for it, so copies are never paired.
    2. Class representatives meet in band buckets. Each bucket's least id is its hub; the other members are
       checked against the hub (signature, then full sets), which gives at most one pair per member and band.
    3. Star components. Where a bucket still spans several components, its members of different components
       are compared as well (see _rest): pair by pair in small buckets, unless their distances to the hub differ by
       more than 1 - percent / 100 (Jaccard distance is a metric, so they can't be linked), in blocks of sets in
       larger ones. No bucket is capped.
    4. Star components of those further links over the components so far. A pair at the threshold misses every bucket with
       probability (1 - s^rows)^bands: 7e-9 at 0.85 and 2e-6 at 0.8 with the defaults.

    Null or wordless text: n_shingles 0, linked with nothing. Null doc_id: component_id null, kept.
    Rows that repeat a doc_id share its component (they get linked if their texts differ); each is returned, and each of
    its texts is looked for. An empty table gives no rows. Other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = written(in_batches(docs, _sketches(k, bands, rows), SKETCH))
    known = all_rows.where("digest is not null and doc_id is not null")
    reps = written(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    twice = written(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("n > 1"))
    repeats = not twice.isEmpty()

    members = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = written(members.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("key", "hub"))
    shared = written(members.join(small(hubs), "key"))
    near = shared.where("doc_id != hub").groupBy("doc_id").agg(F.collect_set("hub").alias("hubs"))  # as many as bands, at most
    stars = near.select(F.explode("hubs").alias("u"), F.col("doc_id").alias("v"))
    texts = docs.where("doc_id is not null")
    sketches = reps.select("doc_id", "sketch")
    check = lambda pairs: _verified(texts, sketches, pairs, k, percent, bands * rows, repeats)
    first = check(stars)
    links = first.where("linked").select("u", "v")
    if repeats:
        texts_of = known.join(small(twice.where("lo != hi").select("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), "digest").distinct()
        links = links.union(texts_of.join(reps.select("digest", F.col("doc_id").alias("v")), "digest").select("u", "v"))
    label = small(components(links))

    more = _rest(texts, shared, first, label, k, percent, check, repeats)
    of = label.select(F.col("node").alias("doc_id"), "component_id")
    classes = reps.select("digest", "doc_id").join(of, "doc_id", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    if more is not None:
        joined = small(components(more)).select(F.col("node").alias("component_id"), F.col("component_id").alias("whole"))
        classes = classes.join(joined, "component_id", "left").select("digest", F.coalesce("whole", "component_id").alias("component_id"))
    found = all_rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(texts: DataFrame, shared: DataFrame, first: DataFrame, label: DataFrame, k: int, percent: int, check: Callable, repeats: bool) -> DataFrame | None:
    """Links (u, v) between components so far, of members of one bucket that are in different ones; None if there are no such members.

    Buckets with the same members (in several bands) count once. In small buckets the pairs that the members'
    distances to the hub leave possible are verified one by one. Larger ones are dealt into blocks of full shingle sets,
    apart for the hub's component and for the others: blocks of the hub's component are never compared with one another, so a
    group of near copies costs its size times the number of members that the hub's component leaves out.
    """
    of = label.select(F.col("node").alias("doc_id"), "component_id")
    named = shared.join(of, "doc_id", "left").select("key", "hub", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
    least = F.min_by("comp", "doc_id").alias("main")
    groups = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h"), least).where("lo < hi and n > 2")
    mixed = written(groups.groupBy("n", "h").agg(F.min(F.struct("key", "main")).alias("m")).select("m.key", "m.main", "n"))
    if mixed.isEmpty():
        return None
    left = written(named.where("doc_id != hub").join(small(mixed), "key"))

    far = small(first.select(F.col("u").alias("hub"), F.col("v").alias("doc_id"), "lo", "hi"))
    few = left.where(F.col("n") <= SMALL_BUCKET).join(far, ["hub", "doc_id"])
    few = few.groupBy("key").agg(F.collect_list(F.struct("doc_id", "comp", "lo", "hi")).alias("all"))  # SMALL_BUCKET members at most
    gap = lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"])
    possible = lambda a, b: (a["doc_id"] < b["doc_id"]) & (a["comp"] != b["comp"]) & (gap(a, b) <= 1 - percent / 100 + 1e-9)
    pair = lambda a: F.transform(F.filter("all", lambda b: possible(a, b)), lambda b: F.struct(a["doc_id"].alias("u"), b["doc_id"].alias("v")))
    pairs = few.select(F.explode(F.flatten(F.transform("all", pair))).alias("p")).select("p.u", "p.v").distinct()
    links = check(pairs).where("linked").select("u", "v")

    many = written(left.where(F.col("n") > SMALL_BUCKET).select("key", "doc_id", "comp", F.when(F.col("comp") == F.col("main"), 0).otherwise(1).alias("side")))
    if not many.isEmpty():
        links = links.union(_between_blocks(many, _sets_of(texts, many.select("doc_id"), k, repeats), percent))
    end = lambda c: of.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"of_{c}"))
    return links.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))


def _between_blocks(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of different components of large buckets: at most one for each member and pair of blocks.

    many: key, doc_id, comp, side (0: in the hub's component). Each pair of blocks is one row of names until both
    blocks are joined to it, so a hot bucket's pairs are dealt over all tasks.
    """
    sized = many.join(small(sets.select("doc_id", "size")), "doc_id")
    blocks_of = lambda s: F.greatest(F.ceil(F.count_if(F.col("side") == s) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0)) / BLOCK_BYTES)).alias(f"n{s}")
    counts = small(written(sized.groupBy("key").agg(blocks_of(0), blocks_of(1)).where("n1 > 0")))
    salt = F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")))
    dealt = many.join(counts, "key").withColumn("block", F.concat_ws("-", "key", "side", salt)).join(sets, "doc_id")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["doc_id"].to_numpy()], "comps": [pdf["comp"].to_numpy()], "sizes": [pdf["size"].to_numpy() // 8], "items": [b"".join(pdf["items"])]})

    blocks = written(dealt.select("block", "doc_id", "comp", "size", "items").groupBy("block").applyInPandas(pack, "block string, ids array<long>, comps array<long>, sizes array<long>, items binary"))
    one = lambda side, i: F.concat_ws("-", "key", F.lit(side), i.cast("string"))
    grid = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1)))
    others = F.transform(F.sequence(F.col("i"), F.col("n1") - 1), lambda j: one(1, j))
    main = F.when(F.col("n0") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n0") - 1), lambda j: one(0, j))).otherwise(F.array().cast("array<string>"))
    grid = grid.select(one(1, F.col("i")).alias("block_a"), F.concat(others, main).alias("with"))
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "comps", "sizes", "items")))
    met = grid.join(side("a"), "block_a").withColumn("block_b", F.explode("with")).drop("with").join(side("b"), "block_b")
    return in_batches(met, _block_links(percent), "u long, v long")


def _block_links(percent: int):
    """Links between members of different components of two blocks of full sets: for each linked row, one that joins it on.

    Only shingles that both blocks have can be shared; their incidence matrices are multiplied in column chunks.
    """

    def incidence(items, sizes, common):
        at = np.searchsorted(common, items)
        at[at == len(common)] = 0
        held = common[at] == items
        return np.repeat(np.arange(len(sizes)), sizes)[held], at[held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ia, ib, ca, cb, sa, sb, xa, xb in zip(*(pdf[c] for c in ("ids_a", "ids_b", "comps_a", "comps_b", "sizes_a", "sizes_b", "items_a", "items_b"))):
                ia, ib, ca, cb, sa, sb = (np.asarray(x) for x in (ia, ib, ca, cb, sa, sb))
                xa, xb = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                common = np.intersect1d(np.unique(xa), np.unique(xb), assume_unique=True)
                if not len(common):
                    continue
                (ra, pa), (rb, pb) = incidence(xa, sa, common), incidence(xb, sb, common)
                both = np.zeros((len(ia), len(ib)))
                for s in range(0, len(common), 8192):
                    width = min(8192, len(common) - s)
                    m, n = np.zeros((len(ia), width), np.float32), np.zeros((len(ib), width), np.float32)
                    here, there = (pa >= s) & (pa < s + width), (pb >= s) & (pb < s + width)
                    m[ra[here], pa[here] - s], n[rb[there], pb[there] - s] = 1, 1
                    both += m @ n.T
                hit = (100 * both >= percent * (sa[:, None] + sb - both)) & (ca[:, None] != cb)
                p, q = np.nonzero(hit)
                ids = np.concatenate([ia, ib])
                root = forest(len(ids), [(p, q + len(ia))])
                moved = np.flatnonzero(root != np.arange(len(ids)))
                yield pd.DataFrame({"u": ids[root[moved]], "v": ids[moved]})

    return run
