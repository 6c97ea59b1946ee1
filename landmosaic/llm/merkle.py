"""Merkle manifest of a document table: bitmap ranks give every leaf its place, arrays of slots reduce the levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Levels that one array of slots reduces: 2^LEVELS slots each.
LEVELS = 10
SLOTS = 2**LEVELS
#: A tree of at most so many words gets its running sums in one window; larger ones go through parents of 2^PARENT words.
TOP_WORDS, PARENT = 65_536, 12
#: The word of a null doc_id, below that of any 64-bit integer.
NULL_WORD = -(2**57) - 1


def hashed(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':', the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(lang: Column) -> Column:
    """A null's tree comes first, the others in order of their bytes."""
    return F.concat(F.when(lang.isNull(), "n").otherwise("s"), F.coalesce(lang, F.lit("")))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, changed of each row; changed is the tampered row's leaf (n_chars + 1) where the rule asks for it, else null."""
    row = lambda n: hashed(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n), field(F.col("text")))
    n = F.col("n_chars")
    tampered = n.isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    changed = F.when(tampered, row(n.cast("decimal(20,0)") + 1))
    return docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row(n).alias("leaf"), changed.alias("changed"))


def _coordinates(df: DataFrame) -> DataFrame:
    return df.withColumn("word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NULL_WORD))).withColumn("bit", F.coalesce(F.pmod("doc_id", F.lit(64)), F.lit(0)).cast("int"))


def bitmaps(ids: DataFrame) -> DataFrame:
    """tree, word, planes, n: each tree's bitmap of doc_ids as its non-empty words of 64 ids.

    An id that occurs m times stands in the planes of m's binary digits, so a word's rows, and those before a bit of it, are
    counted by popcounts whatever is repeated. Tasks' partial words are merged by bitwise or.
    """
    many = ids.groupBy("tree", "doc_id").agg(F.count("*").alias("m"))
    digits = F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, 62), k -> (shiftright(m, k) & 1) = 1)"))
    bits = _coordinates(many).select("tree", "word", F.explode(digits).alias("plane"), F.expr("shiftleft(1L, bit)").alias("one"))
    words = bits.groupBy("tree", "word", "plane").agg(F.bit_or("one").alias("bits"))
    rows = F.expr("shiftleft(cast(bit_count(bits) AS bigint), plane)")
    return words.groupBy("tree", "word").agg(F.collect_list(F.struct("plane", "bits")).alias("planes"), F.sum(rows).alias("n"))


def ranks(words: DataFrame) -> DataFrame:
    """The popcount directory: words (tree, word, n) with `before`, the rows of the tree's smaller words.

    No task sees more than TOP_WORDS words: a larger directory is summed by parents of 2^PARENT words, and again above them.
    """
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if (words.groupBy("tree").count().agg(F.max("count")).first()[0] or 0) <= TOP_WORDS:
        return words.withColumn("before", before("tree"))
    inner = words.withColumn("parent", F.shiftright("word", PARENT))
    parents = written(inner.groupBy("tree", F.col("parent").alias("word")).agg(F.sum("n").alias("n")))
    above = ranks(parents).select("tree", F.col("word").alias("parent"), F.col("before").alias("above"))
    return inner.withColumn("before", before("tree", "parent")).join(above, ["tree", "parent"]).withColumn("before", F.col("before") + F.col("above")).drop("parent", "above")


def placed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows (tree, doc_id, leaf, changed) with pos, the place in its tree: by rank queries, equal doc_ids by their leaves.

    Rows alike in all columns share a range of places. The places within one doc_id are summed by prefixes of the leaf first, so
    a doc_id that holds much of the table isn't ranked in one task.
    """
    looked = _coordinates(rows).join(small(directory.select("tree", "word", "planes", "before"), 200_000), ["tree", "word"])
    in_word = F.expr("aggregate(planes, 0L, (a, p) -> a + shiftleft(cast(bit_count(p.bits & ~shiftleft(-1L, bit)) AS bigint), p.plane))")
    times = F.expr("aggregate(planes, 0L, (a, p) -> a + shiftleft(shiftrightunsigned(p.bits, bit) & 1L, p.plane))")
    looked = looked.select("tree", "doc_id", "leaf", "changed", (F.col("before") + in_word).alias("pos"), times.alias("times"))
    if not directory.where("n > bit_count(planes[0].bits) or size(planes) > 1 or planes[0].plane > 0").limit(1).count():
        return looked.drop("times")
    kept = written(looked)
    alike = written(kept.where("times > 1").groupBy("tree", "doc_id", "leaf", "changed", "pos").agg(F.count("*").alias("c")).withColumn("part", F.substring("leaf", 1, 3)))
    sums = alike.groupBy("tree", "doc_id", "part").agg(F.sum("c").alias("c"))
    earlier = lambda order, *by: F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select(F.col("tree").alias("t_"), F.col("doc_id").alias("d_"), F.col("part").alias("p_"), earlier("part", "tree", "doc_id").alias("first_"))
    same = (F.col("tree") == F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("part") == F.col("p_"))
    at = F.col("pos") + F.col("first_") + earlier("leaf", "tree", "doc_id", "part")
    spread = alike.join(parts, same).withColumn("at", at).withColumn("pos", F.explode(F.sequence("at", F.col("at") + F.col("c") - 1)))
    return kept.where("times = 1").drop("times").unionByName(spread.select("tree", "doc_id", "leaf", "changed", "pos"))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """blocks (slots, todo) with l0 (the slots' hashes) to l10: after todo levels nothing changes any more."""
    out = blocks.withColumn("l0", F.col("slots.hash"))
    for j in range(1, LEVELS + 1):
        pairs = F.expr(f"transform(sequence(0, (size(l{j - 1}) - 1) div 2), i -> sha2(concat(l{j - 1}[2 * i], coalesce(get(l{j - 1}, 2 * i + 1), '')), 256))")
        out = out.withColumn(f"l{j}", F.when(F.col("todo") >= j, pairs).otherwise(F.col(f"l{j - 1}")))
    return out


def _blocks(nodes: DataFrame, sizes: DataFrame, done: int) -> DataFrame:
    """Arrays of up to SLOTS nodes (tree, pos, hash and more) that follow each other: tree, block, slots, todo, top; written once."""
    rest = [c for c in nodes.columns if c not in ("tree", "pos")]
    keyed = nodes.select("tree", F.shiftright("pos", LEVELS).alias("block"), F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), *rest).alias("node"))
    grouped = keyed.groupBy("tree", "block").agg(F.array_sort(F.collect_list("node")).alias("slots"))
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    todo = F.greatest(F.least(depth - done, F.lit(LEVELS)), F.lit(0))
    deep = _with_levels(grouped.join(small(sizes.select("tree", "n")), "tree").withColumn("todo", todo))
    return written(deep.select("tree", "block", "slots", "todo", F.col(f"l{LEVELS}")[0].alias("top")))


def _opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The blocks' nodes with path: for each level up to the root the siblings left and right of the node (above: tree, block, path)."""
    places = []
    for j in range(LEVELS):
        i = f"shiftright(s.slot, {j})"
        places.append(f"struct(CASE WHEN {i} % 2 = 1 THEN l{j}[{i} - 1] ELSE '' END AS left, CASE WHEN {i} % 2 = 0 THEN coalesce(get(l{j}, {i} + 1), '') ELSE '' END AS right)")
    own = F.expr(f"transform(slots, s -> struct(s AS node, concat(slice(array({', '.join(places)}), 1, todo), path) AS path))")
    opened = _with_levels(blocks.join(above, ["tree", "block"])).select("tree", "block", F.explode(own).alias("o"))
    return opened.select("tree", (F.col("block") * SLOTS + F.col("o.node.slot")).alias("pos"), "o.node", "o.path")


def _tree(nodes: DataFrame, sizes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' blocks from the leaves up, and tree, hash: each tree's root."""
    most = sizes.agg(F.max("n")).first()[0] or 1
    rounds, done = [], 0
    while not rounds or done < (most - 1).bit_length():
        rounds.append(_blocks(nodes, sizes, done))
        nodes, done = rounds[-1].select("tree", F.col("block").alias("pos"), F.col("top").alias("hash")), done + LEVELS
    return rounds, written(nodes.select("tree", "hash"))


def _paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest round with their whole paths; above: tree and the path from its root on."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        above = _opened(blocks, above).select("tree", F.col("pos").alias("block"), "path")
    return _opened(rounds[0], above)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, tree, pos, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (doc_id, source, lang, n_chars, text).

    Each lang is a tree of its rows' leaves by ascending doc_id (a null doc_id first; equal ones by leaf). Its root is folded with
    those of the other langs, null first. Places come from ranks in compressed bitmaps, not from a sort of the rows; then every
    1,024 nodes that follow each other reduce ten levels in one array. folded_root starts from the tampered leaf, if there is
    one. Nulls count as '-', an empty text as '0:'; repeated rows are leaves of their own; further columns are ignored. An empty
    table gives no rows.
    """
    rows = leaves(docs)
    directory = written(ranks(written(bitmaps(rows.select("tree", "doc_id")))))
    sizes = written(directory.groupBy("tree").agg(F.sum("n").alias("n")))
    at = placed(rows, directory)
    rounds, subroots = _tree(at.select("tree", "pos", F.col("leaf").alias("hash"), "doc_id", "changed"), sizes)
    every = F.lit("all").alias("tree")
    ids = subroots.select(every, F.col("tree").alias("lang_tree"), "hash")
    order = Window.partitionBy("tree").orderBy("lang_tree")
    top, roots = _tree(ids.select("tree", (F.row_number().over(order) - 1).cast("long").alias("pos"), "hash", "lang_tree"), subroots.groupBy(every).agg(F.count("*").alias("n")))
    none = roots.select("tree", F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("path"))
    langs = written(_paths(top, none).join(F.broadcast(roots.select("tree", F.col("hash").alias("root"))), "tree").select(F.col("node.lang_tree").alias("tree"), "path", F.col("node.hash").alias("subroot"), "root"))
    found = _paths(rounds, langs.select("tree", "path")).join(small(langs.drop("path")), "tree")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)
    folded = F.aggregate("path", F.coalesce("node.changed", "node.hash"), lambda a, p: hashed(p["left"], a, p["right"]))
    out = found.select(F.col("node.doc_id").alias("doc_id"), "tree", "pos", F.col("node.hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
