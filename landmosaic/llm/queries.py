"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, chat, covertree, editcount, langid, merkle, minhash, mixing, packing, pii, quality, urls
from .common import table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(buckets: int, which: int):
    """Whether crc32(doc_id as text) mod buckets is `which`; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == which, F.lit(False))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(table(spark, sf_dir, "documents"), entropy=0.95, repetition=4.0)
    return out.select("doc_id", "source", "epoch", "n_tokens", F.round("mix_order", 6).alias("mix_order"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k=5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: lambda s: s["kind"] == kind
    many = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *many, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    profile = langid.profiles(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profile)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer_path("byte_bpe_50k.tiktoken")
    kept = written(editcount.with_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary))
    return editcount.edited_counts(editcount.derived_edits(kept), vocabulary)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out(5, 0)))
    out = quality.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2, size=4096)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.formatted(chat.as_tree(rows), branches=1)
    turns, texts = chat.read_back(F.col("formatted")), chat.loss_texts(F.col("formatted"), F.col("loss"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(texts, "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The rules of op11 (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 4).alias("p_block"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_ann, op3_pii, op4_embed_dedup, op5_minhash, op6_langid, op7_token_counts, op8_quality, op9_packing, op10_chat, op11_urls, op12_merkle, op13_align)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]|ROLE\]))', '\1\\\2\3', 'g'))
    + length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]|ROLE\]))', '\1\\\2\3', 'g'))
    + 9 + 7 + 4 + CASE WHEN role = 'user' THEN 13 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: crc32 of the decimal doc_id, bit by bit from the ASCII codes of its characters; trees are folded level by level.
ORACLE_SQL["op12_merkle"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS tree, n_chars, CAST(doc_id AS VARCHAR) AS d, CAST(n_chars AS VARCHAR) AS n0, CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS n1,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(CAST(doc_id AS VARCHAR)) AS BIGINT) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n0) || ':' || n0, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen(n1) || ':' || n1, '-') || tail) ELSE sha256(head || coalesce(strlen(n0) || ':' || n0, '-') || tail) END AS changed
  FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
sizes AS (SELECT tree, count(*) AS n FROM placed GROUP BY tree),
up(tree, lvl, pos, hash, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed JOIN sizes USING (tree)
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, n, pos // 2),
subs AS (SELECT tree, lvl AS depth, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
above(lvl, pos, hash, n) AS (
  SELECT 0, pos, subroot, (SELECT count(*) FROM subs) FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM above WHERE n > 1 GROUP BY lvl, n, pos // 2),
top AS (SELECT lvl AS depth, hash AS root FROM above WHERE n = 1),
steps AS (
  SELECT p.tree, p.pos, u.lvl, CASE WHEN u.pos < (p.pos >> u.lvl) THEN u.hash ELSE '' END AS l, CASE WHEN u.pos > (p.pos >> u.lvl) THEN u.hash ELSE '' END AS r
  FROM placed p JOIN subs s USING (tree) JOIN up u ON u.tree = p.tree AND u.lvl < s.depth AND u.pos = xor(p.pos >> u.lvl, 1)
  UNION ALL
  SELECT p.tree, p.pos, s.depth + a.lvl, CASE WHEN a.pos < (s.pos >> a.lvl) THEN a.hash ELSE '' END, CASE WHEN a.pos > (s.pos >> a.lvl) THEN a.hash ELSE '' END
  FROM placed p JOIN subs s USING (tree) JOIN above a ON a.lvl < (SELECT depth FROM top) AND a.pos = xor(s.pos >> a.lvl, 1)),
listed AS (
  SELECT p.tree, p.pos, coalesce(string_agg(l || r, '' ORDER BY lvl), '') AS siblings FROM placed p LEFT JOIN steps t ON t.tree = p.tree AND t.pos = p.pos GROUP BY p.tree, p.pos),
fold(tree, pos, lvl, hash, last) AS (
  SELECT p.tree, p.pos, 0, p.changed, s.depth + (SELECT depth FROM top) FROM placed p JOIN subs s USING (tree)
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, sha256(coalesce(t.l, '') || f.hash || coalesce(t.r, '')), last
  FROM fold f LEFT JOIN steps t ON t.tree = f.tree AND t.pos = f.pos AND t.lvl = f.lvl WHERE f.lvl < last)
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(siblings) AS proof_sha256, f.hash AS folded_root, f.hash = root AS verified
FROM placed p JOIN subs s USING (tree) JOIN listed l ON l.tree = p.tree AND l.pos = p.pos JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.lvl = f.last, top
"""

ORACLE_SQL["op1_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS mix_key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
src AS (SELECT mix_key, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY 1),
shares AS (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS p, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM src WHERE tokens > 0),
spread AS (SELECT min(p) / max(p) AS s, max(p) AS top, 0.95 * ln(CAST(count(*) AS DOUBLE)) AS target FROM shares),
flat(i, lo, hi) AS (
  SELECT 0, 0e0, 1e0
  UNION ALL
  SELECT i + 1, CASE WHEN h < target THEN lo ELSE (lo + hi) / 2 END, CASE WHEN h < target THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, target, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM shares) AS h
        FROM flat, spread WHERE i < 50)),
reps(i, lo, hi) AS (
  SELECT 0, 0e0, 1e0
  UNION ALL
  SELECT i + 1, CASE WHEN pow(s, (lo + hi) / 2 - 1) <= 4 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(s, (lo + hi) / 2 - 1) <= 4 THEN (lo + hi) / 2 ELSE hi END
  FROM reps, spread WHERE i < 50),
expo AS (SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM shares) < target THEN (SELECT lo FROM flat WHERE i = 50) ELSE 1e0 END,
    CASE WHEN pow(s, -1e0) <= 4 THEN 0e0 ELSE (SELECT lo FROM reps WHERE i = 50) END) AS e, top FROM spread),
plan AS (SELECT mix_key, docs, tokens, CAST(ceil(docs / 1024e0) AS BIGINT) AS blocks,
    greatest(round(pow(p, e) / norm * (total * top / (pow(top, e) / norm))), 1) AS budget
  FROM shares, expo, (SELECT sum(pow(p, e)) AS norm FROM shares, expo)
  UNION ALL SELECT mix_key, docs, tokens, CAST(ceil(docs / 1024e0) AS BIGINT), 0 FROM src WHERE tokens = 0),
epochs AS (SELECT *, unnest(range(0, CAST(CASE WHEN tokens > 0 THEN greatest(ceil(budget / tokens) - 1, 0) ELSE 0 END AS BIGINT) + 1)) AS epoch FROM plan),
dealt AS (SELECT d.*, epoch, tokens, budget, CAST('0x' || substr(md5('1/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % blocks AS block
  FROM sized d JOIN epochs USING (mix_key)),
sums AS (SELECT mix_key, block, epoch, sum(n_tokens) AS n, md5('1/' || epoch || '/' || mix_key || '/' || block) AS turn FROM dealt GROUP BY mix_key, block, epoch),
starts AS (SELECT mix_key, block, epoch, coalesce(sum(n) OVER (PARTITION BY mix_key, epoch ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM sums),
placed AS (SELECT doc_id, source, epoch, n_tokens, budget, epoch * tokens + begin
    + coalesce(sum(n_tokens) OVER (PARTITION BY mix_key, epoch, block ORDER BY md5('1/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM dealt JOIN starts USING (mix_key, block, epoch))
SELECT doc_id, source, epoch, n_tokens, CASE WHEN budget > 0 THEN round(CAST(pos AS DOUBLE) / budget, 6) ELSE 0 END AS mix_order
FROM placed WHERE pos < budget OR epoch = 0
"""
