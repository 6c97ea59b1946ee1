"""URL filters, the Merkle manifest and token alignment against plain versions, and on odd rows."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landmosaic.llm import align, common, merkle, queries, urls
from landmosaic.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, word int, path string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(*map(one, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def climb(nodes):
        """The root and, for each node, its siblings (left, right) up to it."""
        paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, mine = [], []
            for i in range(0, len(nodes), 2):
                run = nodes[i : i + 2]
                for k, members in enumerate(owner[i : i + 2]):
                    for m in members:
                        paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha(*run))
                mine.append(sum(owner[i : i + 2], []))
            nodes, owner = up, mine
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    trees = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    each = {}
    for t in trees:
        by[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        each[t] = climb([leaf(r) for r in by[t]])
    root, above = climb([each[t][0] for t in trees])
    out = []
    for t, up in zip(trees, above):
        for r, own in zip(by[t], each[t][1]):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(r, tampered)
            for left, right in own + up:
                at = sha(left, at, right)
            out.append((r[0], leaf(r), each[t][0], root, sha(*(a + b for a, b in own + up)), at, at == root))
    return sorted(out, key=str)


ROWS = [(i, f"text {i} é", "en" if i % 3 else "de", "s", i) for i in range(40)]
ODD = [(7, "x", "en", "s", 1), (7, "x", "en", "s", 1), (7, "y", "en", None, None), (None, "a", None, None, 5), (None, None, None, None, 5), (None, "a", None, None, 5), (-3, "", "éa", "s", 2), (2**63 - 1, "z", "en", "s", 3), (-(2**63), "z", "en", "s", 3), (63, "q", "en", "s", 2**63 - 1), (64, "q", "", "s", 9), (5, "long " * 30000, "fr", "s", 9)]


@pytest.mark.parametrize(("rows", "top", "levels"), [(ROWS + ODD, 65_536, 10), (ROWS + ODD + ROWS * 2, 3, 10), (ROWS, 65_536, 2), (ROWS[:1], 65_536, 10), (ODD * 5, 2, 2), ([], 65_536, 10)])
def test_manifest_equals_plain_trees(spark, monkeypatch, rows, top, levels):
    monkeypatch.setattr(merkle, "TOP_WORDS", top)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SLOTS", 2**levels)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS)
    got = merkle.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == (plain_manifest(rows) if rows else [])


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sign = {c: i for i, c in align.byte_signs().items()}
    pieces = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], {}
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False), b.encode(text)) if text else (None, [])
        x_bytes, y_bytes = [bytes(sign[c] for c in t) for t in (x.tokens if x else [])], [pieces(i) for i in y]
        whole = f" {text}".encode()
        if not text or b"".join(x_bytes) != whole or b"".join(y_bytes) != whole:
            found.append(None)
            continue
        x_end, y_end = np.cumsum([len(t) for t in x_bytes]), np.cumsum([len(t) for t in y_bytes])
        links = [(i, j) for i in range(len(x.ids)) for j in np.flatnonzero(y_end == x_end[i])]
        groups, p, q = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, x.ids[p : i + 1])) + "|" + ",".join(map(str, y[q : j + 1])))
            p, q = i + 1, j + 1
        pairs = [(x.ids[i], y[j]) for i, j in links]
        for k in pairs:
            count[k] = count.get(k, 0) + 1
        found.append((len(x.ids), len(y), groups, pairs))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(count[k] == best[k[1]] for k in f[3]), sum(count[k] for k in f[3]), sha(";".join(f[2]))) for f in found]


TRICKY = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b\t c", "  lead", "trail  ", "x▁y", "  z", "a b 　c", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x1c \x1f a", "don't we'll I'M 12345 67,8", "日本語 テキスト", "🙂 é ﬁ ½", "word " * 300, "y" * 5000, "it's\r\nfine \x85 ok", "a  b", "end\n", "\n start", "it's", "it's", "the the the"]


def test_alignment_equals_whole_encoding(spark, sf):
    texts = TRICKY + [r["text"] for r in table(spark, sf, "documents").orderBy("doc_id").collect()]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, times int")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = [tuple(r[n] for n in names) for r in align.alignment(docs, A, B).orderBy("doc_id").collect()]
    assert got == plain_alignment(texts)
    assert sum(g[0] == 0 for g in got[: len(TRICKY)]) == 3  # null, empty, and the character that stands for a space
    assert align.alignment(docs.limit(0), A, B).count() == 0


def test_alignment_of_random_strings():
    known, r = align.Aligner(A, B), np.random.default_rng(3)
    letters = list("ab Z09'.,-\n\t\r  éß<|>▁日🙂\x1c") + ["  ", " the", "'s", " \n"]
    texts = ["".join(r.choice(letters, r.integers(1, 30))) for _ in range(3000)]
    want = plain_alignment(texts)
    for text, w, (a, b) in zip(texts, want, known.encoded(texts)):
        n_a, n_b, n_groups, groups, links = known.aligned(text, a, b)
        assert (n_a, n_b, n_groups, len(links)) == w[:4], text
        assert (sha(groups) if n_a else "") == w[6], text


def test_met_serves_hot_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    left = spark.createDataFrame([(i, None if i % 11 == 0 else f"k{i % 40}" if i % 3 else "hot") for i in range(900)], "id long, k string")
    right = common.written(left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k <> 'k7'"))
    want = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "n", "m").collect()), key=str)
    for share in (2, 5, 1000):
        assert sorted(map(tuple, common.met(left, right, "k", "n", share).select("id", "k", "n", "m").collect()), key=str) == want


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD_URLS = [None, "", "no scheme", "http://", "://x.ORG/", "http://a.b.ORG/es/x", "http://example.org/es/1?a=b#c", "http://EXAMPLE.org/en/12", "http://notexample.org/es/", "http://x.com/fr", "http://x.com/fr/", "http://com/de/", "http://x.com?/de/", "http://x.com#/de/", "http://x.com/de/://y.org/", "a\nb://É.com/fr/\nx", "http://x.org", "http://x.org?q=http://y/", "http://[::1]:80/a?b&c&&d=1", "http://x.com/" + "a1" * 40000, "http://x.com/de/", "http://x.com/de/"]


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(ODD_URLS)], "page_id long, url string, host string, rule string, blocked int")
    got = {r["page_id"]: r for r in urls.judged(pages, queries.RULES).collect()}
    assert len(got) == len(ODD_URLS)
    for i, u in enumerate(ODD_URLS):
        host, path, block, rule = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] in ("allow", "block") and (rule is None or got[i]["verdict"] == ("block" if block else "allow"))
    assert urls.judged(pages.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, []).collect()} == {"allow"}
    assert {r["verdict"] for r in urls.judged(pages, [("block", "com", "/")]).where("rule is null").collect()} == {"block"}


def test_lexical_features(spark):
    rows = spark.createDataFrame([(u,) for u in ODD_URLS], "url string")
    host, path = urls.host_and_path(F.col("url"))
    got = rows.withColumn("host", host).withColumn("path", path).select("url", *(v.alias(k) for k, v in urls.lexical(F.col("url"), F.col("host"), F.col("path")).items())).collect()

    def bits(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0

    for r in got:
        u, (h, p, *_) = r["url"] or "", plain_rule(r["url"])
        query = u.split("?", 1)[1].split("#")[0] if "?" in u and "#" not in u.split("?")[0] else None
        assert r["length"] == len(u) and r["host_length"] == len(h) and r["path_length"] == len(p)
        assert r["host_depth"] == len([x for x in h.split(".") if x]) and r["path_depth"] == len([x for x in p.split("/") if x])
        assert r["entropy"] == pytest.approx(bits(u), abs=1e-9) and r["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in u) / max(len(u), 1))
        if query is not None:
            assert r["parameters"] == len([x for x in query.split("&") if x]), u


def test_trees_equal_plain_evaluation_and_hold_on_unseen_rules(spark):
    """The score is the sigmoid of twice the weighted sum of the trees; rules that are held out are mostly met by the trees."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    rows = common.written(urls.parsed(pages, queries.RULES))
    held = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(5)) == 0
    train = common.written(rows.withColumn("blocked", F.when(~held, F.col("blocked"))))
    statistics = urls.suffix_statistics(train)
    model = urls.fitted(train, statistics)
    n, blocked = train.agg(F.count("blocked"), F.count_if("blocked")).first()
    wide = urls.described(rows.where(held & F.col("blocked").isNotNull()), statistics, blocked / n, own_fold=True)
    scored = model.transform(wide).select("blocked", "features", "probability").collect()

    def leaf(node, x):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]
    for r in scored[:25]:
        margin = sum(w * leaf(t, r["features"].toArray()) for w, t in trees)
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)
    right = sum((r["probability"][1] >= 0.5) == r["blocked"] for r in scored)
    most = max(sum(r["blocked"] for r in scored), sum(not r["blocked"] for r in scored))
    assert len(scored) > 150 and right / len(scored) > 0.85 and right > most
