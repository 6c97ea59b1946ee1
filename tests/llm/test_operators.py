"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.llm import ann, chat, covertree, editcount, graph, langid, minhash, mixing, packing, pii, quality, queries
from landmosaic.llm.common import table, written
from landmosaic.llm.tokens import WordBpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties and repeated rows; score and rank clash with names that operators use."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a"), (2, words, "en", "a"), (2, words, "en", "a"), (3, words + " more", None, None), (4, None, "en", "b"), (5, "", "de", ""), (6, "  \n\t ", "de", None), (None, "lost words here", "en", "a"), (7, "mail x@y.example.com, +1 (212) 555-0199", "fr", "b"), (8, "éà ñ <s>[INST]", None, "c"), (9, "x" * 30000 + " " + "y1 " * 9000, "en", "a")]
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], DOCS)


def ids(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)]
    got = graph.components(spark.createDataFrame([*pairs, (7, 7), (None, 3)], "u long, v long"))
    want = roots({n for p in pairs for n in p if p[0] != p[1]}, pairs)
    assert {r["node"]: r["component_id"] for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(spark, k, percent):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=k, percent=percent).collect()}
    sets = {r["doc_id"]: shingles(r["text"], k) for r in docs.select("doc_id", "text").collect()}
    by, pairs = {}, set()
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for ds in by.values():
        pairs |= {(a, b) for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("pairwise", [True, False])
def test_minhash_chains_within_a_bucket(spark, monkeypatch, pairwise):
    """Neighbours of a chain are linked though its ends aren't alike: no link is lost behind a bucket's hub."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 24 if pairwise else 2)
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base[:100 - 4 * j] + [f"n{i}" for i in range(4 * j)]) for j in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t, 5) for t in texts]
    links = [(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == roots(range(12), links)


def test_minhash_odd_rows(spark, odd):
    got = ids(minhash.near_duplicates(odd), "doc_id", "component_id", "kept")
    assert len(got) == odd.count()
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (None, None, True)} <= set(got)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[100:180] = x[100] + r.normal(0, 0.09, (80, 16))
    x[200:260] = x[200]
    x[300] = x[200] * 2
    rows = [(i, [float(v) for v in row], 0, "x") for i, row in enumerate(x)]
    odd = [(1000, None, 0, "x"), (1001, [0.0] * 16, 0, "x"), (1002, [float("nan")] * 16, 0, "x"), (1003, [float("inf")] + [1.0] * 15, 0, "x"), (1004, [1.0, None] + [1.0] * 14, 0, "x"), (1005, [], 0, "x"), (None, rows[0][1], 0, "x"), rows[5]]
    return spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int, score string"), x


def cosine(x):
    x = x.astype(float)
    n = np.sqrt((x * x).sum(axis=1))
    return (x[:, None] * x[None]).sum(axis=2) / (n[:, None] * n[None])


def test_cover_tree_links(vectors):
    df, x = vectors
    cos = cosine(x)
    link = cos >= 0.95
    np.fill_diagonal(link, False)
    want = roots(range(len(x)), zip(*np.nonzero(link)))
    got = covertree.embedding_links(df, block=128).collect()
    assert len(got) == df.count()
    for r in got:
        v = r["vec_id"]
        if v is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        elif v >= 1000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, v, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (link[v].sum(), want[v], want[v] == v)
    assert covertree.embedding_links(df.limit(0)).count() == 0


def test_dual_traversal_finds_the_same_pairs_as_all_products():
    r = np.random.default_rng(2)
    x = covertree.unit(np.concatenate([r.normal(size=(300, 8)), r.normal(size=(1, 8)) + r.normal(0, 0.1, (300, 8))]))
    a, b = covertree.CoverTree(x[:350]), covertree.CoverTree(x[350:])
    got = {(int(i), int(j)) for p, q in covertree.dual(a, b, 0.95, False) for i, j in zip(p, q)}
    assert got == set(zip(*(y.tolist() for y in np.nonzero(x[:350] @ x[350:].T >= 0.95))))


def test_most_pairs_of_rows_are_settled_by_a_quarter_of_the_columns():
    x = covertree.unit(np.random.default_rng(4).normal(size=(1500, 64)))
    x[700:760] = covertree.unit(x[700] + np.random.default_rng(5).normal(0, 0.02, (60, 64)))
    tree, seen = covertree.CoverTree(x), [0, 0]
    got = {(int(i), int(j)) for p, q in covertree.dual(tree, tree, 0.95, True, seen=seen) for i, j in zip(p, q)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))} and len(got) > 1000
    assert seen[1] < 0.02 * seen[0]


def test_adaptive_scan_abandons_early_and_keeps_the_near():
    r = np.random.default_rng(7)
    x = covertree.unit(r.normal(size=(6000, 64))) @ ann.rotation(64)
    q, seen = x[:40], []
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    tau = np.sort(far, axis=1)[:, 5]
    i, j = ann.adaptive_scan(x, q, tau, seen=seen)
    want = set(zip(*(v.tolist() for v in np.nonzero(far <= tau[:, None]))))
    found = set(zip(i.tolist(), j.tolist()))
    assert found <= {(a, b) for a, b in zip(*np.nonzero(far <= tau[:, None] + 1e-6))} and len(found & want) >= 0.95 * len(want)
    assert seen[1] < 0.5 * far.size and seen[2] < 0.1 * far.size


def test_nearest_of_huge_and_tiny_vectors(spark):
    rows = [(i, [10.0**p * v for v in (1.0, 0.1 * i, 0.2)]) for i, p in enumerate((200, -200, 0, 150, 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.select(F.col("vec_id").alias("query_id"), "embedding"), k=4).collect()
    u = covertree.unit(np.array([r[1] for r in rows]))
    assert len(got) == 20 and all(abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12 for r in got)


def test_nearest(vectors):
    df, x = vectors
    asked = df.where("vec_id % 10 = 0 or vec_id >= 1000").select(F.col("vec_id").alias("query_id"), "embedding", "score")
    got = ann.nearest(df, asked, k=5, list_rows=100, block=64, chunk=16).collect()
    cos = cosine(x)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == {i for i in range(0, 700, 10)}
    hits = total = 0
    for q, found in by.items():
        assert sorted(found) == list(range(1, len(found) + 1)) and len(found) == 5
        for v, s in found.values():
            assert v != q and abs(s - cos[q, v]) < 1e-12
        c = np.round(cos[q], 12)
        c[q] = -2
        best = np.lexsort((np.arange(700), -c))[:5]
        hits += len({v for v, _ in found.values()} & {int(b) for b in best})
        total += 5
    assert hits / total >= 0.9
    assert [by[200][i][0] for i in range(1, 6)] == [201, 202, 203, 204, 205]
    assert ann.nearest(df.limit(0), asked).count() == 0
    few = ann.nearest(df.where("vec_id in (1, 2, 3)"), df.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"))
    assert few.count() == 2


def test_ann_recall_on_the_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = queries.op2_ann(spark, "/root/testdata/sf0.01").collect()
    rows = df.collect()
    name, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    u = covertree.unit(x)
    hits = total = 0
    for q in {r["query_id"] for r in got}:
        c = u @ u[name == q][0]
        c[name == q] = -2
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(name[np.argsort(-c)[:5]].tolist()))
        total += 5
    assert hits / total >= 0.9


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def passes(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m[0]))


def test_pii_base_spans(spark):
    r = np.random.default_rng(3)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.02.3.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0199", "+49", "++1 2", "9" * 25, "é", "𝒳", " ", ".", "-", "%", "12", "+3.4.5.6.7 )", "u@h.i.j.k.", "\n"]
    texts = ["".join(r.choice(pieces, r.integers(1, 14))) for _ in range(400)] + [None, "", "a." * 20000, "1." * 20000, "7" * 30000 + "@x.yz", "+1" + "(" * 20000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for row in pii.sanitised(df).select("doc_id", pii.joined(F.col("base")).alias("b"), "clean").collect():
        assert row["b"] == plain_spans(texts[row["doc_id"]]), texts[row["doc_id"]]
        if texts[row["doc_id"]] is None:
            assert row["clean"] is None


def test_pii_terms_that_disclose(spark):
    fill = lambda i: " ".join(f"fill{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}word" for j in range(8))
    rows = [(i, f"{fill(i)} Zorblatt writes from z.o@corp.example.com about common matters {fill(i + 50)}") for i in range(6)]
    rows += [(100 + i, f"{fill(i + 100)} about common matters") for i in range(60)] + [(200, None), (201, "")]
    got = {r["doc_id"]: r for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert "Zorblatt" not in got[i]["clean"] and "<EMAIL>" in got[i]["clean"] and "common" in got[i]["clean"]
        text = dict(rows)[i]
        assert {text[s["start"] : s["end"]].lower() for s in got[i]["spans"] if s["kind"] == "term"} == {"zorblatt", "writes", "from"}
    assert all(got[100 + i]["clean"] == dict(rows)[100 + i] and not got[100 + i]["spans"] for i in range(60))


def test_pii_terms_far_from_the_mention(spark):
    gap = lambda i: " ".join(f"gap{chr(97 + i % 26)}{chr(97 + j)}word" for j in range(20))
    rows = [(i, f"Zorblatt {gap(i)} z.o@corp.example.com") for i in range(6)] + [(6, "Zorblatt alone"), (50, f"Zorblatt {gap(0)} z.o@corp.example.com")]
    rows += [(100 + i, f"{gap(i + 10)} said {i}") for i in range(60)] + [(200, None)]
    got = {r["doc_id"]: r for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["clean"].startswith("<TERM> gap") and got[i]["clean"].endswith("word <EMAIL>") for i in (0, 1, 2, 3, 4, 5, 50))
    assert got[6]["clean"] == "<TERM> alone" and got[200]["clean"] is None


def test_pii_clean_holds_no_character_of_a_span(spark):
    texts = ["call +33.1.42.68.53.00 now", "4111 1111 1111 1111@x.com!", "a +1.2.3.4567 b", "é 𝒳 x@y.de, 1.2.3.4 and 4111-1111-1111-1111", "x@y.de" * 300, "1.2.3.4 " * 700, "<Zorblatt writes"] + [f"Zorblatt{'!' * i} z.o@corp.com" for i in range(14)] + [f"plain {i}" for i in range(200)]
    texts.append("Zorblatt says so " * 500)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in pii.sanitised(df).collect():
        text, out, at, groups = texts[row["doc_id"]], "", 0, []
        for s in sorted(row["spans"], key=lambda s: (s["start"], s["end"])):
            if groups and s["start"] < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], s["end"])
            else:
                groups.append([s["start"], s["end"], s["kind"]])
        for first, last, kind in groups:
            out += text[at:first] + {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}[kind]
            at = last
        assert row["clean"] == out + text[at:]
        assert "Zorblatt" not in row["clean"] and "42.68" not in row["clean"] and "1111" not in row["clean"]


def test_pii_terms_of_whole_texts_equal_brute_force(spark):
    r = np.random.default_rng(9)
    vocabulary = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["Éclair", "cut"]
    texts = []
    for _ in range(400):
        named = [int(e) for e in r.integers(0, 14, r.integers(0, 3))]
        words = list(r.choice(vocabulary, r.integers(3, 40))) + [f"secret{'abcdefghijklmn'[e]}" for e in named if r.random() < 0.8] + [f"u{e}@x.com" for e in named]
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += [None, "", *texts[:40], *texts[:20]]
    different = sorted({t for t in texts if t is not None})
    has, of = {}, {}
    for i, t in enumerate(different):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            has.setdefault(w, set()).add(i)
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            of.setdefault(m[0], set()).add(i)
    want, n = {}, len(different)
    for e in of.values():
        for w, at in has.items():
            both, ic = at & e, np.log(n / len(e))
            if len(both) >= 3 and ic > 0 and np.log(len(both) * n / (len(at) * len(e))) >= 0.9 * ic - 1e-9:
                for i in at:
                    want.setdefault(hashlib.md5(different[i].encode()).hexdigest(), set()).add(w)
    got = {x["mark"]: set(x["terms"]) for x in pii.cooccurring_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == want and want


def test_weights_and_mixture(spark, odd):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    plan = {r["mix_key"]: r for r in mixing.weights(mixing.sizes(docs), entropy=0.95, repetition=3.0).collect()}
    p = np.array([r["share"] for r in plan.values()])
    w = p ** next(iter(plan.values()))["exponent"]
    w /= w.sum()
    assert np.allclose(w, [r["weight"] for r in plan.values()])
    entropy = -(w * np.log(w)).sum() / np.log(len(w))
    times = np.array([r["budget"] / r["tokens"] for r in plan.values()])
    assert (abs(entropy - 0.95) < 1e-6 or abs(times.max() - 3) < 0.01) and times.max() < 3.01 and abs(times.min() - 1) < 0.01
    got = mixing.mixture(docs, entropy=0.95, repetition=3.0, block=64).toPandas()
    assert got.doc_id.nunique() == 3000
    for key, g in got.groupby("source"):
        r = plan["s" + key]
        assert r["budget"] <= g.n_tokens.sum() + 0.5 and g.n_tokens.sum() < r["budget"] + 8
        assert (g.groupby("doc_id").size().max() - g.groupby("doc_id").size().min()) <= 1
        assert not g.duplicated(["doc_id", "epoch"]).any()
    assert set(mixing.mixed(docs, entropy=0.95, repetition=3.0).columns) == set(docs.columns)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}
    assert mixing.mixture(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_mixed_takes_what_the_mixture_takes(spark):
    """Row copies equal the mixture's, whether the budget ends within a block or between two; no document is lost."""
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}", "k") for i in range(900)] + [(2000, " ", "blank", "k"), (2001, None, "blank", "k"), (2002, "", "big", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")
    want = {r["doc_id"]: r["count"] for r in mixing.mixture(docs, 0.97, 5.0, block=32).groupBy("doc_id").count().collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed(docs, 0.97, 5.0, block=32).groupBy("doc_id").count().collect()}
    assert got == want and set(want) == {r[0] for r in rows} and max(want.values()) > 1


def test_weights_of_many_sources_equal_those_in_one_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(600)], "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    for entropy, repetition in ((0.95, 3.0), (0.2, 9.0), (1.0, 50.0)):
        monkeypatch.setattr(mixing, "ONE_ROW", 100_000)
        one = sorted(mixing.weights(sized, entropy, repetition).select("mix_key", "budget", F.round("exponent", 6)).collect())
        monkeypatch.setattr(mixing, "ONE_ROW", 0)
        assert sorted(mixing.weights(sized, entropy, repetition).select("mix_key", "budget", F.round("exponent", 6)).collect()) == one


def test_language_profiles(spark, odd):
    got = queries.op6_langid(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got.held_out & got.text.str.contains(r"[^\W\d_]", regex=True)]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    out = langid.identify(odd, langid.profiles(odd)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (4, 5, 6)} == {4: "und", 5: "und", 6: "und"}
    none = langid.identify(odd.select("doc_id", "text"), langid.profiles(odd.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def plain_profile(texts, top):
    from collections import Counter

    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts.update(w)
            counts.update(f" {w} "[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n))
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * i for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:top]]


@pytest.mark.parametrize("most", [10**6, 0])
def test_language_distances_equal_brute_force(spark, monkeypatch, most):
    """Ranks, out-of-place distances and scores, both with profiles sent out and with profiles joined."""
    monkeypatch.setattr(langid, "SENT_ROWS", most)
    learned = {"aa": ["the cat sat on the mat", "a hat and the bat"], "bb": ["der hund und die katze", "über das öl"], "cc": ["le chat est sur la table"]}
    asked = ["the hat", "und das öl 12", "la table", "zzz qqq", "", None, "12 !", "the hat", "x", "the cat und der hund"]
    profile = langid.profiles(spark.createDataFrame([(x, t) for x, ts in learned.items() for t in ts], "lang string, text string"), top=30)
    got = langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), profile, top=30).collect()
    known = {x: plain_profile(ts, 30) for x, ts in learned.items()}
    assert len(got) == len(asked)
    for r in got:
        mine = plain_profile([asked[r["doc_id"]] or ""], 30)
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        away = {x: sum(abs(p.index(g) - i) if g in p else 30 for i, g in enumerate(mine)) for x, p in known.items()}
        best = min(sorted(away), key=away.get)
        close = {x: 1 - d / (30 * len(mine)) for x, d in away.items()}
        assert r["lang_pred"] == best and abs(r["score"] - (close[best] / sum(close.values()) if sum(close.values()) else 0)) < 1e-9


def test_ngrams_match_plain_counting():
    from collections import Counter

    text = "Été, the THE a1b!"
    plain = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        plain.update(w)
        w = f" {w} "
        plain.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * i for i, c in enumerate(g))
    codes, counts = langid.ngrams(text)
    assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in plain.items()}


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_quality(spark, sf).join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id").toPandas()
    test = got[got.held_out]
    order = test.score.rank()
    good = test.quality == 1
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9 and got.score.between(0, 1).all() and test.predicted[good].mean() > 0.95
    labels = spark.createDataFrame([(1, 1), (9, 0), (4, 0), (9, 1), (3, 7)], "doc_id long, quality int")
    out = quality.scored(odd, quality.train(odd, labels))
    assert out.count() == odd.count() and dict(out.dtypes)["score"] == "double"
    assert {r["score"] for r in quality.scored(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}


def test_quality_gradient():
    r = np.random.default_rng(5)
    m = quality.GatedAttention(6, 4, 3)
    x, sizes, y = r.normal(size=(7, 6)), np.array([3, 4]), np.array([0.0, 1.0])
    starts = np.array([0, 3])
    loss = lambda: -np.mean(y * np.log(m._forward(x, starts, sizes)["y"]) + (1 - y) * np.log(1 - m._forward(x, starts, sizes)["y"]))
    g = m._gradient(x, starts, sizes, y)
    for k, v in m.p.items():
        at = (0,) * v.ndim
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_token_ids_match_the_tokenizer(spark):
    bpe = WordBpe(queries.tokenizer_path("word_bpe_49k.json"), most=500)
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    texts += ["<|endoftext|> a<|endoftext|>b", "É't I'll don't x²³ ½ª", "\x1cfoo\x1d bar", "日本 x　y", "İ ẞß áb", "😀!!'s", "", None, "x\xa0z\x85w"]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.ids(texts)] == [bpe.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, odd, sf):
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = table(spark, sf, "documents")
    for df, size in ((docs, 4096), (docs, 128), (odd, 64)):
        got = packing.pack(df, path, size=size, bucket=16).toPandas()
        bpe = WordBpe(path)
        rows = df.select("doc_id", "text").collect()
        ids = [np.append(np.frombuffer(b, "<u4"), np.uint32(2)) for b in bpe.ids([r["text"] for r in rows])]
        assert got.length.sum() == sum(map(len, ids)) and got.length.max() <= size
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= size
        want = sorted((str(r["doc_id"]), i, zlib.crc32(x[i : i + size].astype("<u4").tobytes())) for r, x in zip(rows, ids) for i in range(0, len(x), size))
        assert sorted((str(None if d != d else int(d)), s, c) for d, s, c in zip(got.doc_id.astype(float), got.start, got.ids_crc32)) == want
        if df is docs:
            assert got.length.sum() / (got.sequence_id.nunique() * size) > 0.95
    assert packing.pack(odd.limit(0), path).count() == 0


def test_patterns_place_every_length():
    r = np.random.default_rng(4)
    h = {int(k): int(n) for k, n in zip(r.integers(1, 513, 200), r.integers(1, 10**9, 200))}
    found = packing.patterns(h, 512)
    back = {}
    for p in found:
        assert p.used() <= 512
        for length, copies in p.runs:
            back[length] = back.get(length, 0) + copies * p.count
    assert back == h


@pytest.mark.parametrize("pool", [["", "x", " ", "'s", "  ", "\n", "hello world " * 3, "z" * 200, " a b" * 400], list("'lrevsmdt  \n!1")])
def test_edits_match_whole_counts(pool):
    c = editcount.counter(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    r = np.random.default_rng(6)
    for text in ["", " ", "a", "it's  \n\n an  edge", "they'lx go", "we'v", "".join(r.choice(list("'lrevs "), 3000)), "the cat sat on the mat " * 90]:
        tree, s = editcount.TokenTree.of(text, c), text
        for _ in range(250):
            a = int(r.integers(0, len(s) + 1))
            b = min(len(s), a + int(r.choice([0, 1, 5, 60, 10**6], p=[0.3, 0.3, 0.2, 0.195, 0.005])))
            new = str(r.choice(pool))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert tree.text == s and tree.tokens == len(c.bpe.encode_ordinary(s)) and sum(n for n, _ in tree.leaves) == len(s)


def test_patterns_equal_plain_shortest_pack_first():
    """Each piece by itself, longest first, into the emptiest sequence with room; where none has room, each piece left of that length opens one."""
    r = np.random.default_rng(11)
    for _ in range(20):
        lengths = sorted(r.integers(1, 65, 300).tolist(), reverse=True)
        packs: list[list[int]] = []
        for n in sorted(set(lengths), reverse=True):
            for left in range(lengths.count(n), 0, -1):
                room = [p for p in packs if sum(p) + n <= 64]
                if not room:
                    packs += [[n] for _ in range(left)]
                    break
                min(room, key=sum).append(n)
        plain = sorted(sum(p) for p in packs)
        found = packing.patterns(dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True)))), 64)
        assert sorted(p.used() for p in found for _ in range(p.count)) == plain


def test_quality_scores_equal_plain_attention(spark, odd):
    model = quality.GatedAttention(seed=3)
    model.mean, model.scale = np.full(quality.WIDTH, 0.1), np.full(quality.WIDTH, 0.5)
    p = model.p
    for r in quality.scored(odd, model).collect():
        h = [np.tanh((x - 0.1) / 0.5 @ p["W"] + p["b"]) for x in quality.encode(r["text"])]
        e = np.array([p["w"] @ (np.tanh(x @ p["V"]) / (1 + np.exp(-x @ p["U"]))) for x in h])
        a = np.exp(e) / np.exp(e).sum()
        want = 1 / (1 + np.exp(-(sum(w * x for w, x in zip(a, h)) @ p["c"] + p["d"][0])))
        assert abs(r["score"] - want) < 1e-9


def test_kept_trees_take_edits(spark):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    c = editcount.counter(path)
    kind = "array<struct<start:long,stop:long,new:string>>"
    long = "the cat sat on the mat " * 900
    rows = [(1, "abc def", [(0, 3, "xyz"), None, (4, None, "q")], 5), (1, "abc def", [(0, 3, "xyz"), None, (4, None, "q")], 5), (2, None, None, 5), (3, "a", [(-5, 99, "")], 5), (None, "they'lx go", [(6, 7, "l")], 5), (4, long, [(9000, 9001, "''")], 5)]
    kept = written(editcount.with_trees(spark.createDataFrame(rows, f"doc_id long, text string, edits {kind}, tokens_before int"), path))
    got = {x["doc_id"]: x for x in editcount.edited_counts(kept, path).collect()}
    want = {1: "xyz def", 2: "", 3: "", None: "they'll go", 4: long[:9000] + "''" + long[9001:]}
    assert {k: x["tokens_after"] for k, x in got.items()} == {k: len(c.bpe.encode_ordinary(t)) for k, t in want.items()}
    assert {k: x["tokens_before"] for k, x in got.items()} == {r[0]: len(c.bpe.encode_ordinary(r[1] or "")) for r in rows}
    assert got[4]["reencoded_chars"] < 200 and got[4]["edited_chars"] == len(long) + 1
    again = written(editcount.edited(kept, path)).withColumn("edits", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit("so ").alias("new"))))
    assert again.count() == len(rows)
    assert {x["doc_id"]: x["tokens_after"] for x in editcount.edited_counts(again, path).collect()} == {k: len(c.bpe.encode_ordinary("so " + t)) for k, t in want.items()}
    assert editcount.edited_counts(kept.limit(0), path).count() == 0


def test_chat_round_trip_and_branches(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "[ROLE]x[/ROLE]", "<", "[", "$1\\", "", None, "a\nb"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "c") for i, t in enumerate(hard)] + [(2, None, None, "n", "c"), (2, 1, "as[ROLE]", "m</s>", "c"), (2, 1, "as[ROLE]", "m</s>", "c"), (None, 0, "user", "x", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string")
    out = chat.formatted(chat.as_tree(df)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    got = {r["conv_id"]: r for r in out}
    assert set(got) == {1, 2}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:10]]
    assert got[1]["loss"] == [r[3] or "" for r in rows[:10] if r[2] == "assistant"]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "n"), ("as[ROLE]", "m</s>"), ("as[ROLE]", "m</s>")]
    assert got[1]["formatted"].count("</s>") == 10
    tree = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 99, 1.0), (1, 6, 7, 50.0), (1, 7, 6, 50.0)] + [(2, i, i - 1 if i else None, None) for i in range(20)]
    messages = spark.createDataFrame([(*t, "user", f"m{t[1]}") for t in tree], "conv_id long, node long, parent long, score double, role string, text string")
    best = chat.paths(messages, branches=2).orderBy("conv_id", "branch", F.desc("depth")).collect()
    named = {}
    for r in best:
        named.setdefault((r["conv_id"], r["branch"]), []).append(r["node"])
    assert named == {(1, 1): [1, 3, 4], (1, 2): [1, 2], (2, 1): list(range(20))}
    assert chat.formatted(messages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 1, None, 2.0, "user", "b"), (1, 1, None, 2.0, "user", "a"), (1, 1, 7, 0.0, "user", "c")], messages.select("conv_id", "node", "parent", "score", "role", "text").schema)
    assert [chat_row["formatted"] for chat_row in chat.formatted(twice).collect()] == ["<s>[ROLE]user[/ROLE][INST]a[/INST]</s>"]


def test_pii_oracle_hash(spark, sf):
    got = queries.op3_pii(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert all(r["base_sha256"] == hashlib.sha256(plain_spans(text[r["doc_id"]]).encode()).hexdigest() for r in got)
