"""Personal data: pattern spans with checks, and terms that corpus co-occurrence shows to disclose protected entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Kinds in the order of output: pattern, a cheap test that must hold first, placeholder. The patterns find what
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ | [0-9]+(\.[0-9]+){3} | [0-9]([ -]?[0-9])+ |
#: \+[0-9][ ().0-9-]+[0-9] find, but are possessive and begin only at the start of a run, so long texts take linear time.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), "<EMAIL>"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), "<IP>"),
    "card": (r"[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9][ -]?[0-9]"), "<CARD>"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), "<PHONE>"),
}
TERM = r"\p{L}++"
#: Matches of a text are folded in chunks of so many, since each step of a fold copies what it has so far.
CHUNK = 64
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's checksum: every second digit from the right is doubled, and 9 taken off where that exceeds 9."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, test: Column) -> Column:
    """start, end (code points) and value of each leftmost non-overlapping match, from the pieces between the matches."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    begin = lambda at, out: F.struct(at.cast("long").alias("at"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["piece"])
        last = first + F.length(x["value"])
        return begin(last, F.array_append(acc["out"], F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value"))))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, begin(acc["at"], empty), step)
        return F.transform(F.array(done), lambda r: begin(r["at"], F.array_append(acc["out"], r["out"])))[0]

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(values)).alias("piece"), values.alias("value"))

    def folded(all_pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_pairs, c * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(chunks, begin(F.lit(0), F.array().cast("array<array<struct<start:bigint,end:bigint,value:string>>>")), chunk)["out"])

    return F.when(test, F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, folded(p)).otherwise(empty))[0]).otherwise(empty)


def found(text: Column) -> dict[str, Column]:
    """The base matches of each kind that pass their check."""
    passes = lambda kind: lambda m: valid(kind, m["value"])
    return {kind: F.filter(matches(text, pattern, test(text)), passes(kind)) for kind, (pattern, test, _) in KINDS.items()}


def merged(spans: Column) -> Column:
    """Spans in order of place; those that overlap become one, of the first one's kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        joins = (F.size(out) > 0) & (s["start"] < F.try_element_at(out, F.lit(-1))["end"])
        return F.when(joins, F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), longer)).otherwise(F.array_append(out, s))

    def one(found: Column) -> Column:
        overlap = F.exists(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda i: F.get(found, i)["start"] < F.get(found, i - 1)["end"])
        return F.when(overlap, F.aggregate(found, empty, step)).otherwise(found)

    return F.transform(F.array(order), one)[0]


def generalised(text: Column, spans: Column) -> Column:
    """text with each of the spans (merged, in order) replaced by the mark of its kind."""
    mark = lambda s: F.coalesce(*(F.when(s["kind"] == k, F.lit(m)) for k, (_, _, m) in KINDS.items()), F.lit("<TERM>"))

    def whole(found: Column) -> Column:
        end = lambda i: F.coalesce(F.get(found, i)["end"], F.lit(0).cast("long")).cast("int")
        parts = F.transform(found, lambda s, i: F.concat(F.substring(text, end(i - 1) + 1, (s["start"] - end(i - 1)).cast("int")), mark(s)))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(found) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.transform(F.array(spans), whole)[0]).otherwise(text)


def cooccurring_terms(docs: DataFrame, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """mark (md5 of a text), terms: the terms to sanitise in the texts with that mark, wherever in the text they stand.

    Every base match is a protected entity e, every word (run of letters), lower-cased, a term t, also one within a mention, as
    a name in an address. Counted in whole distinct texts, so that copies count once: n(t, e), n(t), n(e), of N. e has
    the information IC(e) = ln(N / n(e)), and t reveals PMI(t; e) = ln(n(t, e) N / (n(t) n(e))) of it. t discloses e if
    PMI >= threshold * IC, IC > 0 and at least `support` texts have both. A disclosing term is sanitised in every text that
    has it, since a text that names the term alone discloses the entity too.

    The bounds are exact: n(t, e) is at most n(e), and at most m(t), the number of texts with any entity that have t. So
    entities in fewer than `support` texts and terms with m(t) < support have no pair that could disclose, a term that fails
    with n(t, e) = n(e) = m(t) fails with all entities, and a text's terms and entities are paired only where they hold
    with n(t, e) = min(n(e), m(t)). n(t) is counted without a shuffle of texts: k copies of a text add k rows to the group (t, k).
    """
    text = docs.select(F.col("text"), F.md5(F.col("text").cast("binary")).alias("mark")).where("text is not null")
    copies = written(text.groupBy("mark").agg(F.count("*").alias("copies")))
    total = copies.agg(F.count("*").cast("double").alias("n")).collect()[0]["n"]
    kinds = [F.transform(v, lambda m, k=k: F.concat(F.lit(f"{k}:"), F.lower(m["value"]))) for k, v in found(F.col("text")).items()]
    mentions = written(text.select("mark", F.explode(F.array_distinct(F.concat(*kinds))).alias("entity")).distinct())
    n_e = written(mentions.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total)))
    kept = written(mentions.join(small(n_e, 200_000), "entity"))
    marks = written(kept.select("mark").distinct())
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    texts = written(text.join(small(marks, 200_000), "mark", "left_semi").dropDuplicates(["mark"]).select("mark", words.alias("words")))
    held = texts.select("mark", F.explode("words").alias("term"))
    m_t = written(held.groupBy("term").agg(F.count("*").alias("m_t")).where(F.col("m_t") >= support))

    def discloses(both, n_e) -> Column:
        pmi, ic = F.log(both * total / (F.col("n_t") * n_e)), F.log(total / n_e)
        return pmi >= threshold * ic - 1e-9

    many = small(copies.where("copies > 1"), 200_000)
    every = text.join(many, "mark", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(words).alias("term"))
    every = every.join(small(m_t.select("term"), 200_000), "term", "left_semi").groupBy("term", "copies").agg(F.count("*").alias("rows"))
    n_t = every.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("n_t"))
    viable = written(n_t.join(m_t, "term").where(discloses(F.col("m_t"), F.col("m_t"))))
    has = written(held.join(small(viable, 200_000), "term"))
    pairs = has.join(small(kept, 200_000), "mark")
    n_te = pairs.where(discloses(F.least("n_e", "m_t"), F.col("n_e"))).groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te"))
    chosen = written(n_te.where((F.col("n_te") >= support) & discloses(F.col("n_te"), F.col("n_e"))).select("term").distinct())
    named = text.select("mark", F.explode(words).alias("term")).join(small(chosen, 200_000), "term", "left_semi")
    return written(named.groupBy("mark").agg(F.array_sort(F.collect_set("term")).alias("terms")))


def sanitised(docs: DataFrame, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """docs with base (array of kind, start, end by kind and place), spans (base, then terms) and clean (the sanitised text).

    Base spans are those of KINDS that pass their checks (ip: parts up to 255; card: 16 to 19 digits and Luhn; phone: 8 to 15
    digits); a failing match is dropped and not tried again. Terms come from cooccurring_terms(); all their occurrences in the
    text as whole words count, except those that overlap a base span. In clean, every span is gone: base spans are
    generalised to a placeholder for their kind (overlapping ones to one, of the first one's kind) and terms to <TERM>.

    Null text counts as empty; rows, null ids and repeated rows stay as they are. Other columns named base, spans or clean
    are replaced. The texts aren't shuffled as long as the table of terms is small enough to broadcast.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans", "clean")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("pii_row"))  # so no other name can clash
    whole = F.col("pii_row")["text"]
    text = F.coalesce(whole, F.lit(""))
    terms = cooccurring_terms(docs.select("text"), threshold, support).select(F.col("mark").alias("pii_mark"), F.col("terms").alias("pii_terms"))
    rows = rows.withColumn("pii_found", F.md5(whole.cast("binary")))
    rows = rows.join(small(terms, 200_000), F.col("pii_found") == F.col("pii_mark"), "left")
    span = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = F.concat(*(F.transform(v, span(k)) for k, v in found(text).items())).cast(f"array<{SPAN}>")
    rows = rows.withColumn("base", base)
    known = F.filter(matches(text, r"\p{L}++", F.col("pii_terms").isNotNull()), lambda m: F.array_contains("pii_terms", F.lower(m["value"])))
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    extra = F.transform(F.filter(known, apart), span("term"))
    rows = rows.withColumn("spans", F.concat("base", extra).cast(f"array<{SPAN}>"))
    clean = generalised(text, merged(F.col("spans")))
    return rows.withColumn("clean", F.when(whole.isNotNull(), clean)).select("pii_row.*", "base", "spans", "clean")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
