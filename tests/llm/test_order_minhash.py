import hashlib

from pyspark.sql import functions as F

from rheospark.llm import order_minhash as o


def test_edited_texts(spark, sf, texts):
    rows = o.op1_order_minhash(spark, sf).collect()
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    prints = {}
    for r in rows:
        a, b = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(a) // 2
        assert r.n_chars == len(a)
        assert r.edited_sha256 == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(a, r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts) and len(set(prints.values())) == len(prints)
    long = [r for r in rows if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.99 * len(long)


def test_signature_equals_a_plain_one(spark):
    """The signature of a text with repeats, computed again from Spark's hashes with plain Python."""
    text = "a b c a b c a b c d\te f a b c"
    words = text.replace("\t", " ").split(" ")
    hash_of = lambda *cols: spark.range(1).select(F.xxhash64(*cols).alias("h")).first().h
    w = [hash_of(F.lit(x)) for x in words]
    high = lambda h: h >> o.POSITION
    seen, elements = {}, []
    for i in range(len(w) - o.K + 1):
        k = high(hash_of(*[F.lit(x).cast("long") for x in w[i : i + o.K]]))
        n = seen.get(k, 0)
        seen[k] = n + 1
        elements.append((high(hash_of(F.lit(k).cast("long"), F.lit(n))), i))
    bins = {}
    for h, i in sorted(elements):
        bins.setdefault(h >> (64 - o.BIN_BITS - o.POSITION), []).append((i, h))
    want = []
    for b, members in sorted(bins.items()):
        two = [h for _, h in sorted(members[: o.PICK])]
        t = hash_of(*[F.lit(h).cast("long") for h in two])
        want.append((b + (1 << (o.BIN_BITS - 1))) << 32 | (t % (1 << 64)) >> 32)
    got = spark.createDataFrame([(text,)], "t string").select(o.signature(F.col("t")).alias("s")).first().s
    assert sorted(got) == sorted(want)


def test_order_matters_and_edges(spark, weird, empty):
    text = " ".join(f"w{i}" for i in range(300))
    moved = " ".join(text.split()[150:] + text.split()[:150])
    row = spark.createDataFrame([(text, moved)], "a string, b string").select(o.signature(F.col("a")).alias("a"), o.signature(F.col("b")).alias("b"))
    row = row.select(o.likeness(F.col("a"), F.col("b")).alias("n"), o.likeness(F.col("a"), F.col("a")).alias("one")).first()
    assert row.one == 1 and 0.2 < row.n < 0.8
    rows = o.edit_trial(weird.selectExpr("*", "1 AS bucket")).collect()
    assert len(rows) == weird.count() and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert o.edit_trial(empty).collect() == []
    assert o.fingerprints(weird.selectExpr("*", "1 AS Fingerprint")).columns == ["doc_id", "text", "fingerprint"]


def test_neighbours_over_many_buckets(spark):
    docs = spark.createDataFrame([(i * i, f"text {i} " * 5) for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in o.with_next(docs, bucket_bytes=100).collect()}
    text = {i * i: f"text {i} " * 5 for i in range(200)}
    ids = sorted(text, reverse=True)
    assert got == {a: text[b] for a, b in zip(ids, ids[1:] + ids[:1])}
