import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheospark.llm import phrases as p


def brute(rows, least, longest=5, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {x: c for x, c in counts.items() if c >= least}
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [c for (x, w), c in frequent.items() if x == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * c >= 100 * a for c in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), frequent[lang, words[:k]], frequent[lang, words[k:]]))
    return sorted((lang, i + 1, w.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, w, left, right) in enumerate(sorted(found)[:top]))


def some_rows(seed=3):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "cat", "sat", "ÉTÉ", "été", "on", "mat", "x y", "日本", "a", "b"]
    stops = [" ", " ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!", " ?"]
    rows = [(["en", "fr", None, "und", "de"][int(rng.integers(5))], "".join(words[int(rng.integers(len(words)))] + stops[int(rng.integers(len(stops)))] for _ in range(int(rng.integers(0, 60))))) for _ in range(150)]
    return rows + [("en", "new york city is big " * 30), ("en", None), ("en", ""), (None, "..,; \t\n"), ("zz", "once"), ("rare", "so so so so so so so so so so so so")]


@pytest.mark.parametrize(("shard", "least", "top"), [(10**9, 8, 2000), (700, 8, 2000), (1, 12, 5), (3000, 3, 40)])
def test_phrases_as_brute_force(spark, monkeypatch, shard, least, top):
    monkeypatch.setattr(p, "RARE", 20)
    rows = some_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, p.collocations(df, least=least, top=top, shard_bytes=shard).collect()))
    assert got == brute(rows, least, top=top)


def test_a_small_filter_lets_more_pass_but_none_is_lost(spark):
    rows = some_rows(4)
    got = p.collocations(spark.createDataFrame(rows, "lang string, text string"), least=8, filter_bits=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 8)


@pytest.mark.parametrize(("shard", "bits", "by_size"), [(700, 24, True), (10**9, 24, True), (1, 8, True), (700, 24, False)])
def test_size_by_size_as_in_two_passes(spark, shard, bits, by_size):
    rows = some_rows(6)
    df = spark.createDataFrame([("und" if a is None else a, b or "") for a, b in rows], "lang string, text string").repartition(3)
    got = p.frequent_phrases(df, p.word_totals(df), 8, filter_bits=bits, shard_bytes=shard, size_by_size=by_size).collect()
    want = p.frequent_phrases(df, p.word_totals(df), 8, shard_bytes=10**9, size_by_size=False).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_few_phrases_pass_at_a_support_of_one():
    """At a support of one all phrases are frequent in some shard (F2). With all sizes at once they fill the counters, and nearly every
    phrase is counted again and handed on as text; size by size few are, and none is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(f"r{int(i)}" for i in rng.integers(0, 3000, 7)) + " so it is" for _ in range(12_000)]
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * 12_000), pa.array(texts)], ["lang", "text"])
    n, least, shard, whole = 12_000 * 10, 100, 1, p.Shard(rows.column(0), rows.column(1))
    frequent = {size: len(first) for size, first, _ in whole.levels(5, lambda f, c, _: c >= least)}
    bits = max(1, int(np.ceil(np.log2(n / (p.LOAD * least)))))

    def counters(found):
        out, missed = np.zeros((2 << bits >> min(p.BLOCK_BITS, bits), 1 << min(p.BLOCK_BITS, bits)), np.uint8), np.zeros(1 << p.LANG_BITS, np.int64)
        for b in p._blocks_added(least)(iter(found)):
            if b.column(0)[0].as_py() < 0:
                missed = np.frombuffer(b.column(1)[0].as_buffer(), np.int64)
            else:
                out[b.column(0)[0].as_py()] = np.frombuffer(b.column(1)[0].as_buffer(), np.uint8)
        return out.reshape(2, -1), missed

    shared = lambda x: type("B", (), {"value": x.tobytes()})()
    low, missed = counters(p._mine({"en": n}, {"en": 1}, least, 5, bits, shard)(iter([rows])))
    at_once = sum(b.num_rows for b in p._count(shared(low), missed, {"en": 1}, least, 5, bits, shard)(iter([rows])))
    held = np.zeros((2, 1 << bits >> 3), np.uint8)
    for size in range(1, 6):
        held |= np.packbits(counters(p._mine_size(shared(held), size, least, bits, shard)(iter([rows])))[0] >= least, axis=1)
    found = pa.Table.from_batches(p._added(p._count_held(shared(held), 5, bits, shard)(iter([rows])), "f"))
    sums = {r["phrase"]: r["f"] for r in found.to_pylist() if r["f"] >= least}
    assert len(sums) == sum(frequent.values()) and sums["so it is"] == 12_000
    assert found.num_rows < at_once / 5


def test_local_support_prunes():
    import pyarrow as pa

    shard = p.Shard(pa.array(["en"] * 3), pa.array(["a b c a b c", "a b. c", "x y z"]))
    found = {size: dict(zip(shard.phrases(first, size).to_pylist(), counts.tolist(), strict=True)) for size, first, counts in shard.levels(5, lambda f, c, _: c >= 2)}
    assert found == {1: {"a": 3, "b": 3, "c": 3}, 2: {"a b": 3, "b c": 2}, 3: {"a b c": 2}, 4: {}}


def test_scores_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 7 * 10**12)], "lang string, total long")
    row = p.score_cuts(frequent, totals).first()
    assert (row.l, row.r, row.score) == (4 * 10**12, 5 * 10**12, 1000 * 3 * 10**12 * 7 * 10**12 // (20 * 10**24))


def test_odd_tables(spark, weird, empty):
    assert p.collocations(empty.withColumn("lang", F.lit("en"))).collect() == []
    rows = [(None, r.text) for r in weird.collect()]
    df = weird.select(F.lit(None).cast("string").alias("lang"), "text", F.lit(1).alias("phrase"), F.lit(2).alias("f"), F.lit("x").alias("size"))
    assert sorted(map(tuple, p.collocations(df).collect())) == brute(rows, 100)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({p.OP13_SQL})").fetchall()
    got = p.op13_son_phrases(spark, sf).collect()
    assert len(want) > 10
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("shard", [10**9, 20_000, 500])
def test_what_a_task_of_the_first_pass_hands_on_does_not_grow_with_what_its_shards_report(shard):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.3, 400) if i < 10**9) for _ in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), pa.array(texts)], ["lang", "text"])
    n, bits, least = sum(len(t.split()) for t in texts), 18, 40
    found = list(p._mine({"en": n}, {"en": 1}, least, 3, bits, shard)(iter([rows])))
    assert [b.schema.names for b in found] == [["block", "counters"]] * len(found)
    assert sum(b.num_rows for b in found) <= 1 + (2 << bits >> p.BLOCK_BITS)
    counters, missed = np.zeros((2 << bits >> p.BLOCK_BITS, 1 << p.BLOCK_BITS), np.uint8), None
    for b in p._blocks_added(least)(iter(found)):
        if b.column(0)[0].as_py() < 0:
            missed = np.frombuffer(b.column(1)[0].as_buffer(), np.int64)
        else:
            counters[b.column(0)[0].as_py()] = np.frombuffer(b.column(1)[0].as_buffer(), np.uint8)
    whole, low, high = p.Shard(rows.column(0), rows.column(1)), *counters.reshape(2, -1)
    assert missed[1] < least
    for size, first, counts in whole.levels(3, lambda f, c, _: c >= least):
        a, b = p._places(whole.hashes(first, size, {"en": 1}), bits)
        assert len(first) and (np.minimum(low[a], high[b]) + missed[1] >= least).all()


def test_counters_stop_at_the_global_count():
    counters = np.zeros(4, np.uint8)
    p._raise(counters, np.array([1, 1, 2, 3]), np.array([30, 40, 5, 10**6]), 100)
    p._raise(counters, np.array([1, 2]), np.array([60, 1]), 100)
    assert counters.tolist() == [0, 100, 6, 100]
