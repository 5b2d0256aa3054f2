import re

import duckdb

from rheospark.llm import mixing as m
from pyspark.sql import functions as F


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing anew until none is above its limit."""
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else rest * w[s] / total for s in names}
        full |= over


def test_budgets(spark, sf, texts):
    rows = m.op9_mix_sources(spark, sf).collect()
    assert {r.doc_id: r.size for r in rows} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", v)) for k, v in texts.items()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = fill(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s]) for s in sizes)
    assert [tuple(r) for r in m.op9_mix_sources(spark, sf).orderBy("doc_id").collect()] == sorted(tuple(r) for r in rows)


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cursor = con.execute(m.OP9_SQL)
    names = [c[0] for c in cursor.description]
    df = m.op9_mix_sources(spark, sf)
    key = lambda rows, order: sorted(tuple(str(r[i]) for i in order) for r in rows)
    assert key(cursor.fetchall(), [names.index(c) for c in df.columns]) == key(df.collect(), range(len(names)))


def test_edges_and_copies(spark, weird, empty):
    docs = weird.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("s"))).withColumn("Taken", F.lit(9))
    out = m.mix(docs, m.n_words(F.col("text")), m.random_key())
    rows = out.collect()
    assert len(rows) == weird.count() and all(r.taken == 0 for r in rows if not (r.text or "").strip())
    total = sum(r.taken for r in rows)
    made = m.copies(out).select(m.n_words(F.col("text")).alias("n")).collect()
    assert sum(r.n for r in made) == total
    none = empty.withColumn("source", F.lit("x"))
    assert m.mix(none, m.n_words(F.col("text")), m.random_key()).collect() == []
