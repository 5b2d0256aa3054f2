import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rheospark.llm import exact_dedup as e


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, min(known) if known else None, len(keys), digest) for k in keys]
    return sorted(out, key=str), len(groups)


def plain(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_groups_as_brute_force(spark, parts):
    rows = [(i, f"copy  of\n{i % 3}") for i in range(90)] + [(1000 + i, "the  same") for i in range(60)] + [(2000 + i, "p" * 100 + str(i // 2)) for i in range(40)]
    rows += [(None, "the same"), (None, "only nulls"), (None, "only nulls"), (5000, " "), (5001, "\t\n"), (5002, ""), (5003, None), (5004, "É x"), (5005, "É\x0bx"), (5006, "long " * 30000), (5007, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = e.exact_groups(df, parts=parts)
    want, groups = brute(rows)
    assert plain(out) == want
    kept = out.where("kept")
    assert kept.count() == groups
    assert kept.where("not (doc_id <=> keep_id)").count() == 0


def test_texts_whose_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(e.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.length(c[0]) * 0)
    rows = [(i, "q" * 80 + "abc"[i % 3]) for i in range(300)] + [(1000 + i, "z" + str(i % 5)) for i in range(50)]
    out = e.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), parts=9)
    assert plain(out) == brute(rows)[0]
    assert out.where("kept").count() == 8


def test_weird_and_empty_tables(spark, weird, empty):
    rows = [tuple(r) for r in weird.collect()]
    assert plain(e.exact_groups(weird)) == brute(rows)[0]
    assert e.exact_groups(weird).where("kept").count() == brute(rows)[1]  # repeated rows too: one stays
    assert e.exact_groups(empty).collect() == []
    assert e.exact_groups(empty).columns == ["doc_id", *e.VERDICT]


def test_kept_rows_come_whole_and_names_may_clash(spark):
    rows = [(2, "a  b", "x", 1, 1.5), (1, "a b", "y", None, 2.5), (3, "c", None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string, _run int, Kept double")
    out = e.keep_first(df)
    assert sorted(tuple(r) for r in out.select("doc_id", "text", "`odd name`").collect()) == [(1, "a b", "y"), (3, "c", None)]
    assert e.exact_groups(df.withColumnRenamed("doc_id", "group_id"), "group_id").count() == 3
    text = df.select(F.col("doc_id").cast("string").alias("name"), "text")
    assert {r.keep_id for r in e.exact_groups(text, "name").collect()} == {"1", "3"}


def test_heads_of_a_slice_are_whole():
    """A task's first run has more texts in a batch, behind others: those texts, and nothing else, come out (F1)."""
    texts = pa.array([f"text {i} " * 5 for i in range(1000)])
    for lo, hi, which in ((8, 10, 0), (3, 1000, 5), (0, 10, 9), (7, 1000, None)):
        marked = np.zeros(hi - lo, bool)
        marked[which : None if which is None else which + 1] = which is not None
        heads = e._only(texts, np.arange(lo, hi), marked)
        heads.validate(full=True)
        assert heads.to_pylist() == [texts[lo + i].as_py() if m else None for i, m in enumerate(marked)]


def sorted_rows(texts, start):
    keys = pa.array(range(start, start + len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([keys, keys, pa.array(texts), pa.array([7] * len(texts), pa.int64())], ["_k", "_key", "_t", "_hash"])


def test_a_task_whose_first_hash_goes_on_behind_other_rows(monkeypatch):
    """The first run's hash is that of texts in the middle of later batches too, which are slices of them (F1)."""
    monkeypatch.setattr(e, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)})())}))
    texts = [f"{i // 2:04d} some text" for i in range(64)]
    for cut in (1, 8, 9, 20):
        out = list(e._verdicts(["doc_id", *e._FOUND], 1)(iter([sorted_rows(texts[:cut], 0), sorted_rows(texts[cut:], cut)])))
        for batch in out:
            batch.validate(full=True)
        rows = [r for b in out for r in b.to_pylist() if not r["_more"]]
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {i: (i - i % 2, 2) for i in range(64)}
        assert [r["_head"] for r in rows if r["_head"] is not None] == sorted(set(texts))


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({e.OP12_SQL})").fetchall()
    got = e.op12_content_sort(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
