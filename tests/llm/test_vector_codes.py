import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rheospark.llm import vector_codes as c


def brute(entries, queries):
    d = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)  # argmin takes the first of equal ones


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.sampled_from([1, 3, 40, 2**26]))
def test_tree_finds_what_all_comparisons_find(seed, size, reach):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-reach, reach + 1, (size, 4))  # small reaches give ties and equal entries
    queries = np.concatenate([rng.integers(-reach, reach + 1, (60, 4)), entries])
    at, d, _ = c.nearest(c.build(entries), entries, queries)
    want = brute(entries, queries)
    assert (at == want[0]).all() and (d == want[1]).all()


def test_subtrees_are_ruled_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-(10**6), 10**6, (40, 4))
    entries = np.concatenate([centres + rng.integers(-50, 50, centres.shape) for _ in range(25)])
    queries = entries[::7] + rng.integers(-20, 20, entries[::7].shape)
    _, _, compared = c.nearest(c.build(entries), entries, queries)
    assert compared < 0.2 * len(entries) * len(queries)


def plain_codes(rows, parts, entries, rounds=2, scale=256):
    kept = [(k, label, [math.floor(scale * x) for x in v]) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    cut = np.array([v for *_, v in kept], np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda i: kept[i][0])[:entries]
    books = cut[order].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        found = [brute(books[p], cut[:, p]) for p in range(parts)]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[found[p][0] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    errors = np.sum([f[1] for f in found], axis=0)
    return {k: ("".join(f"{found[p][0][i]:02x}" for p in range(parts)), int(errors[i])) for i, (k, _, _) in enumerate(kept)}, books


@pytest.mark.parametrize("entries", [3, 64])
def test_codes_as_brute_force(spark, entries):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12).astype(np.float32)], int(i) % 4 or None) for i in rng.permutation(120)]
    rows += [(200 + i, rows[0][1], 1) for i in range(70)]  # many copies
    rows += [(-1, None, 1), (-2, [0.5] * 11 + [None], 1), (-3, [float("nan")] + [0.0] * 11, None), (-4, [float("inf")] * 12, 2), (-5, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, books = c.product_codes(df, parts=4, entries=entries)
    got = {r.id: (r.code, r.error) for r in codes.collect()}
    want, entries = plain_codes(rows, 4, entries)
    assert got == want and (books.entries == entries).all()


def test_sums_of_labels_with_nulls_and_hot_ones(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else i % 7, i) for i in range(4000)]
    df = c.written(spark.createDataFrame(rows, "id long, label int, error long").withColumn("code", c.F.lit("x")), "t")
    want = {}
    for _, label, e in rows:
        want[label] = want.get(label, 0) + e
    out = c.add_sums(df, "label", "error", "label_error").collect()
    assert len(out) == 4000 and all(r.label_error == want[r.label] for r in out)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error long, v int, id int"
    assert c.product_codes(spark.createDataFrame([], schema))[0].collect() == []
    rows = [(None, [1.0] * 16, None, "x", 1, 1, 1), (1, [1.0] * 16, None, "y", 1, 1, 1), (1, [1.0] * 16, None, "y", 1, 1, 1), (2, [1.0] * 32, 3, "z", 1, 1, 1), (3, [2.0] * 15, 3, "z", 1, 1, 1)]
    codes, books = c.product_codes(spark.createDataFrame(rows, schema))
    out = codes.collect()
    assert sorted((str(r.id), r.code, r.error) for r in out) == [("1", "00" * 16, 0), ("1", "00" * 16, 0), ("None", "00" * 16, 0)]
    assert books.entries.shape == (16, 3, 1)
    with pytest.raises(Exception, match="beyond"):
        c.product_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<float>, label int"))


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({c.OP11_SQL})").fetchall()
    assert sorted(map(tuple, c.op11_gnat_codes(spark, sf).select(*names).collect())) == sorted(want)
