import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from rheospark.llm import simhash as s


def keys_of(prints):
    owner, key = s.golay_keys(np.array(prints, np.uint64))
    return [set(key[owner == i].tolist()) for i in range(len(prints))]


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_up_to_three_bits_share_a_key(word, places):
    a, b = keys_of([word, word ^ sum(1 << p for p in places)])
    assert a & b


@given(st.integers(0, 2**23 - 1), st.sets(st.integers(0, 22), max_size=2))
def test_segments_within_two_bits_share_a_codeword(word, places):
    a, b = s.segment_keys(np.array([word, word ^ sum(1 << p for p in places)]))
    assert set(a.tolist()) & set(b.tolist())


def brute(prints, bits):
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= bits and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


@pytest.mark.parametrize("large", [s.LARGE_RUN, 9])
def test_links_connect_as_all_pairs_do(spark, large):
    rng = np.random.default_rng(1)
    prints = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**63))
        for _ in range(25):
            prints.add(base ^ sum(1 << int(p) for p in set(rng.integers(0, 63, 2))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    links = [(r.u, r.v) for r in s.near_links(df, large=large).collect()]
    from rheospark.llm.graph import components

    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {p: roots.get(p, p) for p in prints} == brute(prints, 3)


def test_components_with_hot_nodes(spark, monkeypatch):
    from rheospark.llm import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 3)
    rng = np.random.default_rng(3)
    links = [(500, int(x)) for x in rng.integers(501, 600, 80)] + [(int(a), int(a) + int(b)) for a, b in zip(rng.integers(0, 400, 150), rng.integers(1, 9, 150), strict=True)]
    links += [(7, 7), (1000, 500), (1001, 1000), None] + links[:5]
    links = [x or (None, 3) for x in links]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(parent) if top(x) != x}


def test_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (5, "ONE two"), (None, "x y z"), (6, "x y z w " * 3000)]
    out = {(r.doc_id, r.fingerprint): r.component_id for r in s.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    zero = "0" * 16
    assert out[1, zero] == out[2, zero] == out[3, zero] == 1
    assert {v for (k, _), v in out.items() if k in (4, 5)} == {4}
    assert [v for (k, _), v in out.items() if k is None] == [None]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_components(empty).collect() == []


def test_fingerprint_counts_repeats():
    import xxhash

    h = [xxhash.xxh64(x, seed=42).intdigest() for x in ("a b a", "b a b", "a b a")]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert s.fingerprint(s.shingle_hashes("A b\ta  b a", 3)) == want
