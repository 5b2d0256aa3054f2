import collections
import random

from rheospark.llm import line_dedup as d
from rheospark.llm.common import WORD

import re


def n_words(s):
    return len(re.findall(r"[^\x20\x09-\x0D]+", s))


def brute(docs, least):
    """docs: (id, text), distinct. What is left of each text."""
    order = sorted(docs)
    first, copies = {}, set()
    for i, t in order:
        if t in first and n_words(t) > least:
            copies.add(i)
        first.setdefault(t, i)
    lines = {i: [(n, x) for n, x in enumerate(t.split("\n")) if n_words(x)] for i, t in order if i not in copies}
    seen, cut = collections.defaultdict(list), collections.defaultdict(set)
    for i, _ in order:
        if i in copies:
            continue
        a = lines[i]
        for p, (_, x) in enumerate(a):
            for j, q in seen[x]:
                b, n = lines[j], 0
                while p + n < len(a) and q + n < len(b) and a[p + n][1] == b[q + n][1]:
                    n += 1
                if sum(n_words(y) for _, y in a[p : p + n]) > least:
                    cut[i] |= {m for m, _ in a[p : p + n]}
            seen[x].append((i, p))
        for (m, _), (o, _) in zip(a, a[1:]):  # lines without words between two deleted ones
            if {m, o} <= cut[i]:
                cut[i] |= set(range(m, o))
    return {i: "" if i in copies else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[i]) for i, t in order}


def test_equals_brute_force(spark, sf, texts):
    got = {r.doc_id: r.text for r in d.op5_line_runs(spark, sf).collect()}
    assert got == brute(list(texts.items()), d.MIN_WORDS)


def test_random_runs_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"l{i} " + "x " * rng.randrange(0, 4) for i in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    docs += [(100, docs[0][1]), (101, "same line\n" * 30)]
    got = {r.doc_id: r.text for r in d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6).collect()}
    assert got == brute(docs, 6)


def test_hot_names_are_salted(spark, monkeypatch):
    """The same result where nearly every repeated line and interval is hot."""
    monkeypatch.setattr(d, "HOT_ROWS", 3)
    monkeypatch.setattr(d, "HOT_SHARE", 1 << 20)
    rng = random.Random(5)
    pool = ["very common line"] * 8 + [f"l{i} " + "x " * rng.randrange(0, 4) for i in range(9)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    docs += [(100 + i, docs[1][1]) for i in range(9)]
    got = {r.doc_id: r.text for r in d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6).collect()}
    assert got == brute(docs, 6)


def test_ranks_are_those_of_the_suffix_array(spark):
    """Ranks of pairs order and group the suffixes as sorting them does."""
    rng = random.Random(7)
    r = [rng.randrange(0, 50) * 2 for _ in range(400)]
    pairs = [(r[i], r[i + 1]) for i in range(399)]
    size = collections.Counter(x for x, _ in pairs)
    start, at = {}, 0
    for x in sorted(size):
        start[x], at = at, at + size[x]
    pairs = [(start[x], start.get(y, 0)) for x, y in pairs]
    ranked = d._pair_ranks(spark.createDataFrame(pairs, "r1 long, r2 long"), 400).collect()
    want = {p: n for p, n in collections.Counter(pairs).items() if n > 1}
    assert {(x.r1, x.r2): x.n for x in ranked} == want
    rank = {(x.r1, x.r2): x.rank for x in ranked}
    order = sorted(rank)
    assert [rank[p] for p in order] == sorted(rank.values()) and len(set(rank.values())) == len(rank)
    assert all(p[0] <= rank[p] < p[0] + sum(n for q, n in collections.Counter(pairs).items() if q[0] == p[0]) for p in order)


def test_edges(weird, empty):
    out = d.dedup_lines(weird.selectExpr("*", "1 AS k", "2 AS N_Lines", "3 AS cuts")).collect()
    assert len(out) == weird.count()
    by = {r.doc_id: r for r in out if r.doc_id not in (None, 4)}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[8].text == "" and by[7].n_deleted_lines > 0
    assert {r.text for r in out if r.doc_id == 4} == {"one"}
    assert all((r.k, r.cuts) == (1, 3) for r in out) and out[0].asDict().keys() == {"doc_id", "text", "k", "cuts", "n_lines", "n_deleted_lines"}
    clash = d.dedup_lines(weird.selectExpr("doc_id AS k", "text", "1 AS t1", "2 AS hit", "3 AS _text", "4 AS doc", "5 AS salt"), key="k").collect()
    assert sorted(str(r.text) for r in clash) == sorted(str(r.text) for r in out) and clash[0].t1 == 1 and clash[0].doc == 4
    assert d.dedup_lines(empty).collect() == []
    assert WORD
