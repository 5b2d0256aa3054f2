import collections
import re

from rheospark.llm import quality as q


def plain(text):
    """The counts of the contract, written out."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark, sf, texts):
    for r in q.op6_repetition_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdict_on_repetition():
    clean = " ".join(f"w{i}" for i in range(200))
    assert q.measure(clean)[-1]
    assert not q.measure(clean + "\n" + clean)[-1]
    assert not q.measure(" ".join(f"w{i % 7}" for i in range(200)))[-1]


def test_edges(weird, empty):
    rows = q.repetition_rules(weird).collect()
    assert len(rows) == weird.count()
    assert all(not r.kept and r.n_words == 0 for r in rows if not (r.text or "").strip())
    assert q.repetition_rules(empty).collect() == []


def test_clashing_columns(weird):
    out = q.repetition_rules(weird.selectExpr("*", "'x' AS N_Words", "1 AS extra"))
    assert [c.lower() for c in out.columns].count("n_words") == 1 and "extra" in out.columns
    assert dict(out.dtypes)["n_words"] == "bigint"


def test_later_copies_only_count():
    marks, top, at = q.repeats(q.np.array([5, 3, 5, 5, 1]))
    assert marks.tolist() == [False, False, True, True, False] and (top, at) == (3, 0)
    assert q.repeats(q.np.array([5, 3, 5]), first_too=True)[0].tolist() == [True, False, True]
