import math
import zlib

import pytest

from rheospark.llm import toxicity as t


def test_folding():
    assert t.fold("  ÉTÉ, 1d10t! Іdіоt 42 $cum x_y") == " ete idiot idiot 42 scum x y "
    assert t.fold(None) == "  "
    assert t.fold("мир и сосна Ὀδύσσεια") == " мир и сосна οδυσσεια "  # one script: no look-alikes
    assert t.fold("stuрid мо1он") == " stupid моiон ".replace("моiон", t.fold("мо1он").strip())


def test_exceptions_and_weights():
    a = t.Lexicon().automaton()
    of = lambda s: t.features(t.pd.Series([s]), a)[0][1]
    assert of("put it into the trash can") == 0 < of("you trash") == of("YOU TR4SH!!")
    assert of("clownish trashy") == 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in t.op10_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].predicted, v) for k, v in labels.items() if got[k].held_out]
    assert sum(p == v for p, v in held) / len(held) > 0.95


def test_edges(spark, weird, empty):
    out = t.score(weird.selectExpr("*", "'x' AS Score"), t.Lexicon()).collect()
    assert len(out) == weird.count() and len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert t.score(empty, t.Lexicon()).collect() == []
    none = spark.createDataFrame([], "text string, toxic int, weight double")
    assert t.learn(none).curve == t.Lexicon().curve


def plain_features(text, lexicon):
    """What features() counts, with every term looked for at every place."""
    folded = t.fold(text)
    best, spared = {}, []
    for term, weight in lexicon.weights.items():
        at = folded.find(term)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), weight)
            at = folded.find(term, at + 1)
    for phrase in lexicon.exceptions:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            spared.append((at, at + len(phrase) + 1))
            at = folded.find(f" {phrase} ", at + 1)
    total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in spared))
    n = folded.count(" ") - 1
    return [1.0, math.log1p(total), total / (n + 20), math.log1p(n)]


def test_scores_as_brute_force(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon = t.learn(t.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = {r.doc_id: r for r in t.op10_toxicity(spark, sf).collect()}
    odd = ["", None, "a trash can full of trash", "clown fish are no clowns, cl0wn!", "IDIOT іdіоt 1d10t", "pond scum scum"]
    for text in odd:
        assert list(t.features([text], lexicon.automaton())[0]) == pytest.approx(plain_features(text, lexicon)), text
    for doc_id, text in texts.items():
        at = sum(c * x for c, x in zip(lexicon.curve, plain_features(text, lexicon), strict=True))
        assert rows[doc_id].score == pytest.approx(1 / (1 + math.exp(-at)), abs=1e-9) and rows[doc_id].predicted == (rows[doc_id].score >= 0.5)


def test_labelled_sample_with_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 1, 2.0) for i in range(40)] + [(None, "no key", 1, 1.0)], "doc_id long, text string, toxic int, weight double")
    labels = spark.createDataFrame([(i, i % 3, "x") for i in range(40)] + [(None, 1, "x"), (3, None, "x"), (6, 0, "y")], "doc_id long, toxic int, text string")
    out = t.labelled_sample(docs, labels).collect()
    held = {r.doc_id for r in docs.where(t.held_out()).collect()}
    assert sorted((r.text, r.toxic) for r in out) == sorted([(f"text {i}", i % 3) for i in range(40) if i % 3 < 2 and i not in held] + ([("text 6", 0)] if 6 not in held else []))
    assert t.labelled_sample(docs, labels.limit(0)).collect() == []
