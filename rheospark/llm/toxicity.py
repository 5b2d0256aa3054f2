"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded texts and normalised by length.

Folding undoes case, accents, look-alike letters and digits that stand for letters. The lexicon has fixed general terms
and terms learned from labelled texts: words, and stems that words begin with, which stand in significantly more
contexts (different neighbours, so that copies count once) of toxic texts than their share of all words explains. A
match inside an exception phrase doesn't count. A logistic curve over the summed weights, their sum per word and the
length gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, least_hashes, small_arrow_batches, table, written

#: Letters that look like others, and digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("аеорсхуіѕјԁһԛԝкмтвναορτυεκιı", "aeopcxyisjdhqwkmtbvaoptuekii", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: General terms with a weight of their own, until labels say more.
GENERAL = """
    idiot moron stupid dumb trash scum loser clown pathetic worthless disgusting imbecile jerk scumbag bastard bitch
    asshole retard filthy vermin pig freak creep
""".split()
GENERAL_WEIGHT = 3.0
#: Phrases whose words aren't meant as insults.
EXCEPTIONS = ("clown fish", "pond scum", "scum line", "trash can", "trash bin", "trash collection", "guinea pig", "dumb bell")
#: Labelled texts of either class to learn from, at most; the least evidence (log-likelihood ratio, 24 is about one in a
#: million) and the fewest contexts of a term; lengths of stems.
SAMPLE, EVIDENCE, CONTEXTS, STEMS = 5000, 24.0, 5, (4, 7)

_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()}
#: A word of Latin letters (or signs for them) and Greek or Cyrillic ones: those stand for Latin letters there. A word of
#: one script stays what it is.
_MIXED = re.compile(r"[\w@$]*(?:[a-z0-9@$][\w@$]*[Ͱ-ԯ]|[Ͱ-ԯ][\w@$]*[a-z])[\w@$]*")
_SIGN = re.compile(r"[0-9@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$|]+")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words of a text in their plain form, parted by one space, with a space at either end."""
    text = (text or "").casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text).replace("ı", "i") if not unicodedata.combining(c))
        text = _MIXED.sub(lambda m: m[0].translate(_TABLE), text)
    if _SIGN.search(text):  # only beside letters: a number stays a number
        text = _SIGN.sub(lambda m: "".join(DIGITS.get(c, c) for c in m[0]), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights: " word " for a word, " stem" for what begins with it; coefficients of the logistic curve."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": GENERAL_WEIGHT for w in GENERAL})
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-3.0, 2.0, 20.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def features(texts: pd.Series, automaton) -> np.ndarray:
    """Rows of 1, log of the summed weights, sum per word, log of the length."""
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (length, weight) in automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in spared))
        n = folded.count(" ") - 1
        out[i] = 1.0, np.log1p(total), total / (n + 20), np.log1p(n)
    return out


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = fold(text).split()
            rows = pd.DataFrame({"word": words, "before": ["", *words[:-1]][: len(words)], "after": [*words[1:], ""][: len(words)]})
            yield rows.drop_duplicates().assign(toxic=int(toxic))


def learn(labelled: DataFrame) -> Lexicon:
    """labelled: text, toxic (0 or 1), weight (rows of the class for each sampled row); at most 2 * SAMPLE rows.

    Without rows of both classes: the general terms with a fixed curve.
    """
    small_arrow_batches(labelled.sparkSession, 200)
    sample = written(labelled.select("text", "toxic", "weight"), "labelled")
    classes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon()
    if not (classes.get(0) and classes.get(1)):
        return lexicon
    found = sample.select("text", "toxic").mapInPandas(_contexts, "word string, before string, after string, toxic int")
    words = found.distinct().groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    words = written(words, "words")
    n_a, n_b = words.agg(F.sum("a"), F.sum("b")).first()
    stems = [F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in range(STEMS[0], STEMS[1] + 1)]
    terms = words.select("a", "b", F.explode(F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *stems))).alias("term"))
    terms = terms.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = n_a / (n_a + n_b)
    part = lambda x, of, p: F.when(x > 0, x * F.log(x / (of * p))).otherwise(0.0)
    both = F.col("a") + F.col("b")
    evidence = 2 * (part(F.col("a"), both, share) + part(F.col("b"), both, 1 - share))
    # far more often toxic than not: in common words a small shift is significant too
    terms = terms.withColumn("evidence", evidence).where((F.col("a") >= CONTEXTS) & (F.col("evidence") >= EVIDENCE))
    terms = terms.withColumn("w", F.log((F.col("a") + 0.5) / (n_a + 1.0)) - F.log((F.col("b") + 0.5) / (n_b + 1.0))).where("w > 2")
    # each term has CONTEXTS contexts in the bounded sample, which bounds their number too
    for r in terms.orderBy(F.desc("evidence"), "term").collect():
        lexicon.weights[r.term] = r.w
    rows = sample.select(_features(F.col("text"), lexicon).alias("x"), "toxic", "weight").collect()
    lexicon.curve = tuple(_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), np.array([r.weight for r in rows], float)))
    return lexicon


def _features(text: Column, lexicon: Lexicon) -> Column:
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            yield pd.Series(list(features(texts, automaton)))

    return F.pandas_udf(make, "array<double>")(text)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; at most 2 * SAMPLE rows."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, beta, weight = x / scale, np.zeros(x.shape[1]), weight / weight.sum() * len(y)
    penalty = np.diag([1e-6, *[ridge * len(y)] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T * (weight * p * (1 - p)) @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to every row of docs, from its whole text.

    Null and empty texts have the score of a text of no words. Repeated rows: each has its own, equal result. Columns
    of docs named like the new ones are replaced. Empty table: empty result.
    """
    small_arrow_batches(docs.sparkSession)
    docs = drop_clashes(docs, ["score", "predicted", "_x"], keep=(text,)).withColumn("_x", _features(F.col(f"`{text}`"), lexicon))
    at = sum((F.lit(float(c)) * F.col("_x")[i] for i, c in enumerate(lexicon.curve)), F.lit(0.0))
    docs = docs.withColumn("score", 1 / (1 + F.exp(-at)))
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_x")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """text, toxic, weight of at most `most` labelled rows of each class that aren't held out, by the order of a hash of the key (ties:
    the key). Null keys and labels other than 0 and 1 are left out; a key with several labels or documents gives a row
    for each pair; other columns of either table aren't read, whatever their names; an empty table gives no rows."""
    usable = labels.where(~held_out(key) & F.col(f"`{key}`").isNotNull() & F.col(label).isin(0, 1)).select(F.col(f"`{key}`").alias(key), F.col(label).cast("int").alias("toxic"))
    picked = None
    for value in (0, 1):
        of_class = usable.where(F.col("toxic") == value)
        count = of_class.count()
        rows = least_hashes(of_class.withColumn("_h", F.xxhash64(key)), count, most, "_h", key).drop("_h")
        rows = rows.withColumn("weight", F.lit(max(1.0, count / most)))
        picked = rows if picked is None else picked.unionByName(rows)
    # what is broadcast has at most 2 * most rows of a key, a label and a weight
    return docs.select(F.col(f"`{key}`"), "text").join(F.broadcast(picked), key).select("text", "toxic", "weight")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
