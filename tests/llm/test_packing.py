import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rheospark.llm import packing as p
from rheospark.llm import training_order as t
from rheospark.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(p.TOKENIZER))
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_give_the_ids_of_whole_texts(whole):
    texts = ["", " \n", "İstanbul can't DON'T we've.", "Σίσυφος ΟΔΥΣΣΕΥΣ, é", "<|endoftext|> a<|startoftext|>b.", "foo\x1cbar x y 中文, ́. ..,, 12.5, abc..., x,y", "été É.",
             "E\u0301te\u0301 œuvre ŒUVRE!! x$$$ a's b'. c'' <|x ß ẞ ЖУК жук ǅ \u00a0a\u2003b\u0085c", "<|ENDOFTEXT|> K Å ﬁ"]
    for part in (texts, [x for x in texts if "endoftext" not in x.lower()]):
        encoder = WordEncoder(p.TOKENIZER, limit=8)
        ids, counts = encoder.encode(pa.array([*part * 3, None]), chunk_bytes=20)
        want = [whole(x)[:-1] for x in [*part * 3, None]]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []


def check(rows, ids, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, full in [*((sorted(v), len(ids[k])) for k, v in by_doc.items()), *((sorted(v), None) for v in by_seq.values())]:
        at = 0
        for start, length in pieces:
            assert start == at and length > 0
            at += length
        assert at == full if full else at <= size
    assert set(by_doc) == set(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert all(sum(n for _, n in by_seq[s]) == size for s in range(len(by_seq) - 1))


def test_pieces_cover_every_id(spark, sf, texts, whole):
    check(p.op2_concat_cut(spark, sf).collect(), {k: whole(v) for k, v in texts.items()}, p.SEQUENCE)


def test_short_sequences_over_many_partitions(spark, whole):
    rows = [(i, "some words " * (i % 37)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(p.pack(docs, 16).collect(), {k: whole(v) for k, v in rows}, 16)


def test_edges(weird, empty):
    out = p.pack(weird.selectExpr("*", "1 AS ids", "2 AS part", "3 AS Start")).collect()
    assert sum(r.length for r in out if r.start == 0) > 0
    assert sum(1 for r in out if r.doc_id == 4 and r.start == 0) == 2
    assert p.pack(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one(n):
    slots = t.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (t.permute(slots, n, inverse=True) == np.arange(n)).all()
    assert n < 100 or (slots != t.permute(np.arange(n), n, key=5)).any()


def test_shards_round_trip(spark, whole, tmp_path):
    """Every record against ids of the plain tokenizer, laid end to end in the order of the token table, and the permutation."""
    rows = [(i, "some more words " * (i % 29)) for i in range(60)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).repartition(5)
    tokens = p.token_table(docs)
    by_id = {(i, len(whole(x))): whole(x) for i, x in rows}
    ids = [x for r in tokens.orderBy("part", "local_start").collect() for x in by_id[r.doc_id, r.n_tokens]]
    path = f"file://{tmp_path}/shards"
    n = t.write_shards(tokens, path, 32, shard_rows=4)
    assert n == -(-len(ids) // 32) and len(ids) == sum(len(whole(x)) for _, x in rows)
    got = t.read_shards(spark, path).collect()
    assert sorted(r.slot for r in got) == list(range(n))
    for r in got:
        part = ids[32 * r.sequence_id : 32 * r.sequence_id + 32]
        assert r.ids == part + [0] * (32 - len(part)) and r.byte_offset == (r.slot % 4) * 73
        assert r.slot == t.permute(np.array([r.sequence_id]), n)[0] and r.shard == r.slot // 4
    files = sorted(tmp_path.glob("shards/data/part-*"))
    assert len(files) == -(-n // 4)
    for shard, file in enumerate(files):  # at its byte offset a record says its slot
        raw = file.read_bytes()
        assert [int.from_bytes(raw[at : at + 8], "little") for at in range(0, len(raw), 73)] == list(range(4 * shard, min(n, 4 * shard + 4)))
    assert sorted(r.slot for r in t.read_shards(spark, path, n // 2).collect()) == list(range(n // 2, n))
    assert t.read_shards(spark, path, n).collect() == []


def test_weird_rows_in_shards(spark, weird, whole, tmp_path):
    path = f"file://{tmp_path}/weird"
    n = t.materialise(weird.selectExpr("*", "1 AS Ids", "2 AS shard"), path, 64, shard_rows=50)
    assert n == -(-sum(len(whole(r.text)) for r in weird.collect()) // 64) == t.read_shards(spark, path).count()


def test_empty_shards(spark, empty, tmp_path):
    assert t.materialise(empty, f"file://{tmp_path}/none") == 0
    assert t.read_shards(spark, f"file://{tmp_path}/none").collect() == []


def test_op3_reads_back_what_op2_cuts(spark, sf):
    rows = t.op3_training_order(spark, sf).collect()
    pieces = p.op2_concat_cut(spark, sf).groupBy("sequence_id").count().count()
    assert len(rows) == pieces
    assert sorted(r.slot for r in rows) == sorted(r.sequence_id for r in rows) == list(range(len(rows)))
