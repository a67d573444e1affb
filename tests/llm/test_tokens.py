import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing, token_counts
from cadenza.llm.queries import op2_best_fit_packing, op5_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "\n\n", "a", "aaaaaaaaaaa" * 50, "Hello  world!  \t x\r\n", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>",
    "don't we'll I'd", "日本語テキスト 12345 ٣٤", "\x1c\x1d a\x85b c d　", "🎉🎉 é́", "!!??...   ", "a" * 5000 + " " * 3000 + "b",
]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library_on_odd_texts():
    got = token_counts.count_texts(ODD, token_counts.merges(PATH), {})
    assert got == [len(ids(t)) for t in ODD]


def test_ids_equal_the_library_on_odd_texts():
    encode = packing.encoder(PATH)
    for t in ODD:
        assert encode(t) == ids(t), t[:30]


def test_count_query_on_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(ids(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def check_packing(rows, texts, capacity=2048):
    """texts: (doc_id, text) of every row of the table."""
    want = collections.Counter()
    for doc, t in texts:
        own = [*ids(t or ""), 0]
        for k, (s, n) in enumerate(packing.cuts(len(own), capacity)):
            want[(doc, k, s, n, zlib.crc32(np.array(own[s : s + n], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op2_best_fit_packing(spark, sf_dir).collect()
    n = check_packing(rows, texts)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) * 1.1 + 1


def test_tree_joins_leaves(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 7)) for i in range(300)] + [(None, None), (7, ""), (7, "")], "doc_id long, text string")
    docs = docs.withColumn("piece", docs.doc_id).repartition(40)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(spark, docs, PATH, capacity=64).collect()
    n = check_packing(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 64) * 1.15


def test_pieces_keep_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    rows = packing.pack(spark, docs, PATH, capacity=4, with_ids=True).collect()
    rows.sort(key=lambda r: r.piece)
    assert np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist() == [*ids("a b c d e f g h"), 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(spark, docs, PATH).count() == 0
    assert token_counts.count_tokens(docs, PATH).count() == 0


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (12, [(0, 4), (4, 4), (8, 4)])])
def test_cuts(n, want):
    assert packing.cuts(n, 4) == want
