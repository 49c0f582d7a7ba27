"""The pipeline against its stages done by brute force in plain Python."""

import zlib
from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline
from millrace.llm import mixing, packing, quality
from millrace.llm.subwords import encoder

from .helpers import TEXTS, documents
from .test_near_duplicates import brute
from .test_small_operators import brute_quality


def rejected(text):
    n_words, chars, symbols, dup_lines, repeats = brute_quality(text)
    lines = len([x for x in (text or "").split("\n") if x.split()])
    return (n_words < 10 or 100 * repeats > 20 * n_words or 100 * symbols > quality.SYMBOL_PERCENT * len(text or "")
            or (lines >= quality.MIN_LINES and 100 * dup_lines > quality.DUPLICATE_LINE_PERCENT * lines) or chars > quality.MAX_WORD_CHARS * n_words)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    good = [r for r in docs if not rejected(r["text"])]
    _, up = brute([(r["doc_id"], r["text"]) for r in good])
    kept = [r for r in good if up[r["doc_id"]] == r["doc_id"]]
    pieces = corpus_pipeline.run(spark, sf).collect()
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    tokens = {r["doc_id"]: len(encode([r["text"]])[0]) // 4 + 1 for r in kept}
    copies = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert set(copies) <= set(tokens) and len(copies) > 50
    for doc_id, n in copies.items():
        mine = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == doc_id)
        assert [x[1] for x in mine] == [x for x in packing.piece_lengths(tokens[doc_id]) for _ in range(n)]
    by = defaultdict(list)
    for r in kept:
        by[r["source"]].append((r["doc_id"], len(r["text"].encode().split())))
    order = sorted(by)
    targets = mixing.water_fill([sum(n for _, n in by[s]) for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    for s, target in zip(order, targets, strict=True):
        assert abs(sum(copies[d] * n for d, n in by[s]) - target) <= max(n for _, n in by[s]) / 2 + 1


def test_packed_sequences_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "some words to pack, one after another"), (2, None)], "doc_id long, text string")
    pieces = sorted(corpus_pipeline.binary_packing(spark, docs, "").collect(), key=lambda p: (p["doc_id"], p["start"]))
    assert all(len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    assert b"".join(p["ids"] for p in pieces) == b"".join(x + packing.END_ID.to_bytes(4, "little") for x in encode(["some words to pack, one after another", ""]))


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls, empty and repeated rows and clashing columns go through every stage; all but the last keep the columns."""
    prose = " ".join(f"word{i}" for i in range(200))
    rows = documents(spark, [*TEXTS, prose, prose + " more", "other " + " ".join(f"text{i}" for i in range(60))], extra=True)
    rows = rows.unionByName(rows.filter("doc_id % 2 = 0"))
    for docs in (rows, rows.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert sum(r["length"] for r in packed if r["start"] == 0) <= sum(r["doc_tokens"] for r in packed)
        assert bool(packed) == bool(docs.count())
