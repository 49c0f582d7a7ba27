"""A text of several megabytes, most of its words its own, among small ones, through the operators on documents."""

import random
import zlib

import public_tokenizers
import pytest

from millrace.llm import mixing, neardup, packing, quality, sharding, tokenfile

from .helpers import DOCS

PATH, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_docs(spark):
    draw = random.Random(7)
    words = [f"w{draw.randrange(1 << 24):x}" for _ in range(500_000)]
    near = words[:250_000] + ["changed"] + words[250_001:]
    small = [" ".join(words[i : i + 40]) for i in range(0, 200, 40)]
    texts = [" ".join(words), " ".join(near), *small]
    assert len(texts[0]) > 3_500_000
    return texts, spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], DOCS).repartition(2).persist()


def test_shards_rules_and_mix(long_docs):
    texts, df = long_docs
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.assign_shards(df, 3).collect()} == {(i, len(t) + 8, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    report = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    assert report[0]["n_words"] == 500_000 and report[0]["kept"] and report[0]["n_repeat_words"] < 100
    assert {r["doc_id"]: r["size"] for r in mixing.mix_report(df).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}


def test_near_duplicates(long_docs):
    _, df = long_docs
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(df).collect()}
    assert got[0][0] == got[1][0] == 0 and all(got[i][0] == i for i in range(2, 7)) and got[0][1] > 499_000


def test_packing_and_token_files(long_docs):
    from tokenizers import Tokenizer

    texts, df = long_docs
    pieces = packing.pack(df, PATH).collect()
    n = {i: len(e.ids) + 1 for i, e in enumerate(Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False))}
    for i in n:
        own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert sum(length for _, length in own) == n[i] and [s for s, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] if len(own) < 100 else sum(x for _, x in own) == n[i]
    found = {r["doc_id"]: r["n_tokens"] for r in tokenfile.token_files(df.filter("doc_id <> 1"), WORDS).collect()}
    assert found == {i: len(e.ids) + 1 for i, e in enumerate(Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)) if i != 1}
