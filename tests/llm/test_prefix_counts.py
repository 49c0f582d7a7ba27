"""Token counts of every prefix against the tokenizers library, prefix by prefix, and the answers drawn from them."""

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import prefixes

from .helpers import DOCS, TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "it's we'll they're 'rest 'lx 've 's 't ''s  '", "  a  b \n\n c\t\td  ", "<|endoftext|><|endoftext|><|endof", "x<|endoftext|>y <|endoftext",
    "日本語テキスト 😀😀 a😀b é é ́x", "a\x00b\x85x\xa0\xa0y　z \x1c\x1f", "-" * 200 + "a" * 90, "1234567890 12,345.67", "           ", "\n\n \n x",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _prefixes(text):
    return [text[:i] for i in range(len(text) + 1)]


def test_every_prefix_is_counted_as_the_library_does(library):
    counter = prefixes.Counter(PATH)
    draw = random.Random(5)
    letters = "aabbeethison  \n\t'’srv1.,-é日😀  ABC_<|"
    texts = [t or "" for t in TEXTS if t is None or len(t) < 500] + ODD
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 50))) for _ in range(300)]
    for _ in range(2):  # kept units the second time
        for text, found in zip(texts, counter.counts(texts), strict=True):
            assert found.tolist() == library(_prefixes(text)), repr(text)


def test_every_token_of_the_vocabulary_is_one_token():
    counter = prefixes.Counter(PATH)
    names = list(counter.ends.keys())
    assert len(names) == 256 + 50_000
    for name in names[::7]:
        data = name.encode("latin-1")
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        assert counter.piece(text)[-1] == 1


def test_kept_units_and_pairs_are_bounded(library, monkeypatch):
    monkeypatch.setattr(prefixes, "KEEP_BYTES", 2000)
    monkeypatch.setattr(prefixes, "KEEP_PAIRS", 20)
    counter = prefixes.Counter(PATH)
    for k in range(40):
        text = f"word{k} and another{k * 7919} thing\n" * 3
        assert counter.counts([text])[0][-1] == library([text])[0]
    assert counter.n < 40 and len(counter.pairs) <= 22


def test_token_counts_of_odd_documents(spark, library):
    docs = documents(spark, extra=True)
    rows = docs.select("doc_id", "text").collect()
    for limit in (3, 1024):
        found = prefixes.token_counts(docs, PATH, limit)
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "cut_tokens"]
        expected = []
        for r in rows:
            text = r["text"] or ""
            n = library([text])[0]
            counts = library(_prefixes(text)) if len(text) < 500 else None
            cut = (len(text), n) if n <= limit else (None, None) if counts is None else max((i, c) for i, c in enumerate(counts) if c <= limit)
            expected.append((r["doc_id"], len(text.encode()), n, n > limit, *cut))
        long = "w " * 3000
        got = [tuple(r) if r["n_bytes"] != len(long) else (*r[:4], None, None) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert prefixes.token_counts(docs.limit(0), PATH).collect() == []


def test_stored_counts_answer_lengths_and_budgets(spark, library):
    """Over several marks, without the text; asked lengths beyond the text give null."""
    text = " ".join(f"tok{k % 97} ein{'…' * (k % 5)} größer\n" for k in range(400))
    assert len(text) > 3 * prefixes.MARK
    stored = prefixes.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH)
    assert "text" not in stored.columns
    asked = [0, 1, 1023, 1024, 1025, 3000, len(text), len(text) + 1, -1]
    found = stored.crossJoin(spark.createDataFrame([(n,) for n in asked], "n long")).select("n", prefixes.tokens_at(F.col("n")).alias("k"))
    expected = {n: library([text[:n]])[0] if 0 <= n <= len(text) else None for n in asked}
    assert {r["n"]: r["k"] for r in found.collect()} == expected
    counts = library(_prefixes(text))
    for budget in (0, 1, 777, counts[-1]):
        assert stored.select(prefixes.chars_within(F.lit(budget)).alias("n")).first()["n"] == max(i for i, c in enumerate(counts) if c <= budget)


def test_very_long_texts_and_words(spark, library):
    word = "".join(random.Random(3).choices("abcdefghij", k=120_000))
    texts = ["several words of a text, " * 80_000, word]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    found = {r["doc_id"]: r for r in prefixes.token_counts(docs, PATH).collect()}
    for i, text in enumerate(texts):
        assert found[i]["n_tokens"] == library([text])[0]
        cut = found[i]["cut_chars"]
        assert library([text[:cut]])[0] == found[i]["cut_tokens"] <= 1024 < library([text[: cut + 1]])[0]


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        prefixes.Counter(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        changed = json.load(f)
    changed["added_tokens"][0]["lstrip"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(changed), encoding="utf-8")
    with pytest.raises(ValueError):
        prefixes.Counter(str(other))
