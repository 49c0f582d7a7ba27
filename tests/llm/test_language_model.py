"""The base and counts against brute force; the model's gradients, windows and probabilities."""

import math
import os
import random
import tempfile
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm

from .helpers import DOCS, TEXTS, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_model(ids=30):
    rng = np.random.default_rng(1)
    class_of = rng.integers(0, lm.CLASSES, ids).astype(np.int32)
    model = lm.Model(class_of, rng.random(ids) * 9, rng.random((lm.CLASSES, ids)) * (rng.random((lm.CLASSES, ids)) < 0.3), rng.random(ids), rng.normal(size=(ids, lm.TOPICS)), rng.random(lm.TOPICS))
    for w in model.weights.values():
        w += (rng.normal(size=w.shape) * 0.3).astype(np.float32)
    return model


def scored(model, docs, first=None, batch=512):
    """Log probability of each id and the topics at each word; without ``first`` each third id begins a word."""
    docs = [np.array(d, dtype=np.int64) for d in docs]
    first = first or [np.arange(len(d)) % 3 == 0 for d in docs]
    return model.score(docs, first, [np.ones(len(d), dtype=bool) for d in docs], batch)


def test_probabilities_sum_to_one():
    model = small_model()
    for context in ([], [3], [3, 7, 7, 1], list(range(20))):
        for begins in (True, False) if context else (True,):
            first = [np.array([i == 0 for i in range(len(context))] + [begins])]
            assert sum(math.exp(scored(model, [[*context, k]], first)[0][-1]) for k in range(30)) == pytest.approx(1, abs=1e-4)
        assert scored(model, [context])[1][-1].sum() == pytest.approx(1, abs=1e-5)
    assert np.exp(model.log_go) + np.exp(model.log_stop) == pytest.approx(1)


def test_each_id_is_scored_once_and_only_from_the_ids_before():
    model, rng = small_model(), np.random.default_rng(2)
    for n in (1, lm.CONTEXT - 1, lm.CONTEXT, lm.CONTEXT + 1, 5 * lm.CONTEXT + 3):
        ids = rng.integers(0, 30, n)
        scores, post = scored(model, [ids])
        assert len(scores) == n and (scores < 0).all() and len(post) == -(-n // 3) + 1
        other = ids.copy()
        other[-1] = (other[-1] + 1) % 30
        again, same = scored(model, [other])
        assert np.allclose(again[:-1], scores[:-1], atol=1e-5) and np.allclose(same[:-1], post[:-1], atol=1e-5)
    docs = [rng.integers(0, 30, n) for n in (5, 1, 200, 0, 33)]
    whole = scored(model, docs, batch=3)
    alone = [scored(model, [d]) for d in docs]
    assert all(np.allclose(np.concatenate([x[k] for x in alone]), whole[k], atol=1e-4) for k in (0, 1))
    assert all(x.size == 0 for x in scored(model, []))


def marked_windows(rng, n):
    rows = rng.integers(0, 30, (n, lm.CONTEXT + 2)) | np.where(rng.random((n, lm.CONTEXT + 2)) < 0.4, lm.FIRST, 0) | np.where(rng.random((n, lm.CONTEXT + 2)) < 0.5, lm.RARE, 0)
    rows[:, -1] = rng.integers(0, lm.TOPICS, n)
    return rows


def test_gradients():
    model, rng = small_model(), np.random.default_rng(3)
    for name in model.weights:
        model.weights[name] = model.weights[name].astype(np.float64)
    rows = marked_windows(rng, 6)
    rows[0, 0], rows[1, 9:-1] = -1, -2
    for name, g in model.gradients(rows).items():
        flat = model.weights[name].reshape(-1)
        for k in rng.integers(0, flat.size, 6):
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = model.loss(rows)
            flat[k] = keep - 1e-3
            down = model.loss(rows)
            flat[k] = keep
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=2e-3), name


def test_training_lowers_the_loss():
    model, rng = small_model(), np.random.default_rng(4)
    rows = marked_windows(rng, 1).repeat(64, 0)
    before = model.loss(rows)
    model.train([rows] * 60)
    assert model.loss(rows) < before - 1


def test_word_hash_is_that_of_spark(spark):
    words = [b"", b"a", "größe".encode(), b"x" * 100]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    assert [r[0] for r in df.select(F.xxhash64("w")).collect()] == [lm.word_hash(w) for w in words]


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_base_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    texts = [*TEXTS, *(f"word{i % 7} and other{i} THE the and" for i in range(60))]
    for df in (documents(spark, texts, extra=True).repartition(3), documents(spark)):
        rows = df.select("doc_id", "text").collect()
        got = lm.score_texts(df, RANKS).collect()
        counts = Counter()

        def tokens(text):
            return [*(text or "").encode().lower().split(), None]

        def held(doc_id):
            return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2

        for r in rows:
            if not held(r["doc_id"]):
                counts.update(tokens(r["text"]))
        n, v = sum(counts.values()), len(counts)
        expected = sorted((str(r["doc_id"]), held(r["doc_id"]), len(tokens(r["text"])), sum(counts[w] > 0 for w in tokens(r["text"])),
                           sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r["text"]))) for r in rows)
        found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
        assert [x[:4] for x in found] == [x[:4] for x in expected]
        assert np.allclose([x[4] for x in found], [x[4] for x in expected]) and all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_score_has_the_counts_of_words_outside_the_head(spark, monkeypatch):
    texts = [*TEXTS, *(f"word{i % 7} and other{i} THE the and" for i in range(60))]
    df = documents(spark, texts).repartition(3)
    found = []
    for head in (1 << 20, 3):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        found.append({r["doc_id"]: r["score"] for r in lm.score_texts(df, RANKS).collect()})
    assert found[0].keys() == found[1].keys()
    assert np.allclose([found[0][k] for k in found[0]], [found[1][k] for k in found[0]], rtol=1e-4)


def test_scores_equal_a_plain_computation(spark, monkeypatch):
    """From the fitted model, each word's probability by its definition, word by word."""
    held, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *args: held.append((args, fit(*args))) or held[0][1])
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choice(["red house", "blue water", f"made{i}up", "the", "and of"]) for _ in range(rng.randint(0, 60))) for i in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, RANKS).collect()}
    (_, _, by_topic, centres, _, _), model = held[0]
    cells, counts = lm._WordCells(), defaultdict(lambda: np.zeros(lm.TOPICS))
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            z = int(lm.nearest_topic(lm.topic_vector(lm.words_of(t), cells)[None], centres)[0])
            for w in [*lm.words_of(t), lm.END]:
                counts[w][z] += 1
    n_z = sum(counts.values())
    n, c = n_z.sum(), {w: x.sum() for w, x in counts.items()}
    assert n_z.tolist() == by_topic
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    discount, encode = (once + 0.1) / (once + 2 * twice + 0.2), lm.subword_encoder(RANKS).encode_ordinary
    for i, t in enumerate(texts):
        words = [[*encode(" " + w.decode())] for w in lm.words_of(t)]
        ids = np.array([x for w in words for x in w], dtype=np.int64)
        first = np.array([k == 0 for w in words for k in range(len(w))], dtype=bool)
        by_id, post = model.score([ids], [first], [np.ones(len(ids), dtype=bool)])
        total, at = 0.0, 0
        for k, w in enumerate([*lm.words_of(t), lm.END]):
            m = c.get(w, 0)
            p = 0.0 if not m else float((post[k] * counts[w] * (1 - discount / m) / np.maximum(1, n_z)).sum() * (1 - lm.LEAK) + lm.LEAK * (m - discount) / n)
            if w != lm.END:
                own = words[k]
                if m < lm.COMMON:
                    classes = model.class_of[own]
                    p += discount * len(c) / n * math.exp(by_id[at : at + len(own)].sum() + model.log_go[classes[:-1]].sum() + model.log_stop[classes[-1]])
                at += len(own)
            total += math.log10(p)
        assert got[i] == pytest.approx(total, rel=1e-4), t


def test_every_training_id_is_a_target_once(spark, monkeypatch):
    assert lm.CLASSES >= 48 and 2 * lm.STRIDE <= lm.CONTEXT
    for n in (0, 1, lm.CONTEXT - 1, lm.CONTEXT, 5 * lm.CONTEXT + 3):
        rows = lm.training_windows(np.arange(n), 3)
        assert rows[:, 1:-1][rows[:, 1:-1] >= 0].tolist() == list(range(n)) and (rows[:, -1] == 3).all()
        assert n == 0 or rows[0, 0] == -1
        assert (rows[1:, 0] == rows[:-1, -2]).all()
    # Every text takes part: what the trainers get has each id as often as the training texts.
    made, windows = Counter(), lm.training_windows
    texts = [*TEXTS, *(f"word{i % 7} and other{i} THE the and" for i in range(60))]
    folder = tempfile.mkdtemp(prefix="spark-")

    def spy(ids, topic):
        rows = windows(ids, topic)
        np.save(f"{folder}/{uuid.uuid4().hex}.npy", rows)
        return rows

    monkeypatch.setattr(lm, "training_windows", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lm.score_texts(df, RANKS)
    for name in os.listdir(folder):
        rows = np.load(f"{folder}/{name}")[:, 1:-1]
        made.update((rows[rows >= 0] & (lm.FIRST - 1)).tolist())
    encode = lm.subword_encoder(RANKS)
    training = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    expected = Counter(y for t in training for w in lm.words_of(t) for y in encode.encode_ordinary(" " + w.decode()))
    assert made == expected and len(os.listdir(folder)) == len(training)


def test_attention_predicts_the_ids_of_words_seen_often(spark, monkeypatch):
    """In training each id of every word is a target of the spelling, and no word is too frequent to have a spelled part."""
    folder, windows = tempfile.mkdtemp(prefix="spark-"), lm.training_windows

    def spy(ids, topic):
        np.save(f"{folder}/{uuid.uuid4().hex}.npy", ids)
        return windows(ids, topic)

    monkeypatch.setattr(lm, "training_windows", spy)
    df = spark.createDataFrame([(i, "the same unbelievable words") for i in range(40)], "doc_id long, text string")
    lm.score_texts(df, RANKS)
    ids = np.concatenate([np.load(f"{folder}/{name}") for name in os.listdir(folder)])
    assert ids.size > 4 * 30 and (ids & lm.RARE > 0).all()
    assert not 1 << 62 >= lm.COMMON  # so the plain computation above has a spelled part for every word


def test_held_out_scores_beat_the_base_where_words_are_known(spark):
    """Two kinds of texts with words of their own: the ids before tell which words come."""
    rng = random.Random(8)
    kinds = [["red", "blue", "green", "house", "river", "stone"], ["uno", "dos", "tres", "casa", "piedra", "rojo"]]
    texts = [" ".join(rng.choice(kinds[i % 2]) for _ in range(40)) for i in range(400)]
    rows = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS).collect()
    held = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 20 and gain > 0.15


def test_reruns_and_partitionings_agree(spark):
    texts = [*TEXTS, *(f"word{i % 7} and other{i} THE the and" for i in range(200))]
    df = documents(spark, texts)
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in lm.score_texts(d, RANKS).collect()) for d in (df, df.repartition(5)))
    assert np.allclose([x[1] for x in one], [x[1] for x in two], rtol=1e-5)


def test_empty_table_and_no_training_rows(spark):
    assert lm.score_texts(spark.createDataFrame([], DOCS), RANKS).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_texts(spark.createDataFrame([(only, "some text", None, None, None)], DOCS), RANKS).collect()[0]
    assert row["held_out"] and row["train_tokens"] == 0 and row["base_score"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])


def test_topics_are_fitted_on_all_documents(spark):
    """Each centre is the mean of the levels of all documents nearest to it, however many there are."""
    n = 24_000
    text = F.concat_ws(" ", *[F.concat(F.lit("kind"), F.col("id") % 8, F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5))) for k in range(6)])
    df = spark.range(n).select(text.alias("text"))
    centres = lm.fit_topics(df)
    cells = lm._WordCells()
    x = np.stack([np.rint(lm.topic_vector(lm.words_of(r["text"]), cells) * 255) / 255 for r in df.collect()])
    label = lm.nearest_topic(x, centres.astype(float))
    assert len(x) == n and len(set(label.tolist())) > 2
    for k in set(label.tolist()):
        assert np.allclose(centres[k], x[label == k].mean(0), atol=1e-6)
    assert (lm.fit_topics(df.repartition(7)) == centres).all()


def test_many_words_are_spelled_like_one(spark):
    words = ["plain", "it's", "größe", "x y", " ", "　a", "日本語", "a\x1cb", "!?", "99a", "-", "'s", "é"] * 40
    encode = lm.subword_encoder(RANKS).encode_ordinary
    ids, widths = lm.spell_words(RANKS, [w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(widths)[:-1])] == [encode(" " + w) for w in words]

def test_the_words_counts_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, to_arrow = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: seen.append(self.columns) or to_arrow(self))
    texts = [" ".join(f"word{i}x{k}" for k in range(50)) for i in range(60)]
    lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS)
    assert seen and not any({"h", "t0"} <= set(columns) for columns in seen)


def test_a_worker_reads_the_head_a_column_at_a_time(tmp_path):
    n, rng = 300_000, np.random.default_rng(3)
    columns = {"h": rng.permutation(n).astype(np.int64), **{c: rng.integers(0, 1 << 30, n).astype(np.int32) for c in ["c", *(f"t{k}" for k in range(lm.TOPICS))]}}
    whole = pa.table(columns)
    pq.write_table(whole, tmp_path / "part.parquet", use_dictionary=False)
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        hashes, counts = lm.head_counts(f"file://{tmp_path}")
    finally:
        pa.set_memory_pool(before)
    assert pool.max_memory() < whole.nbytes * 3 // 4
    order = np.argsort(columns["h"])
    assert (hashes == columns["h"][order]).all() and counts.dtype == np.uint32
    assert (counts == np.stack([x[order] for name, x in columns.items() if name != "h"], axis=1)).all()


def test_scoring_looks_up_the_words_of_many_slices_at_once(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 400)
    monkeypatch.setattr(lm, "SCORED_BYTES", 100)
    texts = [*(f"some words {i % 7} of text {i}" for i in range(60)), None, "", "a long text " * 60, " \n"]
    lexicon, alone, calls, find = lm._Lexicon(RANKS, np.zeros(0, dtype=np.int64)), lm._Lexicon(RANKS, np.zeros(0, dtype=np.int64)), [], lm._Words.find
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(lm._Words, "find", lambda self, x: calls.append(len(x)) or find(self, x))
    slices = list(lexicon.find_pieces(batch, 1))
    assert sum(calls) == len(texts) and 3 * len(calls) < 2 * len(slices)
    assert [d for part, _, _ in slices for d in part.column(0).to_pylist()] == list(range(len(texts)))
    for part, rows, sizes in slices:
        other, same = find(alone, part.column(1))
        assert sizes.tolist() == same.tolist() and (lexicon.hash[rows] == alone.hash[other]).all()


def test_scores_with_inputs_made_once_are_the_same(monkeypatch):
    model, rng = small_model(), np.random.default_rng(5)
    docs = [rng.integers(0, 30, n) for n in (3, 70)]
    marks = [np.arange(len(d)) % 3 == 0 for d in docs]
    once = model.inputs()
    expected = model.score(docs, marks, marks)
    monkeypatch.setattr(model, "inputs", lambda: pytest.fail("made again"))
    found = model.score(docs, marks, marks, inputs=once)
    assert all((x == y).all() for x, y in zip(found, expected, strict=True))


def test_words_before_trailing_symbols_are_encoded_once(monkeypatch):
    words = [w + end for w in ("plain", "größe", "it's", "bread", "x9", "日本語", "café", "a\xa0b") for end in ("", ".", ",", "...", "!?", "'.", "'s.", "9.")] + [".", "..", "'ll,", "\x85."]
    encode, texts = lm.subword_encoder(RANKS).encode_ordinary, []
    ids, widths = lm.spell_words(RANKS, [w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(widths)[:-1])] == [encode(" " + w) for w in words]
    assert all(x.size == 0 for x in lm.spell_words(RANKS, []))

    class Spy:
        n_vocab, decode_single_token_bytes = lm.subword_encoder(RANKS).n_vocab, lm.subword_encoder(RANKS).decode_single_token_bytes
        encode_ordinary = staticmethod(lambda text: texts.append(text) or encode(text))

    monkeypatch.setitem(lm._subwords, RANKS, Spy)
    lm.spell_words(RANKS, [b"bread", b"bread.", b"bread,", b"bread!?"])
    assert sum(x.count("bread") for x in texts) == 1


def test_a_worker_keeps_words_from_task_to_task(monkeypatch):
    monkeypatch.setattr(lm, "_lexicons", {})
    texts, learned, learn = pa.array(["some words here", "some more"]), [], lm._Lexicon.learn
    monkeypatch.setattr(lm._Lexicon, "learn", lambda self, words: learned.extend(words) or learn(self, words))
    tables = [np.sort(np.array([lm.word_hash(w) for w in some], dtype=np.int64)) for some in ([b"some"], [], [b"more", b"here", b"other"])]
    for table in tables:
        lexicon, alone = lm.worker_lexicon(RANKS, table), lm._Lexicon(RANKS, table)
        (rows, sizes), (other, same) = lexicon.find(texts), lm._Words.find(alone, texts)
        assert sizes.tolist() == same.tolist() and lexicon.place[rows].tolist() == alone.place[other].tolist()
        assert lexicon.spell(rows)[0].tolist() == alone.spell(other)[0].tolist()
    assert learned.count(b"some") == 1 + len(tables)  # the kept one learns it once, each new one again


def test_pairs_are_merged_in_a_task_before_they_are_passed_on(spark, monkeypatch):
    names = [f"t{k}" for k in range(lm.TOPICS)]
    words = spark.createDataFrame([(f"made{i}word".encode(), *[i % 3 + k for k in range(lm.TOPICS)]) for i in range(300)], "word binary, " + ", ".join(f"{t} long" for t in names)).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = []
        for most in (1 << 20, 5):
            monkeypatch.setattr(lm, "PAIR_ROWS", most)
            found.append(sorted(tuple(r) for r in lm.count_pairs(words, RANKS).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, encode = defaultdict(lambda: np.zeros(1 + lm.TOPICS, dtype=int)), lm.subword_encoder(RANKS).encode_ordinary
    for r in words.collect():
        ids = [-1, *encode(" " + r["word"].decode()), -1]
        for pair in zip(ids, ids[1:]):
            expected[pair] += [1, *r[1:]]
    assert found[0] == found[1] == sorted((*pair, *n.tolist()) for pair, n in expected.items())
