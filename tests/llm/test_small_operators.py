"""Shards, packing, token files, quality rules and mixing against brute force on a fixture with every odd case."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, sharding, subwords, tokenfile
from millrace.llm.subwords import encoder

from .helpers import DOCS, TEXTS, documents


def test_ring_fills_every_shard_and_moves_little():
    points, owner = sharding.ring(24)
    assert points == sorted(points) and set(owner) == set(range(24))
    counts = [random.Random(1).randint(0, 60) for _ in owner]
    runs = sharding.bounded_runs(counts, owner, 24)
    filled = Counter()
    for arc, begin, end, shard, slot in runs:
        assert slot == filled[shard] and 0 <= begin < end <= counts[arc]
        filled[shard] += end - begin
    assert sum(filled.values()) == sum(counts) and max(filled.values()) - min(filled.values()) <= 1
    home = sum(end - begin for arc, begin, end, shard, _ in runs if owner[arc] == shard)
    assert home > 0.9 * sum(counts)


@pytest.mark.parametrize("extra", [False, True])
def test_shards(spark, extra):
    df = documents(spark, extra=extra).repartition(3)
    rows = sharding.assign_shards(df, shards=7).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    expected = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected


def test_shards_with_one_hot_key_and_reruns(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    once = {tuple(r) for r in sharding.assign_shards(df).collect()}
    assert once == {tuple(r) for r in sharding.assign_shards(df).collect()}
    sizes = Counter(r[4] for r in once)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sharding.assign_shards(none).count() == 0
    assert packing.pack(none, path).count() == 0
    assert tokenfile.token_files(none, path).count() == 0
    assert quality.quality_report(none).count() == 0 and quality.quality_filter(none).count() == 0
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_subwords_equal_the_tokenizer(name):
    from tokenizers import Tokenizer

    path, spaces = public_tokenizers.path(name), [" ", "  ", "\n", "\t", " \n", " ", "\x1c", " "]
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    words = ["a", "the", "don't", "größe", "x1y22", "...", "́e", "中文", "🙂", "<|endoftext|>", "​", "Ä"]
    texts = [*TEXTS[1:], *("".join(rng.choice(words) + (" " if rng.random() < 0.6 else rng.choice(spaces)) for _ in range(rng.randint(1, 30))) for _ in range(3000))]
    texts += [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "'s", "-x"]) for _ in range(40)) for _ in range(300)]
    for text, ids in zip(texts, encoder(path).encode(texts), strict=True):
        assert ids == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_piece_lengths():
    for n in [0, 1, 2, 3, 1023, 1024, 1025, 5000]:
        pieces = packing.piece_lengths(n)
        assert sum(pieces) == n and pieces == sorted(pieces, reverse=True) and all(p & (p - 1) == 0 and p <= 1024 for p in pieces)
        assert len([p for p in pieces if p < 1024]) == bin(n % 1024).count("1")


def test_packing_is_a_cut_of_each_document(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = documents(spark, extra=True)
    rows = packing.pack(df, path, with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    by_length = sorted((r["sequence_id"], r["length"]) for r in rows)
    assert [x for _, x in by_length] == sorted(x for _, x in by_length)
    whole = Counter((r["doc_id"], encoder(path).encode([r["text"]])[0] + b"\0\0\0\0") for r in df.collect())
    pieces = Counter((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows)
    expected = Counter()
    for (doc_id, ids), n in whole.items():
        at = 0
        for length in packing.piece_lengths(len(ids) // 4):
            expected[doc_id, at, ids[4 * at : 4 * (at + length)], len(ids) // 4] += n
            at += length
    assert pieces == expected


def test_repair_grammar_round_trips():
    rng = np.random.default_rng(0)
    for ids in [np.zeros(0, dtype="<u4"), np.array([5], dtype="<u4"), np.full(1000, 3, dtype="<u4"), rng.integers(0, 20, 20000).astype("<u4"),
                np.tile(rng.integers(0, 1000, 37), 300).astype("<u4")]:
        first = int(ids.max()) + 1 if ids.size else 1
        symbols, rules, lengths = tokenfile.compress(ids, first)
        assert (tokenfile.expand(symbols, rules, first) == ids).all()
        assert int(tokenfile.expansion(symbols, first, lengths).sum()) == ids.size
        if ids.size > 1000:
            assert len(symbols) < ids.size
        shard = tokenfile.Shard(tokenfile.shard_bytes([None], [ids.tobytes()]))
        for _ in range(20):
            a, b = sorted(rng.integers(0, ids.size + 1, 2))
            assert (shard.ids(int(a), int(b)) == ids[a:b]).all()


def test_repair_leaves_no_pair_that_occurs_twice():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 30000, 500)
    for ids in [rng.integers(0, 60, 20000).astype("<u4"), np.full(1000, 3, dtype="<u4"), np.array([7, 7, 7], dtype="<u4"),
                np.concatenate([passage, rng.integers(0, 30000, 999), passage, [5], passage]).astype("<u4")]:
        first = int(ids.max()) + 1
        symbols, rules, _ = tokenfile.compress(ids, first)
        last, counts = {}, Counter()
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
            if last.get(pair) != i - 1:
                counts[pair] += 1
                last[pair] = i
        assert max(counts.values(), default=0) < 2
        assert (tokenfile.expand(symbols, rules, first) == ids).all()
    assert len(symbols) < 999 + 20  # the repeated passage is one symbol or few


def test_token_files(spark, monkeypatch, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = documents(spark, extra=True).repartition(5)
    monkeypatch.setattr(tokenfile, "TASK_BYTES", 2000)
    folder = f"file://{tmp_path}/tokens"
    rows = tokenfile.token_files(df, path, folder).orderBy("start").collect()
    assert all(p.name.endswith(".mrtk") for p in (tmp_path / "tokens").iterdir()) and len(list((tmp_path / "tokens").iterdir())) > 1
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    whole = Counter((r["doc_id"], len(x) // 4, zlib.crc32(x)) for r in df.collect() for x in [encoder(path).encode([r["text"]])[0] + b"\1\0\0\0"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == whole


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    places = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(places))


@pytest.mark.parametrize("extra", [False, True])
def test_quality(spark, extra):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(60)), "long" * 40 + " x" * 12]
    df = documents(spark, texts, extra)
    rows = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    kept = {r["doc_id"] for r in quality.quality_filter(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, (n_words, *rest) = rows[i], brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, *rest), (i, text)
        assert r["base_failed"] == (n_words < 10 or 100 * rest[3] > 20 * n_words)
        assert not (r["base_failed"] and r["kept"]) and (i in kept) == r["kept"]


def test_cascade_order_follows_rejection_per_cost(spark):
    df = documents(spark, ["x"] * 50)
    rules = [quality.Rule("never", lambda t: F.length(t) < 0), quality.Rule("always", lambda t: F.length(t) > 0)]
    assert [r.name for r in quality.plan_cascade(df, rules)] == ["always", "never"]


def test_water_fill():
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5.0, 2.0]) == [0.0, 0.0]
    got = mixing.water_fill([10, 1000, 500], [5.0, 2.0, 1.0])
    assert got[0] == 30.0 and abs(sum(got) - 1510) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.water_fill([100, 100, 100], [5.0, 2.0, 1.0]) == [300 * 5 / 8, 300 * 2 / 8, 300 * 1 / 8]


@pytest.mark.parametrize("extra", [False, True])
def test_mixing(spark, extra):
    rng = random.Random(9)
    texts = [*TEXTS, *(" ".join(["w"] * rng.randint(0, 50)) for _ in range(400))]
    df = documents(spark, texts, extra)
    df = df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("big")).otherwise(F.col("source")))
    rows = mixing.mix_report(df).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix_report(df.repartition(7)).collect()}
    by = defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in rows:
        by[source[r["doc_id"]]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["size"] == len((texts[r["doc_id"]] or "").encode().split())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sum(r["size"] for r in by[s]) for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    for s, target in zip(order, targets, strict=True):
        assert all(r["target"] == target and r["source_size"] == sum(x["size"] for x in by[s]) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s]) / 2 + 1
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(df).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows) and mixing.mix_documents(df).columns == df.columns


def _hot(spark, n):
    """A third of the rows have one id: half of these with texts of their own, half with one text; and rows without an id."""
    rows = [(7, f"own {i}") for i in range(n // 6)] + [(7, "one text")] * (n // 6) + [(None, f"t{i % 9}") for i in range(n // 30)]
    return spark.createDataFrame(rows + [(100 + i, f"text {i}") for i in range(n - len(rows))], "doc_id long, text string")


def test_shards_do_not_depend_on_the_partitioning(spark):
    df = _hot(spark, 3000)
    placed = lambda d: sorted(map(tuple, sharding.assign_shards(d).select("doc_id", "text_crc32", "size", "shard", "slot").collect()), key=str)
    assert placed(df.repartition(3)) == placed(df.repartition(7)) == placed(df.orderBy("text").coalesce(1))


def test_few_rows_move_when_shards_or_rows_are_added(spark):
    """Equal counts cost some moves beside the new shard's own; few of the rows change their shard at all."""
    def shards_of(d, n):
        return {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.assign_shards(d, shards=n).collect()}

    df = spark.createDataFrame([(i, f"text {i}") for i in range(12_000)], "doc_id long, text string")
    before, grown = shards_of(df, 24), shards_of(df, 25)
    moved = sum(before[k] != grown[k] for k in before) / len(before)
    new = sum(v == 24 for v in grown.values()) / len(grown)
    assert abs(new - 1 / 25) < 1e-3 and new <= moved < 0.2, moved
    more = shards_of(df.unionByName(spark.createDataFrame([(20_000 + i, "more") for i in range(120)], "doc_id long, text string")), 24)
    shifted = sum(before[k] != more[k] for k in before) / len(before)
    assert shifted < 0.1, shifted
    print(f"moved {moved:.3f} of the rows to 25 shards, {shifted:.3f} for a hundredth more rows")


def test_cheap_rules_go_before_dear_ones_of_the_same_rejection(spark):
    """A rule that does the same a hundred times over is told apart, whichever way round they are given."""
    df = spark.createDataFrame([(i, "some words of a text " * 40) for i in range(300)], "doc_id long, text string")
    cheap = quality.Rule("cheap", lambda t: F.char_length(t) < 100 * F.pmod(F.xxhash64(t), F.lit(20)))
    dear = quality.Rule("dear", lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(300)), F.lit(0), lambda s, i: s + F.size(F.split(F.concat(t, i.cast("string")), " "))) < 0)
    for rules in ([cheap, dear], [dear, cheap]):
        assert [r.name for r in quality.plan_cascade(df, rules)] == ["cheap", "dear"]


def test_a_document_repeated_very_often_is_mixed_by_counting(spark):
    """Equal rows are one row of the plan; what is taken is what taking them one by one would."""
    rows = [(None, "same words here", "a")] * 3000 + [(i, f"w{i} x y z", "a") for i in range(200)] + [(i, "other", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix_report(df).collect()
    assert len(found) == len(rows)
    for source_size in {r["source_size"] for r in found}:
        own = [r for r in found if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_report(df.coalesce(1)).collect()))


def test_late_rounds_look_only_where_symbols_changed(monkeypatch):
    asked, cells = [], tokenfile.pair_cells
    monkeypatch.setattr(tokenfile, "pair_cells", lambda *pair: asked.append(len(pair[0])) or cells(*pair))
    rng = np.random.default_rng(5)
    ids = np.concatenate([(rng.zipf(1.3, 20_000) % 3000), np.repeat(7, 501)]).astype(np.uint32)
    symbols, rules, _ = tokenfile.compress(ids, 3000)
    assert (tokenfile.expand(symbols, rules, 3000) == ids).all()
    pairs, _, _, _ = tokenfile.frequent_pairs(symbols, 2)
    assert not pairs.size and min(asked) < symbols.size // 4


def test_units_that_come_again_are_kept_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(subwords, "KEEP_BYTES", 40_000)
    own = subwords.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(6):
        texts = [" ".join(["often", "again", *(f"once{k}x{i}" for i in range(100))]), None, ""]
        assert [x.tolist() for x in own.ids(pa.array(texts))] == [x.tolist() for x in own.whole([t or "" for t in texts])]
    assert "again" in own.store.slots and not any("once0x" in u for u in own.store.slots)


def test_rounds_of_one_bound_look_only_where_symbols_changed(monkeypatch):
    asked, cells = [], tokenfile.pair_cells
    monkeypatch.setattr(tokenfile, "pair_cells", lambda *pair: asked.append(len(pair[0])) or cells(*pair))
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 5000, (400, 12))[rng.zipf(1.2, 9000) % 400].ravel().astype(np.uint32)
    symbols, rules, _ = tokenfile.compress(ids, 5000)
    assert (tokenfile.expand(symbols, rules, 5000) == ids).all()
    assert sum(asked) < 9 * ids.size  # 7; if nearly all rounds look at all places, 12


def test_whole_shards_are_counted_without_lists_of_places(monkeypatch):
    """Few rounds look at all places, and they don't say which."""
    asked, find = [], tokenfile.frequent_pairs
    monkeypatch.setattr(tokenfile, "frequent_pairs", lambda s, least, among=None, bound=None: asked.append((s.size, among is None)) or find(s, least, among, bound))
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 40_000), 3000).astype(np.uint32)
    ids[5000:9000] = 7  # a long run
    symbols, rules, lengths = tokenfile.compress(ids, 4000)
    assert (tokenfile.expand(symbols, rules, 4000, lengths) == ids).all()
    most = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_counts=True)[1].max()
    assert sum(whole for _, whole in asked) <= int(most).bit_length() - 1
    pairs, at, rank, _ = tokenfile.frequent_pairs(ids, 2, None, 2)
    every, places, ranks, _ = tokenfile.frequent_pairs(ids, 2, np.arange(ids.size), 2)
    assert (pairs == every).all() and (at == places).all() and (rank == ranks).all()


def test_pairs_are_ordered_by_count_and_then_by_symbols():
    rng = np.random.default_rng(6)
    for top in (50, 1 << 31):  # in one number, and in two
        pairs = np.unique(rng.integers(0, top, 500, dtype=np.uint64) << np.uint64(32) | rng.integers(0, top, 500, dtype=np.uint64))
        counts = rng.integers(2, 9, pairs.size)
        assert (tokenfile.by_count(pairs, counts, (top - 1).bit_length()) == np.lexsort((pairs, -counts))).all()


def test_units_are_looked_up_once_and_once_more_where_they_are_new(monkeypatch):
    asked, find = Counter(), subwords._Store.find
    monkeypatch.setattr(subwords._Store, "find", lambda self, units: asked.update(units) or find(self, units))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder, texts = subwords.Encoder(public_tokenizers.path(name)), ["word word, word. other! (odd) ...", "word? été, 'tis <b> été", ""]
        asked.clear()
        expected = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [x.tolist() for x in coder.ids(pa.array(texts))] == [e.ids for e in expected]
        assert max(asked.values()) <= 2 and asked.get("word,", 1) == 1, asked  # as a unit, and as what is before a mark
