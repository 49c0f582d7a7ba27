"""Near-duplicates and components against brute force, with limits set low so that every branch is taken."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import neardup, shared, subwords
from millrace.operators import graph as components

from .helpers import DOCS, documents


@pytest.fixture(autouse=True)
def few_partitions(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", keep)


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [(d, len(s), None if d is None else find(d), True if d is None else find(d) == d) for (d, _), s in zip(rows, sets, strict=True)], up


def key(rows):
    return sorted(((r[0] is None, r[0] or 0, r[1], r[2] if r[2] is not None else -1, r[3]) for r in rows))


def corpus():
    rng = random.Random(11)

    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(5))

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = word()
        return out

    texts = []
    for _ in range(40):  # pairs and small groups near the threshold
        base = [word() for _ in range(rng.randint(5, 120))]
        texts += [" ".join(edited(base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(rng.randint(1, 5))]
    star = [word() for _ in range(150)]
    texts += [" ".join(star), *(" ".join(edited(star, 3)) for _ in range(60))]  # copies link to the original, rarely to each other
    passage = [word() for _ in range(50)]
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(60)]  # one passage in texts that aren't alike
    chain = [word() for _ in range(100)]
    for _ in range(40):  # each like the one before
        chain = edited(chain, 1)
        texts.append(" ".join(chain))
    texts += [texts[0]] * 30 + ["a b c", "A B  c", "a b", "", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"NODE_ROWS": 16, "GROUP_ROWS": 8, "DEPTH": 2, "PIVOTS": 4}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert key(neardup.near_duplicates(df).collect()) == key(brute(rows)[0])


def test_odd_rows(spark):
    df = documents(spark, extra=True)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = neardup.near_duplicates(df).collect()
    assert key(got) == key(brute(rows)[0])
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in got if r[3]}
    none = spark.createDataFrame([], DOCS)
    assert neardup.deduplicate(none).count() == 0


def test_one_row_of_each_id_stays(spark):
    a, b = ("".join(f"{x}{i} " for i in range(30)) for x in "ab")
    rows = [(5, a, 1), (5, a, 1), (5, a, 2), (7, a, 3), (9, b, 4), (9, "other text", 5), (None, "no id", 6), (None, "no id", 6), (11, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = [tuple(r) for r in neardup.deduplicate(df).collect()]
    assert sorted(r[0] for r in kept if r[0] is not None) == [5, 9, 11] and sum(r[0] is None for r in kept) == 2 and set(kept) <= set(rows)
    assert sorted(map(str, kept)) == sorted(str(tuple(r)) for r in neardup.deduplicate(df.orderBy(F.desc("n")).repartition(3)).collect())


def test_rows_with_one_id_are_one_document(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (9, b), (11, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0], r[2]) for r in got) == [(5, 5), (7, 5), (7, 5), (9, 5), (11, 11)]


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(1 << 30)}"
    return out


def test_ids_with_two_unlike_texts_lose_no_link(spark):
    """Each id has two texts that aren't alike, and each text a near copy of its own."""
    rng, rows = random.Random(12), []
    for i in range(20):
        one, two = ([f"{x}{i}w{k}" for k in range(80)] for x in "ab")
        rows += [(1000 + i, " ".join(one)), (1000 + i, " ".join(two)), (3000 + i, " ".join(changed(rng, one, 1))), (2000 + i, " ".join(changed(rng, two, 1)))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 80 and all(r["component_id"] == 1000 + r["doc_id"] % 1000 and r["kept"] == (r["doc_id"] < 2000) for r in got)


def test_one_row_stays_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "a b c"), (3, "a b c"), (4, None), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.deduplicate(df).collect()) == [1, 3, 4]


def test_recall_of_pairs_just_above_the_threshold(spark):
    """600 pairs of a similarity from 75 to 80 %, each found on its own."""
    rng, rows, near = random.Random(13), [], 0
    while near < 600:
        words = [f"v{rng.randrange(1 << 30)}" for _ in range(rng.randint(60, 400))]
        other = changed(rng, words, max(1, round(len(words) * rng.uniform(0.02, 0.03))))
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        if 75 * len(a | b) <= 100 * len(a & b) < 80 * len(a | b):
            rows += [(2 * near, " ".join(words)), (2 * near + 1, " ".join(other))]
            near += 1
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(600)) == 600


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, 6000 + i) for i in range(50)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(x) == got.get(x, x) for x in up)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0


def test_a_chain_of_drifting_versions_is_one_component(spark):
    """1,000 versions, each linked with the ones before and after it only, under ids in no order."""
    rng, n = random.Random(14), 1000
    words = [f"w{rng.randrange(1 << 40)}" for _ in range(6 * n + 60)]
    ids = rng.sample(range(10, 10 + n), n)
    rows = [(i, " ".join(words[6 * k : 6 * k + 60])) for k, i in enumerate(ids)] + [(1, " ".join(words[:50])), (2, "another text of some words")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: 1 for i in [1, *ids]} | {2: 2}


def test_tasks_drop_what_other_operators_kept_in_the_worker():
    path = public_tokenizers.path("word_bpe_49k.json")
    subwords.encoder(path)
    for task in (neardup._sketch, neardup._roots, neardup._children, neardup._agreeing, neardup._forest, neardup._full_sets, neardup._confirm, neardup._against):
        subwords._encoders["left"] = subwords.encoder(path)
        assert list(task(iter([]))) == [] and not subwords._encoders


def test_workers_get_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    df = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("some words "), 1000).alias("text"))
    for compute in (shared.store, shared.materialize):
        found = [r["n"] for r in compute(df.mapInArrow(sizes, "n long")).collect()]
        assert max(found) < 2 * shared.BATCH_BYTES and sum(found) > 4000 * 11_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
