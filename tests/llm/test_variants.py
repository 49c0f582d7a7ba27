"""Spelling variants against brute force: the index's search alone, and the forms of odd documents."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import variants

from .helpers import DOCS, documents


def _one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_the_search_finds_what_comparing_all_finds():
    """Small alphabets, so that intervals are wide, and repeated letters, so that one word is reached in several ways."""
    draw = random.Random(2)
    for letters in (b"ab", b"abc", b"abcdefghijklmnop"):
        for _ in range(8):
            words = sorted({bytes(draw.choices(letters, k=draw.randint(3, 8))) for _ in range(draw.randint(1, 150))})
            exact = np.array([draw.randint(1, len(w) - 1) for w in words])
            found = variants.FmIndex(words).near(words, exact)
            expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
                        if b.endswith(a[-exact[i] :]) and _one_error(a[: len(a) - exact[i]], b[: len(b) - exact[i]])}
            assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(expected)


def test_letters_that_no_word_has_lead_nowhere():
    index = variants.FmIndex([b"abcabc", b"abcabd"])
    assert [x.tolist() for x in index.near([b"abcabx", b"zbcabc"], np.array([3, 3]))] == [[1], [0]]
    assert [x.size for x in variants.FmIndex([b"a" * 3000]).near([b"b" * 3000], np.array([1500]))] == [0, 0]


def expected(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if x != w and _one_error(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def _chain(draw):
    """Words with variants of variants, each five times rarer, and runs that are cut by other characters."""
    words = []
    for base, times in (("language", 700), ("größere", 400), ("élévation", 60)):
        words += [base] * times + [base[:3] + base[4:]] * (times // 5) + [base[:3] + base[4:-1]] * (times // 28) + [base[:3] + "x" + base[4:]] * (times // 25) + [base + "s"] * (times // 7)
    words += ["prefix" + "".join(draw.choices("ab", k=3)) for _ in range(400)] + ["Capital", "CAPITAL", "capital"] * 3 + ["short"] * 50 + ["snake_language", "ümlaut×es", "ÀÉÎÕÜß", "àéîõüß"] * 6
    draw.shuffle(words)
    return [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]


def test_forms_of_odd_documents(spark, monkeypatch):
    docs = documents(spark, extra=True).unionByName(documents(spark, _chain(random.Random(3))), allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit("y") for c in ("word", "n", "form", "root", "_id", "shard", "forward", "part")})
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 2 for r in want)
    found = variants.spelling_forms(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == want
    monkeypatch.setattr(variants, "BLOCK", 3)
    words = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).limit(0)
    assert variants.spelling_forms(words).collect() == []
    # Halves with more words than a task takes are dealt to several tasks.
    stored = variants.store(variants.vocabulary(docs))
    near = lambda size: sorted((r["word"], r["n_near"], tuple(r["best"])) for r in variants.near_words(stored, stored.count(), shard_words=size).collect())
    assert near(2) == near(100_000) and [(r[0], r[1]) for r in near(2)] == sorted((r[0], r[4]) for r in want if r[4])


def test_a_long_text_and_a_long_word(spark):
    text = "language " * 200_000 + "languag " * 6
    rows = [(None, text, None, None, None)] + [(i, "q" * 5000 + (" " if i % 2 else "x "), None, None, None) for i in range(60)]
    found = variants.spelling_forms(spark.createDataFrame(rows, DOCS), drop=None).collect()
    assert sorted((r["word"][:8], len(r["word"]), r["form"] and r["form"][:8], r["n_near"]) for r in found) == [
        ("languag", 7, "language", 1), ("language", 8, None, 1), ("q" * 8, 5000, None, 1), ("q" * 8, 5001, None, 1),
    ]


def test_roots_of_chains(spark):
    rows = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(25)] + [("x", "w3")], "word string, form string")
    assert {r["root"] for r in variants.roots(rows).collect()} == {"w25"}
