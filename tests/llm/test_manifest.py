"""The Merkle manifest against a plain computation, over odd rows, lone sources and several heights."""

import hashlib
import zlib

from pyspark.sql import functions as F

from millrace.llm import merkle

from .helpers import DOCS, TEXTS, documents


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return _hash(*map(_field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _segments(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s] = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])), k, r) for k, r in enumerate(by[s]))
    trees = [_levels([x[0][2] for x in by[s]]) for s in order]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, ((_, _, leaf), _, r) in enumerate(by[s]):
            segments = _segments(trees[k], i) + _segments(top, k)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = _leaf(r, text)
            for left, right in segments:
                folded = _hash(*left, folded, *right)
            proof = _hash(*[x for left, right in segments for x in left + right])
            out.append((r["doc_id"], leaf, trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_proofs_of_odd_rows(spark):
    """Null ids, sources and texts, repeated rows, a lone source, a source of 300 leaves and clashing further columns."""
    docs = documents(spark, extra=True)
    more = [(1000 + i, f"Text number {i} with Capitals", "de", "big", i) for i in range(300)] + [(7, "alone", None, "ß", None)] + [(5, "Same", "en", "same", 4)] * 40
    more = spark.createDataFrame(more, DOCS)
    docs = docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("y") for c in ("_g", "rank", "leaf", "digest", "path", "node", "root")})
    rows = [r.asDict() for r in docs.collect()]
    found = merkle.verify_manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _rows(found) == sorted(expected(rows), key=repr)
    assert _rows(merkle.verify_manifest(docs.repartition(5, "text"))) == _rows(found)
    assert {r["verified"] for r in found.collect()} == {True, False}


def test_many_sources_make_a_tree_of_their_own(spark):
    rows = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], "en", f"s{i % 290}", i) for i in range(400)], DOCS)
    assert _rows(merkle.verify_manifest(rows)) == sorted(expected([r.asDict() for r in rows.collect()]), key=repr)


def test_one_row_no_row_and_a_long_text(spark):
    one = spark.createDataFrame([(3, "word " * 400_000, "en", None, None)], DOCS)
    found = merkle.verify_manifest(one).collect()
    assert [tuple(r) for r in found] == expected([one.first().asDict()])
    assert found[0]["proof_sha256"] == _hash() and found[0]["leaf"] == found[0]["root"]
    assert merkle.verify_manifest(one.limit(0)).collect() == []


def test_records_alone_prove_a_leaf(spark):
    """A few asked leaves; equal subtrees share a record."""
    docs = spark.createDataFrame([(1, "same", "en", "a", 1)] * 512 + [(i, f"t{i}", "en", "b", 1) for i in range(40)], DOCS)
    made = merkle.manifest(docs)
    records = {r["digest"]: r["children"] for r in made.records().collect()}
    # 512 equal leaves: one run, one node above them, and a node of two of those; 40 leaves: 3 runs and a node; and the root.
    assert len(records) == 1 + 1 + 1 + 3 + 1 + 1
    asked = made.leaves.filter("(rank = 7 AND _g = '1b') OR (rank = 300 AND _g = '1a')")
    for r in made.proofs(asked).collect():
        at = r["leaf"]
        for s in r["path"]:
            children = s["left"] + at + s["right"]
            at = _hash(children)
            assert "".join(records[at]) == children
        assert at == made.root
    assert made.proofs(asked).count() == 2
