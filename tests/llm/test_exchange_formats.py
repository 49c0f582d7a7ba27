"""WARC archives, chat repair and top-k search against brute force."""

import gzip
import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, topk, warc


def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice(["<p>" + "a" * 200, "<p>" + "b" * 99, "<p>short", rng.randbytes(300).hex()])) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", "<p>" + "a" * 200), (102, "u", "c" * 500), (102, "u", "c" * 500), (103, "u\nX: y", "c" * 500), (104, "u", "é" * 60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("size", [50, 700, 1 << 22])
def test_warc_round_trip(spark, tmp_path, size):
    df = pages(spark).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    folder = f"file://{tmp_path}/warc"
    rows = warc.read_warc(warc.write_warc(df, folder), folder, range_bytes=size, payloads=True).collect()
    source = defaultdict(list)
    for r in df.collect():
        source[r["page_id"]].append((r["html"] or "").encode())
    assert len(rows) == df.count()
    first = {}
    for page_id in sorted(p for p in source if p is not None):
        for body in source[page_id]:
            first.setdefault(body, page_id)
    for r in rows:
        body = source[r["page_id"]][0]
        assert r["payload_bytes"] == len(body)
        refers = first.get(body) if len(body) >= 100 and r["page_id"] is not None and first.get(body) != r["page_id"] else None
        assert r["refers_to"] == refers and r["record_type"] == ("response" if refers is None else "revisit")
        assert r["payload"] == (body if refers is None else None)


def test_reader_is_not_fooled_by_members_inside_payloads(tmp_path):
    inner = warc.record_bytes(999, "u", b"inner", "d", None) * 3
    records = [warc.record_bytes(i, "u", (inner if i % 2 else b"x" * 50).decode("latin-1").encode("latin-1"), "d", None) for i in range(20)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(records))
    size = path.stat().st_size
    assert len(gzip.open(path).read()) > 0
    with pafs.LocalFileSystem().open_input_file(str(path)) as source:
        for step in (1, 37, 333):
            members = warc.Members(source, size)
            found = [warc.parse_record(raw)[0]["warc-record-id"] for start in range(0, size, step) for raw in members.records(members.bounds(start, start + step)[0], start + step)]
            assert found == [f"<urn:page:{i}>" for i in range(20)], step


def archive(spark, path, records):
    path.write_bytes(b"".join(records))
    return spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long"), f"file://{path.parent}"


@pytest.mark.parametrize("size", [300, 4000, 1 << 22])
def test_broken_archives_raise(spark, tmp_path, size):
    rng = random.Random(5)
    records = [warc.record_bytes(i, "u", body, hashlib.sha256(body).hexdigest(), None) for i in range(60) for body in [rng.randbytes(rng.randint(0, 400))]]
    files, folder = archive(spark, tmp_path / "sound.warc.gz", records)
    assert sorted(r["page_id"] for r in warc.read_warc(files, folder, range_bytes=size).collect()) == list(range(60))
    for k in (0, 31, 59):
        broken = bytearray(records[k])
        broken[len(broken) // 2] ^= 0x55
        for name, changed in (("bits", bytes(broken)), ("cut", records[k][:-7]), ("gone", records[k][:5] + b"\0" * 9), ("more", records[k] + b"garbage")):
            files, folder = archive(spark, tmp_path / f"{name}{k}.warc.gz", [*records[:k], changed, *records[k + 1 :]])
            with pytest.raises(Exception, match="broken member|doesn't match"):
                warc.read_warc(files, folder, range_bytes=size).collect()


def test_an_archive_inside_a_payload_is_not_read(spark, tmp_path):
    rng = random.Random(6)
    inner = b"".join(warc.record_bytes(1000 + i, "u", body, hashlib.sha256(body).hexdigest(), None) for i in range(40) for body in [rng.randbytes(300)])
    bodies = [b"a" * 500, inner, b"b" * 500, inner + b"c", b""]
    records = [warc.record_bytes(i, "u", body, hashlib.sha256(body).hexdigest(), None) for i, body in enumerate(bodies)]
    files, folder = archive(spark, tmp_path / "a.warc.gz", records)
    for size in (700, 5000, 1 << 22):
        rows = warc.read_warc(files, folder, range_bytes=size, payloads=True).collect()
        assert sorted((r["page_id"], bytes(r["payload"])) for r in rows) == list(enumerate(bodies))


def test_no_pages_no_archives(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def brute_cost(roles):
    """Least cost over every choice of labels, merges and insertions."""

    def legal(seq):
        body = seq[1:] if seq[:1] == (1,) else seq
        return len(body) > 0 and len(body) % 2 == 0 and all(r == 2 + i % 2 for i, r in enumerate(body))

    best = 1 << 30
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        relabel = sum(chat.RELABEL for a, b in zip(labels, roles, strict=True) if a != b)
        for merges in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and labels[i] != labels[i + 1] for i, m in enumerate(merges)):
                continue
            turns = tuple(labels[:1]) + tuple(x for x, m in zip(labels[1:], merges, strict=True) if not m)
            cost = relabel + chat.MERGE * sum(merges)
            for extra in range(0, len(turns) + 3):
                if cost + extra * chat.INSERT >= best:
                    break
                places = itertools.combinations_with_replacement(range(len(turns) + 1), extra)
                if any(legal(put(turns, p, fill)) for p in places for fill in itertools.product((1, 2, 3), repeat=extra)):
                    best = cost + extra * chat.INSERT
    return best


def put(turns, places, fill):
    out = []
    for i in range(len(turns) + 1):
        out += [f for p, f in zip(places, fill, strict=True) if p == i]
        out += turns[i : i + 1]
    return tuple(out)


def test_repair_is_cheapest():
    for n in (1, 2, 3):
        for roles in itertools.product((0, 1, 2, 3), repeat=n):
            cost, _, _ = chat.solve(list(roles), 0)
            last = chat.best_last(cost)
            assert cost[last] + chat.INSERT * len(chat.closing(last)) == brute_cost(roles), roles


def test_repair_in_blocks_equals_repair_at_once(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User ", "bot", None]), rng.choice(["hi", None, "", "<|im_end|>"])) for c in (1, 2, 3, None) for t in range(rng.randint(1, 70))]
    rows += [(5, 0, "user", "x")] * 60 + [(6, None, "assistant", "y"), (6, 2, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("new_turn", F.lit(1)).repartition(4)
    whole = chat.repair_chats(df).collect()
    parts = chat.repair_chats(df, block=8).collect()

    def rendered(rows):
        out = defaultdict(list)
        for r in rows:
            out[r["conv_id"]].append((r["new_turn"], r["action"] == "end", r["fragment"].startswith("\n\n"), r["fragment"], r["new_role"], r["action"]))
        return {k: sorted(v) for k, v in out.items()}

    one, two = rendered(whole), rendered(parts)
    assert one.keys() == two.keys()
    for conv in one:
        cost = [sum({"keep": 0, "merge": 1, "relabel": 3, "merge_relabel": 4, "insert": 4, "end": 0}[x[5]] for x in seq[conv]) for seq in (one, two)]
        assert cost[0] == cost[1], conv
        for seq in (one[conv], two[conv]):
            roles = [x[4] for x in seq if x[3].find("<|im_start|>") >= 0]
            assert roles[-1] == "assistant" and all(a != b for a, b in zip(roles, roles[1:], strict=False)) and "system" not in roles[1:]
            assert sorted({x[0] for x in seq}) == list(range(len(roles)))
    assert chat.repair_chats(df.limit(0)).count() == 0


def brute_topk(rows, k):
    usable = [(i, np.floor(256 * np.array(v, dtype=float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, [int(x) for x in v] + [0] * (width - len(v))) for i, v in usable]
    asked = {}
    for i, v in usable:
        if i % 5 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in usable if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20) * rng.choice([0.01, 0.1, 1.0])]) for i in range(500)]
    rows += [(i, rows[7][1]) for i in range(500, 600)]  # a common vector
    rows += [(600, None), (605, [None] * 20), (610, [float("nan")] * 20), (615, [float("inf")] + [0.0] * 19), (620, [0.0] * 20), (None, [1.0] * 20), (10, rows[10][1]), (625, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("length", F.lit("x"))
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 5 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 5)


def test_topk_of_few_rows_and_of_huge_numbers(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 5 == 0).count() == 0
    rows = [(0, [1e5, 3.0]), (1, [1e5, -2.0]), (2, [-1e5, 1.0])]
    big = [(i, [x * 30 for x in v]) for i, v in rows]
    for case in (rows, big):
        case = [(i, [float(np.float32(x)) for x in v]) for i, v in case]
        got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(case, schema), F.col("vec_id") % 5 == 0).collect())
        assert got == brute_topk(case, 5)
