import zlib
from array import array
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emporio.llm import packing, sharding


# --- sharding ---------------------------------------------------------------------
def least_capacity(sizes, shards):
    c = max(sizes)
    while True:
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        if n <= shards:
            return c
        c += 1




@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 8), st.integers(1, 40))
def test_summary_bounds_hold(sizes, shards, width):
    """Greedy cuts from the summary bracket the exact ones, and are exact for width one."""
    upto, run = [], 0
    for s in sizes:
        run += s
        upto.append(run)

    def summary(w):
        rows = {}
        for u in upto:
            rows.setdefault(u // w, []).append(u)
        return sharding.Summary([(min(r), max(r)) for r in rows.values()])

    best = least_capacity(sizes, shards)
    exact = summary(1)
    assert sharding.cuts(exact, best, shards, run, False)[-1] == run
    if best > max(sizes):
        assert sharding.cuts(exact, best - 1, shards, run, True)[-1] != run
    rough = summary(width)
    for c in range(max(sizes), best):
        assert sharding.cuts(rough, c, shards, run, False)[-1] != run   # the lower bound never claims too much
    for c in range(best, best + 5):
        assert sharding.cuts(rough, c, shards, run, True)[-1] == run    # the upper bound never denies


def check_shards(rows, docs, shards=16):
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    sizes = Counter()
    for i, t in texts:
        sizes[i, len((t or "").encode()) + 1, zlib.crc32(t.encode()) if t is not None else None] += 1
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == set(sizes)


def test_sharding_is_minimal_over_groups(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "SUMMARY", 16)  # forces refinement
    rows = sharding.shard(small, 5).collect()
    check_shards(rows, small, 5)
    groups, first = Counter(), {}
    for r in rows:
        key = (r["text_crc32"], r["size"])
        groups[key] += r["size"]
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    order = sorted(groups, key=lambda k: first[k])
    assert max(groups.values()) < sum(groups.values()) / 5
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) == least_capacity([groups[k] for k in order], 5)


def test_sharding_messy(spark, messy, clashing, empty):
    rows = sharding.shard(messy).collect()
    check_shards(rows, messy)
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"one two three")}) == 1
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    again = sharding.shard(clashing)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert sharding.shard(empty).collect() == []


def test_large_group_has_its_own_shard(spark):
    docs = spark.createDataFrame([(i, "hot text " * 20) for i in range(50)] + [(100 + i, f"t{i}") for i in range(200)],
                                 "doc_id long, text string")
    rows = sharding.shard(docs, 4).collect()
    check_shards(rows, docs, 4)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    cold = sorted(loads.values())[:3]
    assert len(loads) == 4 and cold[2] - cold[0] <= 10


# --- packing ----------------------------------------------------------------------
def naive_bins(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150), st.sampled_from([40, 41, 64]))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    plan = packing.best_fit_plan(Counter(lengths), capacity)
    rooms, placed = {}, Counter()
    for size, rank, n, first, per, offset in plan:
        assert rank == placed[size]
        for j in range(n):
            b = first + j // per
            assert capacity - rooms.get(b, capacity) == offset + j % per * size
            rooms[b] = rooms.get(b, capacity) - size
        placed[size] += n
    assert placed == Counter(lengths)
    assert sorted(rooms.values()) == naive_bins(lengths, capacity)


def test_room_tree():
    t = packing.RoomTree(20)
    for r in (3, 9, 20):
        t.set(r, 1)
    assert [t.tightest(s) for s in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    t.set(20, 0)
    assert t.tightest(10) is None


def test_encoder_equals_tokenizer(small):
    enc = packing.Encoder(*packing.default_tokenizer())
    plain = packing.Encoder(packing.default_tokenizer()[0])
    texts = [r["text"] for r in small.limit(60).collect()]
    texts += ["", " ", "a  b", "a b ", " a b", "a\n b", "x\n\ny z", "it's ok", "a \n", "<|endoftext|> b", "a\tb c\t d",
              "　 a b", "a\x1cb c", "a\x85 b", "été ñ 漢字 ok", "a   b", "1 22  333"]
    for t in texts:
        ids = array("I", enc.tok.encode(t, add_special_tokens=False).ids).tobytes()
        assert enc(t) == ids == plain(t), t


@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_packing_round_trip(spark, request, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs).collect()
    tok = packing.Encoder(packing.default_tokenizer()[0])
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = array("I", tok(r["text"] or "") + array("I", [2]).tobytes())
        first, start, piece = len(ids) % 1024 or 1024, 0, 0
        while start < len(ids):
            part = ids[start:first if piece == 0 else start + 1024]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())] += 1
            start, piece = start + len(part), piece + 1
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(1024 - sum(n for _, n in p) for p in seqs.values()) == naive_bins([r["length"] for r in rows], 1024)


def test_packing_empty(empty):
    assert packing.pack(empty).collect() == []
