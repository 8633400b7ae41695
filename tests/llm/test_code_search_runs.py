import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from emporio.llm import byte_pair, lexical_search, periodic_runs, queries

from .conftest import same_columns

LIBRARY = Tokenizer.from_file(byte_pair.default_tokenizer())
ENCODER = byte_pair.Encoder(byte_pair.default_tokenizer())
SPELLER = byte_pair.Speller(ENCODER.vocab.spelled)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- BPE ---------------------------------------------------------------------------
def ids_of(t):
    return np.frombuffer(ENCODER(t), np.uint32).tolist()


MIXED = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(
    ["<|endoftext|>", " the", "  ", "\n", "\n ", " \n", "'s", "'ll", " ", "　", "漢字", "é", "é", "12345", "aaaa", "\x00"])),
    max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_encoding_equals_library(t):
    ids = LIBRARY.encode(t, add_special_tokens=False).ids
    assert ids_of(t) == ids
    assert SPELLER(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abethn "), min_size=1, max_size=400).map(str.encode))
def test_long_words_merge_as_short_ones(w):
    scanned, byte_pair.LONG_WORD = byte_pair.LONG_WORD, 10 ** 9
    try:
        short = ENCODER.merged(w)
    finally:
        byte_pair.LONG_WORD = scanned
    assert ENCODER.merged_long(w) == short


def test_ascii_words_are_those_of_the_library(monkeypatch):
    """op11: text within ASCII is cut without a call of the library, and at the same places."""
    some = "aZ09 \t\n\x0b\r\x1c\x1f\x00'stmdrevl_."
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.product(some, repeat=n)]
    texts += ["".join(p) for p in itertools.product(map(chr, range(128)), repeat=2)] + ["I'll say 12 times:  'save'\r\n\n  x's "]
    want = [[t[a:b] for _, (a, b) in ENCODER.cuts(t)] for t in texts]
    monkeypatch.setattr(ENCODER, "cuts", lambda t: pytest.fail("the library was called"))
    assert [ENCODER.find(t) for t in texts] == want


def test_very_long_words():
    rng = random.Random(3)
    for t in ("x" * 30000, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9000)), "ab" * 9000 + " " + "-" * 5000):
        assert ids_of(t) == LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_coding_tables(spark, request, which):
    docs = request.getfixturevalue(which)
    coded = byte_pair.encode(docs)
    both = byte_pair.decode(coded)
    assert same_columns(both.drop(both.columns[-1], both.columns[-2]), docs)
    for r in both.collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == (r["text"] or "")


def test_decoding_any_ids(spark, empty):
    rows = [(1, [0, 180, 65, 50256, 190]), (2, []), (3, None), (4, [222] * 5)]
    out = {r["k"]: r["decoded"] for r in byte_pair.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert out == {k: LIBRARY.decode(ids or [], skip_special_tokens=False) for k, ids in rows}
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_pair.decode(spark.createDataFrame([(1, [50257])], "k int, ids array<int>")).collect()
    assert byte_pair.decode(byte_pair.encode(empty)).collect() == []


def test_coding_query(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    assert sorted(map(tuple, queries.op11_rank_array_bpe(spark, sf).collect())) == sorted(want)


# --- lexical search -----------------------------------------------------------------
def brute_search(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    tf = [(i, collections.Counter(term(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    big_n, big_l = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(w for _, c in tf for w in c)
    out = collections.Counter()
    for item, t in items:
        scored = []
        for i, c in tf:
            m = 25 + 75 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in term(t) if c[w])
            if s:
                scored.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else i, -s] += 1
    return out


@pytest.fixture(scope="module")
def items(spark, messy):
    texts = [r["text"] for r in messy.collect()]
    rng = random.Random(5)
    words = sorted({w for t in texts for w in (t or "").split()})
    rows = [(1, " ".join(rng.sample(words, 30))), (2, "one two three One, TWO!"), (3, None), (4, ""), (5, "zzzz unknown"),
            (6, " ".join(rng.choices(words, k=300))), (7, texts[0]), (7, texts[0]), (None, "x été 漢字 12"), (9, "x " * 5000)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", queries.F.lit("own")).repartition(2)


@pytest.mark.parametrize("o", [lexical_search.Options(), lexical_search.Options(k=3, items=2, terms=40, tile_terms=7, tile_docs=5)])
@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_search_equals_brute_force(spark, request, items, which, o):
    docs = request.getfixturevalue(which)
    got = lexical_search.search(docs, items, o)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], o.k)
    assert collections.Counter(map(tuple, got.collect())) == want


def test_tiles_bound_sums(monkeypatch):
    """No item's weights exceed the bound in a tile; larger ones are cut; nothing is lost."""
    monkeypatch.setattr(lexical_search, "MOST_WEIGHT", 50)
    rng = np.random.default_rng(1)
    item, col = np.divmod(rng.permutation(60)[:40], 12)
    weights = rng.integers(0, 130, 40).tolist()
    total = np.zeros((5, 12), np.int64)
    for cols, rows in lexical_search.vocabulary_tiles(item, col, weights, 5, 4):
        assert len(cols) <= 4 and (np.diff(cols) > 0).all()
        own = np.zeros((5, 12), np.int64)
        own[rows[:, 0], cols[rows[:, 1]]] = rows[:, 2]
        assert own.sum(axis=1).max() <= 50
        total += own
    want = np.zeros((5, 12), np.int64)
    want[item, col] = weights
    assert (total == want).all()


def test_search_ties_and_empty(spark, items, empty):
    """Many documents of one score over many tasks: the least doc_ids are kept."""
    rows = [(i, "same words here") for i in range(400, 0, -1)] + [(None, "same words here")] * 3 + [(5000, "other")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    one = spark.createDataFrame([(1, "here same")], "item_id long, text string")
    got = lexical_search.search(docs, one, lexical_search.Options(tile_docs=9)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 11)) and len({r["score"] for r in got}) == 1
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def test_search_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()["op12_blocked_lexical_search"]).fetchall()
    assert sorted(map(tuple, queries.op12_blocked_lexical_search(spark, sf).collect())) == sorted(want)


# --- runs ---------------------------------------------------------------------------
def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items()), found


def brute_row(words, least=12):
    runs = sorted(((s, n, q) for s, n, q in brute_runs(words, least)[0]), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def periodic(draw):
    """Words of a small alphabet with stretches that repeat, at times with a fault."""
    out = []
    for _ in range(draw(st.integers(0, 4))):
        piece = draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=7))
        out += (piece * draw(st.integers(1, 9)))[:draw(st.integers(1, 60))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic(), min_size=1, max_size=5), st.sampled_from([2, 3, 5, 12]))
def test_runs_equal_brute_force(texts, least):
    got = periodic_runs.runs_of([[w.encode() for w in t] for t in texts], least)
    for t, own in zip(texts, got):
        assert own == brute_row(t, least)[0]
        assert periodic_runs.collapsed([w.encode() for w in t], own) == brute_row(t, least)[1]


def test_runs_of_all_short_texts():
    texts = [list(t) for n in range(9) for t in itertools.product("ab", repeat=n)]
    for t, own in zip(texts, periodic_runs.runs_of([[w.encode() for w in t] for t in texts], 2)):
        assert own == brute_row(t, 2)[0]


def test_long_periodic_texts():
    """One word, a fibonacci word and many stretches with other left words, in linear numbers of steps."""
    a, b = ["x"], ["x", "y"]
    while len(b) < 1500:
        a, b = b, b + a
    rng = random.Random(4)
    many = [w for k in range(60) for w in [f"u{k}"] + ["v"] * rng.randint(5, 30)]
    for t in (["x"] * 1000, b, many):
        assert periodic_runs.runs_of([[w.encode() for w in t]], 12)[0] == brute_row(t)[0]
    one = periodic_runs.runs_of([[b"x"] * 200_000, [b"x", b"y", b"z"] * 40_000], 12)
    assert one == [[(0, 200_000, 1)], [(0, 120_000, 3)]]


@pytest.mark.parametrize("chunk", [periodic_runs.CHUNK, 50])
@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_run_tables(spark, request, which, chunk, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    docs = request.getfixturevalue(which)
    out = periodic_runs.find_runs(docs)
    assert same_columns(out.drop("runs", "collapsed"), docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None:
            assert r["runs"] == [] and r["collapsed"] is None
        else:
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
            if len(words) < 5000:
                runs, left = brute_row(words)
                assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == (runs, left)


def test_runs_empty(empty):
    assert periodic_runs.find_runs(empty).collect() == []


def test_run_query(spark, messy, tmp_path):
    """The contract's rows, tails made periodic, by brute force."""
    rows = [r for r in messy.where("doc_id is null or doc_id <> 11").collect()]
    rows += [(i, f"w{i} " + " ".join(f"a{k % 23}" for k in range(i * 3)), None, None, None) for i in range(20, 80)]
    spark.createDataFrame(rows, messy.schema).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs, left = brute_row(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        more = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[i, len(runs), *more, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left)] += 1
    got = collections.Counter(map(tuple, queries.op13_maximal_pair_runs(spark, str(tmp_path)).collect()))
    assert got == want
    assert sum(n for k, n in want.items() if k[1]) > 5
