import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emporio.llm import bag_minhash, common, line_dedup, substring_dedup

from .conftest import same_columns


def find(par, x):
    while par[x] != x:
        x = par[x]
    return x


# --- components ------------------------------------------------------------------
def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(par, a), find(par, b)
        par[max(a, b)] = min(a, b)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(par, x) for a, b in edges if a != b for x in (a, b)}


def tables_of(monkeypatch, call):
    """What ``call`` gives, and the names of the tables that it writes."""
    names, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: names.append(name) or write(df, name))
    return call(), names


def test_no_edge_needs_no_round(spark, monkeypatch):
    loops = spark.createDataFrame([(1, 1), (2, 2)], "a long, b long")
    got, names = tables_of(monkeypatch, lambda: common.components(loops, "t"))
    assert got.columns == ["node", "root"] and got.isEmpty() and names == ["t-edges"]


def test_small_buckets_alone_make_no_clusters(spark, monkeypatch):
    """pipeline: without a large bucket the driver plans none of the steps that serve large ones."""
    links = [(k, 10 * k + i) for k in range(30) for i in range(4)]
    members = spark.createDataFrame(links, "key long, node long")
    similar = lambda pairs, name: common.stored(pairs.where("b - a < 3"), f"{name}-links")
    got, names = tables_of(monkeypatch, lambda: common.bucket_classes(members, similar, None, "t"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {(n, 10 * k) for k, n in links}
    assert not any(n.startswith(("t-clusters", "t-placed", "t-open")) for n in names)


def test_sieve_loses_nothing(spark):
    df = spark.range(5000)
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("k"))
    got = common.sieve(df, F.xxhash64("id"), keys, "f", bits=1 << 12)
    flagged = {r["id"] for r in got.where("f").collect()}
    assert set(range(0, 5000, 7)) <= flagged and got.count() == 5000


# --- BagMinHash ------------------------------------------------------------------
def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for most in (2, 9, 40):
        e = np.sort(rng.integers(0, 2 ** 63, 150).astype(np.uint64))
        w1 = rng.integers(0, most, 150)
        w2 = np.maximum(0, w1 + rng.integers(-2, 3, 150))
        j = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        bags = [(e[w > 0], w[w > 0]) for w in (w1, w2)]
        sig = bag_minhash.signatures(bags, 4096)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - j) < 4 * (j * (1 - j) / 4096) ** 0.5 + 1e-9
        assert bag_minhash.overlap(*bags) == pytest.approx(j)


def exact_classes(docs):
    rows = docs.select("doc_id", "text").collect()
    par = list(range(len(rows)))
    bags = [bag_minhash.bag(r["text"].encode() if r["text"] is not None else None, 5) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(bags[i][0]) and len(bags[j][0]) and bag_minhash.overlap(bags[i], bags[j]) >= 0.8:
                a, b = find(par, i), find(par, j)
                par[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(par, i)].append(r["doc_id"])
    return collections.Counter((i, min((x for x in g if x is not None), default=None), len(g))
                               for g in groups.values() for i in g)


@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_near_duplicates_equal_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    got = bag_minhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == exact_classes(docs)
    kept = bag_minhash.keep_one(docs)
    assert same_columns(kept, docs)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in got if r["keep"])


def test_near_duplicates_empty(empty):
    assert bag_minhash.near_duplicates(empty).collect() == []
    assert bag_minhash.keep_one(empty).collect() == []


def test_buckets_lose_no_link(spark):
    """One large bucket where only neighbours are similar: nearly all links miss the bucket's first node."""
    n = 300
    members = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"))
    made = []

    def verify(pairs, name):
        made.append(pairs.count())
        return common.stored(pairs.where("abs(a - b) <= 1 and least(a, b) % 50 <> 49"), "t")

    def compare(near, name):
        a, b = (near.select("cluster", F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        return (a.join(b, "cluster").where("ra <> rb and abs(a - b) <= 1 and least(a, b) % 50 <> 49")
                .selectExpr("ra a", "rb b"))

    got = common.bucket_classes(members, verify, compare, "t").collect()
    assert {r["node"]: r["root"] for r in got} == {i: i - i % 50 for i in range(n)}
    assert made == [n - 1]  # a star, not all pairs


def test_similar_equals_overlap():
    rng = np.random.default_rng(5)
    bags = []
    for _ in range(40):
        w = rng.integers(0, 5, 60)
        w[:20] += 3
        e = np.arange(1, 61, dtype=np.uint64)
        bags.append((e[w > 0], w[w > 0]))
    got = bag_minhash.similar(bags, 0.7, width=16)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == (bag_minhash.overlap(bags[i], bags[j]) >= 0.7)


def test_large_near_copy_group_equals_brute_force(spark):
    """Hundreds of copies with a few changed words each: above and below the threshold, in large buckets."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 4000, 90)]
    rows = []
    for i in range(260):
        own = list(base)
        for k in rng.integers(0, 90, rng.integers(1, 6)):
            own[k] = f"x{rng.integers(0, 10 ** 6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag_minhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == exact_classes(docs)
    # the same as lines of two documents: one line stays of each component
    docs = spark.createDataFrame([(1, "\n".join(t for _, t in rows[:130])), (2, "\n".join(t for _, t in rows[130:]))],
                                 "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    by = brute_char_lines(docs.collect())
    first = {min((d[1], p) for d, _, p, _ in g) for g in by.values()}
    for r in docs.collect():
        assert out[r["doc_id"]] == "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) in first)


def test_components_on_the_driver_and_over_the_cluster(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(500 + i, 501 + i) for i in range(30)]
    df, got = spark.createDataFrame(edges, "a long, b long"), []
    for few in (common.FEW_EDGES, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        got.append({r["node"]: r["root"] for r in common.components(df, "t").collect()})
    assert got[0] == got[1] and got[0][530] == 500


# --- fuzzy lines -------------------------------------------------------------------
def brute_char_links(lines, width=5):
    """Pairs of line numbers at Jaccard 0.8 or more by sets of character shingles."""
    plain = [re.sub(r"\s+", " ", x.lower(), flags=re.ASCII).strip(" ") for x in lines]
    sets = [{x[i:i + width] for i in range(max(1, len(x) - width + 1))} for x in plain]
    return {(j, i) for i in range(len(sets)) for j in range(i)
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}


def brute_char_lines(rows):
    """Places of each component of lines, by all pairs of distinct lines."""
    places, lines = [], {}
    for i, t in {(r["doc_id"], r["text"]) for r in rows}:
        for p, line in enumerate((t or "").lower().split("\n")):
            if x := re.sub(r"\s+", " ", line, flags=re.ASCII).strip(" "):
                places.append(((i is None, i or 0), t, p, lines.setdefault(x, len(lines))))
    par = list(range(len(lines)))
    for i, j in brute_char_links(list(lines)):
        a, b = find(par, i), find(par, j)
        par[max(a, b)] = min(a, b)
    by = collections.defaultdict(list)
    for place in places:
        by[find(par, place[3])].append(place)
    return by


@pytest.mark.parametrize("which", ["messy", "clashing"])
def test_line_dedup_equals_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    out = line_dedup.dedup_lines(docs, counts=True)
    assert same_columns(out.drop(*out.columns[-2:]), docs)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    before = docs.select("doc_id", "text").collect()
    by = brute_char_lines(before)
    assert sum(len(g) - 1 for g in by.values()) == sum(
        {(r["doc_id"], r["text"]): r[-1] for rs in got.values() for r in rs}.values())
    texts = collections.defaultdict(list)
    for r in before:
        texts[r["doc_id"]].append(r["text"])
    for i, t in texts.items():
        assert len(got[i]) == len(t)
        if i is not None and len(t) == 1:  # one text under the id: its first lines are known exactly
            gone = {p for g in by.values() for (_, d), x, p, _ in g if d == i and x == t[0]
                    and min((a, b, c, q) for (a, b), c, q, _ in g)[:2] != (False, i)}
            if not any(len({x[1] for x in g}) > 1 and g[0][0] == (False, i) for g in by.values()):
                lines = (t[0] or "").split("\n")
                own_first = set()
                for g in by.values():
                    mine = sorted(p for (_, d), x, p, _ in g if d == i)
                    if mine and min(g, key=lambda x: x[0])[0] == (False, i):
                        own_first |= set(mine[1:])
                want = None if t[0] is None else "\n".join(x for p, x in enumerate(lines) if p not in gone | own_first)
                assert got[i][0]["text"] == want


def test_line_dedup_on_documents(spark, small):
    """The removed places are all but the first of each component."""
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(small).collect()}
    rows = small.orderBy("doc_id").collect()
    gone = set()
    for g in brute_char_lines(rows).values():
        g = sorted(g, key=lambda x: (x[0], x[2]))
        gone |= {(d[1], p) for d, _, p, _ in g[1:]}
    for r in rows:
        assert out[r["doc_id"]] == "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) not in gone)


def random_sets(rng, sizes):
    """Lines whose shingles are all different, as distinct characters, by the number of shingles."""
    return ["".join(chr(0x4E00 + c) for c in rng.integers(0, 20000, n + 4)) for n in sizes]


@pytest.mark.parametrize("union", [5, 10, 15, 20, 60, 199, 210, 260, 320, 700])
def test_bands_find_pairs_of_all_sizes(union):
    """Pairs at Jaccard 0.8 share a key as often as with independent permutations (0.9992)."""
    o, n = line_dedup.Options(), 1500
    rng = np.random.default_rng(union)
    h = rng.integers(0, 1 << 44, (n, union), dtype=np.uint64)
    met = 0
    with np.errstate(over="ignore"):
        keys = []
        for take in (union, union * 4 // 5):
            x = np.sort(h[:, :take], axis=1)
            owner = np.repeat(np.arange(n), take)
            own = np.zeros((n, 2 * o.bands), np.uint64)
            if take >= 0.8 * o.small:
                own[:, :o.bands] = line_dedup.bin_keys(x.ravel(), owner, n, o)
            if take <= o.small:
                own[:, o.bands:] = line_dedup.permuted_keys(x.ravel(), np.arange(n) * take, o)
            keys.append(own)
    met = ((keys[0] == keys[1]) & (keys[0] != 0)).any(axis=1).mean()
    assert met > 0.9965


def test_different_sets_share_few_keys():
    """Of sets at Jaccard 0.3, few pairs become candidates."""
    o, n = line_dedup.Options(), 3000
    for union in (40, 600):
        h = np.random.default_rng(union).integers(0, 1 << 44, (n, union), dtype=np.uint64)
        keys = []
        for lo, hi in ((0, union * 13 // 20), (union * 7 // 20, union)):
            x = np.sort(h[:, lo:hi], axis=1)
            size = hi - lo
            with np.errstate(over="ignore"):
                keys.append(line_dedup.bin_keys(x.ravel(), np.repeat(np.arange(n), size), n, o) if union > 300
                            else line_dedup.permuted_keys(x.ravel(), np.arange(n) * size, o))
        assert ((keys[0] == keys[1]) & (keys[0] != 0)).any(axis=1).mean() < 0.09


@pytest.mark.parametrize("union", [10, 60, 195, 245, 400, 900])
def test_sketches_rule_out_no_similar_pair(spark, union):
    """Sketches leave every pair at Jaccard 0.8 open, and hardly any at 0.1 of sets that aren't tiny."""
    o, n = line_dedup.Options(), 2000
    h = np.random.default_rng(union).integers(0, 1 << 44, (n, union), dtype=np.uint64)
    bins = union * 4 // 5 >= o.similarity * o.small

    def words(x):
        x, take = np.sort(x, axis=1), x.shape[1]
        with np.errstate(over="ignore"):
            return line_dedup.sketched(line_dedup.bin_minima(x.ravel(), np.repeat(np.arange(n), take), n, o) if bins
                                       else line_dedup.permuted_minima(x.ravel(), np.arange(n) * take, o)).view(np.int64)

    def kept(a, b):
        size = [x.shape[1] for x in (a, b)]
        rows = [(*size, *map(int, x), *map(int, y)) for x, y in zip(words(a), words(b))]
        names = ["a_size", "size", *[f"a_w{k}" for k in range(3)], *[f"w{k}" for k in range(3)]]
        pairs = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
        return pairs.where(line_dedup.may_agree("a_", "", o)).count()

    assert kept(h, h[:, :union * 4 // 5]) == n
    if union >= 60:
        cut = union * 11 // 20
        assert kept(h[:, :cut], h[:, union - cut:]) <= n // 1000


def test_random_lines_of_a_language_are_not_compared_by_text(spark, monkeypatch):
    """Lines of the same frequent words share keys by the hundred; hardly any are candidates."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("aeiounrst"), rng.integers(2, 7))) for _ in range(80)]
    share = 1 / np.arange(1, 81)
    lines = [" ".join(rng.choice(words, 120, p=share / share.sum())) for _ in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows, stored = {}, line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: rows.setdefault(name, stored(df, name)))
    want = brute_char_links(lines)
    out = line_dedup.dedup_lines(docs, counts=True)
    assert not want and out.agg(F.sum(out.columns[-1])).first()[0] == 0
    count = {k: v.count() for k, v in rows.items()}
    assert count["line-buckets"] > 500
    assert count["line-pairs"] + count.get("line-rest-pairs", 0) + count.get("line-near", 0) < count["line-buckets"] // 20


def test_pairs_are_similar_by_hash_as_by_text():
    rng = np.random.default_rng(5)
    a = random_sets(rng, [1, 4, 30, 100, 400, 2500] * 20)
    b = [x[:max(1, round(len(x) * f))] for x, f in zip(a, rng.uniform(0.7, 0.9, len(a)))]
    o = line_dedup.Options()
    assert line_dedup.similar(a, b, o).tolist() == [
        line_dedup.close(line_dedup.shingle_set(x, 5), line_dedup.shingle_set(y, 5), o.similarity) for x, y in zip(a, b)]


def test_signatures_do_not_depend_on_chunks_or_order():
    rng = np.random.default_rng(3)
    lines = random_sets(rng, [1, 3, 40, 199, 200, 250, 251, 900]) + ["ab" * 700, "abc", "x"]
    size, keys = line_dedup.signatures(lines, line_dedup.Options())
    assert size.tolist() == [len(line_dedup.shingle_set(x, 5)) for x in lines]
    for i, x in enumerate(lines):
        s, k = line_dedup.signatures([x], line_dedup.Options())
        assert s[0] == size[i] and (k[0] == keys[i]).all()
    both = (keys[:, :18] != 0).any(axis=1) & (keys[:, 18:] != 0).any(axis=1)
    assert [n for n, b in zip(size, both) if b] == [n for n in size if 200 <= n <= 250]


def test_repetitive_lines_meet_short_ones(spark):
    """Long lines of few different shingles are linked to short ones and to each other."""
    rows = [(1, "tick tock " * 40), (2, "tick tock " * 6), (3, "tick tock " * 90), (4, "abc " * 200 + "\n" + "abc " * 4),
            (5, "something else altogether, which stands alone"), (6, "tick tock tick tack " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = set()
    for g in brute_char_lines(docs.collect()).values():
        gone |= {(d[1], p) for d, _, p, _ in sorted(g, key=lambda x: (x[0], x[2]))[1:]}
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert out == {i: len([1 for g in gone if g[0] == i]) for i, _ in rows} and len(gone) == 3


def test_small_buckets_of_one_class_are_not_compared_pair_by_pair(spark, monkeypatch):
    """op4: twelve copies are compared with the first of a bucket; lines apart in a bucket are still compared with each other."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    base, rows = words(90), []
    for i in range(12):
        rows.append((i, " ".join(base[:7 * i] + [f"x{i}"] + base[7 * i + 1:])))
    # a chain: neighbours are similar, the ends are not
    chain = words(60)
    rows += [(100 + i, " ".join(chain[5 * i:5 * i + 40])) for i in range(5)]
    compared = {}

    def kept(df, name):
        out = plain(df, name)
        if name.endswith("-able"):
            compared[name] = out.count()
        return out

    plain = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    gone = {d[1] for g in brute_char_lines(docs.collect()).values() for d, *_ in sorted(g, key=lambda x: (x[0], x[2]))[1:]}
    assert {i for i, n in out.items() if n} == gone and set(range(1, 12)) <= gone
    assert sum(compared.values()) < 12 * 11 // 2


def test_hot_line_is_joined_by_broadcast(spark, monkeypatch):
    """A line in every document, by the broadcast and by the plain join."""
    rows = [(i, f"the same line in all of the documents here\nown words of document number {i * 7919} only") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = None
    for hot in (1024, 1):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        out = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
        want = want or out
        assert out == want and sum("same line" in t for _, t in out) == 1


def test_line_dedup_empty(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


# --- substrings --------------------------------------------------------------------
def brute_substrings(rows):
    """Result rows by the definition, for rows whose texts under one doc_id are equal."""
    seen, out = {}, collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            first = seen.setdefault(tuple(w[s:s + 20]), (i, s))
            if first != (i, s):
                gone[s:s + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_word_hashes_are_by_word():
    long = (b"word " * 10 + b"y" * 3000 + b"\n") * 1200
    texts = [b"a bb  ccc", b"", b"bb\ta", long, b" a", b"", b"z" * 5000]
    h, first = substring_dedup.word_hashes(texts)
    flat = [w for t in texts for w in t.split()]
    assert len(h) == len(flat) and first.tolist() == [0, *np.cumsum([len(t.split()) for t in texts])]
    by = {}
    for w, x in zip(flat, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 6])
@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_substrings_equal_brute_force(spark, small, bits, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot * 10 ** 6 if hot == 1 else hot)  # one case: every seed is hot
    monkeypatch.setattr(substring_dedup, "SALTS", 2 if hot == 1 else 64)
    got = substring_dedup.remove_repeats(small, substring_dedup.Options(sieve_bits=bits)).collect()
    want = brute_substrings([(r["doc_id"], r["text"]) for r in small.collect()])
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    for r in got:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert all(f["words"] >= 20 for f in r["factors"])
        assert bool(r["factors"]) == (r["n_removed"] > 0)


@pytest.mark.parametrize("which", ["messy", "clashing"])
def test_substrings_messy(spark, request, which):
    docs = request.getfixturevalue(which)
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    single = docs.where("doc_id is not null and doc_id <> 11").dropDuplicates(["doc_id", "text"])
    want = brute_substrings([(r["doc_id"], r["text"]) for r in single.select("doc_id", "text").collect()])
    keys = {k[0] for k in want}
    have = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] in keys}
    assert have == set(want)
    nulls = {(r["n_words"], r["n_removed"]) for r in got if r["doc_id"] is None}
    assert nulls == {(25, 0), (0, 0), (120, 120)}


def test_substrings_empty(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_lines_are_linked_by_character_shingles(spark):
    """Lines with one character changed, short English ones and some without blanks."""
    rng = np.random.default_rng(21)
    lines = []
    for k in range(40):
        if k % 2:
            base = "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 70))
        else:
            base = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(11))
        at = int(rng.integers(10, len(base) - 10))
        lines += [base, base[:at] + "#" + base[at + 1:]]
    links = brute_char_links(lines)
    assert links == {(i, i + 1) for i in range(0, 80, 2)}
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert {i for i, n in out.items() if n} == {b for _, b in links}


def test_line_dedup_equals_brute_force_on_characters(spark, small, messy):
    one = messy.where("doc_id is not null and not (doc_id = 11 and length(text) > 9999)").distinct()
    for docs in (small, one):
        rows = docs.select("doc_id", "text").collect()
        gone = set()
        for g in brute_char_lines(rows).values():
            g = sorted(g, key=lambda x: (x[0], x[2]))
            gone |= {(d[1], p) for d, _, p, _ in g[1:]}
        out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
        for r in rows:
            want = r["text"] and "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) not in gone)
            assert out[r["doc_id"]] == want
