import base64
import collections
import gzip
import hashlib
import json
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emporio.llm import compression_rules, cotraining, decontaminate, language_id, queries, secret_scan

from .conftest import same_columns


def rows_of(docs):
    return docs.select("doc_id", "text").collect()


# --- compression bands --------------------------------------------------------------
def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(hit), failed)


@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_rules_equal_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    got = compression_rules.judge(docs).collect()
    have = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                                r["n_repeat_words"], r["base_failed"]) for r in got)
    assert have == collections.Counter((r["doc_id"], *brute_rules(r["text"])) for r in rows_of(docs))
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_bands_reject_repetition_and_noise(spark, empty):
    rng = np.random.default_rng(2)
    z, bands = zstandard.ZstdCompressor(level=3), compression_rules.Bands()
    prose = " ".join("".join(chr(97 + c) for c in rng.choice(12, rng.integers(2, 9))) for _ in range(900)).encode()
    noise = base64.b85encode(rng.bytes(6000))
    assert compression_rules.verdict(prose, bands, z)[0]
    assert not compression_rules.verdict(b"the same words again " * 300, bands, z)[0]
    assert not compression_rules.verdict(noise, bands, z)[0]
    # whole texts are judged: most chunks are bad, though the start is good
    assert not compression_rules.verdict(prose[:4096] + b"again and " * 4000, bands, z)[0]
    assert compression_rules.judge(empty).collect() == []


# --- decontamination ----------------------------------------------------------------
def brute_hits(rows, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = rx.findall((t or "").translate(lower))
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[s:s + 10])].add("null" if i is None else str(i))
    lengths = {len(k) for k in wins}
    out = collections.Counter()
    for i, t in rows:
        w = rx.findall((t or "").translate(lower))
        hit, ids = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        out[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    return out


def plain(rows):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"],
                                r["contaminated"]) for r in rows)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1500])
def test_decontamination_equals_brute_force(spark, small, messy, block_bytes):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(900, "one, TWO three!"), (None, "ñandú 漢字 été"), (901, None), (902, "..."),
                                   (900, "one two three"), (1000, "x x x x")], "item_id long, text string")
    bench = bench.select("item_id", "text").union(extra)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    for docs in (small, messy):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).collect()
        assert plain(got) == brute_hits(rows_of(docs), items)
        kept = decontaminate.clean(docs, bench, block_bytes=block_bytes)
        assert same_columns(kept, docs)
        assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(
            r["doc_id"] for r in got if not r["contaminated"])


def test_decontamination_spans_and_empty(spark, empty, clashing):
    bench = spark.createDataFrame([(1, "Alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é ALPHA,  beta! alpha beta gamma alpha")], "doc_id long, text string")
    row = decontaminate.decontaminate(docs, bench).first()
    raw = "é ALPHA,  beta! alpha beta gamma alpha".encode()
    assert [raw[s["start"]:s["end"]] for s in row["spans"]] == [b"ALPHA,  beta! alpha beta"]
    none = bench.limit(0)
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.clean(docs, none).count() == 1
    assert decontaminate.decontaminate(empty, bench).collect() == [] == decontaminate.clean(empty, bench).collect()
    assert same_columns(decontaminate.clean(clashing, bench), clashing)


# --- secrets --------------------------------------------------------------------------
def brute_base(t):
    out = []
    rx = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rx, t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("which", ["small", "messy", "clashing"])
def test_base_spans_equal_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    got = secret_scan.scan_secrets(docs).collect()
    want = collections.Counter()
    for r in rows_of(docs):
        base = brute_base(r["text"] or "")
        want[(r["doc_id"], *(sum(k == n for _, k, _ in base) for n in range(3)),
              hashlib.sha256(secret_scan.told(base).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


KEY = "AKIA" + "ABCDEFGH12345678"


@pytest.mark.parametrize("wrap", [
    lambda s: s,
    lambda s: base64.b64encode(s).rstrip(b"="),
    lambda s: base64.urlsafe_b64encode(s),
    lambda s: "".join(f"%{c:02x}" for c in s).encode(),
    lambda s: "".join(f"\\u{c:04x}" for c in s).encode(),
    lambda s: "".join(f"&#{c};" for c in s).encode(),
    lambda s: base64.b64encode(gzip.compress(s)),
    lambda s: base64.b64encode(zlib.compress(s)),
    lambda s: base64.b64encode(zstandard.compress(s)),
    lambda s: base64.b64encode("".join(f"%{c:02x}" for c in base64.b64encode(s)).encode()),
    lambda s: "".join(f"%{c:02x}" for c in base64.b64encode(gzip.compress(base64.b64encode(s)))).encode()])
def test_wrapped_secrets_are_found(wrap):
    secret = wrap(KEY.encode())
    data = "é vor ".encode() + secret + b" nach"
    base, found, _ = secret_scan.scan(data)
    spans = [(a, b) for a, k, b in secret_scan.points(data, found) if k == 1]
    assert spans == [(6, 6 + len(secret))] or len(spans) == 1 and spans[0][0] == 6
    assert set(base) <= found


def test_base_semantics():
    for t in ("secret=token:abcdefgh", "token=token=abcdef", "PassWord : 'abc.def-1'", "api_key\"= \"x12345", "apikey=12345",
              "ſecret=abcdefgh", "toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24 + "g" + "0" * 30):
        data = t.encode()
        assert secret_scan.points(data, secret_scan.scan(data)[0]) == brute_base(t), t


def test_cycles_and_long_texts_end(spark, empty):
    data = b"%25" * 2000 + b" " + b"%2525252525" * 50
    assert secret_scan.scan(data)[2] < 20
    assert secret_scan.scan(b"A" * 200_000)[2] < 50
    assert secret_scan.scan_secrets(empty).collect() == []


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(gzip.compress(gzip.compress(s))),
    lambda s: base64.b64encode(zlib.compress(zstandard.compress(s))),
    lambda s: "".join(f"%{c:02X}" for c in gzip.compress(s)).encode(),
    lambda s: "".join(f"\\x{c:02x}" for c in gzip.compress(s)).encode(),
    lambda s: repr(zlib.compress(s))[2:-1].encode(),
    lambda s: base64.b64encode(gzip.compress(b"none here") + gzip.compress(s)),
    lambda s: base64.b64encode(gzip.compress(s[:9]) + gzip.compress(s[9:])),
    lambda s: base64.b64encode(zstandard.compress(b"none here") + zstandard.compress(s))])
def test_nested_compression_is_found(wrap):
    secret = wrap(KEY.encode())
    data = "é vor ".encode() + secret + b" nach"
    base, found, _ = secret_scan.scan(data)
    assert [(a, k) for a, k, _ in secret_scan.points(data, found)] == [(6, 1)] and not base


def test_a_long_compressed_stretch_is_read_to_its_end():
    for body, pack in ((b"some words, and more. " * (49 << 16), zstandard.compress), (b"\0" * (70 << 20), gzip.compress)):
        data = base64.b64encode(pack(body + KEY.encode()))
        assert {k for _, k, _ in secret_scan.scan(data)[1]} == {1}


def test_pieces_lose_nothing():
    rng = np.random.default_rng(3)
    for body in (b"a1. ", b"x", b"line of words\n"):
        body = body * (40 << 20 >> 4)
        cuts = sorted(rng.integers(0, len(body), 30))
        parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]
        got, at = list(secret_scan.pieces(iter(parts))), 0
        for p in got:
            assert p in body
        assert sum(map(len, got)) >= len(body) and got[-1] == body[len(body) - len(got[-1]):]


@pytest.mark.parametrize("prefix", ["/callback/", "key_", "path/", "a-", "ab", "abc", "x1/y2_"])
@pytest.mark.parametrize("pack", [lambda s: s, gzip.compress, lambda s: b"\1\xff" + s, lambda s: s.decode().encode("utf-16")])
def test_base64_behind_characters_of_its_class(prefix, pack):
    data = b"see " + prefix.encode() + base64.b64encode(pack(KEY.encode() + b" and some more words")) + b" there"
    assert [k for _, k, _ in secret_scan.scan(data)[1]] == [1]


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\n  "])
def test_base64_in_lines(end):
    salt = bytes(np.random.default_rng(8).integers(0, 256, 300, np.uint8))
    for plain in (b"some words " * 4 + b"and " + KEY.encode() + b" more words" * 9, gzip.compress(salt + KEY.encode())):
        b64 = base64.b64encode(plain)
        data = b"see\n" + end.join(b64[a:a + 76] for a in range(0, len(b64), 76)) + b"\nthere"
        assert {k for _, k, _ in secret_scan.scan(data)[1]} == {1}


# --- language ----------------------------------------------------------------------------
def brute_phrases(ref, text):
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in ref:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_equal_greedy_parse():
    rng = np.random.default_rng(4)
    refs = [bytes(rng.choice(list(b"abcd "), 700).tolist()), bytes(rng.choice(list(b"abxy "), 300).tolist()), b"aaaa"]
    model = language_id.fit_model(["p", "q", "r"], refs)
    texts = [bytes(rng.choice(list(b"abcdxyz "), n).tolist()) for n in (0, 1, 50, 333, 64)] + [refs[0], b"zzz", b"a" * 40]
    got = language_id.phrase_counts(model, texts, 10 ** 6, 3)
    assert got.tolist() == [[brute_phrases(r, t) for r in refs] for t in texts]
    # segments start new phrases
    cut = language_id.phrase_counts(model, texts, 64, 2)
    want = [[sum(brute_phrases(r, t[a:a + 64]) for a in range(0, len(t), 64)) for r in refs] for t in texts]
    assert cut.tolist() == want


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_messy(spark, messy, clashing, empty):
    got = language_id.identify(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    assert {r["lang_pred"] for r in got} <= {"und", "en", "fr", "de", "es"}
    assert sorted(map(str, language_id.identify(clashing).collect())) == sorted(map(str, got))
    assert language_id.identify(empty).collect() == []
    unlabelled = messy.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_rare_and_near_empty_languages(spark):
    """German with about 2.5 KB of labelled text, one language without a letter and one with a word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    free = [i for i in range(10 ** 9, 10 ** 9 + 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    known = [r for r in docs.where("lang = 'de' and length(text) > 1300").orderBy("doc_id").collect()
             if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2][:2]
    extra = [(free[k], "de", r["text"][:1300]) for k, r in enumerate(known)] + [(free[5], "zz", "12 34 ..."), (free[6], "zy", "ok")]
    table = docs.withColumn("lang", F.expr("nullif(lang, 'de')")).union(spark.createDataFrame(extra, docs.schema))
    langs, texts = language_id.learn(table, language_id.Sample())
    sizes = dict(zip(langs, map(len, texts)))
    assert 2000 <= sizes["de"] < 3000 and sizes["zz"] == 0 and sizes["en"] > 10 * sizes["de"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(table).where("held_out").collect()}
    for x in ("de", "en", "es", "fr"):
        assert np.mean([got[i] == x for i in got if truth[i] == x]) > 0.95, x


# --- quality ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    opts = cotraining.Options(labelled_rows=2500, pool_rows=800)
    got = {r["doc_id"]: r for r in cotraining.classify(docs, labels, opts).collect()}
    return got, labels.collect(), docs


def test_quality_on_labels(spark, quality):
    got, labels, docs = quality
    assert len(got) == docs.count()
    good = [got[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    poor = [got[r["doc_id"]]["keep"] for r in labels if r["quality"] == 0]
    toxic = [got[r["doc_id"]]["keep"] for r in labels if r["toxic"] == 1]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.05 and np.mean(toxic) < 0.2


def test_quality_messy(spark, messy, clashing, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").union(
        spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars")
    labels = labels.union(labels.selectExpr("doc_id + 1000", "quality", "toxic"))
    docs = messy.unionByName(small)
    got = cotraining.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert same_columns(cotraining.accepted(clashing, labels), clashing)
    assert all(r["score"] == 1 and r["keep"] for r in cotraining.classify(messy, labels.limit(0)).collect())
    assert cotraining.classify(empty, labels).collect() == []


def test_scores_equal_the_model_row_by_row(spark):
    """What the query returns is the learned model, applied to whole texts one after another."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = cotraining.learn(docs, labels)
    got = {r["doc_id"]: r for r in cotraining.classify(docs, labels).collect()}
    for r in docs.collect():
        t = (r["text"] or "").encode()
        found = cotraining.evidence([m.words[w] for w in cotraining.terms_of(cotraining.words_of(t)) if w in m.words])
        a, b = m.odds([found], np.array([cotraining.shares_of(t)]), [cotraining.meta_of(r["lang"], r["source"], r["n_chars"])])
        p = float(cotraining.sigmoid(a + b - m.prior)[0])
        assert abs(got[r["doc_id"]]["score"] - p) < 1e-12 and got[r["doc_id"]]["keep"] == (p >= 0.5)


@pytest.mark.parametrize("bad", [0, 1, 2, 3, 4, 9])
def test_rare_classes_are_in_every_part(bad):
    good = np.array([1.0] * 60 + [0.0] * bad + [np.nan] * 5)[np.random.default_rng(bad).permutation(65 + bad)]
    train, held = cotraining.split(good)
    for part in (train[0::2], train[1::2], held):
        assert set(good[part]) == ({0.0, 1.0} if bad else {1.0})
    if bad >= 4:
        assert not set(train) & set(held) and len(set(train)) == len(train)


def test_two_bad_rows_give_a_model(spark):
    """400 labelled rows, two of them bad: a model is fitted, not an empty one that keeps everything."""
    rows = [(i, "plain words of a good document number %d" % i, "en", "a", 40) for i in range(398)]
    rows += [(398, "### %%% $$$ @@@ !!!", "en", "a", 19), (399, "!!! ### $$$ %%%", "en", "a", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 398), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = cotraining.learn(docs, labels)
    assert model.text is not None
    got = {r["doc_id"]: r["keep"] for r in cotraining.classify(docs, labels).collect()}
    assert not got[398] and not got[399] and sum(got.values()) == 398


def test_a_language_is_learned_from_whole_texts(spark):
    """No text is cut: what fits is taken whole, and of texts that don't fit the shortest."""
    rows = [(i, ("alpha%d " % i) * 40, "x") for i in range(60)] + [(100 + i, "omega%d " % i * (3000 + i), "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, texts = language_id.learn(docs, language_id.Sample(ref_bytes=3000))
    assert langs == ["x", "y"] and len(texts[0]) <= 3100
    for t, lang in zip(texts, langs):
        whole = {language_id.plain(r[1].encode()) for r in rows if r[2] == lang}
        while t:
            own = max((w for w in whole if t.startswith(w) and t[len(w):len(w) + 1] in (b"", b" ")), key=len)
            t = t[len(own):]


def test_views_exchange_confident_labels():
    rng = np.random.default_rng(9)
    n, y = 900, rng.integers(0, 2, 900)
    # both views tell the classes apart; a third of the rows is labelled
    sets = [np.array(sorted(set(rng.integers(0, 50, 20)) | ({60} if y[i] else {61}))) for i in range(n)]
    shares = rng.normal(size=(n, 9))
    slots = [[int(y[i]) * 3 + 1, 40, 50] for i in range(n)]
    good = np.where(np.arange(n) < 300, y, np.nan)
    s = cotraining.Sample(good, sets, [b"t%d" % k for k in range(62)], shares, slots)
    model = cotraining.co_train(s, cotraining.Options())
    assert model.exchanged and all(sum(x) > 0 for x in model.exchanged[:1]) and min(model.exchanged[0]) > 0
    t, m = model.odds(cotraining.term_scores(np.array([model.words.get(w, 0.0) for w in s.vocabulary]), sets), shares, slots)
    assert ((t + m - model.prior > 0) == (y == 1)).mean() > 0.99


# --- registration ------------------------------------------------------------------------
def test_every_operator_is_registered():
    names = entry.queries()
    for k in range(1, 14):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
    assert "pipeline" in names and json.dumps(sorted(entry.oracle_sql()))


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from emporio.llm.common import stored
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), "test-stage")
        assert same_columns(out, docs), name
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
