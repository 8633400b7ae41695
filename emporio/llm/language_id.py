"""Operator 3, language ID: cross-parsing entropy.

Per language a suffix automaton of labelled text gives, at every place
of a new text, the longest match with that language's text.  Parsing a
text into longest matches (each byte without a match is a phrase of its
own) counts phrases; phrases times log2 of the longest reference's
length, per byte, is the cross entropy.  The language with the least
wins.  A phrase costs the same in every language: a language with little
text has shorter matches and so higher costs, and one with next to none
pays that price for each byte.

The automata are fitted on a bounded sample of whole documents: of the
``sample_docs`` documents of a language with the smallest hash those that
fit, one after another, into ``ref_bytes`` bytes; if none does, the
shortest.  Predictions parse whole
texts: segments of ``segment`` bytes each start a new phrase and are
parsed side by side.

Defined results: a NULL text, or one without a letter, is ``und`` with
score 0; ties go to the first language in order; repeated rows get one
row each; with no labelled text every prediction is ``und``; a NULL
doc_id is neither held out nor learned from; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"

#: A-Z to lower case; other ASCII but a-z to spaces; bytes of longer characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(data: bytes) -> bytes:
    """Lower-case words, each after one space."""
    return b" ".join([b"", *data.translate(LETTERS).split()])


@dataclass(frozen=True)
class Sample:
    sample_docs: int = 300
    ref_bytes: int = 50_000
    segment: int = 4096
    lanes: int = 4096


def suffix_automaton(data: bytes) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton of ``data``, state 0 being the root, and its suffix links."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step, link


def parse_table(data: bytes, classes: np.ndarray, width: int) -> np.ndarray:
    """Next state (times ``width``) by state and byte class; the top bit marks the start of a phrase.

    A byte that can't extend the match starts a new phrase at the root;
    one that the text doesn't have at all leaves the parse at the root.
    """
    step, _ = suffix_automaton(data)
    first = np.full(width, 1 << 31, np.uint32)
    for c, t in step[0].items():
        first[classes[c]] = t * width | 1 << 31
    table = np.tile(first, (len(step), 1))
    for s, own in enumerate(step):
        if s:
            for c, t in own.items():
                table[s, classes[c]] = t * width
    return table.ravel()


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray       # byte -> class; the last class is any byte not in the sample
    tables: list[np.ndarray]
    bits: float               # bits of a phrase, the same for all languages


def fit_model(langs: list[str], texts: list[bytes]) -> Model:
    used = sorted({c for t in texts for c in t})
    classes = np.full(256, len(used), np.uint8 if len(used) < 256 else np.uint16)
    classes[used] = np.arange(len(used))
    tables = [parse_table(t, classes, len(used) + 1) for t in texts]
    return Model(langs, classes, tables, float(np.log2(max([2, *map(len, texts)]))))


def phrase_counts(model: Model, texts: list[bytes], segment: int, lanes: int) -> np.ndarray:
    """Phrases of each text by language."""
    parts = [(k, t[a:a + segment]) for k, t in enumerate(texts) for a in range(0, len(t), segment)]
    parts.sort(key=lambda p: -len(p[1]))
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    for at in range(0, len(parts), lanes):
        block = parts[at:at + lanes]
        lengths = np.array([len(p) for _, p in block])
        # one row per position, so that a step reads neighbouring bytes
        chars = np.zeros((len(block), lengths[0]), np.uint8)
        for row, (_, p) in zip(chars, block):
            row[:len(p)] = np.frombuffer(p, np.uint8)
        chars = model.classes[chars.T].astype(np.uint32)
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # lanes at each position
        owner = np.array([k for k, _ in block])
        for j, table in enumerate(model.tables):
            state, count = np.zeros(len(block), np.uint32), np.zeros(len(block), np.int64)
            for i, n in enumerate(live.tolist()):
                v = table[state[:n] + chars[i, :n]]
                count[:n] += v >> 31
                state[:n] = v & 0x7FFFFFFF
            np.add.at(out[:, j], owner, count)
    return out


_MODELS: dict[str, Model] = {}


def learn(docs: DataFrame, opts: Sample) -> tuple[list[str], list[bytes]]:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "lang", "text").where(
        "lang is not null and doc_id is not null and text is not null "
        "and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    # the sample is picked on narrow rows; the limit by rank runs before the shuffle as well
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = (keyed.select("lang", "doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
            .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= opts.sample_docs).collect())
    chosen: dict[str, list] = {}
    for lang in sorted({r["lang"] for r in some}):
        left, seen = opts.ref_bytes, set()
        own = sorted((r for r in some if r["lang"] == lang), key=lambda r: r["_r"])
        for r in own:
            if r["size"] <= left and (r["doc_id"], r["h"]) not in seen:
                left -= r["size"]
                seen.add((r["doc_id"], r["h"]))
        if not seen:
            r = min(own, key=lambda r: (r["size"], r["_r"]))
            seen = {(r["doc_id"], r["h"])}
        chosen[lang] = sorted(seen)
    if not chosen:
        return [], []
    keys = docs.sparkSession.createDataFrame([(x, d, h) for x, own in chosen.items() for d, h in own], "lang string, doc_id long, h long")
    # ``ref_bytes`` of a language reach the driver
    rows = (keyed.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), ["lang", "doc_id", "h"])
            .dropDuplicates(["lang", "doc_id", "h"]).orderBy("lang", F.xxhash64("doc_id"), "h").select("lang", "text").collect())
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r["text"].encode())
    langs = sorted(parts)
    return langs, [b"".join(map(plain, parts[x])) for x in langs]


def identify(docs: DataFrame, opts: Sample = Sample()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    # the texts are sent, not the tables, which are a few hundred times as large
    sent, tag = spark.sparkContext.broadcast(learn(docs, opts)), uuid.uuid4().hex

    def run(batches):
        m = _MODELS.get(tag)
        if m is None:
            _MODELS.clear()
            m = _MODELS[tag] = fit_model(*sent.value)
        for batch in batches:
            letters = batch.column(3).to_pylist()
            texts = [plain(t.as_buffer().to_pybytes()) if ok and m.langs else b"" for t, ok in zip(batch.column(2), letters)]
            langs, scores = [UND] * len(texts), np.zeros(len(texts))
            todo = [k for k, t in enumerate(texts) if t]
            if todo:
                n = phrase_counts(m, [texts[k] for k in todo], opts.segment, opts.lanes)
                h = n * m.bits / np.array([len(texts[k]) for k in todo])[:, None]
                best = h.argmin(axis=1)
                if len(m.langs) > 1:
                    two = np.partition(h, 1, axis=1)
                    score = 1 - np.divide(two[:, 0], two[:, 1], out=np.ones(len(todo)), where=two[:, 1] > 0)
                else:
                    score = np.ones(len(todo))
                for k, b, s in zip(todo, best, score):
                    langs[k], scores[k] = m.langs[b], s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.selectExpr("cast(doc_id as long) doc_id",
                            "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false) held_out",
                            "cast(text as binary) text", r"coalesce(text rlike '\\p{L}', false) letters")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))
