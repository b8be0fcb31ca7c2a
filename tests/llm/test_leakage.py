"""The FM-index against plain searching, and leaked passages against comparing all windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import leakage, wordhash
from millrace.llm.fmindex import FMIndex, WaveletMatrix, suffix_order
from tests.conftest import rows


def stretches(rng, sigma, n, longest):
    out = [0]
    for _ in range(n):
        if rng.random() < 0.3 and len(out) > 40:
            a = rng.randrange(1, len(out) - 20)
            out += [x for x in out[a : a + rng.randrange(1, 20)] if x] + [0]
        out += [rng.randrange(1, sigma) for _ in range(rng.randrange(1, longest))] + [0]
    return np.array(out, dtype=np.int64)


@pytest.mark.parametrize(("seed", "sigma"), [(1, 2), (2, 3), (3, 40), (4, 1000)])
def test_index_against_plain_search(seed, sigma):
    rng = random.Random(seed)
    text = stretches(rng, sigma, 120, 30)
    unique = np.where(text == 0, np.arange(len(text)) - len(text), text)
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: unique[i : i + 600].tolist())
    index = FMIndex(text, sigma, sample=5)
    for size in (1, 3, 6):
        at = [i for i in range(len(text) - size) if (text[i : i + size] != 0).all()]
        patterns = np.array([text[i : i + size] for i in rng.sample(at, min(20, len(at)))] + [[rng.randrange(1, sigma) for _ in range(size)] for _ in range(20)])
        found = dict(zip(*(x.tolist() for x in index.search(patterns)[:1]), zip(*(x.tolist() for x in index.search(patterns)[1:]))))
        for k, p in enumerate(patterns):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert (k in found) == bool(want)
            if want:
                assert sorted(index.locate(np.arange(*found[k])).tolist()) == want


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = WaveletMatrix(s, 37)
    c, i = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert (w.rank(c, i) - w.rank(c, np.zeros(200, dtype=np.int64))).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i)]


def words(text):
    return re.findall(r"[a-z0-9]+", re.sub(r"[^A-Za-z0-9]", " ", text).lower())


def brute(docs, items, size):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    known = [(i, grams(t)) for i, t in items if i is not None and t]
    return sorted({(d, i) for d, t, *_ in docs if d is not None and t for i, g in known if g & grams(t)})


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["def", "Return", "x1", "für", "İ", "K", "a", "b", "if", "nul\x00l"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "_", "é", ", "]) for _ in range(n))
    items = [(i, text(rng.choice([3, 13, 40]))) for i in range(15)] + [(50, None), (None, text(20)), (51, ""), (52, " ... ")]
    docs = []
    for d in range(60):
        t = text(rng.choice([0, 5, 60]))
        if rng.random() < 0.5:
            w = re.split(r"(?<=\W)", rng.choice(items[:15])[1])
            a = rng.randrange(len(w))
            t += "".join(w[a : a + rng.randrange(10, 40)]).swapcase() + text(3)
        docs.append((d, t, "item"))
    return docs + [(70, None, ""), (None, items[2][1], ""), (71, "", ""), (72, text(20000) + items[2][1], ""), (3, docs[3][1], ""), (73, docs[4][1], "")], items


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, 1 << 23, 1 << 25), (2, 2000, 1 << 25), (3, 1 << 23, 300), (4, 2000, 100)])
def test_leaks_against_all_windows(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(leakage, "SHARD_BYTES", shard)
    monkeypatch.setattr(leakage, "BLOCK_BYTES", block)
    monkeypatch.setattr(leakage, "PASS_BYTES", 3 * block)
    monkeypatch.setattr(leakage, "_LOCATE_ROWS", 7)
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaked_passages(d, i, words=12)
    assert rows(found.select("doc_id", "item_id")) == brute(docs, items, 12)
    texts = {d: t for d, t, _ in docs}
    for r in found.collect():
        w, own = words(texts[r.doc_id]), words(dict(items)[r.item_id])
        grams = {tuple(own[k : k + 12]) for k in range(len(own) - 11)}
        inside = {k + j for k in range(len(w) - 11) if tuple(w[k : k + 12]) in grams for j in range(12)}
        assert {k for s in r.spans for k in range(s.first, s.end)} == inside and r.words == len(inside)


def test_nothing_to_search(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a " * 40)], "doc_id long, text string")
    assert rows(leakage.leaked_passages(some, i)) == [] and rows(leakage.leaked_passages(d, some.withColumnRenamed("doc_id", "item_id"))) == []
    assert rows(leakage.leaked_passages(some, some.withColumnRenamed("doc_id", "item_id")).select("words")) == [(40,)]


@pytest.mark.parametrize("piece", [1 << 20, 3, 17])
def test_word_numbers(monkeypatch, piece):
    monkeypatch.setattr(wordhash, "_PIECE", piece)
    wordhash._powers.cache_clear()
    rng = random.Random(piece)
    texts = ["", "abc", "abc", "ABC def", "x" * 50, " -- ", "é1é2", "a"] + ["".join(rng.choice("aB3 .é") for _ in range(rng.randrange(40))) for _ in range(200)]
    hashes, first = wordhash.words_of(*wordhash.bytes_of(pa.array(texts).slice(0)))
    own = [hashes[a:b].tolist() for a, b in zip(first, first[1:])]
    assert [len(x) for x in own] == [len(words(t)) for t in texts]
    pairs = {(h, w) for x, t in zip(own, texts) for h, w in zip(x, words(t))}
    assert len({h for h, _ in pairs}) == len({w for _, w in pairs}) == len(pairs)
    wordhash._powers.cache_clear()


def test_one_id_in_two_shards(spark):
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    items = spark.createDataFrame([(1, text("a", 40))], "item_id int, text string")
    docs = spark.createDataFrame([(7, text("a", 20)), (7, "x y " + text("a", 30)), (7, "z " * 50 + text("a", 12))], "doc_id long, text string").repartition(3)
    assert [tuple(r)[:3] + tuple((s.first, s.end) for s in r.spans) for r in leakage.leaked_passages(docs, items).collect()] == [(7, 1, 44, (0, 32), (50, 62))]


def test_ids_of_any_type_and_short_phrases(spark):
    docs = spark.createDataFrame([("d" * 300, "a b c"), ("e", "c b")], "doc_id string, text string")
    items = spark.createDataFrame([(1.5, "B a!"), (2.5, "b C")], "item_id double, text string")
    found = lambda n: rows(leakage.leaked_passages(docs, items, words=n).select("doc_id", "item_id"))
    assert found(2) == [("d" * 300, 2.5)] and found(1) == [("d" * 300, 1.5), ("d" * 300, 2.5), ("e", 1.5), ("e", 2.5)]
