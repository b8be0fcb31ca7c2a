"""Flows and mixtures: caps hold, shares are reached, repetition is as rare as it can be."""

import random
import time

import numpy as np
import pytest

from millrace.llm import flow
from millrace.llm import mixture as M
from tests.conftest import rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def cheapest(pattern, source, room, tokens, first, lots, quotas):
    """Tokens sent and their price, by one unit after the other along the cheapest path (Bellman-Ford)."""
    n, k = len(tokens), len(quotas)
    edges = [[0, 2 + p, int(tokens[p]), int(first[p] + i)] for p in range(n) for i in range(lots[p])]
    edges += [[2 + int(p), 2 + n + int(s), int(r), 0] for p, s, r in zip(pattern, source, room)] + [[2 + n + s, 1, int(quotas[s]), 0] for s in range(k)]
    edges = [e for a, b, c, w in edges for e in ([a, b, c, w], [b, a, 0, -w])]
    sent = price = 0
    while True:
        far, via = [10**9] * (2 + n + k), [None] * (2 + n + k)
        far[0] = 0
        for _ in far:
            for i, (a, b, c, w) in enumerate(edges):
                if c and far[a] + w < far[b]:
                    far[b], via[b] = far[a] + w, i
        if far[1] == 10**9:
            return sent, price
        at = 1
        while at:
            edges[via[at]][2] -= 1
            edges[via[at] ^ 1][2] += 1
            at = edges[via[at]][0]
        sent, price = sent + 1, price + far[1]


@pytest.mark.parametrize("seed", range(12))
def test_filling_against_cheapest_paths(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 7)), int(rng.integers(1, 5))
    pairs = np.array([(p, s) for p in range(n) for s in range(k) if rng.random() < 0.6], dtype=np.int64).reshape(-1, 2)
    tokens, first, lots = rng.integers(0, 5, n), rng.integers(0, 3, n), rng.integers(0, 4, n)
    room, quotas = rng.integers(0, 8, len(pairs)), rng.integers(0, 12, k)
    got = flow.fill(pairs[:, 0], pairs[:, 1], room, tokens, first, lots, quotas)
    assert (got >= 0).all() and (got <= room).all() and (np.bincount(pairs[:, 1], weights=got, minlength=k) <= quotas).all()
    by_pattern = np.bincount(pairs[:, 0], weights=got, minlength=n).astype(int)
    assert (by_pattern <= tokens * lots).all()
    price = sum(int(first[p] + i) for p in range(n) if tokens[p] for i in range(lots[p]) for _ in range(min(tokens[p], max(0, by_pattern[p] - i * tokens[p]))))
    assert (int(got.sum()), price) == cheapest(pairs[:, 0], pairs[:, 1], room, tokens, first, lots, quotas)


def test_as_many_patterns_as_allowed_are_solved_in_time():
    rng = np.random.default_rng(1)
    names = [f"source {i}" for i in range(17)]
    patterns = {"\x1f".join(s for i, s in enumerate(names) if k >> i & 1): int(rng.integers(1, 1000)) for k in range(1, 1 << 17)}
    targets = {s: M.Target(float(w), 3) for s, w in zip(names, rng.dirichlet(np.ones(17) / 2))}
    began = time.perf_counter()
    plan = M.plan_mixture(patterns, targets, total=2 * sum(patterns.values()))
    assert time.perf_counter() - began < 120
    got = {s: 0 for s in names}
    for own in plan.flows.values():
        for s, n in own.items():
            got[s] += n
    assert all(got[s] <= plan.quotas[s] for s in names) and sum(got.values()) >= 0.99 * sum(plan.quotas.values())


def test_plan_fills_all_shares_or_says_how_far():
    targets = {"a": M.Target(0.5, 1), "b": M.Target(0.3, 3), "none": M.Target(0.2, 2)}
    plan = M.plan_mixture({"a": 1000, "b": 60, "a\x1fb": 40, "zzz": 9}, targets)
    # a and b stand 5 to 3; b can have 3 * 100 tokens at most
    assert plan.quotas["b"] in range(298, 301) and abs(plan.quotas["a"] - 500) <= 2
    got = {s: sum(f.get(s, 0) for f in plan.flows.values()) for s in targets}
    assert got == plan.quotas and got["none"] == 0
    assert plan.flows["a\x1fb"].get("a", 0) == 0
    fixed = M.plan_mixture({"a": 10, "b": 10}, targets, total=1000)
    assert {s: sum(f.get(s, 0) for f in fixed.flows.values()) for s in targets} == {"a": 10, "b": 30, "none": 0}
    assert M.plan_mixture({}, targets).flows == {} and M.plan_mixture({"a": 0}, targets).flows == {}


def test_no_repetition_where_none_is_needed():
    plan = M.plan_mixture({"a": 100, "b": 300}, {"a": M.Target(0.5, 4), "b": M.Target(0.5, 4)}, total=200)
    assert plan.flows == {"a": {"a": 100}, "b": {"b": 100}}


def asked(targets):
    return targets.selectExpr("lower(trim(source)) AS source", "target_share").where("source IS NOT NULL")


def documents(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 60))) + f" {i}"
        for source in rng.choice([["big"], ["big"], ["big"], ["Small "], ["big", "SMALL"], ["other"], [None], ["big", "big"]]):
            out.append((len(out), source, text, "x"))
    return out + [(9000, "big", None, ""), (9001, "big", "", ""), (None, "big", "a", ""), out[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture(spark, seed):
    docs = documents(seed)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string").repartition(3)
    targets = spark.createDataFrame([("big", 0.6, 1), (" small", 0.4, 3), ("missing", 0.0, 1), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(df, targets, seed=seed, tokenizer=TOKENIZER).cache()
    found = rows(mixed)
    assert found == rows(M.mixture(df.repartition(5), targets, seed=seed, tokenizer=TOKENIZER))
    assert found != rows(M.mixture(df, targets, seed=seed + 10, tokenizer=TOKENIZER))
    source = {d: s.strip().lower() for d, s, *_ in docs if s and d is not None}
    text = {d: t for d, _, t, _ in docs}
    used: dict = {}
    for doc, s, copies, tokens in found:
        assert source[doc] == s and 1 <= copies <= {"big": 1, "small": 3}[s] and tokens > 0
        used.setdefault(text[doc], []).append(copies)
    assert all(sum(v) <= 3 for v in used.values())
    shares = {r.source: r for r in M.reached_shares(mixed, asked(targets)).collect()}
    assert set(shares) == {"big", "small", "missing"} and abs(shares["big"].share - 0.6) < 0.02 and shares["missing"].tokens == 0
    assert shares["small"].tokens == sum(c * t for _, s, c, t in found if s == "small")


def test_shares_of_all_tokens(spark):
    docs = documents(9)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 2), ("missing", 0.1, 5)], "source string, target_share double, max_repeats int")
    tokens = {r.doc: (r.source, r.tokens) for r in M.count_tokens(df, tokenizer=TOKENIZER).collect()}
    whole = sum(r.tokens for r in M.count_tokens(df, tokenizer=TOKENIZER).collect())
    got = {r.source: r for r in M.mixture_report(df, targets, tokenizer=TOKENIZER).collect()}
    assert abs(got["big"].tokens - 0.3 * whole) < 200 and got["small"].most_copies == 2
    assert (got["small"].wanted, got["small"].missing) == (int(0.7 * whole), int(0.7 * whole) - got["small"].tokens) and got["small"].available == got["small"].tokens
    assert abs(got["big"].share_of_total - 0.3) < 0.01 and got["missing"].missing == int(0.1 * whole)
    # small is short of texts: it takes every one of its own as often as it may
    own = {t: tokens[d][1] for d, s, t, _ in docs if d is not None and s and s.strip().lower() == "small" and t}
    assert got["small"].tokens == 2 * sum(own.values()) and abs(got["small"].share - got["small"].tokens / (got["small"].tokens + got["big"].tokens)) < 1e-9


def test_whole_texts_are_counted(spark):
    import tiktoken  # noqa: F401

    long = "def f(x):\n    return x\n" * 20000
    df = spark.createDataFrame([(1, "a", long), (2, "A ", long), (3, "a", "é\n")], "doc_id long, source string, text string")
    found = {r.doc: (r.source, bytes(r.content), r.tokens) for r in M.count_tokens(df, tokenizer=TOKENIZER).collect()}
    assert found[1] == found[2] and found[1][2] == len(M._encoding(TOKENIZER, M.PATTERN).encode_ordinary(long)) and found[3][2] >= 2


def test_no_documents_and_no_targets(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert rows(M.mixture(df, targets, tokenizer=TOKENIZER)) == []
    assert [tuple(r) for r in M.mixture_report(df, targets, tokenizer=TOKENIZER).collect()] == [("a", 1.0, 1, 0, 0, 0, 0.0, 0.0, 0, 0, 0)]
    some = spark.createDataFrame([(1, "a", "b c")], "doc_id long, source string, text string")
    assert rows(M.mixture(some, targets.limit(0), tokenizer=TOKENIZER)) == []


def test_every_document_counts_where_texts_are_copied(spark):
    same = "one licence text in many documents"
    docs = [(i, "a", same) for i in range(60)] + [(100 + i, "a", f"text {i}") for i in range(4)] + [(200 + i, "b", same) for i in range(5)] + [(300 + i, "b", f"words {i} of b") for i in range(100)]
    docs += docs[:3]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    size = {r.doc: r.tokens for r in M.count_tokens(df, tokenizer=TOKENIZER).collect()}
    own = {s: {d for d, t, _ in docs if t == s} for s in "ab"}
    # a large total takes every document as often as it may
    found = rows(M.mixture(df, targets, 10_000, tokenizer=TOKENIZER))
    assert found == sorted((d, s, {"a": 2, "b": 1}[s], size[d]) for s in own for d in own[s])
    # all shares can be reached: b sets the amount, and a fills its half
    whole = sum(size[d] for d in own["b"])
    got = {r.source: r for r in M.reached_shares(M.mixture(df, targets, tokenizer=TOKENIZER), asked(targets)).collect()}
    assert abs(got["b"].tokens - whole) <= 1 and abs(got["a"].tokens - whole) < 50
    # no second document of a text while distinct texts suffice
    few = rows(M.mixture(df, targets, 24, tokenizer=TOKENIZER))
    assert sum(d < 60 or 200 <= d < 205 for d, *_ in few) <= 2 and all(c == 1 for _, _, c, _ in few)
