"""Mixing overlapping sources to target shares of tokens, by min-cost flow.

The first documents with equal texts, one for each source, are one text that belongs to all these sources.
Texts with the same set of sources (the same membership pattern) are interchangeable, so the problem is
solved over patterns: a pattern offers its tokens once for free and again at a price that rises with every
repetition, a source takes none of its documents more often than it may be repeated, and each source has to
be filled up to its quota. Further documents with the same text in a source, by the power of two their
number has reached, are patterns of that source alone, whose price starts at that number. The
network has at most one node for each pattern that occurs. Its cheapest flow repeats texts as little as the
shares allow, and takes texts that several sources share for the source that is short of its own.

The flow says how many tokens of a pattern go to which source; seeded order picks the texts. The tokens
of a pattern, in that order, are laid out along a line over and over, and each source gets a stretch of
the line as long as its flow: no longer than the pattern's tokens times the source's repetitions, so no
document comes more often than it may.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import flow, ordered
from millrace.session import cut_lineage, map_arrow, ship_file

#: fixed values: the public byte-level BPE file and the pattern that splits text before merging
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: patterns, and sources with a target, the driver solves for
MOST_PATTERNS = MOST_SOURCES = 1 << 17
#: texts whose number of tokens a task remembers
_REMEMBERED = 1 << 16


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Columns ``doc``, ``source``, ``content``, ``tokens``: whole texts in tokens of a public tokenizer.

    Sources are compared without letter case and surrounding blanks. ``content`` identifies equal
    texts. Rows without an id or text are left out, and so are texts without tokens; a source may be null.
    ``tokenizer`` is a file of byte-level BPE ranks the driver can read; it is sent to the executors.
    """
    name = ship_file(documents.sparkSession, tokenizer)
    picked = documents.select(F.col(doc_id).alias("doc"), F.lower(F.trim(source)).alias("source"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), pattern).encode_ordinary
        known: dict[bytes, int] = {}
        for batch in batches:
            content, tokens = [], []
            for value in batch.column(2):
                t = value.as_py()
                digest = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in known:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[digest] = len(encode(t))
                content.append(digest)
                tokens.append(known[digest])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(tokens, pa.int64())], names=["doc", "source", "content", "tokens"])

    kind = dict(picked.dtypes)["doc"]
    return map_arrow(picked, count, f"doc {kind}, source string, content binary, tokens bigint")


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


def read_targets(targets: DataFrame, most: int = MOST_SOURCES) -> dict[str, Target]:
    """Target share and repetitions by source, for at most ``most`` sources; more are an error.

    Rows without a source are left out; a null share is 0, null repetitions are 1; a source that stands
    there twice gets both shares and the larger number of repetitions.
    """
    rows = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats")
    ).where("source IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources have a target")
    return {r.source: Target(max(0.0, r.share), max(0, r.repeats)) for r in sorted(rows, key=lambda r: r.source)}


@dataclass(frozen=True)
class Plan:
    """Tokens of each pattern for each source, and what was asked for."""

    flows: dict[str, dict[str, int]]
    quotas: dict[str, int]


def _members(pattern: str) -> tuple[list[str], int]:
    """Sources of a pattern, and which use of its texts its first one is: the number after a last U+001E, or the first."""
    names, mark, number = pattern.rpartition("\x1e")
    return (names if mark else pattern).split("\x1f"), int(number) if mark else 1


def plan_mixture(patterns: dict[str, int], targets: dict[str, Target], total: int | None = None) -> Plan:
    """Route the tokens of membership patterns (sources joined by U+001F) to source quotas.

    A pattern holds a document of each of its sources for every text. Without ``total`` it is the largest
    amount at which every source that has any tokens still gets its
    share; the shares of sources without tokens, which nothing can fill, are left out of the sum. With
    a ``total`` quotas are shares of it and are filled as far as possible.
    """
    most = {s: 0 for s in targets}
    for p, tokens in patterns.items():
        for s in _members(p)[0]:
            if s in targets:
                most[s] += tokens * targets[s].repeats
    usable = [s for s in targets if most[s] > 0 and targets[s].share > 0]
    if not usable:
        return Plan({}, {s: 0 for s in targets})
    if total is not None:
        quotas = {s: int(total * t.share) for s, t in targets.items()}
    else:
        whole = sum(targets[s].share for s in usable)
        share = {s: targets[s].share / whole for s in usable}
        # each source has documents of its own, so the one that is shortest sets the amount
        amount = min(int(most[s] / share[s]) for s in usable)
        quotas = {s: int(amount * share[s]) for s in usable}
    names, kinds = list(targets), sorted(patterns)
    number = {s: i for i, s in enumerate(names)}
    members = [_members(p) for p in kinds]
    pairs = np.array([(i, number[s]) for i, (own, _) in enumerate(members) for s in own if s in number], dtype=np.int64).reshape(-1, 2)
    tokens = np.array([patterns[p] for p in kinds], dtype=np.int64)
    repeats = np.array([targets[s].repeats for s in names], dtype=np.int64)
    lots = np.bincount(pairs[:, 0], weights=repeats[pairs[:, 1]], minlength=len(kinds)).astype(np.int64)
    room = tokens[pairs[:, 0]] * repeats[pairs[:, 1]]
    first = np.array([f - 1 for _, f in members], dtype=np.int64)
    sent = flow.fill(pairs[:, 0], pairs[:, 1], room, tokens, first, lots, np.array([quotas.get(s, 0) for s in names]))
    flows: dict[str, dict[str, int]] = {}
    for i in np.flatnonzero(sent):
        flows.setdefault(kinds[pairs[i, 0]], {})[names[pairs[i, 1]]] = int(sent[i])
    return Plan(flows, {s: quotas.get(s, 0) for s in targets})


#: as many tokens as all documents have
ALL = "all"


def _numbered(tokens: DataFrame) -> DataFrame:
    """Columns ``content``, ``source``, ``doc``, ``tokens``, ``number``: each document once, numbered by id among those with its text and source."""
    once = tokens.groupBy("content", "source", "doc").agg(F.max("tokens").alias("tokens")).where("tokens > 0").withColumn("one", F.lit(1).cast("long"))
    run = ordered.sort_once(once, ["content", "source"], ["doc"])

    def number(table: pa.Table, at: ordered.Places) -> pa.Table:
        return table.drop_columns(["one"]).append_column("number", pa.array(at.before + 1))

    kind = dict(tokens.dtypes)["doc"]
    return ordered.map_groups(run, ["content", "source"], "one", lambda _: number, f"content binary, source string, doc {kind}, tokens bigint, number bigint")


def mix(tokens: DataFrame, targets: dict[str, Target], total: int | str | None = None, seed: int = 0) -> DataFrame:
    """Columns ``doc_id``, ``source``, ``copies``, ``tokens`` (of one copy): the mixture.

    ``total`` is the size shares are taken of: a number of tokens, ``ALL`` for as many as the documents
    have, sources without a target included, or None for the most at which all shares can be reached
    (see ``plan_mixture``). ``tokens`` comes from ``count_tokens``. Every document can be used as often as
    its source allows; further documents with a text that is used already count as its repetitions and are
    taken only where distinct texts run short. Repeated rows count once. Which texts are taken depends on
    ``seed`` and on content and number of the documents only, of those with equal text in a source ones with small ids
    first. Sources reach their quotas up to half a text per pattern. No documents or no targets give no rows.
    """
    spark = tokens.sparkSession
    wanted = [s for s, t in targets.items() if t.share > 0 and t.repeats > 0]
    numbered = _numbered(tokens.where(F.col("source").isin(wanted)))
    # the first documents of all sources together, further ones for themselves
    texts = numbered.groupBy("content", "number", F.when(F.col("number") > 1, F.col("source")).alias("alone")).agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc"))).alias("members"))
    pattern = F.concat(F.array_join("members.source", "\x1f"), F.lit("\x1e"), F.expr("shiftleft(1L, length(bin(number)) - 1)").cast("string"))
    seeded = texts.select(pattern.alias("pattern"), F.xxhash64(F.lit(seed), "content", "number").alias("place"), "content", "number", "tokens", "members")
    run = ordered.sort_once(seeded, ["pattern"], ["place", "content", "number"])
    sums = run.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources occur")
    if total == ALL:
        total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    plan = plan_mixture({r.pattern: r.tokens for r in sums}, targets, total)
    shared = spark.sparkContext.broadcast(plan.flows)
    kind = dict(tokens.dtypes)["doc"]

    def choose(table: pa.Table, at_rows: ordered.Places) -> pa.Table:
        starts, before, totals, size = at_rows.starts, at_rows.before, at_rows.totals, at_rows.weights
        bounds = np.append(starts, table.num_rows)
        members = table["members"].combine_chunks()
        docs, names, copies, sizes = [], [], [], []
        for g, start in enumerate(starts):
            pattern = table["pattern"][int(start)].as_py()
            flows = shared.value.get(pattern)
            if not flows:
                continue
            # a text belongs to the stretch its middle lies in
            place = (before + size // 2)[bounds[g] : bounds[g + 1]]
            own = _members(pattern)[0]
            flat = members.slice(int(start), int(bounds[g + 1] - start)).flatten().field("doc")
            at = 0
            for s, tokens_of in sorted(flows.items()):
                times = -((place - (at + tokens_of)) // totals[g]) + (place - at) // totals[g]
                at += tokens_of
                taken = np.flatnonzero(times > 0)
                docs.append(flat.take(pa.array(taken * len(own) + own.index(s))))
                names += [s] * len(taken)
                copies.append(times[taken])
                sizes.append(size[start + taken])
        return pa.table({
            "doc_id": pa.chunked_array(docs, type=members.type.value_type.field("doc").type), "source": pa.array(names, pa.string()),
            "copies": pa.array(np.concatenate([np.zeros(0, np.int32), *copies]).astype(np.int32)), "tokens": pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])),
        })

    return ordered.map_groups(run, ["pattern"], "tokens", lambda _: choose, f"doc_id {kind}, source string, copies int, tokens bigint")


def mixture(documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 0, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """The mixture of ``documents`` (doc_id, source, text) for ``targets`` (source, target_share, max_repeats).

    See ``count_tokens``, ``read_targets``, ``plan_mixture`` and ``mix`` for nulls, repeats and rounding.
    """
    tokens = cut_lineage(count_tokens(documents, tokenizer=tokenizer, pattern=pattern))
    return mix(tokens, read_targets(targets), total, seed)


def quotas(tokens: DataFrame, targets: DataFrame, total: int | str = ALL) -> DataFrame:
    """Columns ``source``, ``target_share``, ``max_repeats``, ``wanted``, ``available``, one row for each source with a target.

    ``wanted`` are the tokens of its share of ``total``, ``available`` those of its documents, each taken as
    often as it may be. Computed where the tokens are, for any number of sources.
    """
    asked = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.greatest(F.sum(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats")
    ).where("source IS NOT NULL")
    documents = tokens.groupBy("source", "content", "doc").agg(F.max("tokens").alias("tokens"))
    own = documents.groupBy(F.col("source").alias("own")).agg(F.sum("tokens").alias("own_tokens"))
    whole = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).scalar() if total == ALL else F.lit(total)
    return asked.join(own, F.col("source") == F.col("own"), "left").select(
        "source", "target_share", "max_repeats", F.floor(whole * F.col("target_share")).cast("long").alias("wanted"),
        (F.coalesce("own_tokens", F.lit(0)) * F.col("max_repeats")).cast("long").alias("available"),
    )


def reached_shares(mixed: DataFrame, asked: DataFrame, total: int | Column | None = None) -> DataFrame:
    """What was reached, one row for each row of ``asked`` (``source``, ``target_share`` and any more columns, which are kept).

    Adds ``tokens``, ``share`` of what was reached altogether, ``documents``, ``most_copies``; with a ``total``
    also ``share_of_total``. Sources that contribute nothing have share 0. Sources are compared without
    letter case and surrounding blanks.
    """
    got = mixed.groupBy(F.col("source").alias("got")).agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    joined = asked.join(got, F.col("source") == F.col("got"), "left").select(
        *asked.columns, *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("tokens", "long"), ("documents", "long"), ("most_copies", "int")))
    )
    whole = joined.agg(F.sum("tokens").alias("n")).scalar()
    share = lambda of: F.coalesce(F.try_divide(F.col("tokens"), of), F.lit(0.0))
    more = [] if total is None else [share(total if isinstance(total, Column) else F.lit(total)).alias("share_of_total")]
    return joined.select(*asked.columns, "tokens", share(whole).alias("share"), *more, "documents", "most_copies")


def mixture_report(documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Shares reached of all tokens: those of ``quotas`` and ``reached_shares``, and ``missing`` tokens of each source."""
    return report(cut_lineage(count_tokens(documents, tokenizer=tokenizer, pattern=pattern)), targets, seed)


def report(tokens: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The same from tokens, or from documents measured in any other way under the same column names."""
    mixed = mix(tokens, read_targets(targets), ALL, seed)
    whole = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).scalar()
    return reached_shares(mixed, quotas(tokens, targets), whole).withColumn("missing", F.greatest(F.col("wanted") - F.col("tokens"), F.lit(0)))
