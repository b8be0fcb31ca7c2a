"""Evaluation passages inside a training corpus, by an FM-index per shard of the corpus.

Every task reads its documents as a stream and cuts it into shards of bounded size. A shard's words
become symbols of one FM-index; phrases of the test items (windows of a fixed number of words) are
searched backward in it, many at once, their occurrences located by sampled suffix positions, and
overlapping occurrences of one item in one document merged into spans. Documents never leave their task:
there is no shuffle of texts, and memory depends on the shard size only.

Words that no item contains cannot be part of a match. They become separators, and stretches between
separators that are shorter than a phrase are left out of the index, which therefore only holds text
that can match. Copies of a document within a shard are indexed once.

The items are the stated query set. Their words become numbers on the executors; the driver streams these
into blocks of bounded size, of four bytes per word, which are broadcast one by one. All blocks of a pass
are searched in one index of each shard, and only items beyond ``PASS_BYTES`` need another pass over the
corpus. Of a block, only windows whose neighbouring words also stand next to each other somewhere in the
shard are searched: any other cannot occur, and a table of these pairs tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm import wordhash
from millrace.llm.fmindex import FMIndex
from millrace.session import map_arrow

#: bytes of text in a shard
SHARD_BYTES = 8 << 20
#: bytes of item symbols broadcast at a time, and searched in one pass over the corpus
BLOCK_BYTES, PASS_BYTES = 32 << 20, 256 << 20
#: rows located at a time
_LOCATE_ROWS = 1 << 20
#: entries of the table of neighbouring words
_PAIR_BITS = 22


def _pairs(symbols: np.ndarray) -> np.ndarray:
    """Table entry of each symbol with the one after it."""
    left, right = symbols[:-1].astype(np.uint64), symbols[1:].astype(np.uint64)
    return (wordhash.mix(left << np.uint64(32) | right) >> np.uint64(64 - _PAIR_BITS)).astype(np.int32)


class Block:
    """Words of some items as symbols, one item after the other."""

    def __init__(self, items: list, symbols: np.ndarray, starts: np.ndarray):
        self.items, self.symbols, self.starts = items, symbols, starts

    def __getstate__(self):
        return self.items, self.symbols, self.starts

    def __setstate__(self, state):
        self.items, self.symbols, self.starts = state

    @cached_property
    def pairs(self) -> np.ndarray:
        """Table entries of neighbours; of neighbours in different items the entry that is never set."""
        out = _pairs(self.symbols)
        out[self.starts[(self.starts > 0) & (self.starts < len(self.symbols))] - 1] = 1 << _PAIR_BITS
        return out

    def windows(self, known: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose pairs are set in ``known``: the distinct ones, items by window, and where each window's items start."""
        if size == 1:
            begin = np.arange(len(self.symbols))
        else:
            at = np.flatnonzero(known[self.pairs])
            # as many neighbouring pairs in a row as a window has
            begin = at[: max(0, len(at) - size + 2)]
            begin = begin[at[size - 2 :] - begin == size - 2]
        if not len(begin):
            return np.zeros((0, size), dtype=np.int64), begin, np.zeros(1, dtype=np.int64)
        rows = np.ascontiguousarray(self.symbols[begin[:, None] + np.arange(size)])
        _, first, number = np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_index=True, return_inverse=True)
        item = np.searchsorted(self.starts, begin, side="right") - 1
        both = np.unique(number * len(self.items) + item)
        owner_start = np.searchsorted(both, np.arange(len(first) + 1) * len(self.items))
        return rows[first].astype(np.int64), both % len(self.items), owner_start


class Items:
    """Blocks of one pass, over one vocabulary (word numbers in order; symbols count from 1)."""

    def __init__(self, vocabulary: Broadcast, blocks: list[Broadcast]):
        self.vocabulary, self.blocks = vocabulary, blocks


class _Shard:
    """Distinct texts of a shard, with the ids of the documents that hold them."""

    def __init__(self, items: Items, size: int):
        self.vocabulary = items.vocabulary.value
        self.blocks, self.size = items.blocks, size
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.seen: dict[bytes, int] = {}
        self.ids: list[list] = []
        self.pieces: list[np.ndarray] = []
        #: of each stretch: its document, its first word's number there, its length with the separator
        self.documents: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, ids: list, texts: pa.Array) -> None:
        raw, bounds = wordhash.bytes_of(texts)
        self.bytes += len(raw)
        number = np.zeros(len(ids), dtype=np.int64)
        new = np.zeros(len(ids), dtype=bool)
        for i in range(len(ids)):
            digest = hashlib.blake2b(raw[bounds[i] : bounds[i + 1]], digest_size=16).digest()
            known = self.seen.get(digest)
            if known is None:
                known = self.seen[digest] = len(self.ids)
                self.ids.append([])
                new[i] = True
            self.ids[known].append(ids[i])
            number[i] = known
        words, first_word = wordhash.words_of(raw, bounds)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.int32)
        # copies of a text match nothing here
        symbols[np.repeat(~new, np.diff(first_word))] = 0
        # stretches of known words of one text: texts end where the next one begins
        ends = np.zeros(len(symbols) + 1, dtype=bool)
        ends[first_word] = True
        known = symbols > 0
        begin = np.flatnonzero(known & (ends[:-1] | ~np.append(False, known[:-1])[: len(known)]))
        stop = np.flatnonzero(known & (ends[1:] | ~np.append(known[1:], False)[: len(known)])) + 1
        long = stop - begin >= self.size
        begin, stop = begin[long], stop[long]
        if not len(begin):
            return
        lengths = stop - begin + 1
        # each stretch gets a separator after it
        place = np.cumsum(lengths) - lengths
        picked = np.repeat(begin - place, lengths) + np.arange(int(lengths.sum()))
        piece = np.append(symbols, 0)[picked]
        piece[place + lengths - 1] = 0
        owner = np.searchsorted(first_word, begin, side="right") - 1
        self.pieces.append(piece)
        self.documents.append(number[owner])
        self.firsts.append(begin - first_word[owner])
        self.lengths.append(lengths)

    def matches(self) -> Iterator[tuple[list, object, list[tuple[int, int]]]]:
        """Document ids, item id and merged spans of words, for each pair of text and item."""
        if not self.pieces:
            return
        size = self.size
        text = np.concatenate([np.zeros(1, dtype=np.int32), *self.pieces]).astype(np.int64)
        documents, firsts = np.concatenate(self.documents), np.concatenate(self.firsts)
        places = 1 + np.append(0, np.cumsum(np.concatenate(self.lengths))[:-1])
        known = np.zeros((1 << _PAIR_BITS) + 1, dtype=bool)
        known[_pairs(text)] = True
        index = None
        for shared in self.blocks:
            block = shared.value
            patterns, owner, owner_start = block.windows(known, size)
            if not len(patterns):
                continue
            if index is None:
                # symbols of this shard, counted without gaps
                present = np.zeros(len(self.vocabulary) + 1, dtype=bool)
                present[text] = True
                local = np.cumsum(present) - 1
                index = FMIndex(local[text], int(local[-1]) + 1)
            some = np.flatnonzero(present[patterns].all(axis=1))
            window, low, high = index.search(local[patterns[some]])
            window = some[window]
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            # intervals of rows are cut so that a bounded number of rows is located at a time
            while len(window):
                take = max(1, int(np.searchsorted(np.cumsum(high - low), _LOCATE_ROWS, side="right")))
                w, a, b = window[:take], low[:take].copy(), high[:take].copy()
                window, low, high = window[take:], low[take:], high[take:]
                if take == 1 and b[0] - a[0] > _LOCATE_ROWS:
                    window, low, high = np.append(w, window), np.append(a + _LOCATE_ROWS, low), np.append(b, high)
                    b = a + _LOCATE_ROWS
                n = b - a
                rows = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                position = index.locate(rows)
                stretch = np.searchsorted(places, position, side="right") - 1
                word = firsts[stretch] + position - places[stretch]
                document = documents[stretch]
                own = np.repeat(w, n)
                # every window stands for all items that hold it
                times = owner_start[own + 1] - owner_start[own]
                at = np.repeat(owner_start[own] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(int(times.sum()))
                item = owner[at]
                document, word = np.repeat(document, times), np.repeat(word, times)
                order = np.lexsort((word, item, document))
                document, item, word = document[order], item[order], word[order]
                new = np.ones(len(word), dtype=bool)
                new[1:] = (document[1:] != document[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + size)
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(word)) - 1
                for d, i, x, y in zip(document[starts].tolist(), item[starts].tolist(), word[starts].tolist(), (word[ends] + size).tolist()):
                    spans.setdefault((d, i), []).append((x, y))
            for (document, item), found in spans.items():
                yield self.ids[document], block.items[item], _merged(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _passes(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[Items]:
    """The items for one pass after the other; the driver holds the distinct words of all items and one block."""
    spark = items.sparkSession
    known = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = wordhash.words_of(*wordhash.bytes_of(batch.column(1)))
            own = [words[a:b].tobytes() if b - a >= size else None for a, b in zip(first, first[1:])]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.large_binary()).cast(pa.binary())], names=["i", "words"])
            yield out.filter(pa.array([x is not None for x in own], pa.bool_()))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [np.frombuffer(x.as_py(), dtype=np.uint64) for batch in batches for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.concatenate(words)).tobytes()] if words else [], pa.binary())], names=["words"])

    numbered = map_arrow(known, number, f"i {dict(known.dtypes)['i']}, words binary")
    vocabulary = np.zeros(0, dtype=np.uint64)
    for row in map_arrow(numbered, distinct, "words binary").toLocalIterator():
        vocabulary = np.union1d(vocabulary, np.frombuffer(row.words, dtype=np.uint64))
    if not len(vocabulary):
        return
    shared = spark.sparkContext.broadcast(vocabulary)
    blocks: list[Broadcast] = []
    ids, parts, held, in_pass = [], [], 0, 0

    def close() -> None:
        nonlocal ids, parts, held
        lengths = [len(p) for p in parts]
        blocks.append(spark.sparkContext.broadcast(Block(ids, np.concatenate(parts), np.append(0, np.cumsum(lengths))[:-1])))
        ids, parts, held = [], [], 0

    for row in numbered.toLocalIterator():
        part = (np.searchsorted(vocabulary, np.frombuffer(row.words, dtype=np.uint64)) + 1).astype(np.int32)
        ids.append(row.i)
        parts.append(part)
        held, in_pass = held + part.nbytes, in_pass + part.nbytes
        if held >= BLOCK_BYTES:
            close()
        if in_pass >= PASS_BYTES:
            if held:
                close()
            yield Items(shared, blocks)
            blocks, in_pass = [], 0
    if held:
        close()
    if blocks:
        yield Items(shared, blocks)


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12) -> DataFrame:
    """Columns ``doc_id``, ``item_id``, ``words`` and ``spans``: every document with passages of every item.

    A passage is a run of at least ``words`` words that are consecutive in both texts; words are the
    longest runs of ASCII letters and digits, letter case ignored, anything else only separating them.
    ``spans`` holds the document's parts to remove as ``[first, end)`` numbers of its words, merged
    where they touch; ``words`` counts the words in them. Null, empty and short texts match nothing;
    rows without an id are left out; rows that are repeated come out once, and of different texts under
    one id the spans are merged; texts of any length are searched whole. Other columns are ignored,
    whatever their names.
    """
    fields = documents.select(F.col(doc_id).alias("doc")).schema.fields + items.select(F.col(item_id).alias("item")).schema.fields
    kinds = [f.dataType.simpleString() for f in fields]
    corpus = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL AND text <> ''")
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    arrow = pa.schema([("doc", to_arrow_type(fields[0].dataType)), ("item", to_arrow_type(fields[1].dataType)), ("spans", pa.list_(span))])
    schema = f"doc {kinds[0]}, item {kinds[1]}, spans array<struct<first: int, end: int>>"
    found = None
    for part in _passes(items, item_id, item_text, words):

        def search(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            shard = _Shard(part, words)

            def emit() -> Iterator[pa.RecordBatch]:
                rows = [{"doc": d, "item": item, "spans": [{"first": a, "end": b} for a, b in spans]} for ids, item, spans in shard.matches() for d in dict.fromkeys(ids)]
                shard.clear()
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=arrow)

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    ends = np.cumsum(wordhash.bytes_of(batch.column(1).slice(at))[1][1:] > SHARD_BYTES - shard.bytes)
                    take = max(1, int((ends == 0).sum()))
                    shard.add(batch.column(0).slice(at, take).to_pylist(), batch.column(1).slice(at, take))
                    at += take
                    if shard.bytes >= SHARD_BYTES or at < batch.num_rows:
                        yield from emit()
            yield from emit()

        one = map_arrow(corpus, search, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = documents.sparkSession.createDataFrame([], schema)
    # a repeated row may have been met in two shards, and items of one id in two blocks
    lists = found.groupBy("doc", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.count(F.lit(1)).alias("n"))
    last = lambda acc: F.element_at(acc, -1)
    merge = F.aggregate(
        "spans", F.array().cast("array<struct<first: int, end: int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = lists.withColumn("spans", F.when(F.col("n") > 1, merge).otherwise(F.col("spans")))
    count = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["first"])
    return merged.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), count.alias("words"), "spans")
