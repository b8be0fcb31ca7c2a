"""Text decoded with the wrong encoding: found and restored by what clean near-twins teach.

Records are the lines that hold characters beyond ASCII. The corpus holds many of them twice, garbled
here and clean there: the same word, line or document which, stripped of all characters beyond ASCII, is
the same text. Such twins are joined on the stripped text, oriented by a character model counted over
the whole corpus, and aligned: between equal ASCII characters, a run of garbage stands against the run
it was made of. A transformation (decoded with one codec, written in another) that turns the one into
the other is shown by the twins. It is learned if it is shown by enough of the twins that could show it,
clearly more often than by shuffled twins and by twins taken the wrong way round, and if it explains
what no transformation shown more often does. Where no known codec explains the aligned runs, the codec
itself is inferred: the characters that stand for the bytes of the clean runs make its table. Learned
transformations are then undone on all records, and one is accepted where it makes the record much more
probable than it stands.

Text in scripts without ASCII letters leaves nothing to join on when stripped; there a transformation is
learned where undoing it makes records more probable by more than chance does in as many trials, the
clean text of the corpus being the twin. Records with replacement characters are found by a twin that
lacks them; where there is none, a rule decides.

What reaches the driver has a fixed size: counts in a fixed number of buckets, and votes per pair of
codecs or per byte.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import encodings
from millrace.llm.encodings import CODECS, PAIRS, ROUNDS, Model, by_decoder, undo
from millrace.session import cut_lineage, map_arrow, write_out

#: twins that have to show a transformation, their share of those that could, and how many times as many as shuffled ones
MIN_TWINS, MIN_SHARE, OVER_NULL = 2, 0.002, 3
#: share of an inferred byte's votes its character has, and of the runs that vote for a table it has to explain
BYTE_SHARE, TABLE_SHARE = 0.9, 0.5
INFERRED = ("inferred", "utf_8")
#: natural logarithm of the odds at which a record counts as garbled
MARGIN = 2.0
#: letters that have to be left of a stripped word or line
WORD_LETTERS, LINE_LETTERS = 3, 12
#: characters scored at a time
_CHARS = 1 << 21

_ENDS = re.compile(r"[\r\n]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_NOT_LETTER = re.compile(r"[^A-Za-z0-9]+")
_BLANKS = re.compile(r"[ \t\x0b\x0c]+")
#: controls no text holds, though rounds of decoding pass through them
_C1 = re.compile(r"[\x80-\x9f]")
#: a replacement character between quotes is meant
_LOST = re.compile("(?<![\"'`])�|�(?![\"'`])")


def _records(text: str) -> list[str]:
    """Lines with characters beyond ASCII, without surrounding blanks; a leading byte-order mark does not count."""
    if text.isascii():
        return []
    return list(dict.fromkeys(s for line in _ENDS.split(text.removeprefix("﻿")) if not line.isascii() and (s := line.strip(" \t\x0b\x0c"))))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def records(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc``, ``twin`` (of the document stripped of characters beyond ASCII), ``whole``, ``place``, ``line``."""
    picked = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    kind = dict(picked.dtypes)["doc"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at = []
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                lines = _records(t)
                if lines:
                    twin, whole = _hash(_FOREIGN.sub("", t)), _hash(t)
                    rows += [(twin, whole, place, line) for place, line in enumerate(lines)]
                    at += [i] * len(lines)
            if rows:
                twin, whole, place, line = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(twin, pa.int64()), pa.array(whole, pa.int64()), pa.array(place, pa.int32()), pa.array(line, pa.string())],
                    names=["doc", "twin", "whole", "place", "line"],
                )

    return map_arrow(picked, split, f"doc {kind}, twin bigint, whole bigint, place int, line string")


def count_model(lines: DataFrame) -> Model:
    """The character model of the distinct lines (``line``, ``n``), a line counting as the root of its number.

    The root keeps a line that stands in many documents from outweighing what varies. Lines that could
    be bytes of UTF-8 are no witnesses for text as it should be: garbage that is copied often would
    else come to look probable. At most one row per bucket is collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(encodings.BUCKETS, dtype=np.int64)
        singles = np.zeros(encodings.SINGLES, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            weight = np.rint(4 * np.sqrt(batch.column(1).to_numpy(zero_copy_only=False))).astype(np.int64)
            sound = [i for i, t in enumerate(texts) if not encodings.may_be_utf_8(t)]
            texts, weight = [texts[i] for i in sound], weight[sound]
            for part, w in _parts(texts, weight):
                p, s = encodings.count_pairs(part, w)
                pairs += p
                singles += s
        for kind, counts in enumerate((pairs, singles)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["kind", "bucket", "n"])

    found = map_arrow(lines.select("line", "n"), count, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (found[c].to_numpy() for c in ("kind", "bucket", "n"))
    pairs, singles = np.zeros(encodings.BUCKETS), np.zeros(encodings.SINGLES)
    pairs[bucket[kind == 0]] = n[kind == 0] / 4
    singles[bucket[kind == 1]] = n[kind == 1] / 4
    return Model(pairs, singles)


def _parts(texts: list[str], weights: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts in parts of a bounded number of characters (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHARS:
            yield texts[start:i], weights[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:], weights[start:]


def variants(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Columns ``key``, ``text``, ``n``: texts by what is left of them when stripped, with how often they stand.

    Words and lines come from the distinct lines, whole documents' lines from ``records``.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, least, texts in (("w", WORD_LETTERS, set(_BLANKS.split(line))), ("l", LINE_LETTERS, [line])):
                    for text in texts:
                        if not text.isascii():
                            left = _NOT_LETTER.sub("", text)
                            if len(left) >= least:
                                counts[_hash(kind + left), text] += n
            if counts:
                key, text = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.string()), pa.array(counts.values(), pa.int64())], names=["key", "text", "n"])

    parts = map_arrow(lines.select("line", "n"), strip, "key bigint, text string, n bigint")
    copied = found.groupBy("twin").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most").select(F.col("twin").alias("copied"))
    slots = found.join(copied, F.col("twin") == F.col("copied"), "left_semi").select(F.xxhash64("twin", "place").alias("key"), F.col("line").alias("text"), F.lit(1).cast("long").alias("n"))
    return parts.unionByName(slots).groupBy("key", "text").agg(F.sum("n").alias("n"))


def twins(texts: DataFrame, model: Broadcast) -> DataFrame:
    """Columns ``a``, ``b``: texts without replacement characters under one key of ``variants``, each against the most
    frequent and the most probable one of them.

    A garbled text may be the most frequent of its key; the most probable one is clean if any is.
    """
    sound = texts.where(~F.contains("text", F.lit("�")))
    several = sound.groupBy("key").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select(F.col("key").alias("some_key"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("p", pa.array(model.value.score_all(batch.column(1).to_pylist()), pa.float64()))

    picked = sound.join(several, F.col("key") == F.col("some_key"), "left_semi").select("key", "text", "n")
    scored = map_arrow(picked, score, "key bigint, text string, n bigint, p double")
    best = scored.groupBy(F.col("key").alias("best_key")).agg(F.max(F.struct("n", "text")).alias("often"), F.max(F.struct("p", "text")).alias("likely"))
    both = best.select("best_key", F.explode(F.array_distinct(F.array("often.text", "likely.text"))).alias("b"))
    return scored.join(both, (F.col("key") == F.col("best_key")) & (F.col("text") != F.col("b")), "inner").select(F.least("text", "b").alias("a"), F.greatest("text", "b").alias("b")).distinct()


@lru_cache(maxsize=1 << 14)
def _undone(garbage: str) -> dict[tuple[str, str], tuple[str, ...]]:
    """For each transformation that can be undone on ``garbage``: what it gives, applied up to ROUNDS times."""
    out = {}
    for w, rights in by_decoder(PAIRS).items():
        try:
            raw = CODECS[w].encode(garbage)
        except UnicodeError:
            continue
        for r in rights:
            steps: list[str] = []
            text, coded = garbage, raw
            for _ in range(ROUNDS):
                try:
                    was = CODECS[r].decode(coded)
                    if was == text:
                        break
                    steps.append(was)
                    text, coded = was, CODECS[w].encode(was)
                except UnicodeError:
                    break
            if steps:
                out[w, r] = tuple(steps)
    return out


def _explained(garbage: str, clean: str) -> tuple[tuple[str, str], ...]:
    """Transformations that made ``garbage`` of ``clean``, applied up to ROUNDS times."""
    return tuple(p for p, steps in _undone(garbage).items() if clean in steps)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs beyond ASCII that stand against each other between equal ASCII characters, where they differ."""
    if _FOREIGN.split(garbled) != _FOREIGN.split(clean):
        return [(garbled, clean)]
    return [(x, y) for x, y in zip(_FOREIGN.findall(garbled), _FOREIGN.findall(clean)) if x != y]


def _runs(batch: pa.RecordBatch, model: Model) -> list[tuple[str, str]]:
    """Aligned runs of twins (garbage, clean), the less probable text of two being the garbled one."""
    left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    better = model.score_all(left) < model.score_all(right)
    return [run for a, b, b_is_clean in zip(left, right, better) for run in align(*((a, b) if b_is_clean else (b, a)))]


@dataclass(frozen=True)
class Transformations:
    """Pairs of codecs that were learned, with the codecs that were inferred."""

    pairs: tuple[tuple[str, str], ...]
    inferred: dict[int, str]

    @property
    def codecs(self) -> dict:
        return CODECS | ({INFERRED[0]: encodings.Learned(self.inferred)} if self.inferred else {})


def learn(pairs: DataFrame, lines: DataFrame, model: Broadcast) -> Transformations:
    """Transformations shown by twins, or by gains of records without ASCII letters."""
    n_lines = lines.count()
    #: of so many lines and transformations, chance makes about one more probable by as much
    margin = float(np.log(max(n_lines, 1) * len(PAIRS)))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            runs = _runs(batch, model.value)
            others = [c for _, c in runs[1:] + runs[:1]]
            for (garbage, clean), other in zip(runs, others):
                for p, steps in _undone(garbage).items():
                    counts["could", p] += 1
                    counts["sound", p] += not _C1.search(steps[0])
                    if clean in steps:
                        counts["shown", p] += 1
                    if other in steps and other != clean:
                        counts["shuffled", p] += 1
                for p in _explained(clean, garbage):
                    counts["reversed", p] += 1
        yield _vote_rows(counts)

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            bare = [t for t in batch.column(0).to_pylist() if all(w.isascii() or len(_NOT_LETTER.sub("", w)) < WORD_LETTERS for w in _BLANKS.split(t))]
            for _, _, pair, gained in _best(bare, model.value, by_decoder(PAIRS), margin):
                counts["gain", pair] += int(gained)
        yield _vote_rows(counts)

    votes: Counter = Counter()
    counted = map_arrow(pairs.select("a", "b"), show, _VOTES).unionByName(map_arrow(lines.select("line"), gain, _VOTES))
    for x in counted.groupBy("kind", "w", "r").agg(F.sum("n").alias("n")).collect():
        votes[x.kind, (x.w, x.r)] = x.n
    #: twins that show the opposite transformation show this one the wrong way round
    stray = lambda p: max(OVER_NULL * votes["shuffled", p], votes["reversed", p] - votes["shown", p[::-1]])
    shown = [p for p in PAIRS if votes["shown", p] >= max(MIN_TWINS, MIN_SHARE * votes["could", p]) and votes["shown", p] > stray(p)]
    # of equals the one that gives text more often
    shown.sort(key=lambda p: (-votes["shown", p], -votes["sound", p]))

    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for garbage, clean in _runs(batch, model.value):
                own = set(_explained(garbage, clean))
                first = next((p for p in shown if p in own), None)
                if first:
                    counts["own", first] += 1
                elif not own:
                    counts.update(("byte", (str(b), c)) for b, c in encodings.byte_votes(garbage, clean))
        yield _vote_rows(counts)

    # a transformation is needed for what none shown more often explains
    for x in map_arrow(pairs.select("a", "b"), credit, _VOTES).groupBy("kind", "w", "r").agg(F.sum("n").alias("n")).groupBy("kind", "w").agg(
        F.max(F.struct("n", "r")).alias("top"), F.sum("n").alias("all"), F.max(F.when(F.col("kind") == "own", F.struct("n", "r"))).alias("own"), F.collect_list(F.when(F.col("kind") == "own", F.struct("r", "n"))).alias("every")
    ).collect():
        if x.kind == "own":
            for y in x.every:
                votes["own", (x.w, y.r)] = y.n
        elif x.top.n >= BYTE_SHARE * x["all"]:
            votes["byte", (x.w, x.top.r)] = x.top.n
    needed = {p for p in shown if votes["own", p] >= MIN_TWINS}
    gained = {p for p in PAIRS if votes["gain", p] >= 3 * margin}
    table = {int(b): c for (kind, (b, c)), n in votes.items() if kind == "byte" and int(b) >= 0x80}
    inferred = encodings.completed(table, lambda name: votes["shown", (name, "utf_8")]) if _is_sound(pairs, model, table) else {}
    return Transformations((*(p for p in PAIRS if p in needed | gained), *([INFERRED] if inferred else [])), inferred)


def _is_sound(pairs: DataFrame, model: Broadcast, table: dict[int, str]) -> bool:
    """Whether no character stands for two bytes and the table explains enough of the runs that voted for it."""
    if len(table) < 3 or len(set(table.values())) < len(table):
        return False
    codec = encodings.Learned(table)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for garbage, clean in _runs(batch, model.value):
                if encodings.byte_votes(garbage, clean) and not _explained(garbage, clean):
                    try:
                        good = codec.encode(garbage).decode("utf-8") == clean
                    except UnicodeError:
                        good = False
                    counts["good" if good else "bad", ("", "")] += 1
        yield _vote_rows(counts)

    n = {x.kind: x.n for x in map_arrow(pairs.select("a", "b"), explain, _VOTES).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    good = n.get("good", 0)
    return good > MIN_TWINS and good >= TABLE_SHARE * (good + n.get("bad", 0))


_VOTES = "kind string, w string, r string, n bigint"


def _vote_rows(counts: Counter) -> pa.RecordBatch:
    columns = [[k for k, _ in counts], [w for _, (w, _) in counts], [r for _, (_, r) in counts]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(counts.values(), pa.int64())], names=["kind", "w", "r", "n"])


def _best(texts: list[str], model: Model, pairs: dict[str, list[str]], margin: float, known: Mapping = CODECS) -> Iterator[tuple[int, str, tuple[str, str], float]]:
    """For each text that one undone transformation makes more probable: its number, the new text, the pair, the gain."""
    at, candidates, names, size = [], [], [], 0

    def flush() -> Iterator[tuple[int, str, tuple[str, str], float]]:
        if not candidates:
            return
        owners = np.array(at)
        some = np.unique(owners)
        stands = np.zeros(len(texts))
        stands[some] = model.score_all([texts[i] for i in some])
        gains = model.score_all(candidates) - stands[owners]
        order = np.lexsort((-gains, owners))
        first = np.ones(len(order), dtype=bool)
        first[1:] = owners[order][1:] != owners[order][:-1]
        for i in order[first]:
            if gains[i] >= margin:
                yield int(owners[i]), candidates[i], names[i], float(gains[i])

    for i, text in enumerate(texts):
        for was, pair in undo(text, pairs, known).items():
            at.append(i)
            candidates.append(was.removeprefix("﻿"))
            names.append(pair)
            size += len(was)
        if size > _CHARS:
            yield from flush()
            at, candidates, names, size = [], [], [], 0
    yield from flush()


def restore_lines(lines: DataFrame, model: Broadcast, learned: Transformations) -> DataFrame:
    """Columns ``line``, ``restored``, ``undone``: the garbled ones of the distinct lines, and all with replacement characters.

    ``undone`` names the transformations, the last decoding first. Of lines with replacement characters
    ``restored`` is null and ``undone`` says ``lost``.
    """
    pairs, codecs = by_decoder(learned.pairs), learned.inferred

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Transformations(learned.pairs, codecs).codecs
        for batch in batches:
            texts = batch.column(0).to_pylist()
            now = dict(enumerate(texts))
            undone: dict[int, list[str]] = {}
            todo = list(now)
            for _ in range(ROUNDS):
                better = []
                for k, was, (w, r), _ in _best([now[i] for i in todo], model.value, pairs, MARGIN, known):
                    now[todo[k]] = was
                    undone.setdefault(todo[k], []).append(f"{w}<{r}")
                    better.append(todo[k])
                todo = better
            rows = [(texts[i], now[i], ",".join(undone[i])) for i in sorted(undone)]
            rows += [(t, None, "lost") for i, t in enumerate(texts) if i not in undone and "�" in t]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["line", "restored", "undone"])

    return map_arrow(lines.select("line"), judge, "line string, restored string, undone string")


def _fits(damaged: str, whole: str) -> bool:
    """Whether ``whole`` is ``damaged`` with characters where the other has replacement characters.

    A character may have become one to three of them.
    """
    pieces = re.split("(�+)", damaged)
    pattern = "".join(f"[^\\x00-\\x7f]{{{-(-len(x) // 3)},{len(x)}}}" if x.startswith("�") else re.escape(x) for x in pieces)
    return "�" not in whole and re.fullmatch(pattern, whole) is not None


def undamaged(texts: DataFrame) -> DataFrame:
    """Columns ``a``, ``whole``: texts with replacement characters, each with the most frequent of all texts under its keys that fit it.

    ``texts`` comes from ``variants``; equally frequent ones count in order of the text. A text that fits
    has runs beyond ASCII at the same places, so only texts of the same shape are compared.
    """

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_fits(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    shaped = texts.withColumn("shape", F.xxhash64(F.regexp_replace("text", r"[^\x00-\x7f]+", "�")))
    lost = F.contains("text", F.lit("�"))
    damaged = shaped.where(lost).select(F.col("key").alias("lost_key"), F.col("shape").alias("lost_shape"), F.col("text").alias("a"))
    both = damaged.join(shaped.where(~lost), (F.col("lost_key") == F.col("key")) & (F.col("lost_shape") == F.col("shape")), "inner")
    fits = map_arrow(both.select("a", F.col("text").alias("b"), "n"), fitting, "a string, b string, n bigint")
    return fits.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("rank"), "b")).alias("best")).select("a", F.col("best.b").alias("whole"))


def repair_lost(lost: DataFrame, known: DataFrame) -> DataFrame:
    """Those lines with replacement characters (``line``) that are damaged, with ``restored`` where twins say what stood there.

    A line is damaged if it or a word of it has an undamaged twin (``known``, of ``undamaged``); ``undone`` then
    says ``lost,twin``. Of the others those count (``lost``) in which a replacement character does not stand
    between quotes, where it is taken as meant. A line is put together from its undamaged twin or from those
    of its words; unless all of it can be told, ``restored`` is null.
    """

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = {x["piece"]: x["whole"] for x in known or []}
                if whole or _LOST.search(line):
                    text = whole.get(line) or "".join(whole.get(w, w) for w in re.split(r"([ \t\x0b\x0c]+)", line))
                    rows.append((line, None if _LOST.search(text) else text, "lost,twin" if whole else "lost"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["line", "restored", "undone"])

    pieces = lost.select("line", F.explode(F.array_distinct(F.concat(F.array("line"), F.split("line", r"[ \t\x0b\x0c]+")))).alias("piece")).where(F.contains("piece", F.lit("�")))
    told = pieces.join(known, F.col("piece") == F.col("a"), "left").groupBy("line").agg(F.collect_list(F.when(F.col("whole").isNotNull(), F.struct("piece", "whole"))).alias("known"))
    return map_arrow(told, put_together, "line string, restored string, undone string")


def garbled_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``line``, ``restored``, ``undone``: every garbled line of every document, once.

    ``restored`` is null where it cannot be told what stood there; ``undone`` tells how a line was found: by
    the transformations undone, by an undamaged twin (``lost,twin``), or by the rule for replacement
    characters without one (``lost``).

    Null, empty and pure ASCII texts hold none; rows without an id are left out; repeated rows count
    once; an empty table gives no rows. Lines of any length are judged whole. Other columns are ignored,
    whatever their names.
    """
    spark = documents.sparkSession
    found = cut_lineage(records(documents, doc_id, text))
    lines = cut_lineage(found.groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    model = spark.sparkContext.broadcast(count_model(lines))
    texts = write_out(variants(found, lines))
    pairs = write_out(twins(texts, model))
    bad = write_out(restore_lines(lines, model, learn(pairs, lines, model)))
    bad = bad.where("undone <> 'lost'").unionByName(repair_lost(bad.where("undone = 'lost'"), undamaged(texts))).withColumnRenamed("line", "bad")
    return found.join(bad, F.col("line") == F.col("bad"), "inner").select(F.col("doc").alias(doc_id), "line", "restored", "undone").distinct()


def restored_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``text``, ``garbled_lines``, ``restored_lines``: affected documents as they were, as far as can be.

    Lines that cannot be restored stay as they are; a text that stands twice under an id comes out twice. See ``garbled_lines`` for nulls and repeats.
    """
    lines = garbled_lines(documents, doc_id, text).groupBy(F.col(doc_id).alias("bad_doc")).agg(F.collect_list(F.struct("line", "restored")).alias("lines"))
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    # of affected documents only
    both = texts.join(lines, F.col("doc") == F.col("bad_doc"), "inner").select("doc", "text", "lines").dropDuplicates(["doc", "text"])
    kind = dict(both.dtypes)["doc"]

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, bad, good = [], [], []
            for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {x["line"]: x["restored"] for x in own if x["restored"] is not None}
                pieces = re.split(r"([\r\n]+)", t)
                for i, piece in enumerate(pieces):
                    core = piece.removeprefix("﻿").strip(" \t\x0b\x0c")
                    if core in known:
                        pieces[i] = piece.replace(core, known[core])
                out.append("".join(pieces))
                bad.append(len(own))
                good.append(len(known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(bad, pa.int32()), pa.array(good, pa.int32())], names=["doc", "text", "garbled_lines", "restored_lines"])

    return map_arrow(both, put_back, f"doc {kind}, text string, garbled_lines int, restored_lines int").withColumnRenamed("doc", doc_id)
