"""Wrong decodings as pairs of codecs, and a character model that tells text from garbage."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np

# fixed values: codecs that text gets wrongly decoded with, and codecs it is written in
SINGLE_BYTE = (
    "latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r",
    "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15",
)
MULTI_BYTE = ("gb18030", "cp932", "euc_jp", "euc_kr", "big5")
WIDE = ("utf_16_le", "utf_16_be")


class _Table:
    """A single-byte codec in which bytes without a character stand for the control of that number."""

    def __init__(self, name: str):
        chars = [bytes([i]).decode(name, "ignore") or chr(i) for i in range(256)]
        self.decoding = "".join(chars)
        self.encoding = codecs.charmap_build(self.decoding)

    def encode(self, text: str) -> bytes:
        return codecs.charmap_encode(text, "strict", self.encoding)[0]

    def decode(self, raw: bytes) -> str:
        return codecs.charmap_decode(raw, "strict", self.decoding)[0]


class _Codec:
    def __init__(self, name: str):
        self.name = name

    def encode(self, text: str) -> bytes:
        return text.encode(self.name)

    def decode(self, raw: bytes) -> str:
        return raw.decode(self.name)


class _Wide(_Codec):
    def encode(self, text: str) -> bytes:
        # an odd last byte became a replacement character
        return text.removesuffix("�").encode(self.name)


class Learned:
    """A single-byte codec of which only some bytes are known, put together from aligned characters."""

    def __init__(self, chars: dict[int, str]):
        self.chars = chars
        self.numbers = {c: b for b, c in chars.items()}

    def encode(self, text: str) -> bytes:
        try:
            return bytes(ord(c) if c < "\x80" else self.numbers[c] for c in text)
        except KeyError as missing:
            raise UnicodeError(f"no byte is known for {missing}") from None

    def decode(self, raw: bytes) -> str:
        try:
            return "".join(chr(b) if b < 0x80 else self.chars[b] for b in raw)
        except KeyError as missing:
            raise UnicodeError(f"no character is known for {missing}") from None


CODECS = {n: _Table(n) for n in SINGLE_BYTE} | {n: _Codec(n) for n in (*MULTI_BYTE, "utf_8")} | {n: _Wide(n) for n in WIDE}

#: (decoded with, written in): what may have happened to a text
PAIRS: tuple[tuple[str, str], ...] = tuple(
    [(w, "utf_8") for w in (*SINGLE_BYTE, *MULTI_BYTE, *WIDE)]
    + [(w, r) for w in (*SINGLE_BYTE, *MULTI_BYTE) for r in MULTI_BYTE if w != r]
    + [(w, r) for w in SINGLE_BYTE for r in SINGLE_BYTE if w != r]
)
#: control characters no text holds
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f�]")
#: rounds of decoding that are undone
ROUNDS = 3


def by_decoder(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w, r in pairs:
        out.setdefault(w, []).append(r)
    return out


def undo(text: str, pairs: dict[str, list[str]], known: Mapping = CODECS) -> dict[str, tuple[str, str]]:
    """Texts that ``text`` may have been, each with the first pair that gives it."""
    out: dict[str, tuple[str, str]] = {}
    #: codecs tried on bytes: relatives encode most texts to the same ones
    tried: dict[bytes, set[str]] = {}
    for w, rights in pairs.items():
        try:
            raw = known[w].encode(text)
        except UnicodeError:
            continue
        done = tried.setdefault(raw, set())
        for r in rights:
            if r in done:
                continue
            done.add(r)
            try:
                was = known[r].decode(raw)
            except UnicodeError:
                continue
            if was not in out and was != text and not _CONTROL.search(was):
                out[was] = (w, r)
    return out


_TO_UTF_8 = by_decoder((w, "utf_8") for w in (*SINGLE_BYTE, *MULTI_BYTE, *WIDE))


def may_be_utf_8(text: str) -> bool:
    """Whether some codec turns ``text`` into valid UTF-8, which text that was decoded rightly hardly ever is."""
    return bool(undo(text, _TO_UTF_8))


_BITS = 20
BUCKETS = 1 << _BITS
#: buckets of single characters
SINGLES = 1 << 17
_PRIOR = 1.0
#: least probability of an ASCII character after another: unusual ASCII says nothing about encodings
_ASCII = 1 / 96
#: characters scored at a time
_CHARS = 1 << 20
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def _chars(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a line end before and after, and where each text starts."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    low = codes < 128
    codes[low] = _FOLD[codes[low]]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return codes, np.append(0, np.cumsum(lengths + 1)[:-1])


def _bucket(codes: np.ndarray) -> np.ndarray:
    mixed = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(32 - _BITS)


def count_pairs(texts: Sequence[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of neighbouring characters by bucket, and of single characters."""
    codes, starts = _chars(texts)
    each = np.repeat(weights, np.diff(np.append(starts, len(codes) - 1)))
    pairs = np.bincount(_bucket(codes), weights=each, minlength=BUCKETS)
    return np.rint(pairs).astype(np.int64), np.rint(np.bincount(codes[1:] % SINGLES, weights=each, minlength=SINGLES)).astype(np.int64)


class Model:
    """Probability of a text as a chain of characters, counted over the whole corpus."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs = pairs.astype(np.float32)
        self.singles = singles.astype(np.float32)
        self.total = float(singles.sum()) + 1.0

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Natural logarithm of each text's probability."""
        if not len(texts):
            return np.zeros(0)
        codes, starts = _chars(texts)
        single = self.singles[codes % SINGLES]
        chance = (single[1:] + 0.05) / self.total
        p = (self.pairs[_bucket(codes)] + _PRIOR * chance) / (single[:-1] + _PRIOR)
        ascii_pair = (codes[1:] < 128) & (codes[:-1] < 128)
        p[ascii_pair] = np.maximum(p[ascii_pair], _ASCII)
        return np.add.reduceat(np.log(np.minimum(p, 1.0), dtype=np.float64), starts)

    def score_all(self, texts: Sequence[str]) -> np.ndarray:
        """``score`` over any number of texts, a bounded number of characters at a time."""
        out, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _CHARS:
                out.append(self.score(texts[start : i + 1]))
                start, size = i + 1, 0
        out.append(self.score(texts[start:]))
        return np.concatenate(out)


def byte_votes(garbled: str, clean: str) -> list[tuple[int, str]]:
    """Which character each byte of the clean run's UTF-8 became, if an unknown single-byte codec decoded it."""
    raw = clean.encode("utf-8", "surrogatepass")
    return list(zip(raw, garbled)) if len(raw) == len(garbled) else []


def completed(table: dict[int, str], shown: Callable[[str], int]) -> dict[int, str]:
    """An inferred table with the bytes nothing is known of taken from the listed codec that agrees with it most, if any does.

    Of several the one that is ``shown`` most often.
    """
    agreeing, _, nearest = max((sum(CODECS[n].decoding[b] == c for b, c in table.items()), shown(n), n) for n in SINGLE_BYTE)
    out, used = dict(table), set(table.values())
    if agreeing:
        out |= {b: c for b, c in enumerate(CODECS[nearest].decoding) if b >= 0x80 and b not in table and c not in used}
    return out
