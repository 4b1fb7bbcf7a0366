"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. A piece that is new to the worker is encoded in time linear in
its length: its bytes, mapped to Latin-1, run through an Aho-Corasick automaton that yields the longest vocabulary entry
at each place; the encoder walks along these, steps back to shorter entries where two neighbours could not have come
out of the merges side by side, and remembers which places are dead ends. Compatibility of neighbours is decided by
undoing merges and is memoised, so the result equals the merges applied in order. Pieces repeat, so nearly all text is
joined from remembered pieces.

Cases: a null text and an empty text have no tokens (an empty list); texts of any length are encoded whole; the strings
of special tokens are ordinary text. Letters are those of the Unicode version of the ``regex`` module.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.lookalike import decode

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact BPE for pieces of text, with memory of neighbouring tokens."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        back = byte_alphabet()
        latin = lambda token: "".join(chr(back[c]) for c in token)
        ids = {latin(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        top = max(ids.values()) + 1
        self.joined: dict[int, int] = {}
        self.rank, self.left, self.right = [-1] * top, [0] * top, [0] * top
        for r, (a, b) in enumerate(merges):
            left, right = ids[latin(a)], ids[latin(b)]
            whole = ids[latin(a) + latin(b)]
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, left, right
            self.joined[left << 24 | right] = r
        single = {ids[chr(b)] for b in range(256) if chr(b) in ids}
        entries = {t: i for t, i in ids.items() if self.rank[i] >= 0 or i in single}
        self.length, self.shorter = [0] * top, [-1] * top
        self.automaton = ahocorasick.Automaton()
        for t, i in entries.items():
            self.length[i] = len(t)
            self.shorter[i] = next((entries[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in entries), -1)
            self.automaton.add_word(t, len(t) << 24 | i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges can leave these tokens side by side.

        Their last merges are undone, latest first. If the inner halves would have been merged before the merge that
        shields them, the neighbours cannot occur.
        """
        rank, joined, bound = self.rank, self.joined, 1 << 60
        while True:
            r = joined.get(a << 24 | b)
            if r is not None and r < bound:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                bound, a = ra, self.right[a]
            elif rb >= 0:  # on equal ranks the left token was merged first
                bound, b = rb + 1, self.left[b]
            else:
                return True

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of many pieces; one pass of the automaton over all of them."""
        coded = [p.encode("utf-8", "replace").decode("latin-1") for p in pieces]
        line = "\u0100".join(coded)  # no byte, so no entry reaches over it
        longest = [0] * (len(line) + 1)
        for end, found in self.automaton.iter(line):  # shorter entries of the same end come later
            at = end + 1 - (found >> 24)
            if found > longest[at]:
                longest[at] = found
        alive = bytearray(b"\x01") * (len(line) + 1)
        fits, fit, length, shorter = self.fits, self._fit, self.length, self.shorter
        if len(fits) > 4 * REMEMBERED:
            fits.clear()
        results, begin = [], 0
        for text in coded:
            stop, at, out = begin + len(text), begin, []
            token = longest[at] & 0xFFFFFF
            while at < stop:
                if not longest[at]:
                    raise ValueError("the vocabulary lacks a byte of the text")
                while True:
                    end = at + length[token]
                    if alive[end]:
                        if not out:
                            break
                        key = out[-1] << 24 | token
                        good = fits.get(key)
                        if good is None:
                            good = fits[key] = fit(out[-1], token)
                        if good:
                            break
                    token = shorter[token]
                    if token < 0:  # a dead end: the token before must be shorter
                        alive[at] = 0
                        if not out:
                            raise ValueError("no way to encode the text")
                        token = out.pop()
                        at -= length[token]
                        end = 0
                        token = shorter[token]
                        while token < 0 and out:
                            alive[at] = 0
                            token = out.pop()
                            at -= length[token]
                            token = shorter[token]
                        if token < 0:
                            raise ValueError("no way to encode the text")
                out.append(token)
                at = end
                token = longest[at] & 0xFFFFFF
            results.append(out)
            begin = stop + 1
        return results


LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Letter, digit, white space or other, for each code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            out[lo : hi + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def piece_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the vocabulary's pattern cuts texts that lie end to end.

    Runs of letters, digits or other marks are pieces, with one blank before them; white space before a piece goes
    without its last character; an apostrophe that begins a piece takes the letters of an English ending.
    """
    n = len(cps)
    kind = _classes()[cps]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= edge[:-1]
    space = kind == SPACE
    last_space = space.copy()
    last_space[:-1] &= ~space[1:]
    last_space &= ~edge[1:]  # white space at the end of a text stays whole
    starts = new | last_space
    after = np.flatnonzero(last_space) + 1
    starts[after[cps[after - 1] == 0x20]] = False  # the blank belongs to what follows
    quote = np.flatnonzero((cps == 0x27) & starts)
    if len(quote):
        at = lambda k: cps[np.minimum(quote + k, n - 1)]
        inside = lambda k: (quote + k < n) & ~edge[np.minimum(quote + 1, n)] & (True if k == 1 else ~edge[np.minimum(quote + 2, n)])
        one = inside(1) & np.isin(at(1), [ord(c) for c in "stmd"])
        two = inside(2) & np.isin(at(1).astype(np.int64) << 8 | at(2), [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & ~one
        for hit, size in ((one, 2), (two, 3)):
            q = quote[hit]
            starts[q + 1] = False
            ends = q + size
            starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


_POWER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up, down = np.full(n, _POWER), np.full(n, np.uint64(pow(int(_POWER), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Worker:
    """Encodes batches; remembers the ids of pieces by a 64-bit digest of their characters."""

    def __init__(self, vocabulary: bytes):
        self.encoder = Encoder(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts in them."""
        strings = pa.compute.fill_null(texts, "").cast(pa.large_string())
        _, off, data = strings.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        cps, offsets = decode(raw, offsets - offsets[0])
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(cps, offsets)
        ends = np.append(starts[1:], len(cps))
        up, down = _powers(1 << max(10, int(len(cps)).bit_length()))
        mixed = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= up[: len(cps)]
        summed = np.zeros(len(cps) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=summed[1:])
        digest = (summed[ends] - summed[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        unique, first, inverse = np.unique(digest, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        where = [known.get(d, -1) for d in unique.tolist()]
        new = [i for i, w in enumerate(where) if w < 0]
        if new:
            lo, hi = starts[first[new]], ends[first[new]]
            for k in range(0, len(new), 20_000):
                # one decode for many pieces: their code points end to end
                part = slice(k, k + 20_000)
                size = hi[part] - lo[part]
                cut = np.concatenate([[0], np.cumsum(size)])
                text = cps[np.repeat(lo[part] - cut[:-1], size) + np.arange(cut[-1])].astype("<u4").tobytes().decode("utf-32-le", "replace")
                cut = cut.tolist()
                pieces = [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                for i, ids in zip(new[part], self.encoder.encode(pieces), strict=True):
                    where[i] = known[int(unique[i])] = len(self.ends) - 1
                    self.flat.extend(ids)
                    self.ends.append(len(self.flat))
        bound = np.frombuffer(self.ends, dtype=np.int64).copy()
        flat = np.frombuffer(self.flat, dtype=np.int32).copy()
        row = np.array(where)[inverse]
        size = bound[row + 1] - bound[row]
        total = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(bound[row] - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, offsets)]


_WORKERS: dict[bytes, Worker] = {}


def _worker(raw: bytes) -> Worker:
    """The process's worker for a vocabulary; its memory serves all tasks of the process."""
    key = hashlib.blake2b(raw).digest()
    if key not in _WORKERS:
        _WORKERS[key] = Worker(raw)
    return _WORKERS[key]


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Parts of a batch with about so many bytes of text each, and at least one row."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // most
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(cut, cut[1:], strict=False):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast variable: a fixed file of a few MB, checked."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("the vocabulary file is larger than 64 MB")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids``: one row a document."""
    shared = _vocabulary(docs, vocabulary)

    def run(batches):
        work = _worker(shared.value)
        for whole in batches:
            for b in _slices(whole, 1):
                flat, ends = work.ids(b.column(1))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``n_tokens``, without the texts."""
    shared = _vocabulary(docs, vocabulary)

    def run(batches):
        work = _worker(shared.value)
        for whole in batches:
            for b in _slices(whole, whole.num_columns - 1):
                n = np.diff(work.ids(b.column(b.num_columns - 1))[1])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens long")
