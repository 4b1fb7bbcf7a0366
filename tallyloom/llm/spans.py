"""Long exact spans shared between records.

Texts are parsed by recompression. Tokens (a word with the blank before it, any other character, each ideograph) are the
first symbols; in every round runs of one symbol and then pairs of a left and a right symbol, told apart by a hash of
the name, become new symbols until a symbol is long enough. A symbol's name is a digest of the characters it stands
for, so names agree across all documents without a dictionary. Equal stretches therefore get the same symbols except
near their ends.

1. Every border between high-level symbols, with 30 characters on each side, is a seed; seeds that occur in two
   documents reveal the repeats. Symbols are shorter than 40 characters, so the middle of any stretch of 120 has a border.
2. Around revealed seeds all windows of 120 characters are named by digest, and a window that occurs in two documents
   is verified as shared; nothing else is. Windows reach some characters beyond a seed, for at the ends of an equal
   stretch borders may lie differently. Runs of shared windows are the spans.

What flows between the steps are digests with a document number. Seeds are counted with pre-aggregation, so a passage
that stands in a third of all documents is one row a task. Windows go once through an exchange by digest, with 80 bits
to tell them apart; what documents of one part of a task share is settled there, and one row of it goes to the others.
Revealed seeds reach the second reading of the texts as a Bloom filter of at most 128 MB, and through a join where there
are more than 268 million of them.

Cases: null and short texts have no spans; null ``doc_id`` rows are left out; repeated rows of one ``doc_id`` are the
same document, so they share nothing with each other; texts may have any length.
"""

from __future__ import annotations

import functools
import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.bittable import ored
from tallyloom.llm.lookalike import decode
from tallyloom.workspace import Workspace

SPAN = 120
LEAST, ROUNDS = 20, 12
AROUND, BEYOND = 30, 28
FILTER_BITS = 30
WORD, SPACE, ALONE = 0, 1, 2
LONG_TOKEN = 16
_POWER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _kinds() -> np.ndarray:
    """Whether a code point is part of a word, a blank, or a token of its own (ideographs too)."""
    out = np.full(0x110000, ALONE, dtype=np.uint8)
    for cp in range(0x2E80):
        ch = chr(cp)
        out[cp] = WORD if ud.category(ch)[0] in "LNM" else SPACE if ch.isspace() else ALONE
    return out


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up, down = np.full(n, _POWER), np.full(n, np.uint64(pow(int(_POWER), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Text:
    """Texts that lie end to end, with digests of any stretch in constant time."""

    def __init__(self, cps: np.ndarray, offsets: np.ndarray):
        self.cps, self.offsets = cps, offsets
        up, self.down = powers(1 << max(10, len(cps).bit_length()))
        mixed = (cps.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= up[: len(cps)]
        self.sums = np.zeros(len(cps) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=self.sums[1:])

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """16 more bits, from other weights of characters and places."""
        odd = (self.cps.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        odd ^= odd >> np.uint64(32)
        odd *= _MIX
        odd ^= odd >> np.uint64(27)
        base = np.uint64(0xA0761D6478BD642F)
        ups = np.full(len(odd) + 1, base)
        ups[0] = 1
        np.multiply.accumulate(ups, out=ups)
        downs = np.full(len(odd) + 1, np.uint64(pow(int(base), -1, 1 << 64)))
        downs[0] = 1
        np.multiply.accumulate(downs, out=downs)
        sums = np.zeros(len(odd) + 1, dtype=np.uint64)
        np.cumsum(odd * ups[:-1], out=sums[1:])
        x = (sums[end] - sums[start]) * downs[start]
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits that are equal for equal stretches wherever they stand."""
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        return x * _MIX


def tokens(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of words (with a blank before them), of other characters, and of each character of overlong words."""
    n = len(cps)
    kind = _kinds()[cps]
    new = kind != WORD
    new[1:] |= kind[:-1] == ALONE
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    size = np.diff(starts, append=n)
    for k in np.flatnonzero(size > LONG_TOKEN):
        new[starts[k] : starts[k] + size[k]] = True
    return np.flatnonzero(new)


def borders(text: Text, least: int = LEAST, rounds: int = ROUNDS) -> np.ndarray:
    """Places between the symbols left after the rounds; inside a long run, at every multiple of its period."""
    n = len(text.cps)
    start = tokens(text.cps, text.offsets)
    first = np.zeros(n + 1, dtype=bool)
    first[text.offsets] = True
    period = np.zeros(len(start), dtype=np.int64)  # of symbols that are runs
    for r in range(rounds):
        size = np.diff(start, append=n)
        name = text.digest(start, start + size)
        same = np.zeros(len(start), dtype=bool)
        same[1:] = (name[1:] == name[:-1]) & ~first[start[1:]] & (size[1:] < least)
        if same.any():
            keep = ~same
            grown = np.append(same[1:], False)
            period = np.where(grown & (period == 0), size, period)[keep]
            start = start[keep]
            size = np.diff(start, append=n)
            name = text.digest(start, start + size)
        side = ((name ^ np.uint64(r * 0x9E3779B9)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)
        short = size < least
        taken = np.zeros(len(start), dtype=bool)
        taken[1:] = (side[:-1] == 0) & short[:-1] & (side[1:] == 1) & short[1:] & ~first[start[1:]]
        keep = ~taken
        period = np.where(np.append(taken[1:], False), 0, period)[keep]
        start = start[keep]
    size = np.diff(start, append=n)
    step = np.where(period > 0, -(-least // np.maximum(period, 1)) * period, size)
    many = np.flatnonzero(size > 2 * step)
    if len(many):
        inner = [np.arange(start[i], start[i] + size[i], step[i]) for i in many]
        start = np.unique(np.concatenate([start, *inner]))
    return start


def _texts(batch: pa.RecordBatch, most: int = 4 << 20):
    """Parts of a batch (document number, text) as (numbers, Text)."""
    import pyarrow.compute as pc

    kept = batch.filter(pc.greater_equal(pc.fill_null(pc.utf8_length(batch.column(1)), 0), SPAN))
    strings = kept.column(1).cast(pa.large_string())
    if not len(strings):
        return
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)
    part = (offsets[:-1] - offsets[0]) // most
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(strings)]])
    ids = kept.column(0).to_numpy()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield ids[a:b], Text(*decode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])), (a, b), kept


def _seeds(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, digest and text number of each seed."""
    at = borders(text)
    doc = np.searchsorted(text.offsets, at, side="right") - 1
    ok = (at - AROUND >= text.offsets[doc]) & (at + AROUND <= text.offsets[doc + 1])
    at, doc = at[ok], doc[ok]
    return at, text.digest(at - AROUND, at + AROUND), doc


def _windows(text: Text, ids: np.ndarray, at: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Every window of the span's length around the seeds: document, digest, place with 16 more bits of digest, shared.

    A window that two documents at hand have is shared; one row of it keeps its digest, so documents elsewhere meet it,
    and the others get a number of their document. A passage of very many documents is one row a digest and part this way.
    """
    lo = np.maximum(at + AROUND - SPAN - BEYOND, text.offsets[doc])
    hi = np.minimum(at - AROUND + BEYOND, text.offsets[doc + 1] - SPAN)
    ok = hi >= lo
    edge = np.zeros(len(text.cps) + 2, dtype=np.int32)
    np.add.at(edge, lo[ok], 1)
    np.add.at(edge, hi[ok] + 1, -1)
    w = np.flatnonzero(np.cumsum(edge) > 0)
    doc = np.searchsorted(text.offsets, w, side="right") - 1
    digest, more, docs = text.digest(w, w + SPAN), text.second(w, w + SPAN), ids[doc]
    place = (w - text.offsets[doc]).astype(np.uint64) | more << np.uint64(32)
    order = np.lexsort((docs, more, digest))
    d, m, i = digest[order], more[order], docs[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    shared = (i[first] != i[last])[group]
    spare = order[shared & ~head]
    known = np.zeros(len(w), dtype=bool)
    known[order] = shared
    digest[spare] = docs[spare].astype(np.uint64) * _POWER * _MIX  # a number of the document, which its text bounds
    # rows stay in the order of the texts, which packs well
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(digest.view(np.int64)), pa.array(place.view(np.int64)), pa.array(known)], names=["doc_id", "digest", "place", "known"])


def _frame(docs: np.ndarray, digest: np.ndarray, pos: np.ndarray | None = None) -> pa.RecordBatch:
    cols = [pa.array(docs), pa.array(digest.view(np.int64))]
    names = ["doc_id", "digest"]
    if pos is not None:
        cols.append(pa.array(pos.astype(np.int32)))
        names.append("pos")
    return pa.RecordBatch.from_arrays(cols, names=names)


def in_two(rows: DataFrame) -> DataFrame:
    """Digests that occur in more than one document."""
    ends = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return ends.where("lo <> hi").select("digest")


def _places(digest: np.ndarray, k: int) -> list[np.ndarray]:
    """Three bits for a digest in an array of 2^k bits."""
    return [(digest * m) >> np.uint64(64 - k) for m in (np.uint64(1), _POWER, np.uint64(0x94D049BB133111EB))]


def _filter(shared: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the digests, about 32 bits each and at most 2^FILTER_BITS bits."""
    k = min(FILTER_BITS, max(16, (32 * n).bit_length()))

    def bits_of(b):
        place = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), k))
        return place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))

    return ored(shared, bits_of, 1 << (k - 6)), k


def windows_near_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Windows of the span's length around revealed seeds, see ``_windows``."""
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").where(F.length("text") >= SPAN)

    def emit(with_pos):
        def run(batches):
            for b in batches:
                for ids, text, _, _ in _texts(b):
                    at, digest, doc = _seeds(text)
                    yield _frame(ids[doc], digest, at - text.offsets[doc] if with_pos else None)

        return run

    shared = ws.put(in_two(src.mapInArrow(emit(False), "doc_id long, digest long")), "shared")
    n = shared.count()
    schema = "doc_id long, digest long, place long, known boolean"
    if 4 * n <= 1 << FILTER_BITS:
        bits, k = _filter(shared, n)
        kept = docs.sparkSession.sparkContext.broadcast(bits)

        def run(batches):
            words = kept.value
            for b in batches:
                for ids, text, _, _ in _texts(b):
                    at, digest, doc = _seeds(text)
                    hit = np.ones(len(digest), dtype=bool)
                    for place in _places(digest, k):
                        hit &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    yield _windows(text, ids, at[hit], doc[hit])

        return src.mapInArrow(run, schema)

    def near(batches):
        for b in batches:
            for ids, text, (lo, hi), kept in _texts(b):
                places = kept.column(2).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.asarray(places.value_lengths()))
                yield _windows(text, ids, places.flatten().to_numpy() + text.offsets[doc], doc)

    seeds = src.mapInArrow(emit(True), "doc_id long, digest long, pos int").join(shared, "digest", "left_semi")
    places = seeds.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("places"))  # bounded by one text
    return src.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(near, schema)


def shared_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start_pos``, ``span_chars``: longest runs of characters that stand verbatim in another document."""
    ws = Workspace(docs.sparkSession)
    # one exchange by digest; rows of a digest stay sorted, and spill rather than gather in memory
    more = F.shiftrightunsigned("place", 32)
    same = Window.partitionBy("digest", "more")
    rows = windows_near_repeats(docs, ws).select("doc_id", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "known", "digest", more.alias("more"))
    both = rows.repartition("digest").select("doc_id", "pos", "known", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi"))
    shared = both.where("known or lo <> hi").select("doc_id", "pos")
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.when(F.col("pos") > F.lag("pos").over(order) + SPAN, 1).otherwise(0)
    runs = shared.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "run").agg(
        F.min("pos").cast("long").alias("start_pos"), (F.max("pos") - F.min("pos") + SPAN).cast("long").alias("span_chars")
    ).select("doc_id", "start_pos", "span_chars")


def shared_fractions(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``shared_chars``, ``shared_fraction`` of every document."""
    spans = shared_spans(docs).groupBy("doc_id").agg(F.sum("span_chars").alias("shared"))
    size = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0))
    return size.join(spans, "doc_id", "left").select(
        "doc_id", "n_chars", shared.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 6).alias("shared_fraction")
    )
