"""Same or near-same records across splits: every pair of texts over the threshold, decided by the pieces themselves.

Normalised texts have a set of 3-character pieces, a number of them, and a sketch of parities: bit i tells whether an odd
number of pieces has a hash of remainder i. Two sketches differ in no more bits than the sets differ in pieces, and sets of
similarity 0.8 differ in at most a ninth of their sizes together, so sketches that differ in more bits settle a pair for
certain. Texts stand in buckets of size, a step of 1.3 wide, so a text can only be similar to texts of its own bucket and of
the two next to it. Buckets are cut into blocks, each cell of two blocks is one group of rows, and in it every text
meets all texts of a fitting size. For the pairs left the similarity of the pieces is computed in full, and the summed
lengths of shared content-defined chunks as overlap fractions.

No pair of similarity 0.8 or more is left out, whatever the texts have in common. The price is that comparisons of sketches
grow with the square of the records (README).

Copies of one text are one text during the search and are expanded at the end.

Cases: null or unreadable states give no strings (an unreadable state is one string itself); null questions, images,
splits and numbers are allowed; texts without a character take no part; a text of one or two characters is one piece, so
only the same text is similar to it; repeated rows of one ``rec_key`` are one record; a null ``rec_key`` names no record;
other splits take no part.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lookalike import decode
from tallyloom.llm.spans import Text
from tallyloom.workspace import Workspace

TRAIN, EVALUATION = ("train",), ("calibration", "validation", "test")
SIMILAR = 0.8
NEAR, ROLL = 3, 3
LEAST_WITH_IMAGE = 200
WIDE = 1.3  # more than 1 / SIMILAR, so similar texts are in one bucket or in neighbours
BLOCK_ROWS, BLOCK_BYTES = 1 << 17, 1 << 25
STRIP = 1 << 14  # sketches that a core keeps at hand
MOST_SLOTS, LEVELS, SALTS = 1 << 26, 16, {}  # read by nothing; tests set them
SMALL_KEYS = 500_000
# How image numbers stand in paths.
COCO_FILE = re.compile(r"COCO_[A-Za-z]+[0-9]{4}_0*([0-9]+)[^/]*$")
COCO_FOLDER = re.compile(r"(?:^|/)(?:train|val)[0-9]{4}/0*([0-9]+)[^/]*$")
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _strings(state) -> list[str]:
    """Strings of a JSON value in written order, without keys and without what stands under ``image``."""
    out, stack = [], [state]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack.extend([v for k, v in x.items() if k != "image"][::-1])
        elif isinstance(x, list):
            stack.extend(x[::-1])
    return out


def record_text(state_json: str | None, instructions: list[str | None] | None) -> str:
    """All strings of the state, then all instructions, in lower case with single blanks."""
    parts = []
    if state_json is not None:
        try:
            parts = _strings(json.loads(state_json))
        except (ValueError, RecursionError):
            parts = [state_json]
    parts.extend(x for x in instructions or () if x is not None)
    return " ".join(" ".join(parts).split()).lower()


def image_numbers(coco_id: int | None, paths: list[str | None] | None) -> set[int]:
    """Image numbers of a record, from its own field and from its image paths."""
    out = set() if coco_id is None else {coco_id}
    for p in paths or ():
        m = p and (COCO_FILE.search(p) or COCO_FOLDER.search(p))
        if m and len(m[1]) < 19:
            out.add(int(m[1]))
    return out


def texts(records: DataFrame) -> DataFrame:
    """``rec_key``, ``side`` (0 train, 1 evaluation), ``tkey`` (null if the text takes no part), ``tid`` (its first 8 bytes), ``text``, ``numbers``."""
    side = F.when(F.col("split").isin(*TRAIN), 0).when(F.col("split").isin(*EVALUATION), 1)
    src = records.where("rec_key is not null").select(
        "rec_key",
        side.cast("int").alias("side"),
        "state_json",
        F.transform(F.col("questions"), lambda q: q["instructions"]).alias("instructions"),
        F.flatten(F.array(F.coalesce(F.transform("images", lambda i: i["path"]), F.array()), F.coalesce(F.transform("images", lambda i: i["url"]), F.array()))).alias("paths"),
        (F.coalesce(F.size("images"), F.lit(0)) > 0).alias("pictured"),
        "coco_id",
    ).where("side is not null")

    def run(batches):
        for b in batches:
            keys, out, numbers = [], [], []
            cols = [b.column(i).to_pylist() for i in range(2, 7)]
            for state, instructions, paths, pictured, coco in zip(*cols, strict=True):
                t = _clean(record_text(state, instructions))
                part = bool(t) and (not pictured or len(t) >= LEAST_WITH_IMAGE)
                keys.append(hashlib.blake2b(t.encode(), digest_size=16).digest() if part else None)
                out.append(t if part else None)
                numbers.append(sorted(image_numbers(coco, paths)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array([k and int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.array(out, pa.string()), pa.array(numbers, pa.list_(pa.int64()))],
                names=["rec_key", "side", "tkey", "tid", "text", "numbers"],
            )

    return src.mapInArrow(run, "rec_key long, side int, tkey binary, tid long, text string, numbers array<long>")


def _clean(s: str) -> str:
    """Text that UTF-8 can hold."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def chunks(text: Text) -> np.ndarray:
    """Starts of the chunks of texts that lie end to end."""
    n = len(text.cps)
    begin = np.zeros(n, dtype=np.int64)
    first = text.offsets[:-1][np.diff(text.offsets) > 0]
    begin[first] = first
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(n) - begin
    unit = text.cps.astype(np.uint64) * _M
    h = unit.copy()
    for k in range(1, ROLL):
        h *= _P
        h[k:] += np.where(place[k:] >= k, unit[:-k], np.uint64(0))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    cut = np.ones(n, dtype=bool)
    for k in range(1, NEAR + 1):
        if k >= n:
            break
        other = place[k:] < k  # the neighbour lies in another text
        cut[k:] &= (h[k:] < h[:-k]) | other
        cut[:-k] &= (h[:-k] < h[k:]) | other
    cut[first] = True
    return np.flatnonzero(cut)


def _batches(batches, text_column: int, most: int = 3 << 20):
    """Parts of the batches with (rows, Text); every row has a text."""
    for b in batches:
        strings = b.column(text_column).cast(pa.large_string())
        if not len(strings):
            continue
        _, off, data = strings.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)
        cut = np.concatenate([[0], np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // most)) + 1, [len(strings)]]).tolist()
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield b.slice(lo, hi - lo), Text(*decode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))


def _grouped(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 44-bit hash of the distinct 3-character pieces, by text and hash."""
    n, docs = len(text.cps), len(text.offsets) - 1
    size = np.diff(text.offsets)
    c = text.cps.astype(np.uint64)
    gram = c.copy()
    for k in (1, 2):
        gram <<= np.uint64(21)
        gram[: n - k] += c[k:]
    gram *= _P
    gram ^= gram >> np.uint64(32)
    inside = np.ones(n, dtype=bool)
    for k in (1, 2):  # the last two characters begin no piece, unless the text is that short
        inside[text.offsets[1:][size > k] - k] = False
    doc = np.repeat(np.arange(docs, dtype=np.uint64), size)[inside]
    both = np.sort(doc << np.uint64(44) | gram[inside] >> np.uint64(20))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1)


def bucket(n: np.ndarray) -> np.ndarray:
    """Bucket of a number of pieces."""
    return np.floor(np.log(n) / np.log(WIDE)).astype(np.int64)


def sketch_bits(k: int) -> int:
    """Bits of the sketches of a bucket: a power of two, at least 1.2 for every piece."""
    return max(128, 1 << int(np.ceil(np.log2(1.2 * WIDE ** (k + 1)))))


def sketches(parts: DataFrame) -> DataFrame:
    """``side``, ``tid``, ``k`` (bucket), ``n`` (distinct pieces), ``sketch`` of the texts of three characters or more; a task sends a text once."""

    def run(batches):
        seen: set[tuple] = set()
        for b in batches:
            fresh = pa.array([k not in seen and not seen.add(k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_())
            if len(seen) > 200_000:
                seen.clear()
            for part, text in _batches([b.filter(fresh)], 2):
                doc, piece = _grouped(text)
                n = np.bincount(doc, minlength=part.num_rows)
                k = bucket(n)
                k[np.diff(text.offsets) < 3] = -1
                for at in np.unique(k[k >= 0]).tolist():
                    rows, bits = np.flatnonzero(k == at), sketch_bits(at)
                    place = np.full(part.num_rows, -1)
                    place[rows] = np.arange(len(rows))
                    own = place[doc] >= 0
                    odd = np.bincount(place[doc[own]] * bits + (piece[own] % np.uint64(bits)).astype(np.int64), minlength=len(rows) * bits) & 1
                    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
                    width = bits // 8
                    cols = [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), at)), pa.array(n[rows])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([packed[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())], names=["side", "tid", "k", "n", "sketch"])

    return parts.select("side", "tid", "text").mapInArrow(run, "side int, tid long, k long, n long, sketch binary")


def _block(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, sizes and words (by word and text) of the distinct texts of a block, by size; sketches folded to so many bits."""
    tid, n, sketch = table["tid"].to_numpy(), table["n"].to_numpy(), table["sketch"]
    _, one = np.unique(tid, return_index=True)
    one = one[np.argsort(n[one], kind="stable")]
    words = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint64).reshape(len(tid), -1)[one]
    while words.shape[1] * 64 > bits:  # parities of the lower half of the remainders
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return tid[one], n[one], np.ascontiguousarray(words.T)


def near_sketches(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers of the pairs of two blocks whose sizes and sketches allow the similarity.

    Sets of sizes a and b and similarity s differ in at most (a + b) (1 - s) / (1 + s) pieces. One piece is to spare, for
    pieces of one hash. Some words settle most pairs, all of them the others; how many words come first follows the share
    of pairs that they leave. Their differing bits are counted in a byte, which can only be too low after 255.
    """
    (tid, n, words), (tid2, n2, words2) = left, right
    share = (1 - SIMILAR) / (1 + SIMILAR) + 1e-9
    first, least = max(1, len(words) // 2), 1
    lows, highs = np.searchsorted(n, n2 * SIMILAR - 1.001, side="left"), np.searchsorted(n, (n2 + 1) / SIMILAR + 0.001, side="right")
    buffers = np.empty(STRIP, dtype=np.uint64), np.empty(STRIP, dtype=np.uint8), np.empty(STRIP, dtype=np.uint8), np.empty(STRIP, dtype=bool)
    out: list[tuple] = []
    for j in np.flatnonzero(highs > lows).tolist():
        for lo in range(lows[j], highs[j], STRIP):
            hi = min(lo + STRIP, highs[j])
            most = int((n[hi - 1] + n2[j]) * share + 1)
            if most >= 64 * len(words):
                at = np.arange(hi - lo)
            else:
                bits, more, differ, near = (x[: hi - lo] for x in buffers)
                for w in range(first):
                    np.bitwise_xor(words[w, lo:hi], words2[w, j], out=bits)
                    np.bitwise_count(bits, out=more if w else differ)
                    if w:
                        np.add(differ, more, out=differ)
                at = np.flatnonzero(np.less_equal(differ, most, out=near))
            if len(at) > (hi - lo) // 128 and first < len(words):
                first = least = first + 1
            elif first > least and len(at) <= (hi - lo) // 4096:
                first -= 1
            if len(at):
                at += lo
                rest = np.bitwise_count(words[:, at] ^ words2[:, j, None]).sum(0, dtype=np.int64)
                at = at[rest <= (n[at] + n2[j]) * share + 1]
                at = at[tid[at] != tid2[j]]
                if len(at):
                    out.append((tid[at], np.full(len(at), tid2[j])))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(x[i] for x in out)]) for i in (0, 1))


def candidates(signed: DataFrame) -> DataFrame:
    """``t_train``, ``t_eval``: distinct pairs of different texts that may be similar enough, from ``sketches``."""
    spark = signed.sparkSession
    sizes: dict[tuple, int] = {(r["side"], r["k"]): r["m"] for r in signed.groupBy("side", "k").agg(F.count("*").alias("m")).collect()}  # a row a bucket
    blocks = {(s, k): -(-m // max(1, min(BLOCK_ROWS, BLOCK_BYTES * 8 // sketch_bits(k)))) for (s, k), m in sizes.items()}
    meet = [(k, o) for s, k in blocks if s == 0 for o in (k - 1, k, k + 1) if (1, o) in blocks]

    def laid(side: int) -> DataFrame:
        """Each text once for every block of the other side that its own block meets."""
        grid = [(p, q, p if side == 0 else q, blocks[side, p if side == 0 else q], other) for p, q in meet for other in range(blocks[1 - side, q if side == 0 else p])]
        g = F.broadcast(spark.createDataFrame(grid, "k0 long, k1 long, k long, many long, other long"))
        own = F.pmod(F.col("tid"), F.col("many"))
        b0, b1 = (own, F.col("other")) if side == 0 else (F.col("other"), own)
        return signed.where(F.col("side") == side).join(g, "k").select("k0", "k1", b0.alias("b0"), b1.alias("b1"), *(F.col(c).alias(f"{c}{side}") for c in ("tid", "n", "sketch")))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if left.num_rows and right.num_rows:
            bits = min(sketch_bits(key[0].as_py()), sketch_bits(key[1].as_py()))
            a, b = near_sketches(*(_block(x.select(range(4, 7)).rename_columns(["tid", "n", "sketch"]), bits) for x in (left, right)))
        return pa.table({"t_train": pa.array(a), "t_eval": pa.array(b)})

    cell = ["k0", "k1", "b0", "b1"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # set, for few bytes make much work
    one, other = (laid(s).repartition(parts, *cell).groupBy(*cell) for s in (0, 1))
    return one.cogroup(other).applyInArrow(run, "t_train long, t_eval long")


def _grams(x: str) -> set[str]:
    return {x[i : i + 3] for i in range(max(1, len(x) - 2))}


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``t_train``, ``t_eval`` (text keys), ``similarity`` and the fraction of each text in shared chunks."""
    keys = pairs.select(F.col("t_train").alias("tid")).union(pairs.select("t_eval")).distinct()
    if keys.count() <= SMALL_KEYS:  # 8 bytes each
        keys = F.broadcast(keys)
    known = parts.select("tkey", "tid", "text").join(keys, "tid", "left_semi").groupBy("tid", "tkey").agg(F.first("text").alias("text"))
    named = lambda t, x: known.select(F.col("tid").alias(t), F.col("tkey").alias(f"{x}_key"), F.col("text").alias(x))
    full = pairs.join(named("t_train", "a"), "t_train").join(named("t_eval", "b"), "t_eval")

    def run(batches):
        for b in batches:
            value = similarity(b.column(2).to_pylist(), b.column(3).to_pylist())
            near = value >= SIMILAR
            b = b.filter(pa.array(near))
            if not b.num_rows:
                continue
            left, right = _shared_lengths(b.column(2), b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in (value[near], left, right))], names=["t_train", "t_eval", "similarity", "train_fraction", "eval_fraction"])

    schema = "t_train binary, t_eval binary, similarity double, train_fraction double, eval_fraction double"
    return full.select(F.col("a_key").alias("t_train"), F.col("b_key").alias("t_eval"), "a", "b").mapInArrow(run, schema)


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Share of the distinct 3-character pieces of either text that are in both, pair by pair."""
    sides = []
    for strings in (left, right):
        size = np.array([len(x) for x in strings])
        c = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        piece = c + np.uint64(1)
        ends = np.cumsum(size)
        pair = np.repeat(np.arange(len(size)), size)
        for k in (1, 2):  # a place after the end counts as 0, so short texts are one piece
            piece <<= np.uint64(21)
            inside = np.flatnonzero(np.arange(len(c)) + k < ends[pair])
            piece[inside] += c[inside + k] + np.uint64(1)
        whole = (np.arange(len(c)) + 2 < ends[pair]) | (np.arange(len(c)) == (ends - size)[pair])
        sides.append((pair[whole], piece[whole]))
    pair, piece = (np.concatenate(x) for x in zip(*sides, strict=True))
    side = np.repeat([0, 1], [len(sides[0][0]), len(sides[1][0])])
    order = np.lexsort((side, piece, pair))
    pair, piece, side = pair[order], piece[order], side[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (piece[1:] != piece[:-1]) | (side[1:] != side[:-1])
    pair, piece = pair[new], piece[new]
    twice = (pair[1:] == pair[:-1]) & (piece[1:] == piece[:-1])
    both = np.bincount(pair[1:][twice], minlength=len(left))
    return both / (np.bincount(pair, minlength=len(left)) - both)


def _shared_lengths(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts, the summed length of shared chunks as a fraction of either."""
    sides = []
    for column in (left, right):
        strings = column.to_pylist()
        size = np.array([len(x) for x in strings])
        text = Text(np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size)]))
        start = chunks(text)
        length = np.diff(start, append=len(text.cps))
        doc = np.searchsorted(text.offsets, start, side="right") - 1
        sides.append((doc, text.digest(start, start + length), length, size))
    out = []
    for (doc, digest, length, size), (doc2, digest2, _, _) in ((sides[0], sides[1]), (sides[1], sides[0])):
        mixed = digest ^ (doc.astype(np.uint64) * _P)
        hit = np.isin(mixed, digest2 ^ (doc2.astype(np.uint64) * _P))
        out.append(np.bincount(doc, weights=length * hit, minlength=len(size)) / size)
    return out[0], out[1]


def text_links(parts: DataFrame, ws: Workspace) -> DataFrame:
    """Similar pairs of different texts across the sides."""
    signed = ws.put(sketches(parts).dropDuplicates(["side", "tid"]), "sketches")  # else copies make blocks, and cells by the square of them
    links = ws.put(verified(ws.put(candidates(signed), "candidates"), parts), "links")
    ws.drop("sketches")
    ws.drop("candidates")
    return links


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and links of classes of alike records.

    Members: ``rec_key``, ``side``, ``kind``, ``class``; a class is a text, or a set of image numbers. Links:
    ``kind`` (image, same text, near text), ``member_kind``, ``c_train``, ``c_eval``, ``eval_fraction``: classes whose
    train members and evaluation members overlap.
    """
    ws = Workspace(records.sparkSession)
    all_texts = ws.put(texts(records), "texts")
    parts = all_texts.where("tkey is not null").select("rec_key", "side", "tkey", "tid", "text")
    links = text_links(parts, ws)
    of_text = parts.select("rec_key", "side", F.lit("text").alias("kind"), F.col("tkey").alias("class"))
    numbered = all_texts.where("size(numbers) > 0").select("rec_key", "side", F.array_sort("numbers").alias("numbers"))
    digest = F.unhex(F.sha2(F.array_join("numbers", ","), 256))
    of_image = numbered.select("rec_key", "side", F.lit("image").alias("kind"), digest.alias("class"))
    members = ws.put(of_text.unionByName(of_image).distinct(), "members")
    sets = numbered.select("side", "numbers").distinct().select("side", digest.alias("class"), F.explode("numbers").alias("number"))
    shown = lambda s, c: sets.where(F.col("side") == s).select(F.col("class").alias(c), "number")
    image = shown(0, "c_train").join(shown(1, "c_eval"), "number").select("c_train", "c_eval").distinct()
    image = image.select(F.lit("image").alias("kind"), F.lit("image").alias("member_kind"), "c_train", "c_eval", F.lit(None).cast("double").alias("eval_fraction"))
    sides = lambda s: members.where((F.col("side") == s) & (F.col("kind") == "text")).select("class").distinct()
    same = sides(0).join(sides(1), "class").select(F.lit("same text").alias("kind"), F.lit("text").alias("member_kind"), F.col("class").alias("c_train"), F.col("class").alias("c_eval"), F.lit(1.0).alias("eval_fraction"))
    near = links.select(F.lit("near text").alias("kind"), F.lit("text").alias("member_kind"), F.col("t_train").alias("c_train"), F.col("t_eval").alias("c_eval"), "eval_fraction")
    return members, ws.put(image.unionByName(same).unionByName(near), "classes")


def _members(members: DataFrame, side: int, key: str, of: str) -> DataFrame:
    return members.where(F.col("side") == side).select(F.col("rec_key").alias(key), F.col("kind").alias("member_kind"), F.col("class").alias(of))


def overlaps(records: DataFrame) -> DataFrame:
    """``rec_train``, ``rec_eval``, ``kind`` (image, same text, near text), ``eval_fraction``: all pairs across the sides."""
    members, links = classes(records)
    pairs = links.join(_members(members, 0, "rec_train", "c_train"), ["member_kind", "c_train"]).join(_members(members, 1, "rec_eval", "c_eval"), ["member_kind", "c_eval"])
    return pairs.where("rec_train <> rec_eval").groupBy("rec_train", "rec_eval", "kind").agg(F.max("eval_fraction").alias("eval_fraction"))


def found(records: DataFrame) -> DataFrame:
    """``rec_a`` < ``rec_b``: a train record and an evaluation record that share an image number or a text."""
    return overlaps(records).select(F.least("rec_train", "rec_eval").alias("rec_a"), F.greatest("rec_train", "rec_eval").alias("rec_b")).distinct()


def report(records: DataFrame) -> DataFrame:
    """Pairs and records with a partner in train, by split and source of the evaluation record and kind.

    Counted from the sizes of the linked classes; no pair of records is made. A record loaded for both sides is no
    partner of itself.
    """
    members, links = classes(records)
    size = members.where("side = 0").groupBy(F.col("kind").alias("member_kind"), F.col("class").alias("c_train")).agg(F.count("*").alias("n"))
    by_class = links.join(size, ["member_kind", "c_train"]).groupBy("kind", "member_kind", "c_eval").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("eval_fraction")).alias("f"))
    by_record = by_class.join(_members(members, 1, "rec_eval", "c_eval"), ["member_kind", "c_eval"]).select("kind", "rec_eval", "n", "f")
    own = _members(members, 0, "rec_eval", "c_train").join(_members(members, 1, "rec_eval", "c_eval"), ["rec_eval", "member_kind"])
    own = own.join(links, ["member_kind", "c_train", "c_eval"]).select("kind", "rec_eval", F.lit(-1).cast("long").alias("n"), (-F.col("eval_fraction")).alias("f"))
    summed = by_record.unionByName(own).groupBy("kind", "rec_eval").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).where("n > 0")
    where = records.where("rec_key is not null").groupBy("rec_key").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return (
        summed.join(where.withColumnRenamed("rec_key", "rec_eval"), "rec_eval")
        .groupBy("split", "source", "kind")
        .agg(F.sum("n").alias("pairs"), F.count("*").alias("records"), F.round(F.sum("f") / F.sum("n"), 6).alias("mean_fraction"))
    )
