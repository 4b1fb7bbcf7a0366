"""One form for texts that look the same.

A table maps every code point to the code points of its plain shape: compatibility forms that only differ in width,
joining or code (full width, ligatures, ideograph variants) are expanded, accents are separated, letters of other
scripts with the same shape become one letter, every single blank becomes U+0020, and invisible characters vanish.
A batch is one array of code points: gathers look up the expansions, offsets place them, marks are put in canonical
order and composed with their base by a sorted table of pairs. No call is made per string.

Superscripts, fractions, circled and squared forms look different from their plain letters and stay, as do case,
missing accents and visible characters.

Cases: null stays null, empty stays empty; text of invisible characters becomes empty; texts may have any length.
"""

from __future__ import annotations

import functools
import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the letter of the same shape that stands for them.
SAME_SHAPE = {
    "Latin": (
        "АВЕЅІЈКМНОРСТУХԚԜҮѴӀ" "аеоросѕіјухһԁԛԝӏѵӕә" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "ονρϲϳ" "ՕՍՏոսցօհզ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏞᏟᏢᏦ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "‐",
        "ABESIJKMHOPCTYXQWYVI" "aeopocsijyxhdqwlvæə" "ABEZHIKMNOPTYXCJ" "ovpcj" "OUSnugohq" "DRTAJEWMHYGZWVSLCPK" "BPDTGKJCZFMNLSRVHWXYAEIOU" "-",
    ),
    "Cyrillic": ("ΓΠΦ", "ГПФ"),
}
# Tags of compatibility forms that look like what they stand for.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Formatting characters that are drawn, and invisible characters of other categories.
DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
KEPT_CONTROLS = {9, 10, 11, 12, 13, 0x85}
LONG_S = {0x17F, 0x1E9B}
LIMIT = 0x110000


def _plain(cp: int) -> tuple[int, ...]:
    """The code points that a code point is drawn as, accents apart."""
    ch = chr(cp)
    cat = ud.category(ch)
    if cat == "Zs":
        return (0x20,)
    if cat == "Cf" and cp not in DRAWN or cp in UNSEEN or cat == "Cc" and cp not in KEPT_CONTROLS:
        return ()
    parts = ud.decomposition(ch).split()
    if not parts or cp in LONG_S:
        return (cp,)
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK or (len(parts) > 2 and parts[1] == "0020"):
            return (cp,)
        parts = parts[1:]
    return tuple(y for x in parts for y in _plain(int(x, 16)))


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup arrays: start and length of each expansion, its code points, combining classes, sorted pairs."""
    same = {ord(a): ord(b) for one, other in SAME_SHAPE.values() for a, b in zip(one, other, strict=True)}
    spans = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]
    length = np.ones(LIMIT, dtype=np.int64)
    start = np.arange(LIMIT, dtype=np.int64)
    flat = list(range(LIMIT))
    for cp in spans:
        out = tuple(same.get(x, x) for x in _plain(cp))
        if out != (cp,):
            start[cp], length[cp] = len(flat), len(out)
            flat.extend(out)
    syllable = np.arange(11172)  # Hangul syllables are arithmetic: lead, vowel and an optional tail
    lead, vowel, tail = 0x1100 + syllable // 588, 0x1161 + syllable % 588 // 28, 0x11A7 + syllable % 28
    start[0xAC00 : 0xAC00 + 11172] = len(flat) + 3 * syllable
    length[0xAC00 : 0xAC00 + 11172] = 2 + (syllable % 28 > 0)
    flat = np.concatenate([np.array(flat, dtype=np.uint32), np.stack([lead, vowel, tail], 1).ravel().astype(np.uint32)])
    ccc = np.zeros(LIMIT, dtype=np.uint8)
    pairs = {}
    for cp in spans:
        if k := ud.combining(chr(cp)):
            ccc[cp] = k
        d = ud.decomposition(chr(cp)).split()
        if len(d) == 2 and d[0][0] != "<" and ud.normalize("NFC", chr(cp)) == chr(cp):
            a, b = (same.get(int(x, 16), int(x, 16)) for x in d)
            if (a, b) == tuple(int(x, 16) for x in d) or (a, b) not in pairs:
                pairs[a, b] = cp
    lv = np.arange(399)
    lead_vowel = {(0x1100 + i // 21, 0x1161 + i % 21): 0xAC00 + i * 28 for i in lv.tolist()}
    with_tail = {(0xAC00 + i * 28, 0x11A7 + t): 0xAC00 + i * 28 + t for i in lv.tolist() for t in range(1, 28)}
    pairs = {**pairs, **lead_vowel, **with_tail}
    # a pair whose result has a plainer shape itself must lead there, so that composing is stable
    key = np.array([a << 21 | b for a, b in pairs], dtype=np.int64)
    value = np.array([same.get(v, v) for v in pairs.values()], dtype=np.uint32)
    order = np.argsort(key)
    return {"start": start, "length": length, "flat": flat, "ccc": ccc, "key": key[order], "value": value[order]}


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets counted in code points."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    lead = data[at]
    size = 1 + (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    cps = lead.astype(np.uint32)
    for k, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        rows = np.flatnonzero(size == k)
        if len(rows):
            c = lead[rows].astype(np.uint32) & keep
            for j in range(1, k):
                c = c << 6 | (data[at[rows] + j] & 0x3F)
            cps[rows] = c
    return cps, np.searchsorted(at, offsets)


def encode(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and the offsets counted in bytes."""
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], dtype=np.uint8)
    for k, head in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        rows = np.flatnonzero(size == k)
        for j in range(k):
            part = cps[rows] >> (6 * (k - 1 - j))
            out[ends[rows] + j] = (part | head) if j == 0 else (part & 0x3F | 0x80)
    return out, ends[offsets]


def fold_points(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts, laid end to end, in the one form; and their new offsets."""
    t = tables()
    n = t["length"][cps]
    ends = np.concatenate([[0], np.cumsum(n)])
    src = np.repeat(t["start"][cps] - ends[:-1], n) + np.arange(ends[-1])
    out, offsets = t["flat"][src], ends[offsets]
    mark = t["ccc"][out]
    if mark.any():  # canonical order: stable sort by class inside each run of marks
        base = mark == 0
        base[offsets[:-1][offsets[:-1] < len(out)]] = True
        run = np.cumsum(base)
        busy = np.flatnonzero(mark > 0)
        nearby = np.flatnonzero(np.isin(run, run[busy[1:][run[busy[1:]] == run[busy[:-1]]]]) & (mark > 0))
        if len(nearby):
            order = np.lexsort((mark[nearby], run[nearby]))
            out[nearby] = out[nearby[order]]
    return _compose(out, offsets, t)


def _compose(out: np.ndarray, offsets: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Join neighbours that form one character, pass by pass until none do."""
    while len(out) > 1:
        first = np.zeros(len(out) + 1, dtype=bool)
        first[offsets] = True
        mark = t["ccc"][out]
        maybe = np.flatnonzero(((mark[1:] > 0) | ((out[1:] >= 0x1161) & (out[1:] <= 0x11C2)) | (out[1:] >= 0x9BE) & (out[1:] <= 0x1B35) | (out[1:] >= 0x3099) & (out[1:] <= 0x309A) | (out[1:] > 0x11000)) & ~first[1:-1])
        # a mark reaches over marks of lower class to its base: look at the nearest base before it
        hit_at, hit_base = maybe + 1, maybe
        if len(hit_at) == 0:
            break
        starts = np.flatnonzero((mark == 0) | first[:-1])
        near = starts[np.searchsorted(starts, hit_at, side="left") - 1]
        blocked = (near != hit_base) & ((mark[hit_base] >= mark[hit_at]) | (mark[hit_at] == 0))
        hit_at, hit_base = hit_at[~blocked], near[~blocked]
        key = out[hit_base].astype(np.int64) << 21 | out[hit_at]
        where = np.minimum(np.searchsorted(t["key"], key), len(t["key"]) - 1)
        good = t["key"][where] == key
        hit_at, hit_base, value = hit_at[good], hit_base[good], t["value"][where[good]]
        if len(hit_at) == 0:
            break
        lone = np.concatenate([[True], hit_base[1:] != hit_base[:-1]])  # one mark a base and pass
        at, base = hit_at[lone], hit_base[lone]
        out[base] = value[lone]
        keep = np.ones(len(out), dtype=bool)
        keep[at] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        out = out[keep]
    return out, offsets


def fold_array(texts: pa.Array) -> pa.Array:
    """An Arrow string array in the one form."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return texts.cast(pa.string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    cps, offsets = decode(raw, offsets - offsets[0])
    out, ends = encode(*fold_points(cps, offsets))
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
    if texts.null_count:
        folded = pa.compute.if_else(texts.is_valid(), folded, None)
    return folded.cast(pa.string())


def with_form(df: DataFrame, column: str, form: str = "form") -> DataFrame:
    """The frame with one more column: the text's one form."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                part = b.slice(k, 20_000)
                yield pa.RecordBatch.from_arrays([*part.columns, fold_array(part.column(column))], names=[*part.schema.names, form])

    schema = df.schema.jsonValue()
    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*StructType.fromJson(schema).fields, StructField(form, StringType())]))


def record_texts(records: DataFrame) -> DataFrame:
    """``rec_key``, ``qname``, ``opt_pos`` (-1: the instruction), ``field``, ``text`` of every question text."""
    q = records.where(F.col("rec_key").isNotNull()).select("rec_key", F.explode("questions").alias("q"))
    instruction = F.struct(F.lit(-1).alias("opt_pos"), F.lit("instructions").alias("field"), F.col("q.instructions").alias("text"))
    options = F.transform(
        F.coalesce(F.col("q.criteria"), F.array()),
        lambda c: F.struct(c["pos"].alias("opt_pos"), F.lit("criteria").alias("field"), c["desc"].alias("text")),
    )
    return q.select("rec_key", F.col("q.name").alias("qname"), F.explode(F.concat(F.array(instruction), options)).alias("t")).select(
        "rec_key", "qname", "t.opt_pos", "t.field", "t.text"
    ).where("text is not null")


def alike(records: DataFrame, wordings: DataFrame) -> DataFrame:
    """Question texts that look like a wording of their field and are written differently.

    Wordings join by their form; the join's side is chosen by Spark from measured sizes. Repeated loads of a record
    give the same rows, made one after the join, where few rows are left.
    """
    plain = with_form(wordings.select("wording_id", "field", F.col("text").alias("wording")).where("wording is not null"), "wording")
    return (
        with_form(record_texts(records), "text")
        .join(plain, ["field", "form"])
        .where("text <> wording")
        .select("rec_key", "qname", "opt_pos", "wording_id")
        .distinct()
    )
