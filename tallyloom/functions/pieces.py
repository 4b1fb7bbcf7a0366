"""Distinct 3-character pieces of texts as numbers, for whole columns at once."""

from __future__ import annotations

import numpy as np


def _pieces(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 63-bit code of each piece in order of place; a text of one or two characters is one piece."""
    size = np.array([len(x) for x in strings], dtype=np.int64)
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters from here to the end of the text
    code = points.copy()
    for k in (1, 2):
        code <<= np.uint64(21)
        more = np.flatnonzero(left > k)
        code[more] += points[more + k]
    starts = np.cumsum(size) - size
    keep = left > 2
    keep[starts[size > 0]] = True
    return text[keep], code[keep]


def piece_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of each distinct piece, by text and code."""
    text, code = _pieces(strings)
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    return text[new], code[new]


def piece_hashes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 44-bit hash of each distinct piece, by text and hash; for less than a million texts at once."""
    text, code = _pieces(strings)
    both = np.sort(text.astype(np.uint64) << np.uint64(44) | mixed(code) >> np.uint64(20))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1)


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Pieces in both out of pieces in either, pair by pair; 0 for two texts without a piece."""
    text, code = (np.concatenate(x) for x in zip(piece_codes(left), piece_codes(right), strict=True))
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    again = (text[1:] == text[:-1]) & (code[1:] == code[:-1])
    both = np.bincount(text[1:][again], minlength=len(left))
    return both / np.maximum(np.bincount(text, minlength=len(left)) - both, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_digests(text: np.ndarray, h: np.ndarray, texts: int, bands: int, rows: int) -> np.ndarray:
    """Digest of each band of ``rows`` minima, from ``piece_hashes``; texts without a piece must be left out before.

    The upper part of a hash gives its bin and the hash its value, so the order by hash has the minimum of each bin
    first. An empty bin takes the next filled one around the end; two texts agree in a bin with the probability of their
    similarity.
    """
    bins = bands * rows
    at = text * bins + (h * np.uint64(bins) >> np.uint64(44)).astype(np.int64)
    head = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
    least = np.zeros(texts * bins, dtype=np.uint64)
    filled = np.zeros(texts * bins, dtype=bool)
    least[at[head]], filled[at[head]] = h[head], True
    twice = np.tile(filled.reshape(texts, bins), 2)
    place = np.where(twice, np.arange(2 * bins), 2 * bins)
    after = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
    values = np.take_along_axis(least.reshape(texts, bins), after % bins, axis=1) + (after - np.arange(bins)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((texts, bands), dtype=np.uint64)
    for k in range(rows):
        out = mixed(out ^ values[:, k::rows] + np.uint64(k + 1))
    return mixed(out + np.arange(bands, dtype=np.uint64))


def sketches(text: np.ndarray, h: np.ndarray, texts: int, words: int) -> np.ndarray:
    """``words`` words of 64 bits a text, one bit for each hash of its pieces."""
    bits = np.zeros(texts * words * 64, dtype=np.uint8)
    bits[text * (words * 64) + (h % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).reshape(texts, words)
