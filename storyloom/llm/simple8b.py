"""Simple-8b: whole numbers packed into 64-bit words, each with a selector of 4 bits and 60 bits of values.

A selector says how many values a word has and how wide they are. Numbers are coded in blocks of BLOCK, so
that any block can be decoded by itself; the words of each block, and its escapes, are found by offsets. A
number of more than 60 bits is an escape: its word has the escape selector, and the number itself stands in the
block's list of escapes, so words stay aligned and decoding needs no loop over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024
#: Values in a word and bits of each, by selector. Selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
_LIMITS = (1 << BITS[1:].astype(np.uint64)).astype(np.uint64)  # the first number that a selector can't hold


@dataclass
class Coded:
    """Words and escapes of some blocks; offsets have one entry more than there are blocks."""

    n: int
    words: np.ndarray
    escapes: np.ndarray
    word_offsets: np.ndarray
    escape_offsets: np.ndarray


def encode(values: np.ndarray) -> Coded:
    """Values of 64 bits without sign. All blocks are coded at once, a word of each at a time."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    wide = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.uint64)  # a block's last word may reach beyond it
    for at in range(blocks):
        part = values[at * BLOCK : (at + 1) * BLOCK]
        wide[at, : len(part)] = part
    least = np.searchsorted(_LIMITS, wide[:, :BLOCK].ravel(), "right").reshape(blocks, BLOCK) + 1  # the narrowest selector; 16: none
    best = np.full((blocks, BLOCK), ESCAPE, np.int8)
    place = np.arange(BLOCK)
    for selector in range(len(COUNTS) - 1, 0, -1):  # each next one takes more values
        held = np.where(least > selector, place, 2 * BLOCK)
        until = np.minimum.accumulate(held[:, ::-1], 1)[:, ::-1]  # the first number from here on that doesn't fit
        best[until - place >= COUNTS[selector]] = selector
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    row_parts, place_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live):
        row_parts.append(live)
        place_parts.append(at[live])
        at[live] += COUNTS[best[live, at[live]]]
        live = live[at[live] < ends[live]]
    rows, places = np.concatenate(row_parts), np.concatenate(place_parts)
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    selectors = best[rows, places].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        if selector != ESCAPE and BITS[selector]:
            own = np.flatnonzero(selectors == selector)
            held = wide[rows[own, None], places[own, None] + np.arange(COUNTS[selector])]
            words[own] |= np.bitwise_or.reduce(held << (np.arange(COUNTS[selector]) * BITS[selector]).astype(np.uint64), 1)
    escaped = selectors == ESCAPE
    until = np.arange(blocks + 1)
    return Coded(n, words, wide[rows[escaped], places[escaped]], np.searchsorted(rows, until), np.searchsorted(rows[escaped], until))


def decode(coded: Coded) -> np.ndarray:
    """The values again; all words of one selector are unpacked together."""
    out = np.zeros(coded.n, np.uint64)
    offsets = coded.word_offsets - coded.word_offsets[0]
    selectors = (coded.words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.cumsum(counts) - counts
    start = block * BLOCK + before - before[offsets[block]]
    end = np.minimum((block + 1) * BLOCK, coded.n)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[start[own]] = coded.escapes
        elif BITS[selector]:
            step = np.arange(COUNTS[selector])
            held = (coded.words[own, None] >> (step * BITS[selector]).astype(np.uint64)) & np.uint64((1 << int(BITS[selector])) - 1)
            places = start[own, None] + step
            inside = places < end[own, None]
            out[places[inside]] = held[inside]
    return out
