"""Evaluation texts leaking into training text, found with an FM-index per shard of the corpus.

Each shard (a few MB of whole texts) is read as words in numpy. Words are runs of letters and digits of any
script, in lower case and without accents (composed, decomposed, dropped or written as entities); signs of
scripts without blanks are words of their own. The FM-index is built over the words that occur in test items;
any other word ends a run, so suffixes are compared within runs only. Its Burrows-Wheeler transform is held
in a wavelet matrix with rank counts. All phrases of ``SEED`` running words of all items are searched
backwards together; occurrences are located by walking to sampled suffix positions. An occurrence fixes an
alignment of item and text, along which every word is compared; windows of ``WINDOW`` words with at most
``CHANGES`` changed words make the leaked span, and overlapping spans are merged.

A passage of ``WINDOW`` words with ``CHANGES`` changes always keeps a run of ``SEED`` words, so the
seeds lose no such passage. Quotes shorter than the window, and the same words in another order, are
no leaks. Case, punctuation, layout and entities do not count.

The items are the small side and are broadcast once per pass; more than ``PASS_BYTES`` of them are searched
in several passes over the corpus, so their number has no bound.

Defined results: NULL and empty texts hold nothing; items shorter than the window cannot leak; very
long texts are searched whole; repeated rows of a document give its rows once (``p8_found`` is
distinct); empty tables give an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 6
WINDOW = 25
CHANGES = 3
SHARD_BYTES = 8 << 20
SAMPLE = 8
PASS_BYTES = 64 << 20  # items searched in one pass
CELLS = 1 << 22  # words compared at a time

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_APART, _LETTER, _MARK, _SIGN = range(4)  # between words, in words, of no account, a word of its own
_ENTITY = re.compile(rb"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_KNOWN: dict[int, tuple[int, int]] = {}
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _unblanked(cp: int) -> bool:
    """Signs of scripts that put no blanks between words."""
    return 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or 0x20000 <= cp < 0x32000 or 0x0E00 <= cp < 0x0E80


def character(cp: int) -> tuple[int, int]:
    """(class, value) of a character: the value is its lower-case base letter."""
    got = _KNOWN.get(cp)
    if got is None:
        c = chr(cp)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFKD", c.lower())[:1] or c
        got = (_MARK, 0) if kind in ("Mn", "Me", "Cf") else (_SIGN, cp) if _unblanked(cp) else (_LETTER, ord(base)) if kind[0] == "L" or kind == "Nd" else (_APART, 0)
        _KNOWN[cp] = got
    return got


def _code_points(buf: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 sequences that begin at ``lead``."""
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    x, y, z, w = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
    return np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of UTF-8 bytes, in bytes; a hash takes in the whole word."""
    value, letter = _LOWER[buf], _ALNUM[buf]
    skip, sign = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        skip = (buf & 0xC0) == 0x80
        seen, at = np.unique(_code_points(buf, lead), return_inverse=True)
        told = np.array([character(int(c)) for c in seen], dtype=np.int64)
        kind = told[at, 0]
        letter[lead], skip[lead], sign[lead] = (kind == _LETTER) | (kind == _SIGN), kind == _MARK, kind == _SIGN
        value[lead] = told[at, 1]
    if (buf == 38).any():
        for m in _ENTITY.finditer(buf.tobytes()):
            s, e = m.span()
            plain = html.unescape(m[0].decode())
            if len(plain) > 2:  # no entity
                continue
            kind, v = character(ord(plain[0]))
            letter[s:e], skip[s + 1 : e] = False, True
            letter[s], value[s], skip[s], sign[s] = kind in (_LETTER, _SIGN), v, kind == _MARK, kind == _SIGN
    pos = np.flatnonzero(~skip)
    inside, own = letter[pos], sign[pos]
    none = np.zeros(0, np.int64)
    if not inside.any():
        return none, none, np.zeros(0, np.uint64)
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    cut = own | np.append(False, own[:-1])  # a sign begins a word and so does what follows it
    first = inside & (~before | cut)
    last = inside & (~after | np.append(cut[1:], False))
    starts = pos[first]
    ends = np.append(pos, len(buf))[np.flatnonzero(last) + 1]
    at = np.flatnonzero(first[inside])
    size = np.diff(np.append(at, int(inside.sum()))).astype(np.uint64)
    place = np.arange(int(inside.sum())) - np.repeat(at, size.astype(np.int64))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(size.max()), _K1, np.uint64))
        v = (value[pos][inside].astype(np.uint64) + np.uint64(1)) * _K2
        v = (v ^ (v >> np.uint64(29))) * powers[place]
        h = np.add.reduceat(v, at) ^ size * _K3
        h = (h ^ (h >> np.uint64(32))) * _K1
    return starts, ends, h


class Items:
    """The test items as words one after another, their vocabulary and all their phrases of SEED words."""

    def __init__(self, items: list[tuple[int, str]]):
        items = sorted((i, t) for i, t in items if i is not None and t)
        hashes = [words_of(np.frombuffer(t.encode(), np.uint8))[2] for _, t in items]
        keep = [k for k, h in enumerate(hashes) if len(h) >= WINDOW]
        self.ids = np.array([items[k][0] for k in keep], dtype=np.int64)
        hashes = [hashes[k] for k in keep]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.words = self.symbols(np.concatenate(hashes)) if hashes else np.zeros(0, np.int32)
        item = np.repeat(np.arange(len(self.size)), self.size)
        offset = np.arange(len(self.words)) - self.start[item]
        whole = np.flatnonzero(offset <= self.size[item] - SEED)  # places where a phrase begins
        grams = self.words[whole[:, None] + np.arange(SEED)] if len(whole) else np.zeros((0, SEED), np.int32)
        self.phrases, back = np.unique(grams, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        self.where = np.stack([item[whole], offset[whole]], axis=1)[order]
        self.first = np.searchsorted(back.ravel()[order], np.arange(len(self.phrases) + 1))

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """1.. for words of the vocabulary, 0 for any other."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)


def suffix_array(sym: np.ndarray, bits: int) -> np.ndarray:
    """Order of suffixes, each compared up to its next 0, ties by position (packed words, then doubling)."""
    n = len(sym)
    pack = max(1, 62 // bits)
    padded = np.concatenate([sym, np.zeros(pack, sym.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for t in range(pack):
        s = padded[t : t + n] * alive
        key = (key << bits) | s
        alive &= s > 0
    sa = np.argsort(key, kind="stable")
    ks = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = ks[1:] != ks[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: first row of the group
    step = pack
    last = (ks & ((1 << bits) - 1)) > 0  # the key did not reach a 0
    open_rows = np.flatnonzero(last & ~(new & np.append(new[1:], True)))
    while len(open_rows):
        pos = sa[open_rows]
        nxt = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        sub = np.lexsort((pos, nxt, rank[pos]))
        pos, nxt = pos[sub], nxt[sub]
        old = rank[pos]
        sa[open_rows] = pos
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_rows, 0))
        stop = sym[np.minimum(pos + step, n - 1)] == 0  # what follows is an end: settled by position
        single = fresh & np.append(fresh[1:], True)
        open_rows = open_rows[~(stop | single)]
        step *= 2
    return sa


class FMIndex:
    """Backward search and location over words 1..; 0 ends a run."""

    def __init__(self, sym: np.ndarray, sigma: int):
        self.n = len(sym)
        self.bits = max(1, int(sigma).bit_length())
        sa = suffix_array(sym, self.bits)
        bwt = np.where(sa > 0, sym[sa - 1], 0)
        counts = np.bincount(sym, minlength=sigma + 2)
        self.starts = np.concatenate([[0], np.cumsum(counts)])  # rows before those that begin with c
        self.ranks: list[np.ndarray] = []  # per level: number of ones before each row
        self.zeros: list[int] = []
        cur = bwt
        for lv in range(self.bits - 1, -1, -1):
            bit = (cur >> lv) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ranks[-1][-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.leaf = self._leaves(sigma)
        # sampled suffixes: every SAMPLE-th position and every start of a run
        prev = np.where(sa > 0, sym[sa - 1], 0)
        sampled = (sa % SAMPLE == 0) | (prev == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]
        self.sampled = sampled
        self.bwt = bwt

    def _leaves(self, sigma: int) -> np.ndarray:
        """Where each symbol's block begins after the last level."""
        c = np.arange(sigma + 2)
        at = np.zeros(len(c), np.int64)
        for lv, ones, z in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            bit = (c >> lv) & 1
            at = np.where(bit == 1, z + ones[at], at - ones[at])
        return at

    def rank(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of c in the transform before each row, through the wavelet matrix."""
        at = row
        for lv, ones, z in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            o = ones[at]
            at = np.where((c >> lv) & 1 == 1, z + o, at - o)
        return at - self.leaf[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur, by backward search over all at once."""
        c = phrases[:, -1].astype(np.int64)
        who = np.arange(len(phrases))
        lo, hi = self.starts[c], self.starts[c + 1]
        for t in range(phrases.shape[1] - 2, -1, -1):
            keep = lo < hi
            who, lo, hi = who[keep], lo[keep], hi[keep]
            c = phrases[who, t].astype(np.int64)
            lo, hi = self.starts[c] + self.rank(c, lo), self.starts[c] + self.rank(c, hi)
        keep = lo < hi
        return who[keep], lo[keep], hi[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        out = np.full(len(rows), -1, np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.samples[self.sample_rank[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            c = self.bwt[row].astype(np.int64)
            row = self.starts[c] + self.rank(c, row)
            steps += 1
        return out


def leaks_in(buf: np.ndarray, ends: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, matched words, start byte, end byte) of the texts that end at ``ends``."""
    w_start, w_end, h = words_of(buf)
    if len(h) < WINDOW or not len(items.ids):
        return []
    sym = items.symbols(h)
    doc = np.searchsorted(ends, w_start, side="right")
    first = np.searchsorted(doc, np.arange(len(ends) + 1))
    # index text: words of the vocabulary, one 0 for each run of others and each border of texts
    inside = sym > 0
    border = np.append(doc[1:] != doc[:-1], True)
    at = np.flatnonzero(inside)
    if len(at) < SEED:
        return []
    gap = np.append((np.diff(at) > 1) | border[at[:-1]], True)
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(gap)[:-1]]) + 1
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = sym[at]
    back = np.zeros(len(text), np.int64)
    back[place] = at
    index = FMIndex(text, len(items.vocabulary))
    who, lo, hi = index.search(items.phrases)
    if not len(who):
        return []
    n = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    pos = back[index.locate(rows)]
    phrase = np.repeat(who, n)
    # every item position of the phrase
    m = items.first[phrase + 1] - items.first[phrase]
    at_where = np.repeat(items.first[phrase] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
    item, offset = items.where[at_where].T
    pos = np.repeat(pos, m)
    # alignments: text, item, and where the item's first word would stand
    align = np.unique(np.stack([doc[pos], item, pos - offset], axis=1), axis=0)
    out: list[tuple[int, int, int, int, int]] = []
    # the words of an item that can stand in the text, and a margin for words put in or left out
    low = np.maximum(0, first[align[:, 0]] - align[:, 2] - CHANGES)
    high = np.minimum(items.size[align[:, 1]], first[align[:, 0] + 1] - align[:, 2] + CHANGES)
    upto = np.cumsum(high - low)
    a = 0
    while a < len(align):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, side="right")))
        while b < len(align) and (align[b, :2] == align[b - 1, :2]).all():
            b += 1  # alignments of one text and item stay together
        out += _aligned(align[a:b], low[a:b], high[a:b], items, sym, first, w_start, w_end)
        a = b
    return out


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of rows of n cells each, laid one after another."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _aligned(part: np.ndarray, low: np.ndarray, high: np.ndarray, items: Items, sym: np.ndarray, first: np.ndarray, w_start: np.ndarray, w_end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The leaked spans of some alignments (text, item, place of the item's first word)."""
    n = high - low
    begin = np.cumsum(n) - n
    row, place = _spread(n)
    k = low[row] + place  # word of the item
    where = part[row, 2] + k
    there = (where >= first[part[row, 0]]) & (where < first[part[row, 0] + 1])
    same = there & (items.words[items.start[part[row, 1]] + k] == sym[np.clip(where, 0, len(sym) - 1)])
    # a word put in or left out moves the alignment by one: neighbours of one text and item count together
    for step in (1, 2):
        near = np.flatnonzero((part[step:, :2] == part[:-step, :2]).all(axis=1) & (part[step:, 2] - part[:-step, 2] <= 3))
        if len(near):
            lo, hi = np.maximum(low[near], low[near + step]), np.minimum(high[near], high[near + step])
            r, p = _spread(np.maximum(hi - lo, 0))
            x = begin[near[r]] + lo[r] - low[near[r]] + p
            y = begin[near[r] + step] + lo[r] - low[near[r] + step] + p
            both = same[x] | same[y]
            same[x] |= both
            same[y] |= both
    total = np.concatenate([[0], np.cumsum(same)])
    end = (begin + n)[row]
    at = np.arange(len(row))
    fits = at + WINDOW <= end
    window = np.where(fits, total[np.minimum(at + WINDOW, len(row))] - total[at], 0)
    good = np.flatnonzero(window >= WINDOW - CHANGES)
    out = []
    if not len(good):
        return out
    rows, start = np.unique(row[good], return_index=True)
    for r, s, e in zip(rows.tolist(), start.tolist(), [*start[1:].tolist(), len(good)], strict=True):
        g = good[s:e]
        hit = np.flatnonzero(same[g[0] : g[-1] + WINDOW]) + g[0]  # the span begins and ends with words of the item
        w = np.clip(where[hit[[0, -1]]], first[part[r, 0]], first[part[r, 0] + 1] - 1)
        out.append((int(part[r, 0]), int(items.ids[part[r, 1]]), int(window[g].max()), int(w_start[w[0]]), int(w_end[w[1]])))
    return out


def _merged(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Overlapping spans of one text and item as one."""
    out: list[tuple[int, int, int, int, int]] = []
    for d, i, n, s, e in sorted(found, key=lambda x: (x[0], x[1], x[3])):
        if out and out[-1][:2] == (d, i) and s <= out[-1][4]:
            _, _, n0, s0, e0 = out[-1]
            out[-1] = (d, i, max(n, n0), s0, max(e, e0))
        else:
            out.append((d, i, n, s, e))
    return out


LEAKS = "doc_id bigint, item_id bigint, matched_words int, span_start int, span_end int"


def leaked_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """One row per leaked span of a document: item and character positions to remove.

    The corpus stays where it is; items beyond ``PASS_BYTES`` are dealt to several passes.
    """
    told = eval_items.where("item_id is not null and text is not null").select("item_id", "text")
    size = told.selectExpr("coalesce(sum(octet_length(text)), 0) as n").first()["n"]
    passes = -(-size // PASS_BYTES) or 1
    out = None
    for k in range(passes):
        given = told if passes == 1 else told.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        got = _one_pass(documents, Items([(r["item_id"], r["text"]) for r in given.distinct().collect()]))
        out = got if out is None else out.unionByName(got)
    return out


def _one_pass(documents: DataFrame, items: Items) -> DataFrame:
    """The leaked spans of the items of one pass, which is of bounded size and broadcast once."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            text = b.column(1).cast(pa.large_string())
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            rows: list[tuple] = []
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SHARD_BYTES, side="right")) - 1)
                base = bounds[at]
                buf = data[base : bounds[to]]
                for d, i, n, s, e in _merged(leaks_in(buf, bounds[at + 1 : to + 1] - base, items)):
                    start = int(bounds[at + d] - base)
                    chars = lambda x, y: int(np.count_nonzero((buf[x:y] & 0xC0) != 0x80))  # noqa: B023, E731
                    head = chars(start, s)
                    rows.append((int(ids[at + d]), i, n, head, head + chars(s, e)))
                at = to
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "matched_words", "span_start", "span_end"])

    return documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text").mapInArrow(run, LEAKS)
