"""Garbled text from wrong character encoding, found and restored.

All garbled sequences are computed beforehand: every character that correct text is expected to hold
is encoded with each true encoding and decoded with each wrong one, once or twice. One multi-pattern
automaton finds them in a text; only matched spans are replaced, so correct text beside them stays as
it is. Sequences of several characters are evidence by themselves. A single character that may also
be correct (``Ú`` for é, ``û`` for a dash) counts only where it cannot stand and its original can:
inside lower case, after a digit, alone between blanks, and so on. Of several originals that fit, the
one whose pair of encodings explains most of the text's single characters is taken. Replacement
characters and control characters of the C1 block are damage in any case, and so are characters that no
correct text holds at their place (a letter of another script after a Latin one, a frame or sign between
two letters); what cannot be told back is counted as lost.

Defined results: NULL and empty texts are no cases; correct accents, decomposed or dropped accents and
escaped entities are none; very long texts are read whole; repeated rows give repeated rows
(``p9_found`` is distinct); empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Characters of correct text in the corpus' languages, beside ASCII.
LATIN = "".join(chr(c) for c in range(0xA0, 0x100) if c != 0xAD)
PUNCTUATION = "–—‘’‚“”„•…‰‹›€™œŒŠšŽžŸ−≤≥≈→Ω"
COMBINING = "̧̀́̂̃̈"
# Letters of other alphabets: Latin beyond Latin-1, Greek and Cyrillic.
OTHER = "".join(c for a, b in ((0x100, 0x180), (0x386, 0x3CF), (0x400, 0x460), (0x490, 0x492)) for c in map(chr, range(a, b)) if c.isalpha())
HELD = set(LATIN + PUNCTUATION + COMBINING) | {chr(c) for c in range(0x80)}  # what the sequences below cover whole
LONG_RUN = 4  # characters beyond ASCII in a row that are not replaced one by one
# Letters and signs that single-byte damage is looked for in.
SINGLE = "àâäçéèêëîïôöùûüœñáíóúãõßÀÂÇÉÈÊËÎÏÔÙÛÜŒÑÁÍÓÚÃÕÄÖ¿¡«»°–—’‘“”•…×³²½¼¾±Øµ·§®™"
LEGIT = set("àâäæçéèêëîïôöùûüÿœñáíóúãõßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒÑÁÍÓÚÃÕØ¿¡«»°–—’‘“”„‚…•·×÷³²¹½¼¾±µ§®™€£¢ªº´\u00a0̧̀́̂̃̈")
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp866", "koi8-r", "cp1254", "cp1253", "cp1257")
TWICE = ("cp1252", "latin-1")
# Fixed values: (true, wrong) pairs of single-byte damage that have the first say; all others of WRONG follow.
FIRST = tuple((t, w) for t in ("cp1252", "latin-1") for w in ("cp437", "cp850", "mac_roman", "latin-1"))
TRUE = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman")
PAIRS = (*FIRST, *((t, w) for t in dict.fromkeys((*TRUE, *WRONG)) for w in WRONG if t != w and (t, w) not in FIRST))
LOST = "�"


def _decode(raw: bytes, encoding: str) -> str | None:
    """Bytes as the wrong encoding shows them; bytes it does not define stay as C1 characters."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if not encoding.startswith("cp125"):
            return None
        return "".join(_byte(b, encoding) for b in raw)


def _byte(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@cache
def single_originals() -> dict[str, dict[str, frozenset[int]]]:
    """Wrong character -> its originals, likeliest first -> the pairs of encodings that make it of them."""
    seen: dict[tuple[str, str], set[int]] = {}

    def add(c: str, at: int) -> None:
        true, wrong = PAIRS[at]
        try:
            g = _decode(c.encode(true), wrong)
        except UnicodeEncodeError:
            return
        if g and g != c and len(g) == 1 and ord(g) > 0x7F:
            seen.setdefault((g, c), set()).add(at)

    for c in SINGLE:
        for at in range(len(FIRST)):
            add(c, at)
    for at in range(len(FIRST), len(PAIRS)):
        for c in SINGLE:
            add(c, at)
    out: dict[str, dict[str, frozenset[int]]] = {}
    for (g, c), pairs in seen.items():
        out.setdefault(g, {})[c] = frozenset(pairs)
    return out


@cache
def patterns() -> dict[str, tuple[str, bool]]:
    """Garbled sequence -> (original, needs context); the originals of a single character stand in a row."""
    table: dict[str, tuple[str, bool]] = {g: ("".join(cs), True) for g, cs in single_originals().items()}
    held = LATIN + PUNCTUATION + COMBINING
    for w in WRONG:  # UTF-8 read with a single-byte encoding; the commoner encoding has the first say
        for c in held:
            g = _decode(c.encode(), w)
            if g and len(g) > 1:
                table.setdefault(g, (c, False))
    for w1 in dict.fromkeys((*TWICE, *WRONG)):  # and once more
        once = [(c, g.encode()) for c in held if (g := _decode(c.encode(), w1))]
        for w2 in dict.fromkeys((*TWICE, *WRONG)):
            for c, raw in once:
                g = _decode(raw, w2)
                if g and len(g) > 2:
                    table.setdefault(g, (c, False))
    for w in WRONG:
        for c in OTHER:  # letters of one other alphabet may be a word of its own
            g = _decode(c.encode(), w)
            if g and len(g) > 1 and not (g.isalpha() and not any(map(_latin, g))):
                table.setdefault(g, (c, False))
                for w2 in TWICE if w in TWICE else ():
                    twice = _decode(g.encode(), w2)
                    if twice and len(twice) > 2:
                        table.setdefault(twice, (c, False))
    for lead, c in (("Ã ", "à"), ("Â ", " ")):  # the second byte, a no-break space, became a blank
        table.setdefault(lead, (c, True))
    for b in range(0x80, 0xA0):
        c = _byte(b, "cp1252")
        table[chr(b)] = ("".join(dict.fromkeys(("" if c == chr(b) else c) + table.get(chr(b), ("",))[0])), True)
    for w in WRONG:  # what any encoding shows of a byte and nothing above explains
        for b in range(0x80, 0x100):
            table.setdefault(_byte(b, w), ("", True))
    table[LOST] = ("", True)
    return table


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, (c, ctx) in patterns().items():
        assert _BEYOND.fullmatch(g), g
        a.add_word(g, (len(g), g, c, ctx))
    a.make_automaton()
    return a


def _kind(ch: str) -> str:
    """S blank or border, L lower letter, U upper letter, D digit, P other, ? a sign no correct text holds."""
    if ch == "" or ch.isspace():
        return "S"
    if ord(ch) > 0x7F and ch not in LEGIT:
        return "?"
    if ch.isdigit() and ord(ch) < 0x80:
        return "D"
    if ch.isalpha() and ch not in "ªºµØ":
        return "U" if ch.isupper() else "L"
    return "P"


def _latin(ch: str) -> bool:
    return ch.isalpha() and ord(ch) < 0x250


_OPEN, _CLOSE = "“‘«„¿¡‚", "”»"


@lru_cache(maxsize=200_000)
def stands(ch: str, before: str, after: str) -> bool:
    """Whether a character can stand between these neighbours in correct text."""
    p, n = _kind(before), _kind(after)
    if ch in "≤≥→−":
        return p in "SP" and n in "SD"
    if ch == "Ω" and before in "kM" and n in "SP":
        return True
    if ord(ch) > 0x7F and ch not in LEGIT:  # a word of another script stands
        return ch.isalpha() and not _latin(ch) and not _latin(before) and not _latin(after) and (before.isalpha() or after.isalpha())
    any_p, any_n = p == "?", n == "?"
    if ch in "“‘" and p in "LUDP" and n in "SP":  # closes „ and ‚
        return True
    if ch in _OPEN:
        return (p in "SP" or any_p) and (n in "LUDP" or any_n or (ch == "«" and n == "S"))
    if ch in _CLOSE:
        return (p in "LUDP" or any_p or (ch == "»" and p == "S")) and (n in "SP" or any_n)
    if ch == "’":
        return (p in "LUD" or any_p) and (n in "LUSP" or any_n)
    if ch in "–—":
        return (p == "S" and n in "SLUD") or (p == "D" and n == "D") or (p in "LU" and n in "SLU") or (any_p and n == "S") or (any_n and p == "S")
    if ch in "•·":
        return (p in "SP" or any_p) and (n == "S" or any_n)
    if ch in "°":
        return (p in "DS" or before in "nNP)" or any_p) and not (p == "L" and before != "n")
    if ch in "²³":
        return (before in "mtnMTN)" and n not in "LU") or (p == "D" and n not in "LU") or any_p
    if ch in "½¼¾":
        return (p in "SDP" or any_p) and n not in "LU"
    if ch in "±×÷":
        return (p in "SDP" or any_p) and (n in "SDP" or any_n)
    if ch in "Ø":
        return (p in "SPD" or any_p) and (n in "SDP" or any_n)
    if ch in "µ":
        return (p in "SDP" or any_p) and (n in "LU" or any_n)
    if ch in "ªº":
        return p in "DLU" and n not in "LU"
    if ch == "…":
        return n in "SP" or any_n
    if ch in "£€¢´§®™":
        return p in "SDP" and n in "SDP" if ch != "™" and ch != "®" else p in "LUD" and n not in "LU"
    if ch.isalpha():
        if p == "D" and n != "D":
            return False
        if ch.islower():
            if n == "U" and p != "L":
                return False
            if p == "U" and n == "U":
                return False
            if p in "S" and n in "S" and not (any_p or any_n):
                return ch in "àéèáóíúò"
            return True
        if p == "L":
            return False
        return not (p == "S" and n == "S" and ch not in "ÀÉÈÁÓ")
    return True


@lru_cache(maxsize=200_000)
def _joins(ch: str, before: str, after: str) -> bool:
    """Stricter than stands(): the original must fit on both sides."""
    if not stands(ch, before, after):
        return False
    p, n = _kind(before), _kind(after)
    if ch.isalpha() and ch not in "Øµ":
        if ch.isupper():
            return p != "L" and (n in "U?" or (n == "L" and p in "SP?") or (p == "U" and n in "SP"))
        return p in "L?" or n in "L?" or (p in "SU" and n == "S" and ch in "àéèá") or (p == "P" and n == "S" and ch in "àé") or (p == "U" and n == "P")
    return True


def _impossible(ch: str, before: str, after: str) -> bool:
    """Whether a character that has no original here can be no correct text either.

    Letters beyond LEGIT may belong to a name and signs may stand apart, so these are none.
    """
    if ch in LEGIT:
        return False
    if 0xE000 <= ord(ch) < 0xF900:
        return True
    if ch.isalpha():
        return not _latin(ch) and _latin(before)
    return _latin(before) and _latin(after) and ch not in PUNCTUATION and not ch.isspace() and ch not in COMBINING and unicodedata.category(ch) not in ("Mn", "Cf")


_BEYOND = re.compile(r"[^\x00-\x7f]+ ?")
_RUN = re.compile(r"[^\x00-\x7f]{3,}")


def _encode(text: str, encoding: str) -> bytes | None:
    """The bytes that this encoding shows as the text; C1 characters are bytes it does not define."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


@lru_cache(maxsize=20_000)
def _run_original(run: str) -> str | None:
    """What a whole run of another script was, where its bytes in some encoding are UTF-8 again."""
    for w in WRONG:
        raw = _encode(run, w)
        try:
            told = raw.decode() if raw else None
        except UnicodeDecodeError:
            continue
        if told and any(c.isalpha() for c in told) and all(unicodedata.category(c)[0] != "C" for c in told):
            told = (_run_original(told) if len(told) > 2 else None) or told
            if not HELD.issuperset(told):
                return told
    return None


def _foreign_word(text: str, at: int) -> bool:
    """Whether a word holds a letter of another Latin alphabet that no damage explains: then it is a word of
    another language, and its other such letters stand as well."""
    a = b = at
    while a > 0 and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha():
        b += 1
    table = patterns()
    for i in range(a, b):
        if 0x100 <= ord(text[i]) < 0x250 and text[i] not in LEGIT:
            if not any(_joins(x, text[i - 1 : i], text[i + 1 : i + 2]) for x in table.get(text[i], ("",))[0]):
                return True
    return False


def _by_runs(text: str, spans: list[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
    """Spans with whole runs told back where sequences do not cover them, and long runs that cannot be left alone."""
    out: list[tuple[int, int, str | None]] = []
    i = 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        while i < len(spans) and spans[i][1] <= s:
            out.append(spans[i])
            i += 1
        first = i
        while i < len(spans) and spans[i][0] < e:
            i += 1
        own = spans[first:i]
        covered = sum(y - x for x, y, c in own if y - x > 1 and c is not None)
        if not own or (covered == e - s and all(HELD.issuperset(c) for _, _, c in own if c)):
            out += own
            continue
        told = _run_original(m[0]) if e - s < 200 else _run_original.__wrapped__(m[0])
        if told:
            out.append((s, e, told))
        elif e - s >= LONG_RUN and covered < e - s:
            out += [(x, y, c if y - x > 1 and c is not None and HELD.issuperset(c) else None) for x, y, c in own]
        else:
            out += own
    return out + spans[i:]


def damage(text: str) -> list[tuple[int, int, str | None]]:
    """[(start, end, original or None when it cannot be told)] of the garbled spans, leftmost longest."""
    if text.isascii():
        return []
    # every sequence is of characters beyond ASCII, and a blank at most: the automaton reads their runs only
    search = automaton().iter
    hits = [(m.start() + end - size + 1, -size, g, c, ctx) for m in _BEYOND.finditer(text) for end, (size, g, c, ctx) in search(m[0])]
    if not hits:
        return []
    hits.sort()
    out: list[tuple[int, int, str | None]] = []
    open_: list[tuple[int, str, list[str]]] = []  # place in out, wrong character, originals that fit
    at = 0
    for start, minus, g, c, ctx in hits:
        end = start - minus
        if start < at:
            continue
        before, after = text[start - 1 : start], text[end : end + 1]
        if g == LOST:
            out.append((start, end, None))
        elif len(g) == 1:
            control = 0x80 <= ord(g) < 0xA0
            if not control and stands(g, before, after):
                continue
            fits = [x for x in c if _joins(x, before, after)]
            if 0x100 <= ord(g) < 0x250 and g not in LEGIT and _foreign_word(text, start):
                continue
            if not fits and control:
                fits = [*c[:1]]
            if fits:
                open_.append((len(out), g, fits))
            elif not control and not _impossible(g, before, after):
                continue
            out.append((start, end, fits[0] if fits else None))
        elif ctx:  # lead letter before a blank
            if _kind(before) == "U" or not (_kind(before) in "LS" and (_kind(before) == "L" or text[end : end + 1].islower())):
                continue
            out.append((start, end, c))
        else:
            # a correct capital before closing punctuation (MAÇÃ”) is no damage
            if len(g) == 2 and g[0] in "ÃÂ" and g[1] in "”’“»«–—…•\u00a0" and _kind(before) == "U" and _kind(after) not in "LU":
                continue
            out.append((start, end, c))
        at = end
    if any(len(fits) > 1 for _, _, fits in open_):
        by = single_originals()
        none: frozenset[int] = frozenset()
        votes = Counter(p for _, g, fits in open_ for p in frozenset().union(*(by.get(g, {}).get(x, none) for x in fits)))
        for i, g, fits in open_:
            best = max(fits, key=lambda x: max((votes[p] for p in by.get(g, {}).get(x, none)), default=0))
            out[i] = (*out[i][:2], best)
    return _by_runs(text, out) if out else out


def repair(text: str) -> tuple[str, int, int]:
    """(text with the garbled spans replaced, spans replaced, spans lost)."""
    spans = damage(text)
    if not spans:
        return text, 0, 0
    out, at, lost = [], 0, 0
    for s, e, c in spans:
        out += [text[at:s], text[s:e] if c is None else c]
        lost += c is None
        at = e
    return "".join(out) + text[at:], len(spans) - lost, lost


def _texts(documents: DataFrame) -> DataFrame:
    """Texts that can be damaged: those with any character beyond ASCII."""
    return documents.where("doc_id is not null and octet_length(text) > length(text)").select("doc_id", "text")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, spans, lost) of documents with garbled characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, len(s), sum(c is None for _, _, c in s)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (s := damage(t))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["doc_id", "spans", "lost"])

    return _texts(documents).mapInArrow(run, "doc_id bigint, spans int, lost int")


def restored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, spans, lost): the restored text of every affected document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := repair(t))[1] + r[2]]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "text", "spans", "lost"])

    return _texts(documents).mapInArrow(run, "doc_id bigint, text string, spans int, lost int")
