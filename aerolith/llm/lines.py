"""Statistics of the lines of many texts at once, as arrays over their characters.

All lines of a batch become one array of code points, from which character classes,
words, tokens and their hashes follow by look-ups and prefix sums. Words and lines are
compared by polynomial hashes of 64 bits. Repetition is measured by the share of
distinct runs of GRAM characters: in a line, and in a text within each CHUNK
characters, so that it doesn't fall with the length of a text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4000
GRAM, CHUNK = 4, 4096
KNOWN = 0x30000  # code points beyond are symbols
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by

_enumerated = re.compile(r"\s*(?:[-*•·–+>]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\[[ xX]\]|[ivx]{1,5}[.)])\s")
_field = re.compile(r"\s*[\w ]{1,24}:\s*\S{0,24}\s*")
_tag = re.compile(r"<[^<>]*>|&#?\w+;|\{\{\w*\}\}")
LEADER = r"\.{4,}|_{4,}|[^\s] {3,}[^\s]"
DUMP = r"(?:\b[0-9a-fA-F]{2}\b ?){8,}"
LETTER, DIGIT, BLANK, UPPER, VOWEL, SIGN, LOW_ASCII, UP_ASCII = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The classes and the lower case of each code point."""
    classes, lower = np.zeros(KNOWN + 1, np.uint8), np.arange(KNOWN + 1, dtype=np.uint64)
    vowels = set("aeiouáéíóúàâäöüèêëîïôùûãõ")
    for c in range(KNOWN):
        ch = chr(c)
        small = ch.lower()
        kind = DIGIT if ch.isdecimal() else LETTER if ch.isalnum() else BLANK if ch.isspace() else 0
        if not kind and ch not in "_'’.,-":
            kind = SIGN
        if "A" <= ch <= "Z" or "À" <= ch <= "Þ" and ch != "×":
            kind |= UPPER
        if small in vowels:
            kind |= VOWEL
        kind |= LOW_ASCII if "a" <= ch <= "z" else UP_ASCII if "A" <= ch <= "Z" else 0
        classes[c] = kind
        if len(small) == 1 and ord(small) < KNOWN:
            lower[c] = ord(small)
    classes[KNOWN] = SIGN
    return classes, lower


def pieces(text: str) -> list[str]:
    """The lines of a text that are not blank, long ones in pieces."""
    out = []
    for line in text.splitlines():
        if line.strip():
            out += [line] if len(line) <= PIECE else [p for i in range(0, len(line), PIECE) if (p := line[i : i + PIECE]).strip()]
    return out


_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _kept or len(_kept[0]) < n:
        base, back = np.full(2 * n, BASE, np.uint64), np.full(2 * n, pow(BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _kept[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)]
    return _kept[0][:n], _kept[1][:n]


class Hashes:
    """Hashes of any parts of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words) -> np.ndarray:
    """Sorted hashes of lower-case words, to look words of texts up in."""
    _, lower = _tables()
    out = []
    for w in words:
        cp = lower[np.minimum(np.frombuffer(w.encode("utf-32-le"), "<u4"), KNOWN)]
        out.append(Hashes(cp).of(np.array([0]), np.array([len(cp)]))[0])
    return np.sort(np.array(out, np.uint64))


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values, by 40 bits of their hashes, each of n groups has."""
    if not len(group):
        return np.zeros(n)
    keys = np.sort(group.astype(np.uint64) << np.uint64(40) | value >> np.uint64(24))
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def line_statistics(texts: list[list[str]], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a line of all texts, and the place of each text's first row; the columns from 25 on are those of the whole text. Every text has a line, no line is blank."""
    lines = [x for text in texts for x in text]
    n, docs = len(lines), len(texts)
    per_doc = np.array([len(t) for t in texts])
    doc_start = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(docs), per_doc)
    classes, lower = _tables()
    cp = np.minimum(np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le"), "<u4"), KNOWN)
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    kinds = classes[cp]
    closing = np.zeros(len(cp), bool)
    closing[end] = True
    is_ = lambda mask: (kinds & mask) > 0

    of_line = np.repeat(np.arange(n), size + 1)
    by_kind = np.bincount((of_line << 8) + kinds, minlength=n << 8).reshape(n, 256).astype(np.float32)
    classed = lambda mask: (by_kind @ ((np.arange(256) & mask) > 0).astype(np.float32)).astype(float)

    def held(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of_line[np.flatnonzero(flags)], minlength=n).astype(float)

    def after(flags: np.ndarray, first: bool = False) -> np.ndarray:
        return np.concatenate([[first], flags[:-1]])

    def ahead(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([flags[1:], [False]])

    letter, digit, blank = is_(LETTER), is_(DIGIT), is_(BLANK)
    letters, digits, blanks = classed(LETTER), classed(DIGIT), classed(BLANK) - 1  # without the break behind a line

    # Words
    w0, w1 = np.flatnonzero(letter & ~after(letter)), np.flatnonzero(letter & ~ahead(letter)) + 1
    word_line = of_line[w0]
    words = np.bincount(word_line, minlength=n).astype(float)
    hashes = Hashes(lower[cp]).of(w0, w1)
    usual = np.zeros(len(w0), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        usual = common[at] == hashes
    usual_n = np.bincount(word_line[usual], minlength=n).astype(float)

    # Tokens
    solid = ~blank
    t0, t1 = np.flatnonzero(solid & after(blank, True)), np.flatnonzero(solid & ahead(blank)) + 1
    token_line = of_line[t0]
    first_token = np.searchsorted(token_line, np.arange(n), "left")
    tokens = np.bincount(token_line, minlength=n).astype(float)
    longest = np.maximum.reduceat(t1 - t0, first_token).astype(float)
    low, up = is_(LOW_ASCII), is_(UP_ASCII)
    either = low | up
    pair = (digit & ahead(either)) | (low & ahead(up)) | (either & ahead(digit))
    sums = np.concatenate([[0], np.cumsum(pair)])
    mixed = np.bincount(token_line[sums[t1 - 1] > sums[t0]], minlength=n)
    last_token = np.append(first_token[1:], len(t0)) - 1
    final = cp[t1[last_token] - 1]
    ends = np.isin(final, [ord(c) for c in ".!?:"]).astype(float)

    sign = is_(SIGN)
    inside = held(sign & after(letter) & ahead(letter))
    tabs, pipes = held(cp == 9), held(cp == ord("|"))
    comma = (cp == ord(",")) | (cp == ord(";"))
    commas = held(comma & (~ahead(blank) | ahead(closing)))
    parts = held((cp == ord(";")) & ahead(cp == 32)) + 1

    grams = cp.astype(np.uint64)
    gram = np.zeros(len(cp), np.uint64)
    for i in range(GRAM):
        gram[: len(cp) - i] = gram[: len(cp) - i] * np.uint64(0x100000001B3) + grams[i:]
    gram = (gram ^ gram >> np.uint64(29)) * np.uint64(BASE)
    whole = np.arange(len(cp)) + GRAM <= end[of_line]
    own = _distinct(of_line[whole], gram[whole], n) / np.maximum(40, size)
    text_start = start[doc_start]
    place = np.arange(len(cp)) - text_start[doc[of_line]]
    n_chunks = int(place.max()) // CHUNK + 1
    chunk = doc[of_line] * n_chunks + place // CHUNK  # never decreases
    new = np.concatenate([[True], chunk[1:] != chunk[:-1]])
    used, number = chunk[new], np.cumsum(new) - 1
    inner = np.arange(len(cp)) + GRAM <= end[np.cumsum(per_doc) - 1][doc[of_line]]
    per_chunk = _distinct(number[inner], gram[inner], len(used))
    total = np.add.reduceat(size + 1, doc_start)
    packed = np.bincount(used // n_chunks, per_chunk, minlength=docs) / np.maximum(40, total)

    array = pa.array(lines, pa.large_string())
    leader = pc.match_substring_regex(array, LEADER).to_numpy(zero_copy_only=False).astype(float)
    dump = pc.match_substring_regex(array, DUMP).to_numpy(zero_copy_only=False).astype(float)
    marked = np.array([_enumerated.match(x) is not None for x in lines], float)
    named = np.array([_field.fullmatch(x) is not None if ":" in x else False for x in lines], float)
    tags = np.zeros(n)
    for i in np.flatnonzero(held((cp == ord("<")) | (cp == ord("&")) | (cp == ord("{")))):
        tags[i] = sum(map(len, _tag.findall(lines[i])))
    short = (words <= 5) * (1 - ends)

    mean = lambda v: np.add.reduceat(v, doc_start) / per_doc
    word_doc = doc[word_line]
    n_words = np.add.reduceat(words, doc_start)
    stripped = Hashes(cp.astype(np.uint64)).of(t0[first_token], t1[last_token])
    separators = (tabs.astype(np.int64) << 40) + (pipes.astype(np.int64) << 20) + commas.astype(np.int64)
    regular = np.zeros(docs)
    some = np.flatnonzero(separators > 0)
    if len(some):
        order = some[np.lexsort((separators[some], doc[some]))]
        new = np.flatnonzero(np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (separators[order][1:] != separators[order][:-1])]))
        np.maximum.at(regular, doc[order][new], np.diff(np.append(new, len(order))))
    by_words = np.lexsort((words, doc))
    ranked = words[by_words]
    median = (ranked[doc_start + (per_doc - 1) // 2] + ranked[doc_start + per_doc // 2]) / 2
    context = np.stack(
        [
            _distinct(doc, stripped, docs) / per_doc, mean(marked), regular / per_doc, median, np.add.reduceat(usual_n, doc_start) / np.maximum(1, n_words), np.log1p(per_doc), mean(short), mean(named),
            _distinct(word_doc, hashes, docs) / np.maximum(1, n_words), packed, mean(ends),
        ],
        axis=1,
    )
    own_rows = np.stack(
        [
            size, words, letters / np.maximum(1, words), (size - letters - digits - blanks) / size, digits / size, ends, usual_n / np.maximum(1, words), marked, tabs, pipes, commas,
            parts - 1, words / parts, named, leader, own, classed(UPPER) / size, classed(VOWEL) / np.maximum(1, letters), held(cp > 0x7F) / size,
            longest, mixed / np.maximum(1, tokens), inside / np.maximum(1, words), blanks / size, dump, tags / size,
        ],
        axis=1,
    )
    return np.concatenate([own_rows, context[doc]], axis=1), doc_start
