"""The rules of `text` and the n-grams of `vectors` over batches in Python, for tables of long texts.

Higher-order functions take a word at a time in the interpreter of the JVM, over and over where a rule
names its text twice. Here a batch's words go through sets and dictionaries and its n-grams through
arrays. Results are those of the columns; a test compares them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from linkloom.functions import rules
from linkloom.functions.translit import LATIN, _latin_table

#: Letters of the texts that are taken together.
TOGETHER = 1 << 20
#: Words whose fixed spelling a worker remembers.
KNOWN = 1 << 19
_FOLD = {**dict(zip(*_latin_table())), **LATIN, **{chr(c): "" for c in range(0x300, 0x370)}}
_DOMAIN = re.compile(r"\.(?:com|net|org|in|co|biz|info|fr|us|io)")
_WEBSITE = re.compile(rules.WEBSITE)
_DOT_IN_INITIALS = re.compile(r"\.(?<=\b[a-z]\.)(?=[a-z]\b)")  # rules.DOT_IN_INITIALS with the dot first
_ZEROS = re.compile(r"\b0+(?=[0-9])")
_BLANKED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_MESSRS = re.compile(r"^(m s|messrs)\s+(?=\S)")
_ZERO_IN_WORD = re.compile(r"(?<=[a-z])0(?=[a-z])")
_DIGITS = str.maketrans(*rules.DIGITS_FOR_LETTERS)
_AFTER_L, _DIGIT = frozenset("nmstdcfvgkpr"), frozenset("0123456789")


def clean(text: str | None) -> str:
    """As text.basic_clean with native."""
    t = (text or "").lower()
    if not t.isascii():
        for c in set(t):
            if c > "\x7f":
                if c in _FOLD:
                    t = t.replace(c, _FOLD[c])
                elif c.isnumeric() and not (c.isalpha() or c.isdecimal()):  # no part of a word to Java
                    t = t.replace(c, "\x7f")
    t = t.replace("&", " and ")
    if "." in t:
        if _DOMAIN.search(t):  # websites hold no blank
            t = " ".join([_WEBSITE.sub(r" \3 ", w) if "." in w and _DOMAIN.search(w) else w for w in t.split(" ")])
        t = _DOT_IN_INITIALS.sub("", t)
    t = " ".join(t.replace("'", "").encode("ascii", "replace").translate(_BLANKED).decode().split())
    return _ZEROS.sub("", t) if "0" in t else t


class _Phrases:
    """Phrases of several words, put as text.replace_phrases does."""

    def __init__(self, table: dict[str, str]):
        many = sorted((p for p in table if " " in p), key=lambda p: (-len(p), p))
        self.many = [(p, re.compile(rf"\b{re.escape(p)}\b"), table[p]) for p in many]
        self.first = frozenset(p.split()[0] for p in many)

    def __call__(self, t: str) -> str:
        for p, pattern, to in self.many:
            if p in t:
                t = pattern.sub(to, t)
        return t


_letter_sequences, _states = _Phrases(rules.LETTER_SEQUENCES), _Phrases(rules.STATE_NAMES)
_state = {p: v for p, v in rules.STATE_NAMES.items() if " " not in p}
_place = {w: rules.ADDRESS_WORDS.get(v, v) for w, v in {**{w: w for w in rules.ADDRESS_WORDS}, **_state}.items()}
_filler = frozenset(rules.ADDRESS_FILLER_WORDS)
assert not any(" " in v for v in _state.values()) and all(" " in p for p in rules.LETTER_SEQUENCES)


def words(t: str | None) -> list[str]:
    return [w for w in (t or "").split(" ") if w]


def clean_row(cleaned: str) -> tuple[str, str, str, str]:
    """(name_clean, name_core, legal_form, addr_clean) as text.name_struct and text.clean_address; phrases are only
    looked for where their first words are."""
    own = w = dict.fromkeys(words(cleaned))
    if not _letter_sequences.first.isdisjoint(own) or "0" in cleaned or cleaned.startswith(("m s", "messrs")):
        w = dict.fromkeys(words(_letter_sequences(_ZERO_IN_WORD.sub("o", _MESSRS.sub("", cleaned)))))
    if not _states.first.isdisjoint(own):
        own = dict.fromkeys(words(_states(cleaned)))
    whole = " ".join(w)
    forms = w.keys() & rules.LEGAL_WORDS.keys()
    core = " ".join([x for x in w if x not in forms]) or whole if forms else whole
    place = dict.fromkeys([_place.get(x, x) for x in own])
    if not _filler.isdisjoint(place):
        place = [x for x in place if x not in _filler]
    return whole, core, " ".join(sorted({rules.LEGAL_WORDS[x] for x in forms})), " ".join(place)


class _Fixed(dict):
    """A word's fixed and mapped spelling, made when it is first met."""

    def __init__(self, word_map: dict[str, str]):
        self.word_map = word_map

    def __missing__(self, w: str) -> str:
        x = w
        if not (x.isascii() and x.isalpha()) and re.search("[0-9]", x) and len(re.sub("[^a-z]", "", x)) >= 3:
            x = x.translate(_DIGITS)
        if x[0] == "l" and x[1:2] in _AFTER_L:
            x = "i" + x[1:]
        x = self.word_map.get(x, x)
        if len(self) < KNOWN:
            self[w] = x
        return x


def key_words(word_map: dict[str, str] | None = None, noise: Iterable[str] = ()) -> Callable[[list[str]], list[str]]:
    """The words of text.name_key from a name's words."""
    fixed, noise, long_number = _Fixed(word_map or {}), frozenset(noise), re.compile("[0-9]{5,}")

    def run(w: list[str]) -> list[str]:
        w = dict.fromkeys([fixed[x] for x in w])
        return [x for x in w if x not in noise and (x[:1] not in _DIGIT or not long_number.fullmatch(x))] or list(w)

    return run


def together(texts: list[str]) -> Iterator[slice]:
    """Slices of about TOGETHER letters and at most 1024 texts, or of one text."""
    ends = np.cumsum([len(t) + TOGETHER // 1024 for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield slice(at, to)
        at = to


def char_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, tf) of each text's distinct 3-grams as vectors.char_ngrams makes them, sorted by row and
    gram. A gram is its three code points of 21 bits, so grams are in the order of their letters."""
    n = np.array([len(t) for t in texts]) + 1
    c = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    mid = np.flatnonzero(c[1:-1] != 32) + 1
    row = np.repeat(np.arange(len(texts)), n)[mid - 1] if len(texts) else mid
    bits = 7 if c.max(initial=0) < 128 else 21
    gram = (c[mid - 1] << 2 * bits) | (c[mid] << bits) | c[mid + 1]
    if bits == 7:
        both = np.sort((row << 21) | gram)
        new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else mid
        row, gram = both[new] >> 21, both[new] & ((1 << 21) - 1)
        gram = (gram >> 14 << 42) | ((gram >> 7 & 127) << 21) | (gram & 127)
    else:
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]) if len(row) else mid
        row, gram = row[new], gram[new]
    return row, gram, np.diff(np.r_[new, len(mid)])


def spelled(grams: np.ndarray) -> list[str]:
    return [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams.tolist()]


def coded(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])
