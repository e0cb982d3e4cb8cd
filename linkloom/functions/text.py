"""Cleaning and key functions as column expressions.

Cleaned text is ASCII words separated by one blank, so a rule about whole words is a function of
the word array. Null text is the empty text throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import rules
from linkloom.functions.translit import fold_latin, latin_udf


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """The blank-separated words; empty for an empty text."""
    return F.filter(F.split(text_or_empty(c), " "), lambda w: w != "")


def joined(array: Column) -> Column:
    return F.array_join(array, " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def mapped(array: Column, pairs: dict[str, str]) -> Column:
    """Words replaced; a hashed test first, since a map is searched entry by entry."""
    table = lookup(pairs)
    return F.transform(array, lambda w: F.when(w.isin(list(pairs)), F.try_element_at(table, w)).otherwise(w))


def basic_clean(c: Column, native: bool = False) -> Column:
    """Latin letters, `&` to and, websites to their main word, initials joined, punctuation to
    blanks, leading zeros of numbers dropped. native: only Latin scripts, without Python."""
    t = fold_latin(text_or_empty(c)) if native else latin_udf(text_or_empty(c))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, rules.WEBSITE, " $3 ")
    t = F.regexp_replace(t, rules.DOT_IN_INITIALS, "")
    t = F.replace(t, F.lit("'"), F.lit(""))
    t = F.regexp_replace(t, "[^a-z0-9]+", " ")
    return squeeze(F.regexp_replace(t, r"\b0+(?=\d)", ""))


def replace_phrases(c: Column, phrases: dict[str, str]) -> Column:
    """Whole-word phrases, longest first; single words by the word array."""
    many = sorted((p for p in phrases if " " in p), key=lambda p: (-len(p), p))
    if many:  # one pass tells whether the text holds any
        done = c
        for p in many:
            done = F.regexp_replace(done, rf"\b{re.escape(p)}\b", phrases[p])
        c = F.when(c.rlike(rf"\b({'|'.join(map(re.escape, many))})\b"), done).otherwise(c)
    single = {p: v for p, v in phrases.items() if " " not in p}
    return joined(mapped(words(c), single)) if single else c


def name_struct(cleaned: Column) -> Column:
    """name_clean, name_core and legal_form of a text that basic_clean has been through, in one struct:
    its words are split once."""
    t = F.regexp_replace(cleaned, r"^(m s|messrs)\s+(?=\S)", "")
    t = F.regexp_replace(t, r"(?<=[a-z])0(?=[a-z])", "o")
    table, known = lookup(rules.LEGAL_WORDS), list(rules.LEGAL_WORDS)

    def parts(w: Column) -> Column:
        forms = F.array_sort(F.array_distinct(F.transform(F.filter(w, lambda x: x.isin(known)), lambda x: F.try_element_at(table, x))))
        core = joined(F.filter(w, lambda x: ~x.isin(known)))
        return F.struct(joined(w).alias("name_clean"), F.when(core != "", core).otherwise(joined(w)).alias("name_core"), joined(forms).alias("legal_form"))

    return F.get(F.transform(F.array(F.array_distinct(words(replace_phrases(t, rules.LETTER_SEQUENCES)))), parts), F.lit(0))


def name_parts(cleaned: Column) -> tuple[Column, Column, Column]:
    """(name_clean, name_core, legal_form), each a column of its own."""
    parts = name_struct(cleaned)
    return parts["name_clean"], parts["name_core"], parts["legal_form"]


def clean_address(cleaned: Column) -> Column:
    """States to codes first, then short forms, fillers out, repeats out."""
    w = mapped(words(replace_phrases(cleaned, rules.STATE_NAMES)), rules.ADDRESS_WORDS)
    w = F.filter(w, lambda x: ~x.isin(rules.ADDRESS_FILLER_WORDS))
    return joined(F.array_distinct(w))


def number_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: w.rlike("^[0-9]+$"))


def first_number(c: Column) -> Column:
    return F.coalesce(F.get(number_words(c), F.lit(0)), F.lit(""))


def postcode(c: Column) -> Column:
    """The last word of 4 to 6 digits, unless it is the first word."""
    w = words(c)
    at = F.filter(F.transform(w, lambda x, i: F.when(x.rlike("^[0-9]{4,6}$"), i)), lambda i: i.isNotNull())
    last = F.element_at(F.concat(F.array(F.lit(0)), at), -1)
    return F.when(last > 0, F.get(w, last)).otherwise(F.lit(""))


def digit_key(c: Column) -> Column:
    return joined(F.array_sort(F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit("([0-9]+)"), F.lit(1)))))


def sound_skeleton(c: Column) -> Column:
    for old, new in rules.SOUND_PAIRS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\w)[aeiouyh]", ""), r"(\w)\1+", "$1")


def fix_typos(c: Column) -> Column:
    """Digits inside words of three letters or more become letters; a leading l before a consonant becomes i."""
    digits, letters = rules.DIGITS_FOR_LETTERS
    odd = lambda w: (F.length(F.regexp_replace(w, "[^a-z]", "")) >= 3) & w.rlike("[0-9]")
    fixed = F.transform(words(c), lambda w: F.when(odd(w), F.translate(w, digits, letters)).otherwise(w))
    return joined(F.transform(fixed, lambda w: F.regexp_replace(w, "^l([nmstdcfvgkpr])", "i$1")))


def name_key(c: Column, word_map: dict[str, str] | None = None, noise: Iterable[str] = ()) -> Column:
    """Typos fixed, spellings mapped, noise words and long numbers out; what was there if nothing is left."""
    w = words(fix_typos(c))
    w = mapped(w, word_map) if word_map else w
    noise = list(noise)
    kept = F.filter(w, lambda x: ~x.rlike("^[0-9]{5,}$") & (~x.isin(noise) if noise else F.lit(True)))
    return joined(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(w)))


def initials(c: Column) -> Column:
    w = words(c)
    return F.when(F.size(w) >= 2, F.array_join(F.transform(w, lambda x: F.left(x, F.lit(1))), "")).otherwise(F.lit(""))


def legal_bits(forms: Column) -> Column:
    """A bit for each legal form in a blank-separated list."""
    table = F.create_map(*[F.lit(x) for i, f in enumerate(rules.LEGAL_FORMS) for x in (f, 1 << i)])
    return F.aggregate(words(forms), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.coalesce(F.try_element_at(table, w).cast("long"), F.lit(0).cast("long"))))


def bits_missing(a: Column, b: Column) -> Column:
    """How many bits of a are not in b."""
    return F.bit_count(a.bitwiseAND(F.bitwise_not(b)))


def plain(c: Column) -> Column:
    """Lower case, Latin folded, other letters out, blanks squeezed."""
    return squeeze(F.regexp_replace(fold_latin(text_or_empty(c)), r"[^\x00-\x7f]", ""))


def rival_key(c: Column) -> Column:
    """Name key of a rival from plain text: no addresses of the net, ids, long numbers, repeated or legal words."""
    t = F.regexp_replace(c, r"www\.\S+|https?://\S+|\S+@\S+|\S+\.com\b", " ")
    t = F.regexp_replace(t, r"\(id:?\s*\d+\)|\d{6,}", " ")
    t = F.regexp_replace(t, "[^a-z0-9 ]", " ")
    t = F.regexp_replace(t, r"\b(\w+)( \1\b)+", "$1")
    return joined(F.filter(words(t), lambda w: ~w.isin(rules.RIVAL_STOP_WORDS)))


def pair_text(name: Column, address: Column) -> Column:
    return F.btrim(F.concat(text_or_empty(name), F.lit(" | "), text_or_empty(address)), F.lit(" |"))


def is_indic(c: Column) -> Column:
    return c.rlike("[ऀ-෿]")


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def temper(c: Column, power: float) -> Column:
    return 1 / (1 + F.exp(-power * logit(c)))


def id_bucket(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % 1000).cast("int")
