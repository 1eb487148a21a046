"""Tokenizers as column expressions from a string to an array of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = "a i an as at be by in is it of on or to and are com for how not the was who www also from that this what when will with about where".split()


def _words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda x: x != "")


def basic(text: Column) -> Column:
    """Runs of ASCII word characters, as they are, repeats included."""
    return _words(text, r"\W+")


def plain_words(text: Column) -> Column:
    """Distinct runs of letters and digits, in small letters."""
    return F.array_distinct(_words(F.lower(text), r"[^\p{L}\p{N}]+"))


def stopped(text: Column, stop: list[str] = STOP) -> Column:
    """Distinct ASCII-letter words in small letters: stop words (at word bounds) and all other characters become blanks."""
    kept = F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(map(re.escape, stop))})\b", " ")
    return F.array_distinct(_words(F.lower(F.regexp_replace(kept, "[^a-zA-Z ]", " ")), " +"))


def title_words(text: Column) -> Column:
    """Words of bibliographic titles: runs that begin with a letter, in small letters, without dots, of two characters at least;
    the k-th occurrence of a word has k - 1 ones appended."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z\u00a0-\u00ff][a-z0-9\u00a0-\u00ff.\-]*"), F.lit(0))
    kept = F.filter(F.transform(words, lambda w: F.replace(w, F.lit("."), F.lit(""))), lambda w: F.length(w) > 1)
    tagged = F.transform(numbered(kept, "\x1f"), lambda t: F.split(t, "\x1f"))
    return F.transform(tagged, lambda p: F.concat(p[0], F.repeat(F.lit("1"), p[1].cast("int") - 1)))


def numbered(tokens: Column, separator: str = "_") -> Column:
    """Each token with the number of its occurrence so far, so that a bag becomes a set.

    A fold over the array carries the counts so far in a map, so time grows with tokens times distinct tokens: for
    names and titles. ``operators.order.numbered_tokens`` does the same for long texts by a window.
    """
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        k = F.coalesce(F.try_element_at(state["n"], token), F.lit(0)) + 1
        rest = F.map_filter(state["n"], lambda key, _: key != token)
        return F.struct(F.map_concat(rest, F.create_map(token, k)).alias("n"), F.concat(state["out"], F.array(F.concat_ws(separator, token, k.cast("string")))).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def occurrences(text: Column, with_rid: bool = False) -> Column:
    """Words in small letters, each tagged with its occurrence number; with_rid leaves the first word out."""
    words = _words(F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]", " "))), " +")
    return numbered(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))) if with_rid else words)


def word_counts(text: Column, separator: str = " ", tag: str = "_") -> Column:
    return numbered(_words(text, re.escape(separator)), tag)


def ngrams(text: Column, n: int = 3, pad: str = "$", tag: bool = True) -> Column:
    """Character n-grams of the text padded on both sides, each with its occurrence number; none of an empty text."""
    padded = F.concat(F.lit(pad * (n - 1)), text, F.lit(pad * (n - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    out = numbered(grams, "") if tag else grams
    return F.when(F.length(text) > 0, out).otherwise(F.array().cast("array<string>"))


def hashed_ngrams(text: Column, n: int = 3, pre: str = "#", post: str = "$") -> Column:
    """Character n-grams of the text between pre- and post-characters as 32-bit hashes, the occurrence number folded in last."""
    padded = F.concat(F.lit(pre * (n - 1)), F.lower(text), F.lit(post * (n - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    parts = F.transform(numbered(grams, "\x1f"), lambda t: F.split(t, "\x1f"))
    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")
    out = F.transform(parts, lambda p: signed(F.pmod(string_hash(p[0]).cast("long") * 31 + p[1].cast("long"), F.lit(1 << 32))))
    return F.when(F.length(text) > 0, out).otherwise(F.array().cast("array<int>"))


def utf8_token(text: Column) -> Column:
    """The UTF-8 bytes of a token in small letters after their number in two bytes."""
    raw = F.encode(F.lower(text), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 4, "0")), raw)


def polynomial_hash(parts: list[Column], buckets: int, base: int = 33) -> Column:
    """``h = base * h + part`` over integer parts in 32 bits with wrap-around, its absolute value modulo ``buckets``."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.lit(0).cast("long")
    for part in parts:
        h = wrap(h * base + part.cast("long"))
    return F.pmod(F.abs(h), F.lit(buckets)).cast("int")


def string_hash(text: Column, fold: bool = True) -> Column:
    """``h = 31 h + c`` over UTF-16 code units below the surrogates, in 32 bits with wrap-around."""
    s = F.lower(text) if fold else text
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    wrap = lambda x: F.pmod(x, F.lit(1 << 32))
    code = lambda c: F.when(F.octet_length(c) == 1, F.ascii(c)).otherwise(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + code(c).cast("long")))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def hashed_words(text: Column) -> Column:
    """Numbered words as 32-bit hashes, the number folded in last."""
    parts = F.transform(occurrences(text), lambda t: F.split(t, "_"))
    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")
    return F.transform(parts, lambda p: signed(F.pmod(string_hash(p[0]).cast("long") * 31 + p[1].cast("long"), F.lit(1 << 32))))


def _measure(stem: str) -> int:
    return len(re.findall("VC", re.sub("V+", "V", re.sub("C+", "C", _shape(stem)))))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "C")
        out += "V" if vowel else "C"
    return out


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def stem(w: str) -> str:
    """Porter's algorithm for suffix stripping."""
    if len(w) <= 2:
        return w
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "C"
    cvc = lambda s: _shape(s)[-3:] == "CVC" and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "V" in _shape(w[: -len(x)])), None)
        if cut is not None:
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if double(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and cvc(cut) else cut
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for old, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(old):
                w = w[: -len(old)] + new if _measure(w[: -len(old)]) > 0 else w
                break
    for old in _STEP4:
        if w.endswith(old):
            s = w[: -len(old)]
            w = s if _measure(s) > 1 and (old != "ion" or s.endswith(("s", "t"))) else w
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not cvc(w[:-1])) else w
    return w[:-1] if double(w) and w.endswith("l") and _measure(w[:-1]) > 1 else w


ENGLISH_STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


#: A word: letters and digits, with an apostrophe, dot or colon between letters, or a dot, comma or apostrophe between digits.
_ENGLISH = re.compile(r"\w+(?:(?:(?<=[^\W\d_])['\u2019.:](?=[^\W\d_])|(?<=\d)[.,;'\u2019](?=\d))\w+)*")


def english_words(text: str) -> list[str]:
    """Words in small letters, without a possessive 's and without stop words."""
    words = (re.sub(r"['\u2019]s$", "", w.lower()) for w in _ENGLISH.findall(text) if w.strip("_"))
    return [w for w in words if w and w not in ENGLISH_STOP]


def _english(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    kept: dict[str, str] = {}
    for texts in batches:
        out = []
        for text in texts:
            words = [] if text is None else english_words(text)
            for w in words:
                if w not in kept:
                    kept[w] = stem(w)
            out.append([kept[w] for w in words])
            if len(kept) > 500_000:
                kept.clear()
        yield pd.Series(out)


def english(text: Column) -> Column:
    """Stems of English words without stop words; the one tokenizer that needs Python, in Arrow batches."""
    return F.pandas_udf(_english, "array<string>")(text)


TOKENIZERS: dict[str, Callable[..., Column]] = {"basic": basic, "stopped": stopped, "english": english, "occurrences": occurrences, "words": word_counts, "ngrams": ngrams, "plain": plain_words, "titles": title_words, "hashed_words": hashed_words, "hashed_ngrams": hashed_ngrams}


def tokenizer(name: str) -> Callable[..., Column]:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; known: {sorted(TOKENIZERS)}")
    return TOKENIZERS[name]
