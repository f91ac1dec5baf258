"""Text functions as Column builders: normalization, tokens, scripts, sentence ends."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that become a space, besides white space.
SEPARATORS = "-.,:;!?“”‘’\"—–…·•«»‒―‑()[]{}|@#*&+=~^°©®™¿¡`" + "。，！？；：、（）《》「」『』【】｛｝"
#: White space beyond what Java's \s has.
SPACE = r"\s\x0B\u0085   -     　"
CJK = "㐀-䶿一-鿿぀-ヿ"
#: Abbreviations that end no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Jr.", "Sr.", "Inc.", "Ltd.", "Corp.", "etc.", "i.e.", "e.g.", "vs.", "Prof.", "Rev.", "Gen.", "Col.", "Sgt.", "Lt.")
#: Closing quotes and brackets that may follow a sentence end.
CLOSERS = "'\"‘’“”)]}»"
URL = r"https?://[^\s]+"
EMAIL = r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"
PHONE = r"\+?[0-9]+(?:-[0-9]+)+"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """What translate() takes to strip accents of every BMP character that folds to one character, or to none."""
    single, gone = [], []
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        folded = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if folded == "":
            gone.append(c)
        elif folded != c and len(folded) == 1:
            single.append((c, folded))
    return "".join(c for c, _ in single) + "".join(gone), "".join(f for _, f in single)


def fold_accents(text: Column) -> Column:
    """Sharp s to ss, accents off, typographic apostrophes to plain ones; plain ASCII stays as it is."""
    plain = text
    text = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("SS"))
    folded = F.replace(F.translate(text, *_folds()), F.lit("’"), F.lit("'"))
    return F.when(F.regexp_like(plain, F.lit(r"[^\x00-\x7F]")), folded).otherwise(plain)


def _class(characters: str) -> str:
    return "".join("\\" + c if c in r"\[]^-&" else c for c in characters)


def scan_words(text: Column) -> Column:
    """Apostrophes out, separators to single spaces, lower case; a segment without a letter, digit or _ swallows the space behind it."""
    spaced = F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), f"[{SPACE}{_class(SEPARATORS)}]+", " ")
    return F.rtrim(F.regexp_replace(F.lower(F.trim(spaced)), r"(?<![^ ])([^\p{L}\p{N}_ ]+) ", "$1"))


def normalize_core(text: Column) -> Column:
    """Normalization of text without protected tokens."""
    return scan_words(fold_accents(text))


def decode_escapes(text: Column) -> Column:
    r"""Literal \uXXXX to its character; surrogates become U+FFFD."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\u[0-9a-fA-F]{4}"), F.lit(0)))

    def put(s, m):
        code = F.substring(m, 3, 4)
        value = F.when(F.regexp_like(code, F.lit("^[dD][89a-fA-F]")), F.lit("�")).otherwise(F.decode(F.unhex(code), "UTF-16BE"))
        return F.replace(s, m, value)

    return F.aggregate(found, text, put)


def _name(kind: str, k: Column) -> Column:
    return F.concat(F.lit(f"{kind}placeholder"), F.lpad(k.cast("string"), 6, "0"), F.lit("qz"))


def _hide(text: Column, pattern: str, kind: str) -> tuple[Column, Column]:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    numbered = F.transform(found, lambda x, k: F.struct(x.alias("was"), _name(kind, k).alias("name")))
    return F.aggregate(numbered, text, lambda s, m: F.replace(s, m["was"], m["name"])), numbered


def _show(text: Column, numbered: Column, form) -> Column:
    return F.aggregate(numbered, text, lambda s, m: F.replace(s, m["name"], form(m["was"])))


def normalize_text(text: Column) -> Column:
    """The whole normalizer: escapes, protected URLs, emails, phones and initialisms, accents, separators."""
    text, urls = _hide(decode_escapes(text), URL, "url")
    text, emails = _hide(text, EMAIL, "email")
    text, phones = _hide(text, PHONE, "phone")
    text, initials = _hide(fold_accents(text), r"(?:[A-Za-z]\.){2,}", "init")
    text = F.transform(F.split(scan_words(text), " "), lambda t: F.when(F.regexp_like(t, F.lit("placeholder[0-9]{6}qz")), t).otherwise(F.replace(t, F.lit("_"), F.lit(" "))))
    text = F.trim(F.regexp_replace(F.array_join(text, " "), " +", " "))
    text = _show(text, phones, lambda p: F.replace(F.replace(p, F.lit("+"), F.lit("")), F.lit("-"), F.lit("_")))
    text = _show(text, emails, F.lower)
    text = _show(text, initials, lambda i: F.regexp_replace(F.replace(F.lower(i), F.lit("."), F.lit("_")), "_$", ""))
    return _show(text, urls, lambda u: u)


def tokenize_words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\r]+"), "")


def tokenize_characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)[^ \\t\\n\\r]"), F.lit(0))


def cjk_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(f"[{CJK}]")) / F.length(text)).otherwise(0.0)


def english_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[A-Za-z0-9 .,]")) / F.length(text)).otherwise(0.0)


def language_handler(text: Column) -> Column:
    """cjk, english or mixed; empty text is english."""
    c, e = cjk_share(text), english_share(text)
    return F.when(F.length(text) == 0, "english").when((c >= e) & (c >= 0.8), "cjk").when((e > c) & (e >= 0.8), "english").otherwise("mixed")


def page_handlers(df):
    """``page_id, handler`` of pages from their ``lines(page_id, text)``: counts of each line, added up by page."""
    n = F.count("*") - 1  # the lines are joined by spaces, which count as English
    c, e, size = F.sum(F.regexp_count("text", F.lit(f"[{CJK}]"))), F.sum(F.regexp_count("text", F.lit("[A-Za-z0-9 .,]"))) + n, F.sum(F.length("text")) + n
    out = df.groupBy("page_id").agg(c.alias("c"), e.alias("e"), size.alias("n"))
    cjk, english = F.col("c") / F.col("n"), F.col("e") / F.col("n")
    kind = F.when(F.col("n") <= 0, "english").when((cjk >= english) & (cjk >= 0.8), "cjk").when((english > cjk) & (english >= 0.8), "english").otherwise("mixed")
    return out.select("page_id", kind.alias("handler"))


def tokenize(handler: Column, text: Column) -> Column:
    """Characters of CJK pages, words of all others."""
    return F.when(handler == "cjk", tokenize_characters(text)).otherwise(tokenize_words(text))


def join_words(handler: Column, words: Column, text=lambda w: w["text"]) -> Column:
    """Each word with what stands between it and the next: nothing between CJK words of pages that are not English."""
    last = F.size(words) - 1
    gap = lambda w, k: F.when(k < last, F.when(needs_space(handler, text(w), text(F.get(words, k + 1))), " ").otherwise("")).otherwise("")
    return F.when(handler == "english", F.transform(words, lambda w, k: F.concat(text(w), F.when(k < last, " ").otherwise("")))).otherwise(F.transform(words, lambda w, k: F.concat(text(w), gap(w, k))))


def needs_space(handler: Column, left: Column, right: Column) -> Column:
    both = F.regexp_like(left, F.lit(f"[{CJK}]")) & F.regexp_like(right, F.lit(f"[{CJK}]"))
    return (handler == "english") | ~both


def ends_sentence(text: Column) -> Column:
    """Ends in ! or ?, or in a period that is no initial and no abbreviation; closing quotes and brackets don't count."""
    core = F.regexp_replace(F.trim(text), f"[{_class(CLOSERS)}]+$", "")
    dotted = F.endswith(core, F.lit("."))
    initial = F.regexp_like(core, F.lit(r"(?<![A-Za-z0-9_])[A-Z]\.([A-Z]\.)*$"))
    short = F.lit(False)
    for a in ABBREVIATIONS:
        short = short | F.endswith(core, F.lit(a))
    return F.regexp_like(core, F.lit("[!?]$")) | (dotted & ~initial & ~short)


def latin_majority(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]")) * 2 > F.length(text)


def rtl_majority(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[֐-ࣿיִ-ﻼ]")) * 2 > F.length(text)


#: CJK, Devanagari, Arabic, Bengali, Thai.
COMPLEX = r"[؀-ۿऀ-ॿঀ-৿฀-๿぀-ヿ㐀-䶿一-鿿가-힯]"


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def score_units(text: Column) -> Column:
    """Units of the accuracy score: characters where over 30 % is CJK or Hangul, words otherwise."""
    cjk = F.regexp_count(text, F.lit(r"[぀-ヿ㐀-䶿一-鿿가-힯]")) > F.length(text) * 0.3
    low = F.lower(text)
    return F.when(cjk, F.regexp_extract_all(low, F.lit(r"[\p{L}\p{Nd}]"), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
