"""Text functions: tokens, stems, clipping, templates, place notes."""

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CLIP = 700

#: The usual English words that carry no meaning for search (the public Snowball list).
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now".split()
)

#: Fixed values of the public English (Porter2) stemming algorithm: whole words with stems of their own, words that its first
#: step leaves as they are, and the endings of its later steps with what replaces them.
STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", -1), lambda x: x != "")


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased English word, by the public Porter2 rules. Words of two letters and other scripts stay.

    A ``y`` that is a consonant is written ``Y`` meanwhile. The two regions are what follows the first consonant after a vowel,
    in the word and again in that.
    """
    if len(word) <= 2 or not word.isascii():
        return word
    if word in STEMS:
        return STEMS[word]
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    start = _REGION.search(w)
    r1 = next((len(x) for x in ("gener", "commun", "arsen") if w.startswith(x)), start.end() if start else len(w))
    start = _REGION.search(w, r1)
    r2 = start.end() if start else len(w)

    # plurals
    e = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in WHOLE:
        return w
    # past and present forms
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = w[: len(w) - len(e)]
    if e in ("eed", "eedly"):
        w = base + "ee" if len(base) >= r1 else w
    elif e and re.search("[aeiouy]", base):
        w = base
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.match(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # endings that are made of others
    e = _ending(w, SECOND)
    base = w[: len(w) - len(e)]
    if e and len(base) >= r1 and (e != "ogi" or base.endswith("l")) and (e != "li" or base[-1:] in tuple("cdeghkmnrt")):
        w = base + SECOND[e]
    e = _ending(w, THIRD)
    base = w[: len(w) - len(e)]
    if e and len(base) >= (r2 if e == "ative" else r1):
        w = base + THIRD[e]
    e = _ending(w, FOURTH)
    base = w[: len(w) - len(e)]
    if e and len(base) >= r2 and (e != "ion" or base.endswith(("s", "t"))):
        w = base
    # a closing e or l
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def english(text: Column) -> Column:
    """Stems of the meaningful words of an English text."""

    @pandas_udf("array<string>")
    def stemmed(words: pd.Series) -> pd.Series:
        return pd.Series([list(map(stem, row)) for row in words], dtype=object)

    return stemmed(meaningful(tokens(text)))


def meaningful(words: Column) -> Column:
    """Without stop words."""
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS))


def first_terms(words: Column, n: int = 8) -> Column:
    """The first ``n`` different words in order of their bytes."""
    return F.slice(F.array_sort(F.array_distinct(words)), 1, n)


def clip(text: Column, n: int = CLIP) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def place_note(note: Column, place: Column, pattern: str, otherwise: Column) -> Column:
    """Replace a note's closing ``, place.``, or write another note where it has none."""
    return F.when(note.rlike(pattern), F.regexp_replace(note, F.lit(pattern), F.concat(F.lit(", "), place, F.lit(".")))).otherwise(otherwise)


def row_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
