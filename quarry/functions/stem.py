"""English stemming by the published Porter2 rules, ASCII folding and stop words. Used for the content field only."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_VOWEL = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    special = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    after = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
    r1 = special if special is not None else (m.end() if (m := after.search(w)) else len(w))
    return r1, (m.end() if (m := after.search(w, r1)) else len(w))


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$", w) or re.match(f"^[{_VOWEL}][^{_VOWEL}]$", w))


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = re.sub(f"(^|[{_VOWEL}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # past and progressive
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(f"[{_VOWEL}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # suffixes in R1
    end = _longest(w, (*_STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    end = _longest(w, (*_STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]
    # suffixes in R2
    end = _longest(w, (*_STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def fold(word: str) -> str:
    """Letters without their accents."""
    return unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode() or word


def stemmed(tokens: Column) -> Column:
    """Tokens folded and stemmed, stop words left out."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: [stem(fold(w)) for w in words if w not in STOP_WORDS])

    return run(tokens)


def stemmed_tokens(text: Column) -> Column:
    from quarry.functions.text import tokens

    return stemmed(tokens(text))
