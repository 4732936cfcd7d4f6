"""English (Porter2) stemming, written from the published description of the algorithm.

Stemming is the one step the built-in functions cannot express well. It runs inside an Arrow
UDF that stems each distinct token of a batch once; tokens are neither shuffled nor joined.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Fixed values of the published algorithm: words with a given stem, and words left alone.
GIVEN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset(
    "inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())

# Suffix -> replacement, for the steps that apply inside the first region.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able",
    "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)

_REGION = re.compile("[aeiouy][^aeiouy]")
_EARLY_REGION = re.compile("(?:gener|commun|arsen)")
_SHORT_END = re.compile("(?:(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])", re.DOTALL)
_VOWEL = re.compile("[aeiouy]")


def _suffix(word: str, suffixes) -> str:
    """Longest of the suffixes that ends the word, or the empty string."""
    return max(filter(word.endswith, suffixes), key=len, default="")


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _mark_consonant_y(word: str) -> str:
    # One pass from the left: a y after a marked Y is a vowel again.
    out: list[str] = []
    for letter in word:
        vowel_before = bool(out) and out[-1] in "aeiouy"
        out.append("Y" if letter == "y" and (not out or vowel_before) else letter)
    return "".join(out)


def _ends_short(word: str) -> bool:
    return _SHORT_END.fullmatch(word) is not None


def _plural(word: str) -> str:
    end = _suffix(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past_and_participle(word: str, r1: int) -> str:
    end = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[:len(word) - len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not end or not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in DOUBLES:
        return base[:-1]
    return base + "e" if r1 >= len(base) and _ends_short(base) else base


def _derived(word: str, r1: int, r2: int) -> str:
    end = _suffix(word, STEP_2)
    at = len(word) - len(end)
    if end and at >= r1:
        before = word[at - 1:at]
        if end == "ogi":
            allowed = before == "l"
        else:
            allowed = end != "li" or before in tuple("cdeghkmnrt")
        if allowed:
            word = word[:at] + STEP_2[end]

    end = _suffix(word, STEP_3)
    at = len(word) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        word = word[:at] + STEP_3[end]

    end = _suffix(word, STEP_4)
    at = len(word) - len(end)
    if end and at >= r2 and (end != "ion" or word[at - 1:at] in ("s", "t")):
        word = word[:at]
    return word


def _final_letter(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e"):
        drop = at >= r2 or (at >= r1 and not _ends_short(word[:-1]))
    else:
        drop = word.endswith("ll") and at >= r2
    return word[:-1] if drop else word


def stem_word(word: str) -> str:
    """Stem of one lower-case English word."""
    if len(word) <= 2:
        return word
    if word in GIVEN:
        return GIVEN[word]
    word = _mark_consonant_y(word.removeprefix("'"))
    early = _EARLY_REGION.match(word)
    r1 = early.end() if early else _region(word, 0)
    r2 = _region(word, r1)

    word = word[:len(word) - len(_suffix(word, ("'s'", "'s", "'")))]
    word = _plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past_and_participle(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    return _final_letter(word, r1, r2).replace("Y", "y")


# Distinct words that are stemmed at a time, and whose stems a task keeps at most: what Python holds
# beside a batch is bounded by these, however many words a batch or a corpus has.
SLICE_WORDS, KNOWN_WORDS = 50_000, 700_000


def _stem_distinct(values: pa.Array, known: dict[str, str]) -> pa.Array:
    encoded = values.dictionary_encode()
    stems = [pa.array([], pa.string())]
    for at in range(0, len(encoded.dictionary), SLICE_WORDS):
        distinct = encoded.dictionary.slice(at, SLICE_WORDS).to_pylist()
        if len(known) + len(distinct) > KNOWN_WORDS:
            known.clear()
        for word in distinct:
            if word not in known:
                known[word] = stem_word(word)
        stems.append(pa.array([known[word] for word in distinct], pa.string()))
    return pa.concat_arrays(stems).take(encoded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem every token of a token array, in place."""
    known: dict[str, str] = {}
    for tokens in batches:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0)
        ends = pc.cumulative_sum(sizes).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        stems = _stem_distinct(tokens.flatten(), known)
        yield pa.ListArray.from_arrays(offsets, stems, mask=tokens.is_null())


@F.arrow_udf(T.StringType())
def stem(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem a column of single words."""
    known: dict[str, str] = {}
    for words in batches:
        yield _stem_distinct(words, known)


# Ship the code with the UDF, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
