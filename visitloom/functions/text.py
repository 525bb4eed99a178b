"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and what they fold to; marks that are dropped; digits of two scripts.
LETTERS, FOLDED = "أإآٱةى", "ااااهي"
MARKS = "ًٌٍَُِّْ"
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
TATWEEL = "ـ"


def fold(text: Column, letters: str = LETTERS, folded: str = FOLDED, marks: str = MARKS) -> Column:
    """Letters folded one to one, marks dropped."""
    return F.translate(text, letters + marks, folded)


def fold_digits(text: Column) -> Column:
    return F.translate(text, DIGITS + TATWEEL, "0123456789" * 2)


def small(text: Column) -> Column:
    """Small letters, as many characters as before: the capital I with a dot is the only one that becomes two."""
    return F.lower(F.translate(text, "\u0130", "i"))


def expand(text: Column, names: dict[str, str]) -> Column:
    """Standalone words replaced by what they stand for; words are parted by single spaces."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(known[w], w)), " ")


def clean(text: Column) -> Column:
    """White space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\v]+", " "))


def clean_clause(text: Column) -> Column:
    return F.regexp_replace(clean(text), r"[ .,;:!?]+$", "")


def repetition(text: Column) -> Column:
    """1 less the share of distinct words; 0 under four words."""
    words = F.split(clean(text), " ")
    return F.when(F.size(words) < 4, 0.0).otherwise(F.round(1 - F.size(F.array_distinct(words)) / F.size(words), 6))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"))


# Arabic-Indic and Persian digits, decimal and thousands separators.
DIGITS_AND_MARKS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9\u066b\u066c"


def numeric_sig(text: Column, folded: bool = True) -> Column:
    """The numbers of a text in order, in ASCII digits with a point; folded: those in the other scripts' digits too.

    Of the other scripts' marks the decimal one is a point and the one for thousands is passed over; only what is found
    is translated, not the text.
    """
    if not folded:
        return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)")), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    digit, passed = "0-9\u0660-\u0669\u06f0-\u06f9", "\u066c"
    found = F.regexp_extract_all(text, F.lit(f"[{digit}][{digit}{passed}]*(?:[.,\u066b]{passed}*[{digit}][{digit}{passed}]*)?"), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, DIGITS_AND_MARKS[:-1] + "," + passed, "01234567890123456789.."))


def unit_sig(text: Column, units: list[str], whole: bool = True) -> Column:
    """The units right behind a digit, in order; whole: no letter of a to z follows."""
    return units_in(F.lower(text), units, whole)


def units_in(low: Column, units: list[str], whole: bool = True) -> Column:
    """unit_sig of a text in small letters."""
    return F.regexp_extract_all(low, F.lit(r"\d ?(" + "|".join(sorted(units, key=lambda u: (-len(u), u))) + ")" + (r"(?![a-z])" if whole else "")))


def speech_sig(text: Column) -> Column:
    """Whether a text asks, anywhere in it."""
    return text.rlike("[?\u061f]")


def qualifier_sig(text: Column, groups: dict[str, list[str]]) -> Column:
    """The groups of the qualifiers in a text, in order; of phrases that overlap the longest counts."""
    return qualifiers_in(F.lower(text), groups)


def qualifiers_in(low: Column, groups: dict[str, list[str]]) -> Column:
    """qualifier_sig of a text in small letters."""
    group_of = {phrase: name for name, phrases in groups.items() for phrase in phrases}
    longest = sorted(group_of, key=lambda x: (-len(x), x))
    known = F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair])
    found = F.regexp_extract_all(low, F.lit(f"{_start(longest)}(?:{'|'.join(rf'\Q{x}\E' for x in longest)})"), F.lit(0))
    return F.transform(found, lambda x: known[x])


def _start(phrases: list[str]) -> str:
    """Looks ahead for a first character of any phrase: most places of a text fail here, before phrases are tried."""
    return "(?=[" + "".join(sorted({rf"\x{{{ord(p[0]):x}}}" for p in phrases})) + "])"


def once(value: Column, use) -> Column:
    """use(value), with value worked out once, wherever and however often use names it. Written out, an expression inside
    a condition is worked out anew at each of its places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A character of a word.
WORD = r"\p{L}\p{M}\p{N}"


def cues_in(low: Column, *cues: dict[str, list[str]]) -> Column:
    """The different cues that a text in small letters holds as whole words, at each place the longest that starts there;
    words of a cue are parted by a space, those of the text by anything that is no word."""
    words = {w for of in cues for every in of.values() for w in every}
    longest = sorted((w for w in words if all(x and all(unicodedata.category(c)[0] in "LMN" for c in x) for x in w.split(" "))), key=lambda w: (-len(w), w))
    if not longest:
        return F.array().cast("array<string>")
    either = "|".join(f"[^{WORD}]+".join(rf"\Q{x}\E" for x in w.split(" ")) for w in longest)
    # The match itself is empty, so that cues inside of others are found at their own places.
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"{_start(longest)}(?<![{WORD}])(?=({either})(?![{WORD}]))")))
    return F.transform(found, lambda x: F.regexp_replace(x, f"[^{WORD}]+", " "))


def kinds_of(found: Column, cues: dict[str, list[str]]) -> Column:
    """The kinds, in the order given, of which a cue is among those that cues_in found, or begins one of them."""

    def any_of(words: list[str]) -> Column:
        return F.exists(found, lambda x: reduce(or_, ((x == w) | F.startswith(x, F.lit(f"{w} ")) for w in words), F.lit(False)))

    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(kind)) for kind, words in cues.items()]))


def scope_sig(text: Column, cues: dict[str, list[str]]) -> Column:
    """The kinds of cues that a text holds as whole words, in the order given."""
    return once(cues_in(F.lower(text), cues), lambda found: kinds_of(found, cues))


def display(code: Column, names: Column) -> Column:
    """The name of a code in a map; else the code."""
    return F.coalesce(F.element_at(names, code), code)


def fingerprint(patient: Column, audio: Column, at: Column) -> Column:
    """sha256 over patient, audio hash and UTC second."""
    return F.sha2(F.concat_ws("|", patient.cast("string"), audio, F.date_format(at, "yyyy-MM-dd HH:mm:ss")), 256)


def merge_unique(first: Column, second: Column, key) -> Column:
    """The elements of two arrays in order, the first of each key; key maps an element to what tells it apart. For lists
    of a record, not for texts: each element looks through the keys before it."""
    every = F.concat(F.coalesce(first, F.slice(second, 1, 0)), F.coalesce(second, F.slice(first, 1, 0)))
    keys = F.transform(every, key)
    return F.filter(every, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def reasons(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def lab_status(value: Column, low: Column, high: Column, word: Column) -> Column:
    """low, normal or high by the range; without a number by the adjective."""
    by_number = F.when(value < low, "low").when(value > high, "high").when(value.isNotNull(), "normal")
    return F.coalesce(by_number, word)


def implies_plan(text: Column, past: str, direct: str, modal: str, action: str, near: int = 56) -> Column:
    """A direct phrase, or a modal followed by an action within near characters; nothing of the past. Regular expressions."""
    low = F.lower(text)
    return ~low.rlike(past) & (low.rlike(direct) | low.rlike(f"(?s)(?:{modal}).{{0,{near}}}(?:{action})"))


def route(labels: Column, sections: dict[str, str], priority: list[str]) -> Column:
    """The section of several labels: the first in priority that any of them has."""
    known = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])
    got = F.transform(labels, lambda x: F.coalesce(known[x], F.lit(priority[-1])))
    return F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(got, p)), F.lit(0))
