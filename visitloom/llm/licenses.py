"""Licence scans: a positional index of rare licence words, with key phrases verified in place."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import columns

# The base phrases with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Mandatory key phrases of further licences, with their labels; each of a label's phrases must stand.
MORE = (
    ("agpl", ("gnu affero general public license",)),
    ("apache-2.0", ("apache license version 2 0",)),
    ("bsd", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("cc-by-nc", ("cc by nc",)),
    ("cc-by-nd", ("cc by nd",)),
    ("cc-by-sa", ("cc by sa",)),
    ("cc0", ("creative commons zero",)),
    ("gpl-2", ("general public license version 2",)),
    ("gpl-3", ("general public license version 3",)),
    ("isc", ("permission to use copy modify and or distribute this software",)),
    ("lgpl", ("lesser general public license",)),
    ("mit", ("mit license",)),
    ("mit-text", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("mpl-2.0", ("mozilla public license",)),
    ("unlicense", ("free and unencumbered software released into the public domain",)),
)
#: Words of a phrase that are looked up, rarest first; the others are only verified.
ANCHORS = 2
#: White space for every byte that belongs to no word, with A to Z in small letters.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def templates() -> list[tuple[str, bool, tuple[bytes, ...]]]:
    """(label, whether it is a base phrase, its words)."""
    out = [(label, True, tuple(phrase.encode().split())) for phrase, label in BASE]
    return out + [(label, False, tuple(phrase.encode().split())) for label, phrases in MORE for phrase in phrases]


def _document_counts(vocabulary: frozenset[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in columns(batch, "text")[0]:
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": pa.array(list(seen.values()), pa.int64())})

    return run


def _scanner(postings: dict[bytes, list[tuple[int, int]]], phrases: list[tuple[str, bool, tuple[bytes, ...]]]):
    looked_up = frozenset(postings)
    n_anchors = Counter(t for places in postings.values() for t, _ in places)
    mandatory = Counter(label for label, _, _ in phrases)

    def scan(text: str | None) -> tuple:
        found = words(text)
        votes: Counter[tuple[int, int]] = Counter()
        if not looked_up.isdisjoint(found):
            for i, word in enumerate(found):
                if word in looked_up:
                    for t, offset in postings[word]:
                        votes[t, i - offset] += 1
        base, labels, part = [], Counter(), 0.0
        verified: set[int] = set()
        for (t, start), n in votes.items():
            label, is_base, phrase = phrases[t]
            if n == n_anchors[t] and start >= 0 and tuple(found[start : start + len(phrase)]) == phrase:
                if is_base:
                    base.append((start, label))
                verified.add(t)
        for t in verified:
            labels[phrases[t][0]] += 1
        part = max((n / mandatory[label] for label, n in labels.items()), default=0.0)
        kept = {label for label, n in labels.items() if n == mandatory[label]}
        starts = [s for s, _ in base]
        return len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(kept)), part

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            got = list(zip(*map(scan, texts), strict=True)) if texts else [[]] * 7
            longs = [pa.array(x, pa.int64()) for x in (doc_ids, *got[:4])]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(got[4], pa.string()), pa.array(got[5], pa.string()), pa.array(got[6], pa.float64())], RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))

    return run


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): RESULT.

    Spark counts in how many documents each word of the phrases stands. The rarest ANCHORS words of each phrase make a
    positional index: word to phrase and offset. A text's words are looked up there; where all of a phrase's rare words
    point to the same start, the phrase is verified word by word. Places of base phrases are counted and may overlap;
    labels are those of which every phrase stands; score is the largest share of a label's phrases that stands.

    Words are as in `words` (A-Z in small letters; runs of 0-9, a-z and code points from U+0080). Null and empty texts have no words:
    zeros, null places, empty labels, score 0. Repeated rows get a row each; other columns of docs are ignored.
    """
    phrases = templates()
    vocabulary = frozenset(w for _, _, phrase in phrases for w in phrase)
    counts = docs.select("text").mapInArrow(_document_counts(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"].encode(): r["n"] for r in counts.collect()}  # at most as many rows as the phrases have words
    idf = {w: -math.log1p(n.get(w, 0)) for w in vocabulary}
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for t, (_, _, phrase) in enumerate(phrases):
        for offset in sorted(range(len(phrase)), key=lambda k: (-idf[phrase[k]], k))[:ANCHORS]:
            postings.setdefault(phrase[offset], []).append((t, offset))
    return docs.select("doc_id", "text").mapInArrow(_scanner(postings, phrases), RESULT)


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, over the table documents."""

    def places(phrase: tuple[bytes, ...]) -> str:
        test = " and ".join(f"w[i + {k + 1}] = '{x.decode()}'" for k, x in enumerate(phrase))
        return f"list_filter(range(len(w)), lambda i: {test})"

    base = [(label, places(p)) for label, is_base, p in templates() if is_base]
    count = " + ".join(f"len({x})" for _, x in base)
    every = f"list_concat({base[0][1]}, list_concat({base[1][1]}, {base[2][1]}))"
    names = ", ".join(f"case when len({x}) > 0 then '{label}' end" for label, x in base)
    shares: dict[str, list[str]] = {}
    for label, _, p in templates():
        shares.setdefault(label, []).append(f"(' ' || array_to_string(w, ' ') || ' ' like '% {b' '.join(p).decode()} %')::int")
    share = {label: f"(({' + '.join(x)})::double / {len(x)})" for label, x in shares.items()}
    labels = ", ".join(f"case when {x} = 1 then '{label}' end" for label, x in sorted(share.items()))
    return f"""
    with words as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents)
    select doc_id, len(w)::bigint n_words, ({count})::bigint n_base, list_min({every})::bigint first_word, list_max({every})::bigint last_word,
      concat_ws(',', {names}) base_labels, concat_ws(',', {labels}) labels, greatest({', '.join(share.values())})::double score
    from words"""
