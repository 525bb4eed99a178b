"""Terms of a lexicon in texts: one automaton over all of them, sent to the tasks, and spans claimed by precedence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of an automaton that is sent; a larger lexicon is cut into as many as it takes, and texts are scanned for each.
SENT = 1 << 19
#: Bytes of the texts that a task works on at a time.
CHUNK = 1 << 18
WORD = re.compile(r"[^\W_]+")
# What may stand before a term within its word.
PREFIXES = ("", "و", "ف", "ب", "ك", "ل", "ال", "وال", "فال", "بال", "كال", "لل")

HIT = [("kind", pa.string()), ("code", pa.string()), ("surface", pa.string()), ("at", pa.int32()), ("n_words", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]
HITS = "array<struct<kind: string, code: string, surface: string, at: int, n_words: int, begin: int, end: int>>"


def portions(batch: pa.RecordBatch, text: int = -1) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK bytes of its text column, so that what is found in them stays small."""
    sizes = pc.binary_length(batch.column(text % batch.num_columns)).fill_null(0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if sizes:
        yield batch.slice(begin)


def listed(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Lists of structs of rows of tuples."""
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(flat, fields, strict=True)], fields=[pa.field(n, t) for n, t in fields]))


def small(text: str) -> str:
    """Small letters, as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(terms: Iterable[tuple[str, str, str]]) -> ahocorasick.Automaton:
    """Of (kind, code, surface): finds a surface's words, with single spaces, up to the end of a word."""
    by: dict[str, list[tuple[str, str, str]]] = {}
    for kind, code, surface in sorted(set(terms)):
        if words := WORD.findall(surface):
            by.setdefault(" ".join(words) + " ", []).append((kind, code, surface))
    out = ahocorasick.Automaton()
    for key, named in by.items():
        out.add_word(key, (len(key), key.count(" "), named))
    out.make_automaton()
    return out


def found(text: str, terms: ahocorasick.Automaton, prefixes: frozenset[str], exact: bool) -> list[tuple]:
    """Every place of a term: kind, code, surface, first word, number of words, begin, end in characters.

    A term begins a word, but for a prefix; exact: what stands between its words is what the surface has there.
    """
    low = small(text)
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    line, ends, out = " ".join(words) + " ", [], []
    total = 0
    for w in words:
        total += len(w) + 1
        ends.append(total - 1)
    last = {e: i for i, e in enumerate(ends)}
    for at_end, (size, n, named) in terms.iter(line) if words else ():
        first = last[at_end] - n + 1
        begins = ends[first - 1] + 1 if first else 0
        prefix = line[begins : at_end - size + 1]
        if prefix in prefixes:
            begin, end = spans[first][0] + len(prefix), spans[last[at_end]][1]
            out += [(kind, code, surface, first, n, begin, end) for kind, code, surface in named if not exact or low[begin:end] == surface]
    return out


def claimed(hits: list[tuple]) -> list[tuple]:
    """Of each kind the longest surface first, the first place of it that no claim of the kind overlaps; one a code."""
    out, taken, done = [], set(), set()
    for hit in sorted(hits, key=lambda h: (-len(h[2]), h[2], h[1], h[3])):
        kind, code, _, at, n = hit[:5]
        words = [(kind, k) for k in range(at, at + n)]
        if (kind, code) not in done and taken.isdisjoint(words):
            out.append(hit)
            taken.update(words)
            done.add((kind, code))
    return out


def _parts(lexicon: DataFrame) -> Iterator[list[tuple[str, str, str]]]:
    """The lexicon in parts of about SENT terms: what is sent has a bound, whatever the lexicon's size."""
    terms = lexicon.where("surface is not null and kind is not null and code is not null").select("kind", "code", F.lower("surface").alias("surface"))
    parts = max(1, math.ceil(terms.count() / SENT))
    for p in range(parts):
        mine = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("surface"), F.lit(parts)) == p)
        yield [tuple(r) for r in mine.collect()]


def _scanner(sent, prefixes: frozenset[str], exact: bool, claim: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in chain.from_iterable(map(portions, batches)):
            hits = (found(text or "", terms, prefixes, exact) for text in batch.column(batch.num_columns - 1).to_pylist())
            rows = [claimed(h) if claim else h for h in hits]
            yield pa.RecordBatch.from_arrays([*batch.columns, listed(rows, HIT)], [*batch.schema.names, "hits"])

    return run


def _scanned(texts: DataFrame, terms: list[tuple[str, str, str]], prefixes: Iterable[str], exact: bool, claim: bool) -> DataFrame:
    """texts, whose last column is text, with an array of hits; without terms an empty one."""
    if not terms:
        return texts.withColumn("hits", F.array().cast(HITS))
    sent = texts.sparkSession.sparkContext.broadcast(automaton(terms))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(_scanner(sent, frozenset(prefixes), exact, claim), f"{columns}, hits {HITS}")


def find_terms(texts: DataFrame, lexicon: DataFrame, prefixes: Iterable[str] = ("",), exact: bool = False) -> DataFrame:
    """Every place of a lexicon's terms (kind, code, surface) in texts (id, text): id, kind, code, surface, at, n_words,
    begin, end.

    at counts words from 0, begin and end characters. Case doesn't count; a term stands at word boundaries, but for the
    prefixes, and with exact in the surface's own spacing. Texts are read once for each SENT terms and never shuffled.
    """
    out = None
    for terms in _parts(lexicon):
        one = _scanned(texts.select("id", "text"), terms, prefixes, exact, False).select("id", F.inline("hits"))
        out = one if out is None else out.unionByName(one)
    return out


def spans(texts: DataFrame, lexicon: DataFrame, prefixes: Iterable[str] = ("",), exact: bool = False) -> DataFrame:
    """texts with hits: their claimed mentions, longest surface of each kind first, one a code, no two of a kind overlapping.

    A lexicon of more than SENT terms is claimed over what its parts found, text by text.
    """
    parts = list(_parts(lexicon))
    columns = [c for c in texts.columns if c != "text"]
    rows = texts.select(*columns, "text")
    if len(parts) == 1:
        return _scanned(rows, parts[0], prefixes, exact, True)
    every: Column = F.array().cast(HITS)
    for k, terms in enumerate(parts):
        rows = _scanned(rows, terms, prefixes, exact, False).withColumnRenamed("hits", f"hits_{k}").select(*columns, *[f"hits_{j}" for j in range(k + 1)], "text")
        every = F.concat(every, F.col(f"hits_{k}"))
    merged = rows.select(*columns, "text", every.alias("hits"))

    def claim(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(portions(b, -2) for b in batches):
            kept = [claimed([tuple(x[n] for n, _ in HIT) for x in row]) for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed(kept, HIT)], batch.schema.names)

    return merged.mapInArrow(claim, merged.schema)


def mentions(texts: DataFrame, lexicon: DataFrame, prefixes: Iterable[str] = ("",), exact: bool = False) -> DataFrame:
    """The claimed mentions of each text, a row each: id, kind, code, surface, at, n_words, begin, end."""
    return spans(texts.select("id", "text"), lexicon, prefixes, exact).select("id", F.inline("hits"))


def triggers(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, code of each phrase (code, phrase) that a text (id, text) holds, anywhere and as it is written."""
    listed = phrases.where("phrase <> '' and code is not null").select("code", "phrase")
    n, out = max(1, math.ceil(listed.count() / SENT)), None
    for p in range(n):
        by: dict[str, list[str]] = {}
        for code, phrase in (listed if n == 1 else listed.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == p)).collect():  # at most about SENT
            by.setdefault(phrase, []).append(code)
        if not by:
            one = texts.where("false").select("id", F.lit("").alias("code"))
        else:
            terms = ahocorasick.Automaton()
            for phrase, codes in by.items():
                terms.add_word(phrase, codes)
            terms.make_automaton()
            sent = texts.sparkSession.sparkContext.broadcast(terms)

            def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    held = [sorted({c for _, codes in sent.value.iter(t) for c in codes}) if t else [] for t in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.string()))], ["id", "codes"])

            one = texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, codes array<string>").select("id", F.explode("codes").alias("code"))
        out = one if out is None else out.unionByName(one)
    return out if n == 1 else out.distinct()
