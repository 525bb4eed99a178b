"""Full extraction from labelled texts: terms, numbers and drugs with their assertion, and the rules between them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.text import small
from visitloom.operators import lexicon as lx
from visitloom.operators.mentions import CUES, assertion, lab_reading


class Pattern(NamedTuple):
    """A number that a regular expression finds: its first match that no earlier pattern of the same group has claimed.

    The value is group 1, value2 group 2 if there is one; both in full where said in tens (short, up to 25); value is
    multiplied by scale of what the group named per says. unless: what mustn't stand in the match or the twelve characters
    after it. test: a test that it implies; status: what it says by itself.
    """

    kind: str
    code: str
    regex: str
    unit: str | None = None
    status: str | None = None
    test: str | None = None
    group: str | None = None
    short: bool = False
    scale: dict[str, float] = {}
    unless: str | None = None


# Runs of Latin letters that may name a drug, the labels under which an unknown one is flagged and its
# confidence, and words that name none.
LATIN = re.compile(r"[A-Za-z][A-Za-z\-]{3,}")
DRUG_LABELS, UNKNOWN = ("allergy", "medication", "treatment"), 0.4
NO_DRUGS = frozenset("allergic allergy drug drugs medication medications medicine tablet tablets capsule capsules daily twice once dose doses test tests scan result results normal high low blood urine patient history with without from this that".split())
#: Kinds whose mentions come straight from the lexicon.
PLAIN = ("symptom", "condition", "test", "procedure", "nutrition")
ENTITY = [("kind", pa.string()), ("code", pa.string()), ("surface", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("status", pa.string()), ("value", pa.float64()), ("value2", pa.float64()), ("unit", pa.string()), ("confidence", pa.float64()), ("asserted", pa.bool_())]
ENTITIES = "array<struct<kind: string, code: string, surface: string, begin: int, end: int, status: string, value: double, value2: double, unit: string, confidence: double, asserted: boolean>>"


def numbers(text: str, patterns: list[tuple[Pattern, re.Pattern]]) -> list[tuple]:
    """ENTITY rows of what patterns find, in their order, each followed by the test that it implies."""
    out, taken = [], []
    for p, compiled in patterns:
        for m in compiled.finditer(text):
            if p.group and any(g == p.group and m.start() < b and a < m.end() for g, a, b in taken):
                continue
            if p.unless and p.unless in text[m.start() : m.end() + 12]:
                continue
            taken.append((p.group, m.start(), m.end()))
            values = [float(x.replace(",", ".")) if x and re.fullmatch(r"\d+(?:[.,]\d+)?", x) else None for x in m.groups()[:2]] + [None, None]
            value, value2 = values[0], values[1]
            if p.short and value is not None and value <= 25:
                value, value2 = value * 10, None if value2 is None else value2 * 10
            if value is not None and "per" in compiled.groupindex:
                value *= p.scale.get(m.group("per") or "", 1.0)
                value2 = None
            out.append((p.kind, p.code, m.group(), m.start(), m.end(), p.status, value, value2, p.unit, 1.0, True))
            if p.test:
                out.append(("test", p.test, m.group(), m.start(), m.end(), None, None, None, None, 1.0, False))
            break
    return out


def unknown_drugs(text: str, known: list[tuple[int, int]], kind: str) -> list[tuple]:
    """ENTITY rows of Latin words that no known drug overlaps."""
    out = []
    for m in LATIN.finditer(text):
        if m.group().lower() not in NO_DRUGS and not any(m.start() < b and a < m.end() for a, b in known):
            out.append((kind, "unknown_drug", m.group(), m.start(), m.end(), None, None, None, None, UNKNOWN, True))
    return out


def _rest(patterns: list[Pattern]):
    """Numbers, known and unknown drugs of each text, beside the lexicon's hits."""
    compiled = [(p, re.compile(p.regex)) for p in patterns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(lx.portions(b, b.schema.get_field_index("text")) for b in batches):
            rows = []
            for label, text, hits in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "text", "hits")), strict=True):
                kind = "allergy" if label == "allergy" else "medication"
                drugs = [h for h in hits if h["kind"] == "drug"]
                own = numbers(text or "", compiled) + [(kind, h["code"], h["surface"], h["begin"], h["end"], None, None, None, None, 1.0, True) for h in drugs]
                if label in DRUG_LABELS:
                    own += unknown_drugs(text or "", [(h["begin"], h["end"]) for h in drugs], kind)
                rows.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, lx.listed(rows, ENTITY)], [*batch.schema.names, "rest"])

    return run


def _entities(texts: DataFrame, lexicon: DataFrame, patterns: list[Pattern], prefixes: Iterable[str], exact: bool) -> DataFrame:
    rows = lx.spans(texts.select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("text")), lexicon, prefixes, exact)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_rest(patterns), f"{columns}, rest {ENTITIES}")


def drug_mentions(texts: DataFrame, lexicon: DataFrame, prefixes: Iterable[str] = ("",)) -> DataFrame:
    """id, kind, code, surface, begin, end, confidence of drugs in labelled texts (id, text, label).

    Terms of the lexicon are allergies under that label, else medications; under DRUG_LABELS other Latin words of four
    letters or more are flagged as unknown, not taken for a drug.
    """
    rows = _entities(texts, lexicon.where("kind = 'drug'"), [], prefixes, False)
    return rows.select("id", F.inline("rest")).select("id", "kind", "code", "surface", "begin", "end", "confidence")


def extract(
    texts: DataFrame,
    lexicon: DataFrame,
    patterns: list[Pattern],
    *,
    cues: dict[str, list[str]] = CUES,
    levels: dict[str, list[str]] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    units: dict[str, str] | None = None,
    conditionals: Iterable[str] = ("if ",),
    scheduled: Iterable[str] = ("appointment", "follow up"),
    once: str = "puerperal_infection",
    follow_up: str = "follow_up_visit",
    prefixes: Iterable[str] = ("",),
    exact: bool = False,
) -> DataFrame:
    """id, kind, code, surface, begin, end, assertion, status, value, value2, unit, confidence of each mention in labelled
    texts (id, text, label).

    lexicon: kind (PLAIN, lab or drug), code, surface. The rules between mentions of a text: a procedure that is there
    under the label plan is planned; a follow-up is planned too where only a condition behind it made it hypothetical and
    a word of scheduling stands before that condition; of several mentions of the condition once, one is kept, the
    suspected one if there is; a lab that a pattern has found isn't taken from the lexicon again; a lab with a level or
    value is there, whatever its surroundings say; each lab of the lexicon implies its test. Empty texts hold nothing.

    All mentions of a text are one array, so rules are expressions within the row and nothing is shuffled.
    """
    levels, none = levels or {}, F.lit(None)
    rows = _entities(texts, lexicon, patterns, prefixes, exact)
    text, label = F.col("text"), F.col("label")
    at = [F.nullif(F.locate(c, small(F.col("text"))), F.lit(0)) - 1 for c in conditionals]
    first = F.least(*at) if len(at) > 1 else at[0]
    before = F.substring(small(F.col("text")), F.lit(1), F.coalesce(first, F.length("text")))
    planned_before = reduce(or_, [F.contains(before, F.lit(s)) for s in scheduled], F.lit(False))

    def entity(kind, code, surface, begin, end, said, status=none, value=none, value2=none, unit=none, confidence=1.0) -> Column:
        named = {"kind": kind, "code": code, "surface": surface, "begin": begin, "end": end, "assertion": said, "status": status, "value": value, "value2": value2, "unit": unit, "confidence": confidence}
        kinds = {"begin": "int", "end": "int", "value": "double", "value2": "double", "confidence": "double"}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(n, "string")).alias(n) for n, v in named.items()])

    def plain(h: Column) -> Column:
        said = assertion(text, h["begin"], h["end"], cues)
        late = (h["code"] == follow_up) & (said == "hypothetical") & (first > h["end"]) & planned_before
        procedure = F.when(late | ((label == "plan") & (said == "present")), F.lit("planned")).otherwise(said)
        return entity(h["kind"], h["code"], h["surface"], h["begin"], h["end"], F.when(h["kind"] == "procedure", procedure).otherwise(said))

    def other(r: Column) -> Column:
        said = F.when(r["asserted"] & r["status"].isNull(), assertion(text, r["begin"], r["end"], cues)).otherwise("present")
        return entity(r["kind"], r["code"], r["surface"], r["begin"], r["end"], said, r["status"], r["value"], r["value2"], r["unit"], r["confidence"])

    def by_range(code: Column, value: Column) -> Column:
        tests = [F.when((code == c) & value.isNotNull(), F.when(value < low, "low").when(value > high, "high").otherwise("normal")) for c, (low, high) in (ranges or {}).items()]
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")

    def lab(h: Column) -> Column:
        read = lab_reading(text, h["begin"], h["end"], levels, cues)
        status = F.coalesce(by_range(h["code"], read["value"]), read["qualifier"])
        said = F.when(status.isNotNull() | read["value"].isNotNull(), "present").otherwise(assertion(text, h["begin"], h["end"], cues))
        unit = F.coalesce(*[F.when(h["code"] == c, F.lit(u)) for c, u in (units or {}).items()], F.lit(None).cast("string"))
        implied = entity("test", F.concat(h["code"], F.lit("_test")), h["surface"], h["begin"], h["end"], "present")
        return F.array(entity("lab", h["code"], h["surface"], h["begin"], h["end"], said, status, read["value"], none, unit), implied)

    parsed = F.transform(F.filter("rest", lambda r: r["kind"] == "lab"), lambda r: r["code"])
    labs = F.filter("hits", lambda h: (h["kind"] == "lab") & ~F.array_contains(parsed, h["code"]))
    most = F.concat(F.transform(F.filter("hits", lambda h: h["kind"].isin(*PLAIN)), plain), F.transform("rest", other))

    def is_once(e: Column) -> Column:
        return (e["kind"] == "condition") & (e["code"] == once)

    chosen = F.coalesce(F.get(F.filter("most", lambda e: is_once(e) & F.coalesce(e["status"] == "suspected", F.lit(False))), F.lit(0)), F.get(F.filter("most", is_once), F.lit(0)))
    kept = F.filter("most", lambda e: ~is_once(e) | e.eqNullSafe(F.col("chosen")))
    table = rows.where("trim(text) <> ''").select("id", most.alias("most"), F.flatten(F.transform(labs, lab)).alias("labs")).withColumn("chosen", chosen)
    return table.select("id", F.inline(F.concat(kept, F.col("labs"))))


def refresh(entities: DataFrame, edited: DataFrame, lexicon: DataFrame, patterns: list[Pattern], **rules) -> DataFrame:
    """entities (those of extract) after items (id, text, label) were edited: theirs go, and what their texts hold now
    comes; an item that holds nothing any more has none. Items that aren't edited aren't read."""
    new = extract(edited, lexicon, patterns, **rules)
    return entities.join(edited.select("id").distinct(), "id", "left_anti").unionByName(new.select(entities.columns))


def numeric_facts(texts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """id, kind, code, value, value2, unit, begin, end of the numbers that patterns find in texts (id, text)."""
    rows = texts.select("id", F.lit("").alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast(lx.HITS).alias("hits"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_rest(patterns), f"{columns}, rest {ENTITIES}").select("id", F.inline("rest")).select("id", "kind", "code", "value", "value2", "unit", "begin", "end")
