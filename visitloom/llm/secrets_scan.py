"""Secrets in texts: fixed patterns, and automata inferred from what the patterns find."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import columns, stored

#: Patterns by kind, the group that counts and its least characters; kinds in the order in which spans of one place stand.
KINDS = ("assign", "access", "hex", "format")
PATTERNS = {
    "assign": (re.compile(r"(?=[aAsStTpP])((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: One of these stands in every text in which the first pattern finds something.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: What may be a credential: runs of these characters, eight at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: What labels a candidate that no pattern finds. Of these the shape is learnt: what class each character is of.
ORDINARY, LETTERS = "ordinary", "letters"
SHAPE = str.maketrans("BCDEF" + "GHIJKLMNOPQRSTUVWXYZ" + "bcdef" + "ghijklmnopqrstuvwxyz" + "123456789", "A" * 5 + "L" * 20 + "a" * 5 + "l" * 20 + "0" * 9)
#: Prefix trees go DEPTH symbols deep; a state stands for this share of its label's values at least, and for EVIDENCE of them.
DEPTH, SHARE, EVIDENCE = 40, 1 / 4096, 8
#: States are merged unless their shares differ with this significance.
ALPHA = 0.01
#: A label with fewer different values gets no automaton. Each symbol is taken as seen this often more in every state.
FEWEST, PRIOR = 16, 0.05
#: A candidate is a secret if it is so many nats likelier as one, in all and a symbol, and no further from what its kind
#: needs a symbol than so many deviations (LEAST_DEVIATION nats at least) divided by the root of its length.
ODDS, ODDS_EACH, DEVIATIONS, LEAST_DEVIATION = 12.0, 0.4, 4.0, 0.5
#: Prefixes that a task counts before it sends them on; candidates scored at a time.
HELD, SCORED = 1 << 18, 1 << 16
END = len(SYMBOLS)
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def base_spans(text: str, longest: int) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of every pattern's matches; longest: the length of its longest candidate."""
    low, out = text.lower(), []
    may = {"assign": any(w in low for w in WORDS), "access": longest >= 16 and "AKIA" in text, "hex": longest >= 32}
    for kind, (pattern, group, least) in PATTERNS.items():
        for m in pattern.finditer(text) if may[kind] else ():
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind, m.group(group)))
    return out


def form(label: str, value: str) -> str:
    """What a label's automaton reads."""
    return value.translate(SHAPE) if label == ORDINARY else value


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each label's different values, those that a batch has."""
    for batch in batches:
        named: set[tuple[str, str]] = set()
        plain: set[str] = set()
        for text in columns(batch, "text")[0]:
            text = text or ""
            found = CANDIDATE.findall(text)
            plain.update(found)
            named.update((kind, value) for _, _, kind, value in base_spans(text, max(map(len, found), default=0)))
        yield pa.RecordBatch.from_arrays([pa.array([*(k for k, _ in named), *[ORDINARY] * len(plain)], pa.string()), pa.array([*(v for _, v in named), *plain], pa.string())], ["label", "value"])


def values(docs: DataFrame) -> DataFrame:
    """(label, value): the different credentials of each kind in all docs, and the different candidates beside them.

    A candidate that is or holds a credential is no ordinary one.
    """
    every = stored(docs.select("text").mapInArrow(_gathered, "label string, value string").distinct())
    named = every.where(F.col("label") != ORDINARY)
    plain = every.where(F.col("label") == ORDINARY).where(~F.col("value").rlike(r"(?i)(password|passwd|secret|token|api_?key)[:=]") & ~F.col("value").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}"))
    return named.unionByName(plain.join(named.select("value").distinct(), "value", "left_anti").select("label", "value"))


def _forms(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, Counter[str]], list[str]]]:
    """Of each batch, how many values of each label read alike, and the ordinary ones."""
    for batch in batches:
        by: dict[str, Counter[str]] = defaultdict(Counter)
        plain = []
        for label, value in zip(*columns(batch, "label", "value"), strict=True):
            by[label][form(label, value)] += 1
            if label == ORDINARY:
                plain.append(value)
        yield by, plain


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often what follows each prefix of at most DEPTH symbols; counts are sent on once HELD prefixes are known."""
    counts: Counter[tuple[str, str, int]] = Counter()
    number = {c: i for i, c in enumerate(SYMBOLS)}

    def flush() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in counts.items()]
        counts.clear()
        made = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["label", "prefix", "next", "n"])

    for by, _ in _forms(batches):
        for label, forms in by.items():
            for value, n in forms.items():
                for i in range(min(len(value), DEPTH) + 1):
                    counts[label, value[:i], number[value[i]] if i < len(value) else END] += n
                if len(counts) >= HELD:
                    yield flush()
    yield flush()


class Automaton:
    """A deterministic automaton: where each state goes with each symbol (-1: nowhere), and how often it did so or ended."""

    def __init__(self, goes: np.ndarray, counts: np.ndarray):
        self.goes, self.counts = goes, counts

    def costs(self) -> np.ndarray:
        """Nats of each symbol, and of the end, in each state; in the last row where no state is known."""
        shares = np.vstack([self.counts, self.counts.sum(axis=0)]) + PRIOR
        return -np.log(shares / shares.sum(axis=1, keepdims=True))

    def usual(self) -> tuple[float, float]:
        """Mean and deviation of the nats that a symbol of its own values takes."""
        costs, shares = self.costs()[:-1], self.counts / max(1.0, self.counts.sum())
        mean = float((costs * shares).sum())
        return mean, max(LEAST_DEVIATION, math.sqrt(float(((costs - mean) ** 2 * shares).sum())))

    def run(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, each) -> None:
        """Calls each(which values, their states, their next symbols) place by place, for values in one array of codes.

        A value whose state goes nowhere with a symbol goes on in the state without name, the last.
        """
        none = len(self.goes)
        goes = np.vstack([np.where(self.goes < 0, none, self.goes), np.full((1, self.goes.shape[1]), none)])
        order = np.argsort(-sizes, kind="stable")
        state = np.zeros(len(sizes), np.int64)
        falling, alive = -sizes[order], len(order)
        for i in range(int(sizes.max(initial=0)) + 1):
            alive = int(np.searchsorted(falling, -i, side="right"))
            going = int(np.searchsorted(falling, -i, side="left"))
            some = order[:going]
            if going <= 4 and i >= 256:
                for v in some.tolist():
                    self._walk(goes, codes, int(begins[v]), int(sizes[v]), i, int(state[v]), v, each)
                done = order[going:alive]
                each(done, state[done], np.full(len(done), END))
                return
            done = order[going:alive]
            if len(done):
                each(done, state[done], np.full(len(done), END))
            symbol = codes[begins[some] + i]
            if len(some):
                each(some, state[some], symbol)
                state[some] = goes[state[some], symbol]

    def _walk(self, goes: np.ndarray, codes: np.ndarray, begin: int, size: int, at: int, state: int, which: int, each) -> None:
        """The rest of one long value, symbol by symbol, a bounded number of them at a time."""
        while at < size:
            part = codes[begin + at : begin + min(size, at + SCORED)].tolist()
            states = []
            for symbol in part:
                states.append(state)
                state = goes.item(state, symbol)
            each(np.full(len(part), which), np.array(states), np.array(part))
            at += len(part)
        each(np.array([which]), np.array([state]), np.array([END]))


def _differ(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two states' shares of any symbol, or of the end, differ by more than Hoeffding's bound."""
    n, m = a.sum(), b.sum()
    if not n or not m:
        return False
    return bool((np.abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))).any())


def inferred(tree: dict[str, np.ndarray]) -> Automaton:
    """The automaton of a prefix tree (prefix -> counts of symbols and the end), its compatible states merged.

    States are taken by depth. The first is kept; each next one is merged into the first kept state that it and all below
    it agree with, or else kept, and what follows it comes up next.
    """
    names = sorted(tree, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(names)}
    counts = np.array([tree[p] for p in names], np.float64)
    goes = [[-1] * len(SYMBOLS) for _ in names]
    for p, i in number.items():
        if p and p[:-1] in number:
            goes[number[p[:-1]]][SYMBOLS.index(p[-1])] = i

    def agree(a: int, b: int) -> bool:
        pairs, seen = [(a, b)], set()
        while pairs:
            x, y = pairs.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            if _differ(counts[x], counts[y]):
                return False
            pairs += [(u, v) for u, v in zip(goes[x], goes[y], strict=True) if u >= 0 and v >= 0]
        return True

    def fold(a: int, b: int) -> None:
        """State b, a tree of its own, becomes part of a."""
        pairs = [(a, b)]
        while pairs:
            x, y = pairs.pop()
            counts[x] += counts[y]
            for s in range(len(SYMBOLS)):
                if (v := goes[y][s]) >= 0:
                    if goes[x][s] < 0:
                        goes[x][s] = v
                    elif goes[x][s] != v:
                        pairs.append((goes[x][s], v))

    kept, inside = [0], {0}
    while True:
        edge = [(u, s) for u in kept for s in range(len(SYMBOLS)) if goes[u][s] >= 0 and goes[u][s] not in inside]
        if not edge:
            break
        u, s = min(edge, key=lambda e: goes[e[0]][e[1]])
        new = goes[u][s]
        match = next((r for r in kept if agree(r, new)), None)
        if match is None:
            kept.append(new)
            inside.add(new)
        else:
            goes[u][s] = match
            fold(match, new)
    at = {old: i for i, old in enumerate(kept)}
    return Automaton(np.array([[at.get(v, -1) for v in goes[old]] for old in kept], np.int64), counts[kept])


def _encoded(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer("".join(found).encode("latin-1"), np.uint8)].astype(np.int64)
    sizes = np.array([len(x) for x in found], np.int64)
    return codes, np.cumsum(sizes) - sizes, sizes


def _passes(automata: dict[str, Automaton]):
    """How often each state of a label's automaton meets each symbol over whole values, and each letter in ordinary ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {label: np.zeros((len(a.goes) + 1, END + 1), np.int64) for label, a in automata.items()}
        letters = np.zeros((1, END + 1), np.int64)
        for by, plain in _forms(batches):
            for label, forms in by.items():
                if label in automata:
                    total, times = totals[label], np.array(list(forms.values()))
                    automata[label].run(*_encoded(list(forms)), lambda which, state, symbol, total=total, times=times: np.add.at(total, (state, symbol), times[which]))
            letters[0, :END] += np.bincount(_encoded(plain)[0], minlength=END)
        rows = [(label, int(i), int(j), int(t[i, j])) for label, t in [*totals.items(), (LETTERS, letters)] for i, j in zip(*np.nonzero(t), strict=True)]
        made = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["label", "state", "next", "n"])

    return run


def learn(known: DataFrame) -> tuple[dict[str, Automaton], np.ndarray]:
    """An automaton for each label of known (label, value) that has FEWEST values at least, and counts of ordinary letters.

    Spark counts what follows each prefix; states of a share of a label's values come to the driver, at most DEPTH / SHARE
    of a label whatever the input. What the merged states meet is then counted anew, over whole values, so that symbols
    beyond DEPTH and rare prefixes count too.
    """
    after = known.mapInArrow(_prefixes, "label string, prefix string, next int, n long").groupBy("label", "prefix", "next").agg(F.sum("n").alias("n"))
    states = after.groupBy("label", "prefix").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("counts"))
    states = stored(states.where(F.col("all") >= EVIDENCE))
    sizes = {r["label"]: r["all"] for r in states.where("prefix = ''").select("label", "all").collect()}  # a row a label
    least = F.lit(None).cast("double")
    for label, n in sizes.items():
        least = F.when(F.col("label") == label, max(EVIDENCE, n * SHARE)).otherwise(least)
    trees: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
    for r in states.where(F.col("all") >= least).select("label", "prefix", "counts").toLocalIterator():
        row = np.zeros(END + 1)
        row[list(r["counts"])] = list(r["counts"].values())
        trees[r["label"]][r["prefix"]] = row
    automata = {label: inferred(tree) for label, tree in trees.items() if sizes.get(label, 0) >= FEWEST}
    totals = {label: np.zeros((len(a.goes) + 1, END + 1)) for label, a in automata.items()} | {LETTERS: np.zeros((1, END + 1))}
    passes = known.mapInArrow(_passes(automata), "label string, state long, next long, n long").groupBy("label", "state", "next").agg(F.sum("n").alias("n"))
    for r in passes.toLocalIterator():
        totals[r["label"]][r["state"], r["next"]] = r["n"]
    for label, a in automata.items():
        a.counts = totals[label][:-1]
    return automata, totals[LETTERS][0, :END]


def within(letters: np.ndarray) -> np.ndarray:
    """Nats of each symbol once its class is known."""
    of = np.array([SYMBOLS.index(c.translate(SHAPE)) for c in SYMBOLS])
    counts = letters + PRIOR
    return -np.log(counts / np.bincount(of, counts, minlength=END)[of])


def likelihoods(automaton: Automaton, found: list[str]) -> np.ndarray:
    """Nats that an automaton needs for each of what it reads."""
    costs, total = automaton.costs(), np.zeros(len(found))
    automaton.run(*_encoded(found), lambda which, state, symbol: np.add.at(total, which, costs[state, symbol]))
    return total


def secrets(learnt: tuple[dict[str, Automaton], np.ndarray], found: list[str]) -> set[str]:
    """Candidates that some credential's automaton takes for much likelier than the ordinary one does, and as likely as
    its own credentials."""
    automata, letters = learnt
    out: set[str] = set()
    if ORDINARY not in automata:
        return out
    each = within(letters)
    for i in range(0, len(found), SCORED):
        some = found[i : i + SCORED]
        codes, begins, sizes = _encoded(some)
        plain = likelihoods(automata[ORDINARY], [form(ORDINARY, x) for x in some]) + np.add.reduceat(each[codes], begins)
        for label, automaton in automata.items():
            if label == ORDINARY:
                continue
            mean, deviation = automaton.usual()
            nats = likelihoods(automaton, some)
            gain, steps = plain - nats, sizes + 1
            usual = (nats / steps - mean) <= DEVIATIONS * deviation / np.sqrt(steps)
            out.update(some[j] for j in np.flatnonzero(usual & (gain >= ODDS) & (gain >= ODDS_EACH * sizes)).tolist())
    return out


def spans(text: str, longest: int, taken: set[str]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, and of candidates in taken that overlap none, in order."""
    base = base_spans(text, longest)
    out = [(start, KINDS.index(kind), end) for start, end, kind, _ in base]
    if taken:
        begins = sorted(start for start, _, _, _ in base)
        reach = list(accumulate((end for _, end in sorted((start, end) for start, end, _, _ in base)), max))
        for m in CANDIDATE.finditer(text):
            if m.group() in taken and not ((k := bisect_left(begins, m.end())) and reach[k - 1] > m.start()):
                out.append((m.start(), KINDS.index("format"), m.end()))
    return [(start, KINDS[k], end) for start, k, end in sorted(out)]


def _scanner(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            texts = [t or "" for t in texts]
            candidates = [set(CANDIDATE.findall(t)) for t in texts]
            taken = secrets(learnt, sorted(set().union(*candidates)))
            found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, k, b in spans(t, max(map(len, c), default=0), taken & c)] for t, c in zip(texts, candidates, strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "found"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, found (an array of kind, start, end, value), in order of place.

    Kinds: assign, access and hex are the patterns' matches, code points, end exclusive; format is a run of CANDIDATE that
    overlaps none of them and that an automaton inferred from their credentials takes for ODDS nats likelier than that of
    the shapes of ordinary runs does. With too few credentials of every kind there are no formats. Null and empty texts hold nothing;
    repeated rows and null ids stay; other columns are ignored.
    """
    learnt = docs.sparkSession.sparkContext.broadcast(learn(stored(values(docs))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(learnt), "doc_id long, found array<struct<kind: string, start: long, end: long, value: string>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what scan finds."""

    def said(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def held(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "format")
    counts = [held(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
