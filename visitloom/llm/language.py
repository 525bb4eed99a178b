"""Language identification by the lowest cross-entropy under Kneser-Ney character models."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm import charlm
from visitloom.llm.common import is_held_out, stored
from visitloom.llm.lookups import joined

#: A document is rejected if its cross-entropy lies so many deviations over its language's median, but not before it has
#: gone the first, and in any case once it has gone the second, of these shares of the way to noise.
DEVIATIONS, LEAST_WAY, MOST_WAY = 8.0, 0.35, 0.75
#: Letters from which a document counts as long; cross-entropies are counted in steps of 1 / STEPS.
LONG, STEPS = 500, 256
#: Up to so many probabilities (n-grams times languages) are sent to all tasks, 4 bytes each; more are joined.
SHARED = 1 << 25
UNKNOWN = "und"
ADDED = "lang_pred string, score double, cross_entropy double, n_letters long"


def _scored(model: charlm.Model, langs: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without its last column, its text, and ADDED."""
    best, score, entropy, letters = [], [], [], []
    for _, _, some in charlm.pieces(batch.column(batch.num_columns - 1).to_pylist()):
        keys, starts, sizes = charlm.ngrams(some)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            own = keys[s : s + n]
            has = int(np.count_nonzero(own & charlm.mask(1)))
            letters.append(has)
            if not has or not langs:
                best.append(UNKNOWN), score.append(0.0), entropy.append(None)
                continue
            mean = np.zeros(len(langs))
            for i in range(0, n, charlm.CHUNK):
                mean += model.log_p(own[i : i + charlm.CHUNK]).sum(axis=0, dtype=np.float64)
            mean /= n
            k = int(np.argmax(mean))
            best.append(langs[k])
            score.append(float(1 / np.exp((mean - mean[k]) * min(n, 50)).sum()))
            entropy.append(float(-mean[k]))
    keep = [batch.column(i) for i in range(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*keep, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(letters, pa.int64())], [*batch.schema.names[:-1], *(x.split()[0] for x in ADDED.split(", "))])


def _with_shared(shared, langs: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield _scored(model, langs, batch)

    return run


class Identifier:
    """Scores texts with a model (charlm.MODEL, stored) of langs: sent to all tasks up to SHARED, joined beyond."""

    def __init__(self, model: DataFrame, langs: list[str]):
        self.model, self.langs, self.shared = model, langs, None
        if model.where(F.col("kind") <= charlm.ORDER).count() * max(1, len(langs)) <= SHARED:
            self.shared = model.sparkSession.sparkContext.broadcast(charlm.Model(model.toArrow(), len(langs)))

    def score(self, rows: DataFrame) -> DataFrame:
        """All columns of rows but the last, its text, and ADDED."""
        kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1]), ADDED])
        langs = self.langs
        if self.shared:
            return rows.mapInArrow(_with_shared(self.shared, langs), kinds)
        # What a letter has that was never seen belongs to every text.
        floor = self.model.where(F.col("kind") == charlm.CONTEXT).toArrow()

        def score(found: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
            own = pa.concat_tables([found.select(floor.column_names).cast(floor.schema), floor])
            return _scored(charlm.Model(own, len(langs)), langs, batch)

        return joined(rows, self.model, charlm.asked, score, kinds)


def median(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(lang_pred, name): the median of value, in steps of 1 / STEPS; each language's counts are a few thousand rows."""
    each = rows.groupBy("lang_pred", F.floor(value * STEPS).alias("step")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang_pred").orderBy("step")
    upto = each.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang_pred")))
    return upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang_pred").agg(((F.min("step") + 0.5) / STEPS).alias(name))


def limits(scored: DataFrame, noise: float) -> DataFrame:
    """(lang_pred, mid, between, within, way): of the documents learned from, the median cross-entropy, the spread between
    long ones, and of short ones the spread times the root of their letters; the way from the median to noise.

    Medians of absolute deviations, so a few odd documents move none of it, whatever the size of the table.
    """
    learned = scored.where("learned and cross_entropy is not null").select("lang_pred", "cross_entropy", "n_letters")
    mids = median(learned, F.col("cross_entropy"), "mid")
    off = learned.join(F.broadcast(mids), "lang_pred").withColumn("off", F.abs(F.col("cross_entropy") - F.col("mid")))
    long, short = F.col("n_letters") >= LONG, F.col("n_letters") < LONG
    spread = mids.join(median(off.where(long), F.col("off"), "between"), "lang_pred", "left").join(median(off.where(short), F.col("off") * F.sqrt("n_letters"), "within"), "lang_pred", "left")
    return spread.select("lang_pred", "mid", *(F.coalesce(F.col(c) * 1.4826, F.lit(x)).alias(c) for c, x in (("between", 0.05), ("within", 1.0))), (F.lit(noise) - F.col("mid")).alias("way"))


def identify(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Models of four-grams are learned per language from all rows with a lang whose id isn't held out. lang_pred is the
    language of the lowest cross-entropy per character; ties go to the first by code point. score is the share of the
    winner in the likelihoods of 50 characters (fewer, if the text is shorter). rejected: no letter, or a cross-entropy
    too far over the median of the language's documents that were learned from: DEVIATIONS times their spread (between
    documents, and one that shrinks with length), within LEAST_WAY and MOST_WAY of the way to random letters.

    Null and empty texts and texts without letters: `und`, score 0, rejected. Rows with a null lang or null doc_id are
    never learned from but get a row. Repeated rows get a row each. Without any row to learn from every text is `und`.
    Other columns of docs are ignored, but for those of carry, which the result has too (any but lang_pred, score,
    cross_entropy, n_letters, rejected). Very long texts are scored whole, a piece at a time.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang", *[c for c in carry if c not in ("doc_id", "text", "lang")])
    learn = rows.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r[0] for r in learn.select("lang").distinct().collect())
    ids = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)]) if langs else None
    if langs:
        model = stored(charlm.fitted(charlm.counted(learn.select("text", ids[F.col("lang")].cast("int").alias("cls")))))
    else:
        model = spark.createDataFrame([], charlm.MODEL)
    known = Identifier(model, langs)
    drawn = random.Random(7)
    letters = " ".join("".join(drawn.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(600))
    noise = known.score(spark.createDataFrame([(letters,)], "text string")).first()["cross_entropy"] or 0.0
    learned = F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"))
    kept = rows.select("doc_id", learned.alias("learned"), *[F.col(c).alias(f"carry_{c}") for c in carry if c != "doc_id"], "text")
    scored = stored(known.score(kept))
    deviation = DEVIATIONS * F.sqrt(F.pow("between", F.lit(2)) + F.pow("within", F.lit(2)) / F.col("n_letters"))
    limit = F.col("mid") + F.least(F.greatest(deviation, LEAST_WAY * F.col("way")), MOST_WAY * F.col("way"))
    out = scored.join(F.broadcast(limits(scored, noise)), "lang_pred", "left")
    return out.select(*[F.col(f"carry_{c}").alias(c) for c in carry if c != "doc_id"], "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > limit, F.col("cross_entropy").isNull()).alias("rejected"))
