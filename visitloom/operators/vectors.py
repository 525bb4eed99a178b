"""Jobs over vectors: class statistics, distances, clusters, calibration of confidences."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scores import softmax
from visitloom.operators.aggregates import ece
from visitloom.operators.lineage import kept
from visitloom.operators.ranks import quantiles

SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def components(vectors: DataFrame) -> DataFrame:
    """label, i, x for each component of each vector (id, label, v)."""
    return vectors.select("id", "label", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def class_stats(vectors: DataFrame) -> DataFrame:
    """A row per class: label, n, mean (array); and the shared variance of residuals of each dimension (ddof 1, shrunk by
    0.001 towards their median, at least a millionth of it), the same array on each row."""
    long = components(vectors)
    per = long.groupBy("label", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s"))
    within = per.groupBy("i").agg((F.sum(F.col("s") - F.col("n") * F.col("m") * F.col("m")) / (F.sum("n") - 1)).alias("v"))
    target = within.where("v > 0").agg(F.percentile("v", F.lit(0.5)).alias("t"))
    shrunk = within.crossJoin(F.broadcast(target)).select("i", F.greatest(0.999 * F.col("v") + 0.001 * F.col("t"), 1e-6 * F.col("t"), F.lit(1e-12)).alias("v"))

    def listed(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])

    means = per.groupBy("label").agg(F.max("n").alias("n"), listed("m").alias("mean"))
    return means.crossJoin(F.broadcast(shrunk.agg(listed("v").alias("variance"))))


def class_distance(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """The distance to the nearest class centre under the shared variances; stats are few rows, one array of them."""
    table = stats.agg(F.array_sort(F.collect_list(F.struct("label", "mean", "variance"))).alias("classes"))

    def gap(c: Column) -> Column:
        parts = F.transform(F.arrays_zip(F.col("v"), c["mean"].alias("m"), c["variance"].alias("s")), lambda z: (z["v"].cast("double") - z["m"]) * (z["v"].cast("double") - z["m"]) / z["s"])
        return F.struct(F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).alias("d"), c["label"].alias("label"))

    best = F.array_min(F.transform("classes", gap))
    return vectors.crossJoin(F.broadcast(table)).select("id", "label", best.alias("b")).select("id", F.col("label"), F.round("b.d", 6).alias("distance"), F.col("b.label").alias("nearest"))


def distance_quantiles(distances: DataFrame) -> DataFrame:
    """One row of exact quantiles of distance, 6 places."""
    shares = [0.5, 0.9, 0.95, 0.99, 0.995]
    found = quantiles(distances, "distance", shares)
    return distances.sparkSession.range(1).select(*[F.round(F.lit(v).cast("double"), 6).alias(f"p{str(q)[2:]}") for q, v in zip(shares, found, strict=True)])


def logits(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """id, gold, logits: minus the squared distance to each class mean, classes in order of label."""
    table = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("ps"))
    d = F.transform("ps", lambda p: -F.aggregate(F.zip_with("v", p, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return vectors.crossJoin(F.broadcast(table)).select("id", F.col("label").alias("gold"), F.transform(d, lambda x: F.round(x, 9)).alias("logits"))


def predicted(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """id, gold, pred, conf, hit, p_gold from logits; ties to the first class."""
    p = rows.withColumn("p", softmax(F.col("logits"), temperature))
    pred = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    return p.select("id", "gold", pred.alias("pred"), F.round(F.array_max("p"), 9).alias("conf"), (pred == F.col("gold")).alias("hit"), F.get("p", F.col("gold")).alias("p_gold"))


def calibrate(rows: DataFrame, steps: int = 60, levels: int = 3) -> DataFrame:
    """The temperature that calibrates best: 1, that of the least likelihood loss or that of the least error, by ECE, ties
    to 1. One row: temperature, ece.

    A ternary search needs the cost at two points a step; as the points of the next levels are known up to which way each
    step goes, one job evaluates all of levels steps: 2 * (2 ** levels - 1) temperatures exploded onto each row.
    """
    spark = rows.sparkSession

    def costs(temps: list[float]) -> dict[float, tuple[float, float]]:
        table = rows.withColumn("t", F.explode(F.array(*map(F.lit, temps))))
        scaled = table.withColumn("p", F.transform("logits", lambda x: F.exp((x - F.array_max("logits")) / F.col("t"))))
        total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        pred = F.array_position("logits", F.array_max("logits")) - 1
        each = scaled.select("t", (1 / total).alias("conf"), (pred == F.col("gold")).alias("hit"), F.greatest(F.get("p", F.col("gold")) / total, F.lit(1e-12)).alias("q"))
        loss = {r["t"]: r["nll"] for r in each.groupBy("t").agg(F.avg(-F.log("q")).alias("nll")).collect()}
        error = {r["t"]: r["ece"] for r in ece(each, by="t").collect()}
        return {t: (loss[t], error[t]) for t in temps}

    def search(which: int) -> float:
        low, high, done = 0.05, 10.0, 0
        while done < steps:
            spans, points = [(low, high)], []
            for _ in range(levels):
                points += [p for a, b in spans for p in (a + (b - a) / 3, b - (b - a) / 3)]
                spans = [s for a, b in spans for s in ((a, b - (b - a) / 3), (a + (b - a) / 3, b))]
            cost = costs(points)
            for _ in range(min(levels, steps - done)):
                a, b = low + (high - low) / 3, high - (high - low) / 3
                low, high = (low, b) if cost[a][which] < cost[b][which] else (a, high)
                done += 1
            if high - low < 1e-5:
                break
        return round((low + high) / 2, 4)

    candidates = [1.0, search(0), search(1)]
    found = costs(sorted(set(candidates)))
    best = min(candidates, key=lambda t: (found[t][1], abs(t - 1)))
    return spark.createDataFrame([(best, found[best][1])], "temperature double, ece double")


def mc_stats(samples: DataFrame) -> DataFrame:
    """Of (pass, id, class, p): mean variance over passes (population) and the share of passes off the majority."""
    spread = samples.groupBy("id", "class").agg(F.var_pop("p").alias("v"), F.avg("p").alias("m")).groupBy("id").agg(F.round(F.avg("v"), 8).alias("variance"), F.round(F.max("m"), 8).alias("confidence"))
    votes = samples.groupBy("id", "pass").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("vote")).groupBy("id", "vote").agg(F.count("*").alias("k"))
    off = votes.groupBy("id").agg(F.round(1 - F.max("k") / F.sum("k"), 6).alias("disagreement"))
    return spread.join(off, "id")


def separability(neighbours: DataFrame, a: object, b: object) -> DataFrame:
    """How often the nearest of two labels' vectors has the same label, and what that says. neighbours: label, other."""
    pure = neighbours.where(F.col("label").isin(a, b)).agg(F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("purity"))
    return pure.withColumn("band", F.when(F.col("purity") >= 0.8, "separable").when(F.col("purity") >= 0.6, "weak").otherwise("not separable"))


def mahalanobis(vectors: DataFrame) -> DataFrame:
    """Distances to the mean under the full covariance, shrunk by a thousandth of its mean variance.

    Tasks sum the moments of their rows and Spark sums those element by element, so one matrix of the dimension's size
    comes to the driver, whose only work is its pseudo-inverse.
    """

    def moments(frames):
        n, s, ss = 0, 0.0, 0.0
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_list()).astype(float)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [np.asarray(s).tolist()], "ss": [np.asarray(ss).ravel().tolist()]})

    parts = vectors.select("v").mapInPandas(moments, "n long, s array<double>, ss array<double>")
    long = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "ss")).alias("i", "x"))
    every = np.array([r["x"] for r in long.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    if not len(every):
        return vectors.select("id", F.lit(None).cast("double").alias("distance"))
    width = round((math.sqrt(4 * len(every) - 3) - 1) / 2)  # of 1 + d + d * d numbers
    n, s, ss = every[0], every[1 : 1 + width], every[1 + width :]
    d = len(s)
    mean = s / n
    cov = (ss.reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)
    precision = np.linalg.pinv(cov + 1e-3 * np.eye(d) * np.trace(cov) / d)

    def measure(frames):
        for f in frames:
            x = np.stack(f["v"].to_list()).astype(float) - mean if len(f) else np.zeros((0, d))
            yield pd.DataFrame({"id": f["id"], "distance": np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", x, precision, x))).round(6)})

    return vectors.select("id", "v").mapInPandas(measure, "id long, distance double")


def murmur(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 of 32 bits, signed: what Spark's HashingTF takes."""
    h, n, mask = seed, len(data), 0xFFFFFFFF
    for i in range(0, n, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        h ^= ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        if i + 4 <= n:
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


#: Words whose columns a task remembers, and texts that it multiplies at a time.
KNOWN_WORDS, TEXTS = 1 << 17, 256


def _gram_counts(vocabulary: int):
    """Small texts as the columns of their n-grams and how often each stands, both as bytes."""

    def run(batches):
        columns, known = {}, {}

        def of(word: str) -> list[int]:
            w = f" {word} "
            out = []
            for n in (2, 3, 4):
                for i in range(max(len(w) - n + 1, 1)):
                    g = w[i : i + n]
                    if g not in columns:
                        columns[g] = murmur(g.encode("utf-8", "replace")) % vocabulary
                    out.append(columns[g])
            return out

        for batch in batches:
            at, times = [], []
            for text in batch.column(1).to_pylist():
                cells = []
                for word in SPACES.split(text or ""):
                    if word:
                        if word not in known:
                            known[word] = of(word)
                        cells += known[word]
                counts = np.bincount(np.array(cells, np.int64), minlength=1)
                some = np.flatnonzero(counts)
                at.append(some.astype(np.int32).tobytes())
                times.append(counts[some].astype(np.int32).tobytes())
                if len(known) > KNOWN_WORDS:
                    known.clear()
                if len(columns) > 4 * KNOWN_WORDS:
                    columns.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["id", "at", "times"])

    return run


def _matrices(batch: pa.RecordBatch, weights: np.ndarray):
    """Rows of a batch (id, at, times) as matrices of weighted counts, TEXTS at a time: where they begin, matrix."""
    for i in range(0, batch.num_rows, TEXTS):
        part = batch.slice(i, TEXTS)
        at = [np.frombuffer(x, np.int32) for x in part.column(1).to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.int32) for x in part.column(2).to_pylist()])
        columns = np.concatenate(at)
        out = np.zeros((len(at), len(weights)))
        out[np.repeat(np.arange(len(at)), [len(x) for x in at]), columns] = times * weights[columns]
        yield i, out


def char_tfidf(texts: DataFrame, most: int = 64, vocabulary: int = 4096) -> DataFrame:
    """id and v: TF-IDF over character 2- to 4-grams within words, in up to most singular directions.

    N-grams are hashed to vocabulary columns, once for each different word of a task, and texts are stored as counted
    columns. The directions come from a randomised subspace iteration: each pass reads the counts, sends the tasks
    vocabulary x (most + 10) numbers, and as many are summed up over them; rows stay where they are. A column in a single
    text weighs nothing; a null text is an empty one.
    """
    spark = texts.sparkSession
    sc, wide = spark.sparkContext, min(vocabulary, most + 10)
    small = texts.select("id", F.lower("text").alias("text"))
    rows = kept(small.mapInArrow(_gram_counts(vocabulary), f"id {texts.schema['id'].dataType.simpleString()}, at binary, times binary"))

    def summed(part, shape: tuple[int, ...]) -> np.ndarray:
        """The sums over all tasks of what part adds up to an array for each of its batches."""

        def run(batches):
            out = np.zeros(shape)
            for batch in batches:
                part(batch, out)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        found = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]).reshape(shape))
        return found.treeReduce(np.add) if found.getNumPartitions() else np.zeros(shape)

    def held(batch, out):
        for x in batch.column(1).to_pylist():
            out[np.frombuffer(x, np.int32)] += 1
        out[-1] += batch.num_rows

    df = summed(held, (vocabulary + 1,))
    weights = np.where(df[:-1] >= 2, np.log((df[-1] + 1) / (df[:-1] + 1)), 0.0)

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        """A'A basis over all rows A, or basis'A'A basis."""
        sent = sc.broadcast(basis)

        def add(batch, out):
            for _, x in _matrices(batch, weights):
                y = x @ sent.value
                out += y.T @ y if gram else x.T @ y

        return summed(add, (basis.shape[1] if gram else basis.shape[0], basis.shape[1]))

    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(vocabulary, wide)))[0]
    for _ in range(4):
        basis = np.linalg.qr(product(basis, False))[0]
    _, turned = np.linalg.eigh(product(basis, True))
    directions = sc.broadcast(basis @ turned[:, ::-1][:, :most])

    def project(batches):
        for batch in batches:
            for i, x in _matrices(batch, weights):
                v = x @ directions.value
                offsets = np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(v)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], ["id", "v"])

    return rows.mapInArrow(project, "id long, v array<double>")


def cluster_label(vectors: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=42).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def seeded_mask(ids: np.ndarray, turn: int, width: int) -> np.ndarray:
    """Which components of each vector a pass keeps: three of ten go, by a generator seeded with the id and the pass."""
    return np.stack([np.random.default_rng([int(i) & 0x7FFFFFFF, turn]).random(width) >= 0.3 for i in ids]) if len(ids) else np.zeros((0, width), bool)


def score(vectors: DataFrame, model, below: float = 0.9, passes: int = 8, mask=seeded_mask) -> DataFrame:
    """id, label, confidence, entropy, variance, scored of vectors (id, v): model maps an array of them to probabilities.

    Vectors whose confidence is under below are scored again, passes times, with the components that mask (ids, pass,
    width) keeps; variance is the mean over classes of the variance over these passes, 0 for the others, which are scored
    once. entropy is a share of the largest possible. Masks depend on ids alone, so the result doesn't depend on batches.
    """

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x, ids = np.stack(f["v"].to_list()).astype(float), f["id"].to_numpy()
            p = np.asarray(model(x), float)
            most = np.take_along_axis(p, p.argmax(1)[:, None], 1)[:, 0]
            logs = np.where(p > 0, np.log(np.where(p > 0, p, 1.0)), 0.0)
            entropy = -(p * logs).sum(1) / math.log(max(2, p.shape[1]))
            again = np.flatnonzero(most < below) if passes > 1 else np.zeros(0, int)
            variance = np.zeros(len(x))
            if len(again):
                samples = np.stack([np.asarray(model(x[again] * mask(ids[again], k, x.shape[1])), float) for k in range(passes)])
                variance[again] = samples.var(axis=0).mean(axis=1)
            scored = np.where(np.isin(np.arange(len(x)), again), 1 + passes, 1)
            yield pd.DataFrame({"id": ids, "label": p.argmax(1), "confidence": most.round(6), "entropy": entropy.round(6), "variance": variance.round(8), "scored": scored.astype(np.int64)})

    return vectors.where("id is not null and v is not null").select("id", "v").mapInPandas(run, "id long, label long, confidence double, entropy double, variance double, scored long")
