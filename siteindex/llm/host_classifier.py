"""Quality and toxicity by hierarchical empirical Bayes over documents, hosts and paths.

Evidence. A naive Bayes score of the document's distinct words, from labelled rows;
words are kept whose classes differ clearly.
Hierarchy. The rate of a label has a beta prior at each level: a host's rate around the
corpus rate, a path's (host and language here) around its host's. Counts are of all
labelled rows, grouped by path, host and corpus. Each level's correlation rho, the share
of the variance that lies between groups, is fitted by beta-binomial moments over its
groups, adjusted to be positive; a group's posterior mean is (rho y + (1 - rho) m) /
(rho n + 1 - rho), with m the level above. The less the groups vary beyond sampling, the
nearer they stay to m, and sparse or unlabelled hosts and paths stay near it always.
Combination. The document's log odds are its evidence plus the path's posterior log odds
in place of the corpus's, ``host_weight`` of them.

Bounds. The naive Bayes tables hold words of at most ``max_labelled`` labelled rows and
are broadcast; rates are grouped tables that are written and joined.

Defined cases: null or wordless texts have no evidence and score by their host; null
hosts and languages are values of their own; unlabelled rows only get scores; without
labelled rows of both classes every probability is the smoothed base rate; labels that
repeat count as often as they stand; null labels are ignored; rows that repeat stay
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from .common import any_columns, arrow, texts_as_bytes

#: ASCII letters are lower-cased; ASCII characters but letters and digits separate words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _features(text: bytes) -> set[bytes]:
    found = set(text.translate(WORDS).split())
    words = text.count(b" ") + 1
    # Shares of marks and capitals in powers of two: shape is evidence too.
    for name, marks in ((b"symbols", b"#*$%&"), (b"bars", b"|"), (b"shouts", b"!")):
        found.add(b"\x01%s%d" % (name, min(9, (64 * sum(text.count(marks[i : i + 1]) for i in range(len(marks))) // words).bit_length())))
    lines = text.split(b"\n")
    found.add(b"\x01again%d" % (8 * (len(lines) - len(set(lines))) // len(lines)))
    found.add(b"\x01long%d" % min(9, len(text) // words // 4))
    return found


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], max_labelled: int = 200_000, min_documents: int = 3, min_z: float = 4.0, min_odds: float = 1.0) -> dict[str, tuple[dict[bytes, float], float]]:
    """For each label, log odds by feature and the log prior odds.

    Learns from about ``max_labelled`` labelled rows at most (a share of them by hash), so
    few that their ids are broadcast.
    """
    values = [F.when(F.col(k).isin(0, 1), F.col(k).cast("long")).alias(k) for k in names]
    marked = labels.where("doc_id is not null").select(F.col("doc_id").alias("label_id"), *values)
    n, share = marked.count(), 1 << 20
    if n > max_labelled:
        marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(share)) < F.lit(int(share * max_labelled / n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            ys = zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)
            for y, text in zip(ys, texts_as_bytes(batch.column(batch.num_columns - 1)), strict=True):
                at = [2 * i + v for i, v in enumerate(y) if v is not None]
                for w in (*_features(text), b""):
                    row = held.setdefault(w, [0] * (2 * len(names)))
                    for i in at:
                        row[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), *(pa.array([x[i] for x in held.values()], pa.int64()) for i in range(2 * len(names)))], names=["word", *columns])

    columns = [f"n{v}_{k}" for k in names for v in (0, 1)]
    pairs = docs.join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select(*names, "text")
    rows = arrow(pairs, count, "word binary, " + ", ".join(f"`{c}` long" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    rows = written(rows)
    total = rows.where(F.length("word") == 0).first()
    models: dict[str, tuple[dict[bytes, float], float]] = {}
    for k in names:
        n0, n1 = (total[f"n0_{k}"], total[f"n1_{k}"]) if total else (0, 0)
        prior = math.log((n1 + 0.5) / (n0 + 0.5))
        models[k] = {}, prior
        if n0 and n1:
            a, b = F.col(f"n0_{k}"), F.col(f"n1_{k}")
            odds = F.log((b + 0.5) / (n1 + 1.0)) - F.log((a + 0.5) / (n0 + 1.0))
            error = F.sqrt(1 / (b + 0.5) + 1 / (a + 0.5))
            # Odds count as far as they are sure: two standard errors nearer to even. Weak ones,
            # of which a text holds many that depend on each other, are left out.
            sure = F.signum(odds) * (F.abs(odds) - 2 * error)
            strong = rows.where((F.length("word") > 0) & (a + b >= min_documents) & (F.abs(odds) > min_z * error)).select("word", sure.alias("odds")).where(F.abs("odds") >= min_odds)
            models[k] = {bytes(r["word"]): r["odds"] for r in strong.toLocalIterator()}, prior
    return models


def evidence(docs: DataFrame, models: dict[str, tuple[dict[bytes, float], float]]) -> DataFrame:
    """``docs`` without its text plus the log odds of each label, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = [c for c in docs.columns if c != "text"]
    keys = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(sent.value[k][0], frozenset(sent.value[k][0]), sent.value[k][1]) for k in keys]
        for batch in batches:
            out: list[list[float]] = [[] for _ in keys]
            for text in texts_as_bytes(batch.column(batch.num_columns - 1)):
                words = _features(text)
                for o, (odds, known, prior) in zip(out, tables, strict=True):
                    o.append(prior + sum(odds[w] for w in sorted(known.intersection(words))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(o, pa.float64()) for o in out)], names=[*batch.schema.names[:-1], *(f"{k}_evidence" for k in keys)])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(f"{k}_evidence", T.DoubleType()) for k in keys)])
    return arrow(docs.select(*names, "text"), run, schema)


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def labelled_counts(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], host: Column, path: Column) -> DataFrame:
    """``host_``, ``path_`` and, for each label, ``n_`` (rows with a label of 0 or 1) and ``y_`` (of 1): over all labelled rows."""
    marked = labels.where("doc_id is not null").select(F.col("doc_id").alias("label_id"), *[F.when(F.col(k).isin(0, 1), F.col(k).cast("long")).alias(f"label_{k}") for k in names])
    rows = docs.select("doc_id", host.alias("host_"), path.alias("path_")).join(marked, F.col("doc_id") == F.col("label_id"))
    sums = [(f"n_{k}", F.count(f"label_{k}")) for k in names] + [(f"y_{k}", F.coalesce(F.sum(f"label_{k}"), F.lit(0))) for k in names]
    return rows.groupBy("host_", "path_").agg(*[c.alias(n) for n, c in sums])


def _correlation(variance: float, expected: float, error: float, spread: float, unit: float) -> float:
    """rho of a level: the excess of its variance over what sampling gives, as a share of ``spread``.

    The estimate d = excess / spread has the standard error e = ``error`` / spread without any
    excess; adjusted density maximisation, (d + sqrt(d^2 + 4 e^2)) / 2, keeps rho above zero.
    ``unit``, one more row's variance, keeps it below one.
    """
    if spread <= 0 or unit <= 0:
        return 0.0
    d, e = (variance - expected) / spread, error / spread
    return min((d + math.sqrt(d * d + 4 * e * e)) / 2, spread / (spread + unit))


def posteriors(counts: DataFrame, label: str) -> tuple[DataFrame, float]:
    """``host_``, ``path_``, ``{label}_host_rate`` and ``{label}_path_rate`` of every path in ``counts``; the corpus rate.

    rho of a level: over groups of n rows with mean r around m, E[sum n (r - m)^2] =
    v (G - 1) + rho v (N - sum n^2 / N - (G - 1)), v = m (1 - m). Paths add this up over hosts.
    """
    n, y, p = F.col(f"n_{label}"), F.col(f"y_{label}"), F.col("host_rate")
    hosts = counts.groupBy("host_").agg(F.sum(n).alias("n"), F.sum(y).alias("y"), F.sum(n * n).alias("n2"), F.sum((n > 0).cast("long")).alias("g"), F.sum(F.when(n > 0, y * y / n).otherwise(0.0)).alias("q"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum((F.col("n") > 0).cast("long")).alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.when(F.col("n") > 0, F.col("y") * F.col("y") / F.col("n")).otherwise(0.0)).alias("q")).first()
    total, ones, groups = whole["n"] or 0, whole["y"] or 0, whole["g"] or 0
    rate = (ones + 0.5) / (total + 1.0)
    v = rate * (1 - rate)
    mean = ones / total if total else 0.0
    spread = v * (total - (whole["n2"] or 0) / total - (groups - 1)) if total else 0.0
    rho = _correlation((whole["q"] or 0.0) - total * mean * mean, (groups - 1) * v, v * math.sqrt(2 * max(groups - 1, 0)), spread, v)
    hosts = hosts.withColumn("host_rate", (rho * F.col("y") + (1 - rho) * rate) / (rho * F.col("n") + (1 - rho)))
    host_v, parts = p * (1 - p), F.col("g") - 1
    inside = hosts.where("n > 0").agg(
        F.sum(F.col("q") - F.col("y") * F.col("y") / F.col("n")).alias("variance"),
        F.sum(host_v * parts).alias("expected"),
        F.sum(2 * host_v * host_v * parts).alias("error2"),
        F.sum(host_v * (F.col("n") - F.col("n2") / F.col("n") - parts)).alias("spread"),
    ).first()
    own = _correlation(inside["variance"] or 0.0, inside["expected"] or 0.0, math.sqrt(inside["error2"] or 0.0), inside["spread"] or 0.0, v)
    named = counts.join(hosts.select("host_", "host_rate"), "host_")
    path_rate = (own * y + (1 - own) * p) / (own * n + (1 - own))
    return named.select("host_", "path_", p.alias(f"{label}_host_rate"), path_rate.alias(f"{label}_path_rate")), rate


@any_columns
def classify(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "toxic"), host: str = "source", path: str = "lang", host_weight: float = 1.0, **parameters) -> DataFrame:
    """``docs`` without its text plus, for each label, evidence, host and path rate and probability."""
    models = train(docs, labels, names, **parameters)
    host_key = F.coalesce(F.concat(F.lit("h:"), F.col(host)), F.lit("null"))
    path_key = F.coalesce(F.concat(F.lit("p:"), F.col(path)), F.lit("null"))
    scored = written(evidence(docs, models).withColumns({"host_": host_key, "path_": path_key}))
    counts = written(labelled_counts(docs, labels, names, host_key, path_key))
    # Paths without labels stand at their host's rate, hosts without labels at the corpus's.
    every = scored.select("host_", "path_").distinct().join(counts, ["host_", "path_"], "left").na.fill(0)
    every = written(every)
    rates, corpus = every.select("host_", "path_"), {}
    for k in names:
        of_label, corpus[k] = posteriors(every, k)
        rates = rates.join(of_label, ["host_", "path_"])
    out = scored.join(written(rates), ["host_", "path_"])
    for k in names:
        shift = host_weight * (_logit(F.col(f"{k}_path_rate")) - _logit(F.lit(corpus[k])))
        out = out.withColumn(f"{k}_probability", _probability(F.col(f"{k}_evidence") + shift))
    return out.drop("host_", "path_")
