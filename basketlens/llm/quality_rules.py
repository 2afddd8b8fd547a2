"""Quality rules: base statistics of a text, then robust multivariate outliers.

A document that fails a base rule goes. The others become vectors of six
transformed statistics. For each (language, source) a minimum-covariance-
determinant estimate gives centre and scatter: from three deterministic starts,
concentration steps refit both to the half of the group nearest to the estimate
until its edge stops moving, and the result of least determinant counts. So
junk may be nearly half of a group. A document whose Mahalanobis distance
exceeds a chi-square quantile is an outlier and goes.

Every step is an aggregation over all rows of a group, with partial sums, so a
group of any size is spread over all tasks; no group is brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: The vector: name, SQL over the statistics, least standard deviation that is believed.
#: Most texts have no symbol, repeat or capital word at all, so a group's scatter
#: there can be nil; below these deviations a difference says nothing.
FEATURES = [
    ("log_words", "ln(n_words)", 0.7),
    ("word_length", "word_chars / n_words", 0.6),
    ("symbols", "n_symbols / word_chars", 0.012),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.08),
    ("repeats", "sqrt(n_repeat_words / n_words)", 0.12),
    ("capitals", "n_upper / word_chars", 0.03),
]
P = len(FEATURES)
#: Share of a group that an estimate rests on (the p + 1 rows more that keep a bare scatter
#: regular are not needed: the floors do that); rows that an estimate needs.
SUBSET, LEAST_ROWS = 0.5, 60
#: A group's rows are dealt to parts of about so many rows.
PART_ROWS = 1000
#: Rank accuracy of an edge (1 / so much of the rows); relative move below which an edge stands
#: still (above what the accuracy leaves open); fall of the log determinant that counts as one.
EDGE_ACCURACY, STILL, FALL = 10_000, 1e-3, 1e-6
#: Levels of the quantiles that starts are made from.
LEVELS = [k / 20 for k in range(21)]
#: Chance that a normal vector is called an outlier.
TAIL = 1e-6
WORDS_AT_ONCE = 1 << 20


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pair = code[:-1] * v + code[1:]
    if v ** 3 < 2 ** 62:
        key = pair[:-1] * v + code[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1][:-1] * v + code[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[order[1:][same] + k] = True
        hit[order[:-1][same] + k] = True
    return int(hit.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The values of ``STATS`` for one text."""
    words = text.encode().split()
    if not words:
        return (0,) * len(STATS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), sum(map(str.isupper, text)) if not text.islower() else 0)


def document_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``STATS`` (long). A null text has no words."""
    names = [c for c in docs.columns if c != text_col]
    inner = [f"__in_{k}" for k in range(len(names))]
    kept = docs.select(*[F.col(c).alias(i) for c, i in zip(names, inner)], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"{i} {kept.schema[i].dataType.simpleString()}" for i in inner) + "".join(f", {s} long" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(len(inner)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(inner))), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS)))], [*inner, *STATS])

    return kept.mapInArrow(run, schema).withColumnsRenamed(dict(zip(inner, names)))


# ---------------------------------------------------------------- minimum covariance determinant

def chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi_square_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dof) < p else (lo, mid)
    return hi


#: Makes the scatter of the inner ``SUBSET`` that of the whole, for normal data.
CONSISTENCY = SUBSET / chi_square(chi_square_quantile(SUBSET, P), P + 2)
CUTOFF = chi_square_quantile(1 - TAIL, P)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOOR = np.diag([f[2] ** 2 for f in FEATURES])
STATE = "grp string, parts long, start int, centre array<double>, inverse array<double>, logdet double, edge double, moving boolean"


def _symmetric(values: Iterable[float]) -> np.ndarray:
    """A matrix from its upper triangle, in the order of ``PAIRS``."""
    matrix = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, values):
        matrix[i, j] = matrix[j, i] = v
    return matrix


def _products(vector: list[str], over: str = "1D") -> Column:
    """Sums of the products of a vector's elements (SQL), in the order of ``PAIRS``."""
    return F.array(*[F.expr(f"sum({vector[i]} * {vector[j]} / {over})") for i, j in PAIRS])


def _to_parts(per_group: DataFrame) -> DataFrame:
    """A row per group with its number of ``parts`` -> the row once for each part that the group's rows are dealt to."""
    return per_group.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")


def _parts() -> Column:
    """The number of parts of an aggregated group: its rows carry it, so that no join has to fetch it."""
    return F.first("parts").alias("parts")


def _starts(x: DataFrame) -> DataFrame:
    """Three starts per group: medians and median deviations, the shortest half of
    each feature, and the medians with the scatter of the rows' directions."""
    middle = len(LEVELS) // 2
    quantiles = x.groupBy("grp").agg(_parts(), F.array(*[F.percentile_approx(F.col("x")[k], LEVELS, 1000) for k in range(P)]).alias("q"))
    spread = materialize(x.join(_to_parts(quantiles), ["grp", "part"]).groupBy("grp").agg(
        _parts(), F.first("q").alias("q"), F.array(*[F.percentile_approx(F.abs(F.col("x")[k] - F.col("q")[k][middle]), 0.5, 1000) for k in range(P)]).alias("mad")), "spread")
    z = x.join(_to_parts(spread), ["grp", "part"]).select("grp", "parts", "q", "mad", *[F.expr(f"(x[{k}] - q[{k}][{middle}]) / sqrt(pow(1.4826D * mad[{k}], 2) + {FEATURES[k][2] ** 2}D)").alias(f"z{k}") for k in range(P)])
    z = z.withColumn("zz", F.expr("greatest(" + " + ".join(f"z{k} * z{k}" for k in range(P)) + ", 1e-12D)"))
    signs = z.groupBy("grp").agg(_parts(), F.first("q").alias("q"), F.first("mad").alias("mad"), F.count("*").alias("n"), _products([f"z{k}" for k in range(P)], "zz").alias("signs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                q = np.array([list(v) for v in r.q])
                width = q[:, middle:] - q[:, :middle + 1]
                at = width.argmin(axis=1)
                low, high = q[np.arange(P), at], q[np.arange(P), at + middle]
                deviation = np.sqrt((1.4826 * np.array(r.mad)) ** 2 + np.diag(FLOOR))
                directions = P * _symmetric(r.signs) / r.n + 0.01 * np.eye(P)
                for start, (centre, scatter) in enumerate([
                        (q[:, middle], np.diag(deviation ** 2)),
                        ((low + high) / 2, np.diag(((high - low) * 0.7413) ** 2) + FLOOR),
                        (q[:, middle], directions * np.outer(deviation, deviation))]):
                    out.append((r.grp, r.parts, start, centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), math.inf, math.inf, True))
            yield pd.DataFrame(out, columns=["grp", "parts", "start", "centre", "inverse", "logdet", "edge", "moving"])

    return signs.mapInPandas(run, STATE)


def _group_estimates(moments: DataFrame) -> DataFrame:
    """Moments of the inner rows per group and start -> centre, the inverse and log determinant of the floored scatter.

    An estimate moves on while its edge moves and its determinant falls. Each
    step lowers the determinant, which the floors bound, so the steps end.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                mean = np.array(r.sums) / r.n
                scatter = CONSISTENCY * (_symmetric(r.products) / r.n - np.outer(mean, mean)) + FLOOR
                logdet = float(np.linalg.slogdet(scatter)[1])
                moving = logdet < r.last_logdet - FALL and abs(r.edge - r.last_edge) > STILL * r.edge
                out.append((r.grp, r.parts, r.start, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), logdet, r.edge, moving))
            yield pd.DataFrame(out, columns=["grp", "parts", "start", "centre", "inverse", "logdet", "edge", "moving"])

    return moments.mapInPandas(run, STATE)


#: Squared Mahalanobis distance of ``x`` to ``centre``.
DISTANCE = " + ".join(f"{1 if i == j else 2}D * inverse[{i * P + j}] * (x[{i}] - centre[{i}]) * (x[{j}] - centre[{j}])" for i, j in PAIRS)


def _estimates(x: DataFrame) -> DataFrame:
    """``grp, parts, part, x`` -> per group the centre and inverse scatter of least determinant.

    Rows meet what is known of their group part by part, so that a join deals a
    group to as many tasks as it has parts; sums are then taken per group, each
    task's own first.
    """
    spark = x.sparkSession
    state, settled = materialize(_starts(x), "estimate"), []
    while True:
        moving = state.filter("moving").select("grp", "parts", "start", "centre", "inverse", F.col("logdet").alias("last_logdet"), F.col("edge").alias("last_edge"))
        near = x.join(_to_parts(moving), ["grp", "part"])
        near = near.select("grp", "parts", "part", "start", "x", "last_logdet", "last_edge", F.expr(DISTANCE).alias("d"))
        edge = near.groupBy("grp", "start").agg(_parts(), F.percentile_approx("d", SUBSET, EDGE_ACCURACY).alias("edge"))
        inner = near.join(_to_parts(edge), ["grp", "part", "start"]).filter("d <= edge")
        moments = inner.groupBy("grp", "start").agg(
            _parts(), F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(P)]).alias("sums"), _products([f"x[{i}]" for i in range(P)]).alias("products"),
            F.max("edge").alias("edge"), F.max("last_edge").alias("last_edge"), F.max("last_logdet").alias("last_logdet"))
        state = materialize(_group_estimates(moments), "estimate")
        settled.append(state.filter("not moving"))
        spark._jvm.System.gc()  # plans and broadcasts of the steps so far: the driver goes on with little
        if state.filter("moving").isEmpty():
            break
    best = reduce(DataFrame.unionByName, settled).groupBy("grp").agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("best"))
    return materialize(best.select("grp", "best.*"), "estimate")


def robust_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with ``STATS``) plus ``distance``: squared Mahalanobis distance to the group's robust estimate.

    The group is ``keys``; rows of groups under ``LEAST_ROWS`` are judged by the
    estimate of all rows of the same first key (those of large groups too), and,
    where those are too few, by that of the whole table. Only where even that
    is too small the distance is null.
    """
    names = [f[0] for f in FEATURES]
    text = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    own, first = F.to_json(F.struct(*[t.alias(f"k{i}") for i, t in enumerate(text)])), F.to_json(F.struct(text[0].alias("k0")))
    base = rows.select("*", *[F.expr(f"cast({sql} as double)").alias(f"__{name}") for name, sql, _ in FEATURES], own.alias("__own"), first.alias("__first"))
    base = materialize(base.withColumn("__row", F.monotonically_increasing_id()), "vectors")
    sizes = materialize(base.groupBy("__own", "__first").agg(F.count("*").alias("n")), "sizes")
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    judges = sizes.join(sizes.groupBy("__first").agg(F.sum("n").alias("of_first")), "__first").select("__own", "__first", "n", "of_first", F.expr(
        f"case when n >= {LEAST_ROWS} then __own when of_first >= {LEAST_ROWS} then __first when {whole} >= {LEAST_ROWS} then '' end").alias("judge"))
    judges = materialize(judges, "judges")
    needed = judges.filter("judge is not null").select(F.col("judge").alias("grp")).distinct()
    # A row takes part in every estimate that some group needs: its own group's, its first key's, the whole table's.
    groups = judges.select("__own", F.explode(F.array(F.struct(F.col("__own").alias("grp"), "n"), F.struct(F.col("__first").alias("grp"), F.col("of_first").alias("n")),
                                                      F.struct(F.lit("").alias("grp"), F.lit(whole).cast("long").alias("n")))).alias("g")).select("__own", "g.*").distinct()
    member = groups.join(needed, "grp").withColumn("parts", F.ceil(F.col("n") / PART_ROWS))
    vectors = base.select("__row", "__own", F.array(*[f"__{n}" for n in names]).alias("x"))
    grouped = vectors.join(member, "__own").select("grp", "parts", F.pmod(F.xxhash64("__row", F.lit(5)), "parts").alias("part"), "x")
    best = _estimates(materialize(grouped, "grouped"))
    judged = judges.select("__own", "judge").join(best, F.col("judge") == F.col("grp")).select("__own", "centre", "inverse")
    distances = vectors.join(judged, "__own", "left").select("__row", F.expr(DISTANCE).alias("distance"))
    return base.join(distances, "__row").select(*rows.columns, "distance")


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, lang, source``, ``STATS``, ``base_failed``, ``distance`` and ``kept`` for every row.

    A text with under 50 words, or with over half of its words in repeated
    three-word windows, fails and takes no part in the estimates (its distance
    is null). Others are kept unless their distance exceeds ``CUTOFF``. A null
    text has no words; null languages and sources are groups of their own;
    repeated rows count as often as they come; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    stats = materialize(document_statistics(rows).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "statistics")
    passed = robust_distances(stats.filter("not base_failed"), ["lang", "source"])
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return passed.unionByName(failed).withColumn("kept", F.expr(f"not base_failed and coalesce(distance, 0D) <= {CUTOFF}"))
