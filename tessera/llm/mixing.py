"""Mixing sources to target weights by soft membership.

A softmax classifier, fitted on at most ``TRAIN_ROWS`` labelled documents (in the order of a hash of their doc_id), gives
every document its posterior over the domains.  Rates of the documents then start at 1 and are moved so that the domains'
expected token totals, the sum of rate * tokens * posterior, match the targets: projected gradient steps on the squared
residuals, weighted by the inverse of the domains' Gram matrix, each projected on rates of zero or more.  One step is one
aggregate over a narrow table; a document's rate is a fold over the steps so far, so no rates are kept or joined.  Steps go on
until every share is within ``CLOSE`` of its target; where ``ROUNDS`` of them do not get there, as when no document leans to a
domain that is asked for, a warning names what is left.

The classifier sees a few figures of style and the words, hashed into ``WORDS`` places.

Rows: a null or empty text has no tokens and keeps its rate from the posterior; a null doc_id is carried; repeated rows get
equal rates; null labels are not trained on, nor are doc_ids whose labels disagree; with no labels all domains are equally
likely; with no tokens all rates stay 1; an empty table gives no row.  Columns other than doc_id and text are ignored by
``rates`` and carried by ``mix``.
"""

from __future__ import annotations

import math
import operator
import warnings
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import map_arrow, map_rows, materialize, slices
from .toxicity import Matcher, SEED

TRAIN_ROWS = 8_000
ROUNDS, CLOSE = 200, 1e-6
WORDS = 512

# Domain -> condition on the labelled table.
DOMAINS = {"good": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"good": 0.80, "poor": 0.12, "toxic": 0.08}


def describer() -> Callable[[str | None], tuple[int, np.ndarray]]:
    """text -> (tokens, figures of its style and its words): tokens are runs of visible characters."""
    insults = Matcher({w: 1.0 for w in SEED}, ())

    def describe(text: str | None) -> tuple[int, np.ndarray]:
        t = text or ""
        words = t.split()
        n, m = len(words), max(1, len(t))
        lines = [x for x in t.split("\n") if x]
        again = sum(map(operator.eq, words, words[1:]))
        distinct = set(words)
        upper = sum(map(str.isupper, words))
        marks = [t.count(c) / m for c in "!|.,"]
        hits = insults.figures(t)[0] if n else 0.0
        places = np.zeros(WORDS)
        if n:
            as_bytes = " ".join(distinct).encode("utf-8", "surrogatepass").split(b" ")
            places[np.fromiter(map(zlib.crc32, as_bytes), np.int64, len(as_bytes)) % WORDS] = 1
            places /= max(1.0, places.sum() ** 0.5)
        style = [
            1.0, math.log1p(n) / 10, m / max(1, n) / 10, upper / max(1, n), again / max(1, n), len(distinct) / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)), *(min(1.0, 20 * x) for x in marks), sum(t.count(d) for d in "0123456789") / m,
            float(t.isascii()), min(1.0, hits), min(1.0, 20 * hits / max(1, n)), len(lines) / max(1, n),
        ]
        return n, np.concatenate([style, places])

    return describe


def softmax(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    z = x @ theta.T
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str], rows: int = TRAIN_ROWS) -> list[list[float]]:
    """Weights of the figures, one list per domain."""
    which: Column = F.lit(None).cast("int")
    for k, rule in enumerate(domains.values()):
        which = F.coalesce(F.when(F.expr(rule), k), which)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), which.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "domain")
    few = docs.sparkSession.createDataFrame(some.collect(), some.schema)  # at most ``rows`` pairs of integers

    def make():
        describe = describer()
        return lambda c: {"domain": c["domain"], "x": [describe(t)[1].astype("<f4").tobytes() for t in c["text"]]}

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    train = met.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text")  # a row per doc_id
    got = sorted((r["domain"], bytes(r["x"])) for r in map_rows(train, make, "domain int, x binary").collect())  # at most ``rows`` lists of figures
    width, n = len(describer()("")[1]), len(domains)
    theta = np.zeros((n, width))
    if got:
        x, y = np.frombuffer(b"".join(g[1] for g in got), "<f4").reshape(len(got), width).astype(float), np.eye(n)[[g[0] for g in got]]
        lr = len(got) / (0.5 * np.linalg.norm(x, 2) ** 2 + 1)
        speed, ahead = np.zeros_like(theta), theta
        for step in range(600):  # accelerated gradient with a small penalty
            new = ahead + lr * ((y - softmax(x, ahead)).T @ x / len(got) - 1e-4 * ahead)
            ahead, theta = new + step / (step + 3) * (new - theta), new
    return [[round(float(v), 9) for v in row] for row in theta]


def posterior(theta: list[list[float]]) -> Callable[[list[str | None]], tuple[list[int], list[list[float]]]]:
    """texts -> (tokens, posteriors rounded to six decimals)."""
    describe, weights = describer(), np.array(theta)

    def run(texts: list[str | None]) -> tuple[list[int], list[list[float]]]:
        tokens, out = [], []
        for a in range(0, len(texts), 256):
            both = [describe(t) for t in texts[a : a + 256]]
            tokens += [b[0] for b in both]
            out += softmax(np.array([b[1] for b in both]), weights).round(6).tolist()
        return tokens, out

    return run


def memberships(docs: DataFrame, theta: list[list[float]]) -> DataFrame:
    """(doc_id, n_tokens, p): the narrow table that the steps run over."""

    def make():
        f = posterior(theta)

        def read(c: dict[str, list]) -> dict[str, list]:
            n, p = f(c["text"])
            return {"doc_id": c["doc_id"], "n_tokens": n, "p": p}

        return read

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_tokens long, p array<double>")


def folded(steps: list[list[float]], p: str = "p") -> Column:
    """The rate after ``steps``: each is taken along the posterior, then cut at zero."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    along = lambda s: sum((s[k] * F.col(p)[k] for k in range(1, len(steps[0]))), s[0] * F.col(p)[0])
    return F.aggregate(moves, F.lit(1.0), lambda rate, s: F.greatest(F.lit(0.0), rate - along(s)))


def fit_rates(members: DataFrame, targets: list[float], rounds: int = ROUNDS, close: float = CLOSE) -> list[list[float]]:
    """The steps that bring the expected shares of the token total to ``targets`` (of sum 1)."""
    n = len(targets)
    tokens = F.col("n_tokens").cast("double")
    first = members.agg(F.sum(tokens).alias("all"), *[F.sum(tokens * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if not first["all"]:
        return []
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / first["all"]
    inverse = np.linalg.inv(gram + 1e-6 * np.eye(n))
    steps: list[list[float]] = []
    for _ in range(rounds):
        now = members.withColumn("rate", folded(steps)).agg(*[F.sum(F.col("rate") * tokens * F.col("p")[k]).alias(f"s{k}") for k in range(n)]).first()
        left = np.array([now[f"s{k}"] for k in range(n)]) / first["all"] - np.array(targets)
        if np.abs(left).max() <= close:
            return steps
        steps.append([round(float(v), 9) for v in inverse @ left])
    warnings.warn(f"shares differ from the targets by {np.round(left, 6).tolist()} before step {rounds}", stacklevel=2)
    return steps


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domains: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) of every document."""
    domains, targets = domains or DOMAINS, targets or TARGETS
    members = materialize(memberships(docs, fit_classifier(docs, labels, domains)), "memberships")
    steps = fit_rates(members, [targets[d] for d in domains])
    return members.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], folded(steps).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domains: dict[str, str]) -> DataFrame:
    """The documents, each as often as its rate says: the whole part, and once more if the rest beats a hash of the row.

    Each text is classified once: the posteriors are written beside the row, and the steps read those columns alone.
    """
    theta = fit_classifier(docs, labels, domains)
    schema = StructType([*docs.schema.fields, StructField("n_tokens ", LongType()), StructField("p ", ArrayType(DoubleType()))])

    def run(batches):
        import pyarrow as pa

        f = posterior(theta)
        for b in (part for whole in batches for part in slices(whole)):
            if b.num_rows:
                n, p = f(b.column(b.schema.names.index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], [*b.schema.names, "n_tokens ", "p "])

    beside = materialize(map_arrow(docs, run, schema), "posteriors")
    steps = fit_rates(beside.select(F.col("n_tokens ").alias("n_tokens"), F.col("p ").alias("p")), [targets[d] for d in domains])
    row = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    times = F.floor(folded(steps, "p ") + F.crc32(row) / 2**32).cast("int")
    kept = beside.withColumn("n_tokens ", times).where(F.col("n_tokens ") > 0)
    return kept.withColumn("n_tokens ", F.explode(F.sequence(F.lit(1), F.col("n_tokens ")))).select(*docs.columns)
