"""Mixing by soft membership: rates of documents that bring the expected tokens of domains to their targets.

A classifier learned from the labels gives each document's posteriors over domains. With t tokens and posteriors p,
a document at rate r adds r * t * p to the domains' expected tokens. Projected gradient least squares finds rates
of 0 or more (and at most `most`, if that is given), starting from 1, that bring those totals to the targets. Residuals are weighted by the inverse of
sum t p p', which makes the problem well conditioned, and steps are measured by tokens, so each step is
r - p . w (clipped) with one short vector w for all documents. A document's rate is therefore a replay of those
vectors, and the only state is the list of them: an iteration is one pass over (t, p) that returns a sum for each task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pick
from quarry.llm.encode import encoder, forget

DOMAINS = ("clean", "junk", "toxic")
#: Labelled documents to learn from at most, words in the vocabulary, and passes of the learner.
MAX_TRAIN, WORDS, EPOCHS = 8_000, 4_096, 200
SYMBOLS = "#*$%&|<>!"
DENSE = 6


def labelled(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, domain of at most max_train labelled documents, by the order of a hash of doc_id; toxic goes before quality.

    Rows with a null among doc_id, text and both labels are left out; of a document labelled twice all labels count.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    known = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    present = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = materialize(present.orderBy(F.xxhash64("doc_id"), "domain").limit(max_train), "mix-labels")
    return materialize(rows.join(F.broadcast(chosen), "doc_id"), "mix-train")  # at most max_train rows are broadcast


@dataclass
class Classifier:
    """Softmax regression on the words of a vocabulary that a text has and on a few shares of its characters and words."""

    words: dict[str, int]
    weights: np.ndarray  # (words + DENSE + 1) x domains
    mean: np.ndarray
    spread: np.ndarray

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and its posteriors. Null is an empty text."""
        n, places, dense = features(texts, self.words)
        z = ((dense - self.mean) / self.spread) @ self.weights[len(self.words) : -1] + self.weights[-1]
        for i, at in enumerate(places):
            if at:
                z[i] += self.weights[at].sum(axis=0)
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return n, e / e.sum(axis=1, keepdims=True)


def features(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    n, places, dense = np.zeros(len(texts)), [], np.zeros((len(texts), DENSE))
    for i, text in enumerate(texts):
        text = text or ""
        words = text.split()
        kinds = {x.strip(".,;:!?\"'#*$%&|<>()").lower() for x in set(words)}
        places.append([vocabulary[x] for x in kinds if x in vocabulary])
        n[i], chars = len(words), max(len(text), 1)
        some = max(len(words), 1)
        dense[i] = (np.log1p(len(words)), sum(map(text.count, SYMBOLS)) / chars, sum(map(str.isupper, words)) / some, len(kinds) / some, chars / some, text.count("\n") / some)
    return n, places, dense


def train(sample: DataFrame, words: int = WORDS, epochs: int = EPOCHS) -> Classifier:
    """Learn from the sample of labelled(): the words that tell the domains apart best by chi-square, then weights on the driver.

    What comes to the driver is bounded: the vocabulary, and for each sample document its places in it.
    Without any labelled document every domain has the same posterior.
    """
    k = len(DOMAINS)
    totals = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sum(totals.values())
    kinds = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    each = sample.select("domain", F.explode(kinds).alias("word")).where("word <> ''")
    counts = each.groupBy("word").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{d}") for d in range(k)], F.count(F.lit(1)).alias("n")).where("n >= 3")
    score = F.lit(0.0)
    for d in range(k):
        expected = F.col("n") * F.lit(max(totals.get(d, 0), 0.5) / max(size, 1))
        score = score + (F.col(f"n{d}") - expected) ** 2 / expected
    best = counts.orderBy(score.desc(), "word").limit(words).select("word").collect()
    vocabulary = {r.word: i for i, r in enumerate(best)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, places, dense = features(batch.column("text").to_pylist(), vocabulary)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "domain": batch.column("domain"), "places": pa.array(places, pa.list_(pa.int32())), "dense": pa.array(dense.tolist(), pa.list_(pa.float64()))})

    rows = sample.mapInArrow(found, "doc_id long, domain int, places array<int>, dense array<double>").toArrow().sort_by("doc_id")
    m = rows.num_rows
    if not m:
        return Classifier(vocabulary, np.zeros((len(vocabulary) + DENSE + 1, k)), np.zeros(DENSE), np.ones(DENSE))
    lists = rows.column("places").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    at, doc = lists.flatten().to_numpy(), np.repeat(np.arange(m), lengths)
    dense = np.asarray(rows.column("dense").to_pylist())
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = np.hstack([(dense - mean) / spread, np.ones((m, 1))])
    y = np.eye(k)[rows.column("domain").to_numpy()]
    w, v = np.zeros((len(vocabulary), k)), np.zeros((DENSE + 1, k))
    state = [np.zeros_like(a) for a in (w, v, w, v)]
    for step in range(1, epochs + 1):
        z = x @ v + np.stack([np.bincount(doc, weights=w[at, c], minlength=m) for c in range(k)], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - y) / m
        grads = (np.stack([np.bincount(at, weights=g[doc, c], minlength=len(w)) for c in range(k)], axis=1) + 1e-5 * w, x.T @ g + 1e-5 * v)
        for i, (a, d) in enumerate(zip((w, v), grads, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * d
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * d * d
            a -= 0.05 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)
    return Classifier(vocabulary, np.vstack([w, v]), mean, spread)


def memberships(docs: DataFrame, model: Classifier, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text_hash, n_tokens, p (posteriors), from whole texts: a row for each row. Tokens are the vocabulary's ids, or words without one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary's size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, counts=True) if tokenizer else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                n, p = shared.value.posteriors(texts)
                tokens = count([x or "" for x in texts]) if count else n.astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(tokens, pa.int64()), pa.array(p.tolist(), schema.field("p").type)], schema=schema)

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(scored, "doc_id long, text_hash long, n_tokens long, p array<double>")


@dataclass
class Fit:
    history: list[tuple[list[float], float]]  # step vectors and momenta
    most: float | None
    totals: np.ndarray  # expected tokens at the rates found
    targets: np.ndarray
    natural: np.ndarray  # at rate 1

    @property
    def met(self) -> bool:
        """Whether every domain's total is within a thousandth of all target tokens. With a bound on rates, or a domain that
        hardly any document has, targets may be out of reach; the totals are then the nearest that were found."""
        return bool(np.abs(self.totals - self.targets).max() <= 1e-3 * max(self.targets.sum(), 1.0))


def replay(p: np.ndarray, history: list, most: float | None) -> np.ndarray:
    """Rates of documents with posteriors p after these steps."""
    r = before = np.ones(len(p))
    for w, momentum in history:
        y = r + momentum * (r - before)
        before, r = r, np.clip(y - p @ np.asarray(w), 0.0, most)
    return r


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("p").flatten().to_numpy().reshape(-1, len(DOMAINS))


def fit_rates(members: DataFrame, shares: dict[str, float], budget: float | str | None = None, most: float | None = None, steps: int = 60, tolerance: float = 1e-6) -> Fit:
    """Rates for targets shares * budget. budget: tokens in all, by default as many as there are; 0: as many as leave no target
    above what there is; a domain's name: as many as make that domain's target just what there is of it.

    Stops when the residuals are within tolerance of the budget, or when they and the step have settled, or after `steps` passes;
    the result tells what was reached, and a warning is given if that isn't the targets.
    Sums are added in the order of tasks, so a run repeats exactly on the same splits.
    """
    k = len(DOMAINS)
    want = np.asarray([shares.get(d, 0.0) for d in DOMAINS])
    want = want / want.sum()

    def sums(history: list, gram: bool) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            total = np.zeros(k * k if gram else k)
            for batch in batches:
                p, t = _matrix(batch), batch.column("n_tokens").to_numpy().astype(float)
                total += ((p * t[:, None]).T @ p).ravel() if gram else (t * replay(p, history, most)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

        rows = members.mapInArrow(add, "x array<double>").collect()  # a row for each task, in their order
        return np.sum([r.x for r in rows], axis=0) if rows else np.zeros(k * k if gram else k)

    natural, gram = sums([], False), sums([], True).reshape(k, k)
    if budget is None:
        budget = float(natural.sum())
    elif isinstance(budget, str):
        budget = float(natural[DOMAINS.index(budget)] / want[DOMAINS.index(budget)])
    elif budget == 0:
        budget = float(min(n / s for n, s in zip(natural, want, strict=True) if s > 0))
    targets = want * budget
    weigh = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    history: list[tuple[list[float], float]] = []
    now = before = natural
    momentum, theta = 0.0, 1.0
    for _ in range(steps):
        if np.abs(now - targets).max() <= tolerance * max(budget, 1.0):
            break
        residual = now + momentum * (now - before) - targets
        history.append(((weigh @ residual).tolist(), momentum))
        before, now = now, sums(history, False)
        if len(history) > 1 and np.abs(now - before).max() <= 1e-9 * max(budget, 1.0):
            break
        after = (1 + np.sqrt(1 + 4 * theta * theta)) / 2
        momentum, theta = (theta - 1) / after, after
        loss = lambda s: (s - targets) @ weigh @ (s - targets)
        if loss(now) > loss(before):  # restart the momentum
            momentum, theta = 0.0, 1.0
    fit = Fit(history, most, now, targets, natural)
    if not fit.met:
        warnings.warn(f"mixing: targets {targets.round().tolist()} aren't met; reached {now.round().tolist()}", stacklevel=2)
    return fit


def rated(members: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text_hash, n_tokens, p_<domain>, rate, and copies: the rate's whole part, and one more by a hash of doc_id with its
    fraction's chance; and, alike in all rows, wanted_<domain> and reached_<domain>, the expected tokens asked for and found.

    The hash is of doc_id alone, so what a document gets doesn't hang on the others. Null doc_id is one key.
    """
    history, most = fit.history, fit.most
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), *[(f"p_{d}", pa.float64()) for d in DOMAINS], ("rate", pa.float64())]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            p = _matrix(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc_id", "text_hash", "n_tokens")], *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1])], pa.array(replay(p, history, most))], schema=pa.schema(fields))

    out = members.mapInArrow(rate, "doc_id long, text_hash long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    told = {f"{name}_{d}": F.lit(float(x)) for name, each in (("wanted", fit.targets), ("reached", fit.totals)) for d, x in zip(DOMAINS, each, strict=True)}
    return out.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("long")).cast("long")).withColumns(told)


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], tokenizer: str | None = None, budget: float | str | None = None, most: float | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rates for all documents: rated() of memberships() under the fit for these shares.

    Null text has no tokens; it gets a rate but weighs nothing. Rows that repeat a document count each and get the
    same rate. Empty tables give an empty result. Other columns are left out.
    """
    model = train(labelled(docs, labels, max_train))
    members = materialize(memberships(docs, model, tokenizer), "mix-members")
    return rated(members, fit_rates(members, shares, budget, most))
