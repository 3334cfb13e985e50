"""Toxicity scores by weak supervision.

Many voters look for one word, word beginning or pattern each and abstain where they find nothing; one more fires where no lexicon voter
does, and the annotators of the labelled rows are one more, who abstain on all other rows. A
generative label model (a hidden label, and for every voter, the annotators included, how often it fires under either label) is fitted to
the votes on labelled and unlabelled rows by expectation maximization, from what the lexicon and pattern voters alone say; correlations between voters, beyond what the
label explains, share the weight of voters that say the same. Its posterior labels, which may overrule an annotator, train a linear classifier on words and word
beginnings, whose margins Platt scaling turns into scores. ``ToxicityModel.report`` says how far posterior and given labels differ.

Lexicon voters and the scaling come from a bounded sample of the labelled rows that are not held out; the label model sees a bounded sample of
unlabelled rows besides. What reaches the driver is bounded in rows and in bytes.

Defined results: null and empty texts have no feature and get the score of the bias; labels of unknown documents, null labels and labels outside
{0, 1} are left out; of several labels of one document the smallest counts; repeated documents are scored each; with labels of
one class only, every score is the share of label 1 (0.5 without any). An empty table gives no rows. Other columns pass through ``score_toxicity``,
unless they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import extended, forget, held_out, map_batches, platt, sigmoid, within_bytes, written
from tablewright.llm.words import Lookup, WordHasher

#: Labelled rows that are learned from, and rows without a label that are voted on, chosen by a hash of the id.
FIT_ROWS = 12_000
UNLABELLED_ROWS = 6_000
#: What a row without a label counts when rates are estimated, and when the linear model is fitted if its posterior is outside ``UNSURE``; else it is left out there.
UNTOLD, WEAKLY = 0.1, 0.25
UNSURE = (0.02, 0.95)
#: Bytes of features of these rows, beyond which no further row is taken.
FIT_BYTES = 128_000_000
#: One labelled row in so many judges the voters, and is not looked at when they are chosen.
JUDGE_EVERY = 3
THRESHOLD = 0.3
VOTERS = 400
VOCABULARY = 20_000
#: A key must be in so many sampled texts to be a voter or a feature.
LEAST_TEXTS = 4
_BEGINNINGS = (4, 5, 6, 7, 8)
#: Patterns that vote, by the share of characters or words they take: all of a voter's name, what it counts, and the least share.
_PATTERNS = tuple((f"{kind}{least:g}", kind, least) for kind in ("shouts", "capitals") for least in (0.01, 0.05, 0.2))


class Keys:
    """Words and word beginnings of a text as 64-bit keys."""

    def __init__(self):
        self.hasher = WordHasher()

    def of(self, text: str) -> np.ndarray:
        data = text.lower().encode()
        words = self.hasher.words(data)
        out = [words.hashes]
        raw = np.frombuffer(data, np.uint8)
        for size in _BEGINNINGS:
            starts = words.starts[words.sizes >= size]
            h = np.full(len(starts), size, np.uint64)
            for i in range(size):
                h = (h ^ raw[starts + i]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(32)
            out.append(h * np.uint64(0x9E3779B97F4A7C15))
        return np.concatenate(out)


def pattern_votes(text: str) -> np.ndarray:
    share = {
        "shouts": text.count("!") / max(1, len(text)),
        "capitals": sum(w.isupper() and len(w) > 1 for w in text.split()) / max(1, text.count(" ") + 1),
    }
    return np.array([share[kind] >= least for _, kind, least in _PATTERNS])


def voter_rates(votes: np.ndarray, post: np.ndarray, counts: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each voter fires under labels 1 and 0, and its weight: voters with correlated votes share one. ``counts`` is what each row counts."""
    ones, zeros = post * counts, (1 - post) * counts
    overall = votes.mean(axis=0)
    # Half a row of either label, with the voter's overall rate, keeps rates off zero.
    rate1 = np.clip((ones @ votes + 0.5 * overall) / (ones.sum() + 0.5), 1e-6, 1.0)
    rate0 = np.clip((zeros @ votes + 0.5 * overall) / (zeros.sum() + 0.5), 1e-6, 1.0)
    # Correlation of the votes that the label leaves unexplained.
    rest = votes - (post[:, None] * rate1 + (1 - post)[:, None] * rate0)
    sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
    linked = np.clip((rest.T @ rest) / len(votes) / np.outer(sd, sd), 0.0, 1.0)
    linked[linked < 0.2] = 0.0
    np.fill_diagonal(linked, 1.0)
    return rate1, rate0, 1.0 / linked.sum(axis=0)


def evidence(votes: np.ndarray, rates: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log ratio of label 1 to label 0 that the votes of each row make; a voter that abstains says nothing."""
    rate1, rate0, weight = rates
    return votes @ (weight * np.log(rate1 / rate0))


def scale(log_ratio: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor (never below 0, so that labels cannot change sides) and offset that fit log ratios to labels or their posteriors, by Newton steps that are halved until they help."""
    x, centre = log_ratio.astype(np.float64), float(log_ratio.mean())
    spread = float(x.std()) or 1.0
    x = (x - centre) / spread
    n1, n0 = float(y.sum()), float((1 - y).sum())
    target = np.clip(y.astype(np.float64), 1 / (n0 + 2), (n1 + 1) / (n1 + 2))
    at = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((np.logaddexp(0.0, z) - target * z).sum())

    for _ in range(50):
        p = sigmoid(at[0] * x + at[1])
        v = p * (1 - p)
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    factor = max(float(at[0]), 0.0)
    return factor / spread, float(at[1]) - factor * centre / spread


def label_model(
    votes: np.ndarray, start: np.ndarray, given: np.ndarray | float = 0.0, rounds: int = 40,
    told: np.ndarray | None = None, judges: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of ``votes`` (fires or abstains), and each voter's rate under labels 1 and 0.

    ``start`` is the first guess of the posterior; its mean is the share of label 1. ``given`` is further evidence (a log ratio for each row).
    ``told`` holds what annotators say (1, 0, or -1 where they abstain). They are one more voter, the last one, whose rates of saying 1 are
    estimated like the others'. Where they speak, the others' summed evidence is put on scale: a factor and an offset, estimated in each round,
    take up the correlations between many voters that pairs of them do not show. ``judges`` marks the rows that this is estimated on (all that
    annotators speak of, by default); it should be those that the voters were not chosen by.
    """
    votes = votes.astype(np.float32)
    prior = float(np.clip(start.mean(), 0.01, 0.99))
    post = start.astype(np.float32)
    spoken = told >= 0 if told is not None else np.zeros(len(votes), bool)
    judges = spoken if judges is None else judges
    counts = np.where(spoken | ~spoken.any(), 1.0, UNTOLD).astype(np.float32)
    scaled = spoken.any() and 0 < (told[judges] == 1).sum() < judges.sum()
    for _ in range(rounds):
        rates = voter_rates(votes, post, counts)
        log_ratio = evidence(votes, rates) + np.log(prior / (1 - prior))
        if scaled:
            slope, offset = scale(log_ratio[judges], post[judges])
            log_ratio = slope * log_ratio + offset
            ones, says = post[spoken], told[spoken] == 1
            right, wrong = ((p[says].sum() + 0.5) / (p.sum() + 1) for p in (ones, 1 - ones))
            log_ratio[spoken] += np.where(says, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        new = sigmoid(log_ratio + given).astype(np.float32)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4:
            break
    if scaled:
        rates = (np.append(rates[0], right), np.append(rates[1], wrong))
    return post.astype(np.float64), rates[0], rates[1]


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    #: Rows by label, share of labelled rows on the other side of the posterior, mean distance, how often annotators say 1 under labels 1 and 0.
    report: dict = field(default_factory=dict, compare=False)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.keys, self.lookup = model, Keys(), Lookup(model.keys)

    def margin(self, text: str) -> float:
        held = np.unique(self.lookup.find(self.keys.of(text))[1])
        return float(self.model.weights[held].sum()) + self.model.bias

    def score(self, text: str) -> float:
        return float(sigmoid(self.model.slope * self.margin(text) + self.model.offset))


def fit_linear(
    rows: list[np.ndarray], target: np.ndarray, size: int, penalty: float = 1e-4, rounds: int = 300, counts: np.ndarray | float = 1.0
) -> tuple[np.ndarray, float]:
    """Logistic regression on indicators with targets between 0 and 1, by gradient steps with momentum; ``counts`` is what each row counts."""
    counts = np.broadcast_to(np.asarray(counts, np.float64), (len(rows),))
    counts = counts / counts.mean()
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    w, bias = np.zeros(size), float(np.log(np.clip(target.mean(), 1e-4, 1 - 1e-4) / np.clip(1 - target.mean(), 1e-4, 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (sigmoid(np.bincount(of, w[flat], len(rows)) + bias) - target) * counts
        g = np.bincount(flat, error[of], size) / len(rows) + penalty * w
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, bias


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, unlabelled: int = UNLABELLED_ROWS, most_bytes: int = FIT_BYTES
) -> ToxicityModel:
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    judge = F.pmod(F.xxhash64(F.lit("judge"), "doc_id"), F.lit(JUDGE_EVERY)) == 0
    # A repeated id has one vote, that of its smallest text.
    sample = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("judge", judge), "labelled")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = float(np.clip(n1 / (n1 + n0), 1e-6, 1 - 1e-6)) if n1 + n0 else 0.5
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = Keys()
        y = batch.column("y").to_numpy()
        held = [np.unique(keys.of(t or "")) for t in batch.column("text").to_pylist()]
        every, at = np.unique(np.concatenate(held), return_inverse=True)
        size = [len(h) for h in held]
        chooses = np.repeat(~batch.column("judge").to_numpy(zero_copy_only=False), size)
        ones = np.repeat(y, size) == 1
        columns = [np.bincount(at, w, len(every)).astype(np.int64) for w in (ones, ~ones, ones & chooses, ~ones & chooses)]
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, columns)], ["key", *tallies])

    def log_ratio(ones: str, zeros: str) -> F.Column:
        return F.log((F.col(ones) + 0.5) / (n1 + 1.0)) - F.log((F.col(zeros) + 0.5) / (n0 + 1.0))

    tallies = ("ones", "zeros", "ones_chosen", "zeros_chosen")
    per_key = map_batches(sample, counts, "key long, " + ", ".join(f"{t} long" for t in tallies))
    per_key = per_key.groupBy("key").agg(*[F.sum(t).alias(t) for t in tallies])
    ratio = log_ratio("ones", "zeros")
    per_key = per_key.where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS).withColumn("ratio", ratio).where("abs(ratio) >= 1")
    told = per_key.withColumn("told", F.abs("ratio") * F.sqrt(F.greatest(F.col("ones") / n1, F.col("zeros") / n0)))
    # Voters are chosen without the rows that judge them.
    told = told.withColumn("voter", (log_ratio("ones_chosen", "zeros_chosen") >= 1) & (F.col("ones_chosen") + F.col("zeros_chosen") >= LEAST_TEXTS))
    table = told.orderBy(F.desc("told"), "key").limit(VOCABULARY).collect()
    table.sort(key=lambda r: r["key"] & 0xFFFFFFFFFFFFFFFF)
    vocabulary = np.array([r["key"] for r in table], np.int64).view(np.uint64)
    lexicon = sorted((i for i, r in enumerate(table) if r["voter"]), key=lambda i: (-table[i]["ones_chosen"] + table[i]["zeros_chosen"], table[i]["key"]))[:VOTERS]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    labelled_ids = labels.select(F.col("doc_id").cast("long")).where("doc_id is not null")
    # Ids are chosen first, so that only the chosen texts are moved.
    free = texts.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).join(labelled_ids, "doc_id", "left_anti")
    picked = free.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    others = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    voted_on = sample.unionByName(others.select("doc_id", F.lit(-1).alias("y"), "text", F.lit(False).alias("judge")))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, lookup = Keys(), Lookup(shared.value)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        held = [np.unique(lookup.find(keys.of(t))[1]).astype(np.int32).tobytes() for t in texts]
        votes = [np.packbits(pattern_votes(t)).tobytes() for t in texts]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "judge")), pa.array(held), pa.array(votes)], ["doc_id", "y", "judge", "held", "votes"])

    voted = written(map_batches(voted_on, features, "doc_id long, y int, judge boolean, held binary, votes binary"), "voted")
    got = sorted(within_bytes(voted, F.octet_length("held"), most_bytes), key=lambda r: r["doc_id"])
    forget(sample, voted)
    rows_held = [np.frombuffer(bytes(r["held"]), np.int32) for r in got]
    y = np.array([r["y"] for r in got])
    column = np.full(len(vocabulary), -1)
    column[lexicon] = np.arange(len(lexicon))
    votes = np.zeros((len(got), len(lexicon) + len(_PATTERNS) + 1), np.float32)
    for i, (r, held) in enumerate(zip(got, rows_held, strict=True)):
        fires = column[held]
        votes[i, fires[fires >= 0]] = 1
        votes[i, len(lexicon) : -1] = np.unpackbits(np.frombuffer(bytes(r["votes"]), np.uint8))[: len(_PATTERNS)]
        votes[i, -1] = not (fires >= 0).any()
    told = y >= 0
    # The first guess is what the voters alone say, with their rates on the labelled rows.
    start = evidence(votes, voter_rates(votes[told], y[told].astype(np.float32)))
    judges = told & np.array([r["judge"] for r in got], bool)
    if not 0 < (y[judges] == 1).sum() < judges.sum():
        judges = told
    slope, offset = scale(start[judges], y[judges])
    post, rate1, rate0 = label_model(votes, sigmoid(slope * start + offset), told=y, judges=judges)
    sure = told | (post <= UNSURE[0]) | (post >= UNSURE[1])
    taught = np.flatnonzero(sure)
    w, bias = fit_linear([rows_held[i] for i in taught], post[taught], len(vocabulary), counts=np.where(told, 1.0, WEAKLY)[taught])
    margins = np.array([w[h].sum() + bias for h, t in zip(rows_held, told, strict=True) if t])
    slope, offset = platt(margins, y[told])
    report = {
        "labelled": int(told.sum()), "unlabelled": int((~told).sum()), "weakly_labelled": int((sure & ~told).sum()), "weakly_toxic": int((sure & ~told & (post >= 0.5)).sum()),
        "overruled": int(((post >= 0.5) != (y == 1))[told].sum()), "distance": float(np.abs(post - y)[told].mean()),
        "annotators": [float(rate1[-1]), float(rate0[-1])],
    }
    return ToxicityModel(vocabulary, w, bias, slope, offset, report)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    docs = docs.drop("score", "predicted")

    def score(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, extended(docs, "score double, predicted int"))
