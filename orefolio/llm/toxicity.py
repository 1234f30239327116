"""Operator 10: toxicity by weak supervision.

Many voters look at the distinct words of a whole text. A lexicon voter fires on a word of a written insult list (four
languages); a pattern voter fires where one, two, or three and more distinct words begin with some letters. Patterns are
proposed by the labelled training rows (`FOUND`, `SHARE`), one for each family of words and each number of words.

A generative label model (one hidden class, voters that fire or abstain) is then fitted by expectation-maximisation to the
votes alone: labels give each voter a starting accuracy worth `PRIOR` firings, which also says which class is the toxic one,
and the posterior of a row never sees the row's label. From what the classes leave unexplained the model estimates how
strongly voters are correlated; correlated voters share their weight. A linear classifier is trained on the posterior, on
which voters fire and on how many distinct words look like any voter's. Everything is fitted on a bounded sample of
labelled rows (`MAX_ROWS`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, documents, slices, staged, text_of
from .quality import held_out, labelled_sample

MAX_ROWS = 20_000
FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: Pattern voters at most. A pattern is proposed where its words go with the label by at least FOUND (log-likelihood ratio)
#: and SHARE of the rows it fires on are toxic.
PATTERNS, FOUND, SHARE = 512, 17.0, 0.5
#: Numbers of distinct words that a pattern may ask for; the last stands for more, too.
WORDS = (1, 2, 3)
#: Firings that a voter's starting accuracy is worth.
PRIOR = 10.0
#: Residual correlation from which voters share their weight.
LINKED = 0.8
#: Penalty on the weight of a single voter.
RIDGE = 0.1
MEMO = 500_000

# Words of the insult voters, in English, German, French and Spanish.
INSULTS = """
bastard clown coward creep crook disgusting dumb dumbass filth fool freak garbage idiot idiotic imbecile jerk lame liar
loser lunatic maggot moron moronic nasty parasite pathetic pig rat repulsive retard scum scumbag shameful sickening slob
stupid swine trash ugly useless vermin vile weasel whore worm worthless wretch
abschaum arschloch blödmann dreckskerl dummkopf erbärmlich idioten mistkerl schwein trottel versager wertlos widerlich
abruti connard crétin débile dégoûtant imbécile minable ordure pathétique pourriture raclure salaud
asqueroso basura cabrón escoria estúpido gilipollas idiota imbécil inútil payaso patético repugnante
""".split()

LETTERS = re.compile(r"[^\W\d_]+")


def keys_of(word: str) -> list[str]:
    """What a voter may look for in a word: the word (marked by =) and its beginnings of three to six letters."""
    return ["=" + word, *(word[:k] for k in range(3, min(6, len(word)) + 1))]


@dataclass
class Voters:
    """Keys that voters look for, the voters (a key and the number of distinct words asked for), and the linear classifier."""

    place: dict[str, int]
    key: np.ndarray
    asked: np.ndarray
    weights: np.ndarray
    bias: float = 0.0

    def fired(self, text: str, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Which voters fire (0 or 1), then the number of distinct chunks that look like any voter's."""
        counts, any_key = np.zeros(len(self.place), np.int64), 0
        for chunk in set(text.lower().split()):
            found = memo.get(chunk)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[chunk] = found = tuple({self.place[k] for w in LETTERS.findall(chunk) for k in keys_of(w) if k in self.place})
            if found:
                counts[list(found)] += 1
                any_key += 1
        return np.append(np.minimum(counts, WORDS[-1])[self.key] == self.asked, min(any_key, 65_535)).astype(np.uint16)

    def features(self, fired: np.ndarray) -> np.ndarray:
        words = fired[:, len(self.key):].astype(np.float32)
        return np.hstack([fired[:, :len(self.key)].astype(np.float32), np.log1p(words), *(words >= k for k in WORDS)])

    def score(self, fired: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.features(fired) @ self.weights + self.bias)))


def family_voters(candidates: list[tuple[str, int, float]], listed: Iterable[str] = (), most: int = PATTERNS) -> list[tuple[str, int]]:
    """Of candidates (key, asked, merit) the best of each family and number of words: a key goes where a better one begins it or begins
    with it, so that one voter stands for all words of a family. Words listed have a voter already."""
    kept: list[tuple[str, int]] = []
    taken = {1: (set(listed), {word[:k] for word in listed for k in range(1, len(word) + 1)})}
    for key, asked, _ in sorted(candidates, key=lambda c: (-c[2], c[0], c[1])):
        word = key.lstrip("=")
        words, starts = taken.setdefault(asked, (set(), set()))
        if word not in starts and not any(word[:k] in words for k in range(1, len(word) + 1)):
            kept.append((key, asked))
            words.add(word)
            starts.update(word[:k] for k in range(1, len(word) + 1))
    return kept[:most]


@dataclass
class LabelModel:
    """What the votes say: posterior of the toxic class per row; per voter the share of its firings that are toxic, its weight
    where all others correlated with it fire too (1: independent of all others) and how often it fires in either class; residual correlations of voters; the prior."""

    posterior: np.ndarray
    accuracy: np.ndarray
    weight: np.ndarray
    in_toxic: np.ndarray
    in_clean: np.ndarray
    correlation: np.ndarray


def label_model(fired: np.ndarray, stated: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Fit to the votes (rows by voters, 0 and 1). stated: each voter's starting accuracy, worth `PRIOR` firings; prior: the
    share of toxic rows, which stays. All that is made of the votes' size are two products."""
    n, m = fired.shape
    fired = fired.astype(np.float32)
    fires = fired.sum(0).astype(float)
    together = (fired.T @ fired).astype(float)
    posterior = 1 - np.exp(fired @ np.log(1 - np.clip(stated, 0, 0.999)))  # any of the voters that fire is right
    weight, linked, alike = np.ones(m), np.zeros((m, m)), np.zeros((m, m), np.float32)
    for turn in range(rounds):
        total = float(posterior.sum())
        toxic = posterior.astype(np.float32) @ fired
        accuracy = (toxic + PRIOR * stated) / (fires + PRIOR)
        in_toxic = np.minimum((accuracy * fires + 0.01) / (total + 0.02), 0.99)
        in_clean = np.minimum(((1 - accuracy) * fires + 0.01) / (n - total + 0.02), 0.99)
        if turn % 10 == 5:  # covariance that the classes leave unexplained
            p, q = toxic / max(total, 1e-9), (fires - toxic) / max(n - total, 1e-9)
            rest = together / n - total / n * np.outer(p, p) - (1 - total / n) * np.outer(q, q)
            scale = np.sqrt(np.maximum(np.diag(rest), 1e-9))
            linked = rest / np.outer(scale, scale)
            np.fill_diagonal(linked, 0)
            alike = np.where(np.abs(linked) > LINKED, np.minimum(np.abs(linked), 1), 0).astype(np.float32)
            weight = 1 / (1 + alike.sum(0))
        yes, no = np.log(in_toxic / in_clean).astype(np.float32), np.log((1 - in_toxic) / (1 - in_clean)).astype(np.float32)
        odds = np.zeros(n, np.float32)
        for k in range(0, n, 4096):  # of the voters that fire on a row, and of those that abstain, correlated ones share their weight
            part = fired[k:k + 4096]
            odds[k:k + 4096] = (part / (1 + part @ alike)) @ yes + ((1 - part) / (1 + (1 - part) @ alike)) @ no
        posterior = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -30, 30)))
    accuracy = (posterior.astype(np.float32) @ fired + PRIOR * stated) / (fires + PRIOR)
    return LabelModel(posterior, accuracy, weight, in_toxic, in_clean, linked)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps, with a penalty for each feature."""
    design = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.append(ridge, 1e-3)
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + penalty * w
        curve = sum((part * (q * (1 - q) + 1e-4)[:, None].astype(x.dtype)).T @ part for part, q in  # in blocks of rows
                    ((design[k:k + 4096], p[k:k + 4096]) for k in range(0, len(x), 4096))) + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Voters:
    """Fit on the sample. Its texts stay on the executors: the driver gets keys that pass, votes and counts."""
    sample = staged(labelled_sample(docs, labels, "toxic", FOLDS, HELD, most), "toxic-sample")

    def keys(batches):
        for part in slices(batches, 1, SLICE // 8):  # text is the second column; sums of a slice, not rows of its words
            n, t = Counter(), Counter()
            for text, y in zip(part.column("text"), part.column("y").to_pylist()):
                found = Counter(k for w in set(LETTERS.findall(text.as_py().decode().lower())) for k in keys_of(w))
                asked = [(k, min(c, WORDS[-1])) for k, c in found.items()]
                n.update(asked)
                if y:
                    t.update(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in n], pa.string()), pa.array([c for _, c in n], pa.int32()), pa.array(list(n.values()), pa.int64()),
                 pa.array([t[k] for k in n], pa.int64())], names=["key", "asked", "n", "t"])

    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = min(max(toxic / rows, 1e-6), 1 - 1e-6) if rows else 0.5
    n, t = F.col("n"), F.col("t")
    merit = 2 * (t * F.log(t / (n * share)) + F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - share)))).otherwise(0.0))
    lexicon = [("=" + w, 1) for w in INSULTS]
    listed = F.col("key").isin([k for k, _ in lexicon]) & (F.col("asked") == 1)
    passes = (t >= n * SHARE) & (t > n * share) & (t > 0) & (F.col("merit") >= FOUND)
    counted = (sample.mapInArrow(keys, "key string, asked int, n long, t long").groupBy("key", "asked").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
               .withColumn("merit", merit).withColumn("listed", listed).where(F.col("listed") | passes)
               .orderBy(F.desc("listed"), F.desc("merit"), "key", "asked").limit(len(lexicon) + 16 * PATTERNS).collect())
    listed = {r["key"]: (r["n"], r["t"]) for r in counted if r["listed"]}
    passing = [r for r in counted if not r["listed"]]
    mined = {(r["key"], r["asked"]): (r["n"], r["t"]) for r in passing}
    chosen = lexicon + family_voters([(r["key"], r["asked"], r["merit"]) for r in passing], listed=INSULTS)
    stated = np.array([(listed.get(k, (0, 0))[1] + 1.8) / (listed.get(k, (0, 0))[0] + 2) if v < len(lexicon) else (mined[k, c][1] + 0.5) / (mined[k, c][0] + 1)
                       for v, (k, c) in enumerate(chosen)])
    place = {key: at for at, key in enumerate(dict.fromkeys(k for k, _ in chosen))}
    voters = Voters(place, np.array([place[k] for k, _ in chosen]), np.array([c for _, c in chosen]), np.zeros(len(chosen) + 1 + len(WORDS)))

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            x = [voters.fired(text.as_py().decode(), memo).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])

    found = sample.mapInArrow(run, "doc_id long, x binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(found):
        return voters
    x = np.frombuffer(b"".join(map(bytes, found["x"])), np.uint16).reshape(len(found), len(chosen) + 1)
    posterior = label_model(x[:, :len(chosen)], stated, share).posterior
    ridge = np.full(len(voters.weights), 0.01)
    ridge[:len(chosen)] = RIDGE
    voters.weights, voters.bias = fit_linear(voters.features(x), posterior, ridge)
    return voters


def scorer(model: Voters):
    """An Arrow function from texts to scores; a worker remembers which voters a chunk fires."""
    memo: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = [model.score(model.fired(t.as_py() or "", memo)[None])[0] for t in text]
        return pa.array(out, pa.float64())

    return score


def score_toxicity(docs: DataFrame, model: Voters, text_col: str = "text") -> DataFrame:
    """The rows of docs with a column __score in 0..1.

    Null text counts as empty; an empty text fires no voter and gets the classifier's base score. Rows are scored one by
    one, so repeated rows get equal scores and extra columns pass through; an empty table gives an empty result.
    """
    return docs.withColumn("__score", scorer(model)(text_of(docs, text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (score_toxicity(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), F.col("__score").alias("score"),
                    (F.col("__score") >= THRESHOLD).cast("int").alias("predicted")))
