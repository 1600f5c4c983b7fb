"""Toxicity of whole texts: the largest score of all their overlapping windows, from a bidirectional recurrent network."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.llm.gru import GRAM_BUCKETS, Network, Tokens, tokens, windows
from tabulark.llm.tables import written
from tabulark.llm.words import MARKS, Block, blocks, counts_per_text, word_spans

SIZE, STEP = 16, 8
#: Windows that the network reads at a time.
_AT_ONCE = 8192


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the training; a document gives at most ``likely + other`` windows."""

    docs_per_label: int = 3000
    likely: int = 3
    other: int = 2
    epochs: int = 6
    least_steps: int = 400
    batch: int = 256
    rate: float = 0.01
    seed: int = 5


@dataclass
class Model:
    network: Network
    slope: float
    shift: float


def _laid_out(block: Block) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Distinct words, places of all windows as rows of them (padding last), and the text of each window."""
    words = tokens(block)
    at, text = windows(np.diff(counts_per_text(words.owner, len(block))), SIZE, STEP, len(words.token))
    return words, np.append(words.token, len(words.bucket))[at], text


def _sample(labels: DataFrame, docs_per_label: int) -> DataFrame:
    """About ``docs_per_label`` keys of each label (all if fewer), chosen by a hash of the key, with the weight that makes up for it."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = {k: min(1.0, docs_per_label / n) for k, n in counts.items()}
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    of = F.when(F.col("label") > 0, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return labels.filter(chance < of).withColumn("weight", 1 / of)


def _odds(sample: DataFrame) -> np.ndarray:
    """For each n-gram bucket how much more often toxic texts have it, as a smoothed log ratio. Tasks send two numbers a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, texts = np.zeros((2, GRAM_BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for block in blocks(batch.column(0), 1 << 18):
                words = tokens(block)
                token_at = np.argsort(words.gram_word, kind="stable")
                begin = np.searchsorted(words.gram_word[token_at], np.arange(len(words.bucket) + 1))
                seen = counts_per_text(words.owner, len(block))
                for i in range(len(block)):
                    own = np.unique(words.token[seen[i] : seen[i + 1]])
                    grams = [words.grams[token_at[begin[w] : begin[w + 1]]] for w in own]
                    totals[int(labels[block.first + i]), np.unique(np.concatenate(grams)) if grams else []] += 1
                    texts[int(labels[block.first + i])] += 1
        at = np.flatnonzero(totals.any(axis=0))
        columns = [np.append(at, -1), np.append(totals[0, at], texts[0]), np.append(totals[1, at], texts[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["bucket", "no", "yes"])

    sums = sample.select("text", "label").mapInArrow(count, "bucket long, no long, yes long").groupBy("bucket")
    table = sums.agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas().set_index("bucket")
    no, yes = np.zeros(GRAM_BUCKETS), np.zeros(GRAM_BUCKETS)
    inside = table[table.index >= 0]
    no[inside.index], yes[inside.index] = inside["no"], inside["yes"]
    texts = table.loc[-1] if -1 in table.index else {"no": 0, "yes": 0}
    return np.log((yes + 1) / (texts["yes"] + 2)) - np.log((no + 1) / (texts["no"] + 2))


def _windows(sample: DataFrame, odds: np.ndarray, how: Training) -> list[tuple]:
    """The likeliest windows of each sampled text and some others, as words: ``(doc, label, rank, words)``."""
    sent = sample.sparkSession.sparkContext.broadcast(odds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, (text, label) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
                for block in blocks(pa.array([text.as_py()], pa.large_string())):
                    words, places, _ = _laid_out(block)
                    score = np.bincount(words.gram_word, sent.value[words.grams], len(words.bucket)) * words.gram_share
                    best = np.append(score, -9.0)[places].max(axis=1)
                    order = np.argsort(-best, kind="stable")
                    rest = order[how.likely :]
                    spread = rest[:: max(1, len(rest) // how.other)][: how.other] if len(rest) and not label else rest[:0]
                    for rank, w in enumerate([*order[: how.likely], *spread]):
                        out.append((int(batch.column(2)[row].as_py()), label, rank, _spelled(block, int(w))))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "label", "rank", "words"])

    schema = "doc long, label int, rank int, words string"
    rows = sample.select("text", "label", F.xxhash64("key").alias("doc")).mapInArrow(choose, schema)
    return sorted(map(tuple, rows.collect()))


def _spelled(block: Block, window: int) -> str:
    starts, ends, _ = word_spans(block, MARKS)
    own = slice(window * STEP, window * STEP + SIZE)
    return " ".join(bytes(block.data[a:b]).decode() for a, b in zip(starts[own], ends[own]))


def _block(texts: list[str]) -> Block:
    return next(blocks(pa.array(texts, pa.large_string()), 1 << 40))


def _trained(rows: list[tuple], odds: np.ndarray, how: Training) -> Network:
    """Windows of texts without the label are no examples; of a text with it, only the window that scores highest is one."""
    network = Network(how.seed)
    network.p["grams"][:, 0] = np.clip(odds, -4, 8) / 2
    chance = np.random.RandomState(how.seed)
    words, places, _ = _laid_out(_block([r[3] for r in rows]))
    label = np.array([r[1] for r in rows])
    doc = np.unique([r[0] for r in rows], return_inverse=True)[1]
    rank = np.array([r[2] for r in rows], np.float64)
    examples = int((label == 0).sum()) + len(np.unique(doc[label == 1]))
    epochs = max(how.epochs, -(-how.least_steps * how.batch // max(examples, 1)))
    for epoch in range(epochs):
        if epoch:
            rank = -network.run(network.projected(network.inputs(words)), places)
        order = np.lexsort((rank, doc))
        top = order[np.diff(doc[order], prepend=-1) != 0]
        chosen = np.concatenate((top[label[top] == 1], np.flatnonzero(label == 0)))
        chosen = chance.permutation(chosen)
        for at in range(0, len(chosen), how.batch):
            part = chosen[at : at + how.batch]
            network.learn(*_only(words, places[part]), label[part], how.rate * 0.1 ** (epoch / epochs))
    return network


def _only(words: Tokens, places: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The words that these windows have, and the windows in their numbers."""
    pad = len(words.bucket)
    used = np.unique(places)
    used = used[used < pad]
    number = np.full(pad + 1, len(used))
    number[used] = np.arange(len(used))
    mine = number[words.gram_word] < len(used)
    return Tokens(words.bucket[used], words.grams[mine], number[words.gram_word[mine]], words.token[:0], words.owner[:0]), number[places]


def _logits(block: Block, network: Network) -> np.ndarray:
    """The largest logit of each text's windows."""
    words, places, text = _laid_out(block)
    gates = network.projected(network.inputs(words))
    logit = np.concatenate([network.run(gates, places[i : i + _AT_ONCE]) for i in range(0, len(places), _AT_ONCE)])
    return np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1)))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, how: Training = Training()) -> Model:
    """Learn from the documents that ``labels`` marks 0 or 1, from a bounded sample of each.

    First the log ratios of n-grams point to likely windows; then the network is trained on windows, with the
    likeliest window of each toxic text as its example; at last the largest logit of a text is calibrated to a
    probability, at the proportions of the whole table. Without texts of both labels every score is near the one
    label there is, or 0.5. Null keys, texts and labels are left out; a key with both labels counts as 1.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marks = marks.filter("label in (0, 1) and key is not null").groupBy("key").agg(F.max("label").alias("label"))
    # The sample of keys is bounded and sent to the documents, which need not move.
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    sample = written(texts.join(F.broadcast(_sample(marks, how.docs_per_label)), "key"), "sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if len(counts) < 2:
        share = min(max(float(1 in counts), 0.01), 0.99) if counts else 0.5
        return Model(Network(how.seed), 0.0, math.log(share / (1 - share)))
    odds = _odds(sample)
    network = _trained(_windows(sample, odds, how), odds, how)
    raw = _largest(sample, "text", network).select("logit", "label", "weight").toPandas()
    slope, shift = _calibrated(raw["logit"].to_numpy(), raw["label"].to_numpy(), raw["weight"].to_numpy())
    return Model(network, slope, shift)


def _calibrated(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the label on the logit, by Newton's method with a small ridge."""
    x, beta = np.column_stack((logit, np.ones_like(logit))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (label - p)) - 1e-2 * (beta - [1, 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        beta += np.clip(step, -2, 2)
    return max(float(beta[0]), 0.0), float(beta[1])


def _largest(df: DataFrame, text: str, network: Network) -> DataFrame:
    """Every row with ``logit``, the largest of its windows."""
    df = df.drop("logit")
    sent, at_text, names = df.sparkSession.sparkContext.broadcast(network.p), df.columns.index(text), [*df.columns, "logit"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = sent.value
        for batch in batches:
            parts = [_logits(block, own) for block in blocks(batch.column(at_text))]
            logit = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logit.astype(np.float64))], names)

    return df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("logit", T.DoubleType())]))


def predict(df: DataFrame, text: str, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    All windows of ``SIZE`` words, ``STEP`` apart, of the whole text are read. A null or empty text has one empty
    window. Rows are independent of each other, so ties and repeated rows need nothing.
    """
    scored = _largest(df.drop(*[c for c in ("score", "predicted") if c != text]), text, model.network)
    score = 1 / (1 + F.exp(-(F.col("logit") * F.lit(model.slope) + F.lit(model.shift))))
    return scored.withColumn("score", score).drop("logit").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
