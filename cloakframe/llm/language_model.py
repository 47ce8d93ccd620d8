"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) is a product of softmaxes over 16 outcomes each: of a word's group, of its class in the group, and of its leaf in the
class; times the word's share of the leaf. Group and class are hashes of a word's last two bytes, which tell endings and so languages
apart; the leaf is a hash of the word. Each softmax sums weights of hashed features of the context and of the outcomes above it: none,
the ending before, the ending two before (a skip), both (a trigram of endings), and the word before. In a leaf words follow their
training counts plus one, with one more share for all unknown words.

Word counts: each block of texts sends its distinct words' hashes and counts once to the hashes' buckets, which sum them and
answer each block. So a frequent word costs a row for each block, and what is gathered grows with the corpus.
Weights: in each round every partition takes gradient steps over its own training texts of the round from the same weights, and the
results are averaged by slices of the weight table. Its rows double with every eightfold vocabulary from a million words on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks_for, bucketed, finished, in_blocks, mix, prefix_hashes, span_hashes, stored, text_bytes, texts_of, words_of

#: Outcomes of each softmax, softmaxes of a word, and leaves that they lead to.
WAYS, LEVELS = 16, 3
LEAVES = WAYS**LEVELS
KINDS = 5
#: Rows of the weight table for each level and kind of feature, at least; and at most, as they are kept as 16 bits.
ROWS, MOST_ROWS = 1 << 12, 1 << 16
#: Passes over the training texts, and rounds of each.
EPOCHS, ROUNDS, BATCH, RATE = 2, 2, 8192, 0.3
SLICES = 16
BLOCK, PART = 4 << 20, 24 << 20
PER_BUCKET = 500_000
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def tokens_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the last two bytes, document) of every token; each document's last one is END, whose ending is 0."""
    low = LOWER[buf]
    a, b, doc = words_of(low, offs)
    n = len(offs) - 1
    h = span_hashes(prefix_hashes(low), a, b)
    second = np.where(b - a > 1, low[np.maximum(b - 2, 0)], 0).astype(np.uint64)
    tail = mix(low[b - 1].astype(np.uint64) * np.uint64(257) + second)
    ends = np.searchsorted(doc, np.arange(n), "right")
    return np.insert(h, ends, END), np.insert(tail, ends, 0), np.insert(doc, ends, np.arange(n))


def leaves_of(h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The leaf of every token: group, class and leaf, four bits each from the highest."""
    return ((tail >> np.uint64(20)) & np.uint64(255)).astype(np.int64) * WAYS + ((mix(h + np.uint64(3)) >> np.uint64(13)) & np.uint64(WAYS - 1)).astype(np.int64)


def contexts_of(h: np.ndarray, tail: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(KINDS, tokens) hashes of the features, from the tokens before in the same document only."""

    def before(x, k, missing):
        out = np.full(len(x), missing, x.dtype)
        if len(x) > k:
            out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], missing)
        return out

    one, two = before(tail, 1, START), before(tail, 2, START)
    return np.stack([np.zeros(len(h), np.uint64), one, two + np.uint64(1), mix(one * np.uint64(31) + two), before(h, 1, START) + np.uint64(2)])


def features_of(contexts: np.ndarray, leaf: np.ndarray, level: int, rows: int) -> np.ndarray:
    """(KINDS, tokens) rows of a level's weight table: the context together with the outcomes above the level. rows is a power of two."""
    above = (leaf // WAYS ** (LEVELS - level) + WAYS**level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(contexts + above) & np.uint64(rows - 1)).astype(np.uint16)


def outcome(leaf: np.ndarray, level: int) -> np.ndarray:
    return leaf // WAYS ** (LEVELS - 1 - level) % WAYS


class Maxent:
    """weights: (LEVELS, KINDS, rows, WAYS)."""

    def __init__(self, weights: np.ndarray | None = None, rows: int = ROWS):
        self.w = np.zeros((LEVELS, KINDS, rows, WAYS), np.float32) if weights is None else weights
        self.rows = self.w.shape[2]

    def _exponentials(self, level: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token's outcomes, and their sums."""
        s = self.w[level, 0].take(f[0], axis=0)
        part = np.empty_like(s)
        for k in range(1, KINDS):
            s += self.w[level, k].take(f[k], axis=0, out=part, mode="clip")
        if s.size and max(s.max(), -s.min()) > 60:  # else neither exponentials nor their sums leave the range
            s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        return s, s @ np.ones(WAYS, np.float32)

    def probabilities(self, level: int, f: np.ndarray) -> np.ndarray:
        s, total = self._exponentials(level, f)
        s /= total[:, None]
        return s

    def log10(self, contexts: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each token's leaf."""
        out = np.zeros(len(leaf))
        for i in range(0, len(leaf), BATCH):
            x, y = contexts[:, i : i + BATCH], leaf[i : i + BATCH]
            for level in range(LEVELS):
                s, total = self._exponentials(level, features_of(x, y, level, self.rows))
                out[i : i + BATCH] += np.log10(np.maximum(s[np.arange(len(y)), outcome(y, level)] / total, 1e-30))
        return out

    def learn(self, contexts: np.ndarray, leaf: np.ndarray, power: np.ndarray) -> None:
        """One Adagrad step a batch and level; power holds the sums of squared gradients. The one added keeps rare rows small."""
        for i in range(0, len(leaf), BATCH):
            x, y = contexts[:, i : i + BATCH], leaf[i : i + BATCH]
            for level in range(LEVELS):
                f = features_of(x, y, level, self.rows)
                g = self.probabilities(level, f)
                g[np.arange(len(y)), outcome(y, level)] -= 1
                # Outcomes two by two: a pair of sums is one complex number.
                pairs = g.view(np.complex64).T.copy()
                for k in range(KINDS):
                    if k and self.rows <= BATCH:  # most of a small table's rows: it is cheaper as a whole
                        row, place, n = slice(None), f[k].astype(np.intp), self.rows
                    else:
                        has = np.bincount(f[k], minlength=self.rows) > 0
                        row, place = np.flatnonzero(has), (np.cumsum(has) - 1).take(f[k])
                        n = len(row)
                    if n == 1:
                        d = g.sum(axis=0, keepdims=True)
                    else:
                        sums = np.zeros((WAYS // 2, n), np.complex64)
                        for c in range(WAYS // 2):
                            np.add.at(sums[c], place, pairs[c])
                        d = sums.T.copy().view(np.float32)
                    p = power[level, k][row]
                    p += d * d
                    if n < self.rows:
                        power[level, k][row] = p
                    step = np.sqrt(p + 1.0)
                    d *= RATE
                    d /= step
                    self.w[level, k][row] -= d


# ------------------------------------------------------------------ counts
_COUNTED = "bucket int, block long, words binary, classes binary, counts binary"


def _count(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        total: dict[str, list] = {"h": [], "c": [], "n": []}
        for batch in in_blocks(table.to_batches()):
            buf, offs = texts_of(batch.column("text"))
            h, tail, doc = tokens_of(buf, offs)
            cls = leaves_of(h, tail)
            learned = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            total["h"].append(u)
            total["c"].append(cls[first])
            total["n"].append(np.bincount(inverse, learned[doc], minlength=len(u)).astype(np.int64))
        h, c, n = (np.concatenate(total[k]) for k in "hcn")
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, n, minlength=len(u)).astype(np.int64)
        c = c[first].astype(np.uint16)
        where = (u % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(where, kind="stable")
        u, c, n = u[by], c[by], n[by]
        cut = np.searchsorted(where[by], np.arange(buckets + 1))
        rows = [(x, block, u[i:j].tobytes(), c[i:j].tobytes(), n[i:j].tobytes()) for x, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["bucket", "block", "words", "classes", "counts"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """Of one bucket: every block's words with their training counts over all blocks; and, once, tokens and words of each leaf."""
    words, classes, counts = (table.column(c).to_pylist() for c in ("words", "classes", "counts"))
    h = np.frombuffer(b"".join(words), np.uint64)
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.frombuffer(b"".join(counts), np.int64), minlength=len(u)).astype(np.int64)
    cls = np.frombuffer(b"".join(classes), np.uint16)[first]
    seen = n > 0
    stats = np.stack([np.bincount(cls, n, minlength=LEAVES), np.bincount(cls[seen], minlength=LEAVES)]).astype(np.int64)
    cut = np.cumsum([0] + [len(x) // 8 for x in words])
    answer = [n[inverse[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
    size = len(words)
    return pa.table({
        "block": table.column("block"), "words": table.column("words"), "counts": pa.array(answer, pa.binary()),
        "stats": pa.array([stats.tobytes()] + [None] * (size - 1), pa.binary()),
    })


# ------------------------------------------------------------------ training
def _round(weights: np.ndarray):
    def run(batches):
        model, power, seen = Maxent(weights.copy()), np.zeros_like(weights), 0
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            h, tail, doc = tokens_of(buf, offs)
            model.learn(contexts_of(h, tail, doc), leaves_of(h, tail), power)
            seen += len(h)
        if seen:
            parts = np.split(model.w.reshape(-1, WAYS), SLICES)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "n": pa.array([seen] * SLICES, pa.int64()), "w": pa.array([x.tobytes() for x in parts], pa.binary())})

    return run


def _average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of one slice, each partition by the tokens it has seen; a row at a time in memory."""
    total, seen = None, 0
    for batch in batches:
        for n, w in zip(batch.column("n").to_pylist(), batch.column("w").to_pylist()):
            w = np.frombuffer(w, np.float32).astype(np.float64) * n
            total, seen = w if total is None else total + w, seen + n
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([seen], pa.int64()), "w": pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())})


_SLICE = "slice int, n long, w binary"


def rows_for(vocabulary: int) -> int:
    return min(MOST_ROWS, ROWS << max(0, (vocabulary.bit_length() - 20) // 3))


def train(texts: DataFrame, rows: int = ROWS) -> Maxent:
    """Over every training text EPOCHS times: the rounds of an epoch take the blocks in turn."""
    model = Maxent(rows=rows)
    for k in range(EPOCHS * ROUNDS):
        some = texts.where(~F.col("held_out") & (F.col("block") % ROUNDS == k % ROUNDS)).select("text").mapInArrow(_round(model.w), _SLICE)
        got = {x["slice"]: x["w"] for x in some.groupBy("slice").applyInArrow(_average, _SLICE).collect()}
        if got:
            model = Maxent(np.concatenate([np.frombuffer(got[k], np.float32) for k in range(SLICES)]).reshape(model.w.shape).copy())
    return model


# ------------------------------------------------------------------ scoring
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Maxent, tokens: np.ndarray, words: np.ndarray):
    total, vocabulary = int(tokens.sum()), int(words.sum())
    within = np.log10(np.maximum(tokens + words + 1, 1).astype(np.float64))

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        known = np.frombuffer(b"".join(counts.column("words").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(counts.column("counts").to_pylist()), np.int64)
        by = np.argsort(known)
        known, n = known[by], n[by]
        out = []
        for batch in in_blocks(texts.to_batches()):
            buf, offs = texts_of(batch.column("text"))
            h, tail, doc = tokens_of(buf, offs)
            c, leaf = n[np.searchsorted(known, h)], leaves_of(h, tail)
            add = np.log10(c + 1.0)
            logp = model.log10(contexts_of(h, tail, doc), leaf) + add - within[leaf]
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            tokens_in = np.bincount(doc, minlength=batch.num_rows)
            base = np.add.reduceat(add, first) - tokens_in * np.log10(float(total + vocabulary + 1))
            out.append(pa.table({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(tokens_in.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), "train_tokens": pa.array(np.full(batch.num_rows, total, np.int64)),
                "base_score": pa.array(base), "score": pa.array(np.add.reduceat(logp, first)),
            }))
        if not out:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        return pa.concat_tables(out)

    return run


@finished
def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text; others are
    ignored).

    Learns from documents that are not held out; a null doc_id never is. A null or empty text is its end alone. Rows that
    repeat count as often. An empty table gives an empty result; without a training text all words are unknown.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    # With fewer buckets than shuffle partitions a later step would deal them again.
    blocks, parts = blocks_for(total, BLOCK), max(blocks_for(total, PART), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    # Dealt to blocks once, in a table whose blocks later steps read without another exchange.
    texts = bucketed(rows.repartition(parts, "block"), "lm", "block", parts)

    buckets = blocks_for(total // 100, PER_BUCKET)
    counted = texts.groupBy("block").applyInArrow(_count(buckets), _COUNTED)
    counts = stored(counted.groupBy("bucket").applyInArrow(_sum, "block long, words binary, counts binary, stats binary"), "counts")
    stats = np.zeros((2, LEAVES), np.int64)
    for x in counts.where("stats is not null").select("stats").toLocalIterator():
        stats += np.frombuffer(x["stats"], np.int64).reshape(2, LEAVES)
    model = train(texts, rows_for(int(stats[1].sum())))
    pair = texts.groupBy("block").cogroup(counts.select("block", "words", "counts").groupBy("block"))
    return pair.applyInArrow(_score(model, stats[0], stats[1]), _SCORED)
