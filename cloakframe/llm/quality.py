"""Quality by line labels: a linear-chain conditional random field marks each line content or boilerplate.

Viterbi decoding gives the labels; the share of a text's line characters in content lines decides, after a few plain
rules on words. The field is trained here by its likelihood's gradient.

Only documents have labels, so lines get theirs in rounds. A line of a good document is content, unless it repeats an earlier one of
its text. A bad document's lines are boilerplate at first; after a fit they take the labels that the field decodes, where most of
their characters stay boilerplate: so clean lines in bad documents become content. Besides the documents, sequences are spliced
from a good document with a bad one between its lines, so that the field learns where labels change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, mix, prefix_hashes, span_hashes, texts_of, words_of

#: The fit's bounds: labelled documents of each quality, and lines of each, from any place of the text.
DOCS_PER_LABEL, LINES_PER_DOC = 1500, 64
STEPS, RATE, DECAY = 150, 0.5, 1e-3
#: Fits; before each but the first the lines of bad documents are labelled anew.
ROUNDS = 3
MIN_WORDS, REPEAT_PERCENT, WINDOW, CONTENT_SHARE = 20, 30, 8, 0.5
BOILERPLATE, CONTENT = 0, 1
FEATURES = 9
#: The feature that a line repeats an earlier one of its text.
AGAIN = 6
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?:;\"')")] = True


def _upto(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _per(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, minlength=n).astype(np.int64)


def analyse(buf: np.ndarray, offs: np.ndarray):
    """(counts of each document, features of each line with a word, the line's document, its bytes)."""
    n = len(offs) - 1
    a, b, doc = words_of(buf, offs)
    prefix = prefix_hashes(buf)
    chars = _upto((buf & 0xC0) != 0x80)
    symbols = _upto(SYMBOL[buf])
    out = {"n_words": _per(doc, n), "word_chars": _per(doc, n, chars[b] - chars[a]), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    # Lines: between line feeds, none across documents.
    cut = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offs[:-1], cut + 1]))
    end = np.sort(np.concatenate([offs[1:], cut]))
    of = np.searchsorted(offs, begin, "right") - 1
    if len(cut):  # an empty document shares its place with the next one, and a last line feed begins an empty line
        of = np.repeat(np.arange(n), 1 + _per(np.searchsorted(offs, cut, "right") - 1, n))
        by = np.lexsort((np.concatenate([offs[:-1], cut + 1]), np.concatenate([np.arange(n), np.searchsorted(offs, cut, "right") - 1])))
        begin = np.concatenate([offs[:-1], cut + 1])[by]
        by = np.lexsort((np.concatenate([cut, offs[1:]]), np.concatenate([np.searchsorted(offs, cut, "right") - 1, np.arange(n)])))
        end = np.concatenate([cut, offs[1:]])[by]
    else:
        of, begin, end = np.arange(n), offs[:-1], offs[1:]
    inside = np.searchsorted(a, end) - np.searchsorted(a, begin)
    has = inside > 0
    begin, end, of, inside = begin[has], end[has], of[has], inside[has]
    key = span_hashes(prefix, begin, end) + mix(of.astype(np.uint64))
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[by[1:]] = key[by][1:] == key[by][:-1]
    out["n_dup_lines"] = _per(of[again], n)

    # Windows of eight words that occur twice in their document.
    h = span_hashes(prefix, a, b)
    m = len(h) - WINDOW + 1
    covered = np.zeros(len(h) + 1, np.int64)
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        ok = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        w = mix(acc[ok]) + mix(doc[ok].astype(np.uint64) + np.uint64(77))
        by = np.argsort(w)
        same = np.concatenate([[False], w[by][1:] == w[by][:-1], [False]])
        twice = ok[by[same[:-1] | same[1:]]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = _per(doc[np.cumsum(covered)[:-1] > 0], n)

    size = np.maximum(end - begin, 1)
    letters, digits = _upto(LETTER[buf]), _upto(DIGIT[buf])
    share = lambda c: (c[end] - c[begin]) / size
    sym = share(symbols)
    last = b[np.searchsorted(a, end) - 1] - 1 if len(end) else end
    f = np.stack([np.ones(len(size)), np.minimum(sym * 10, 2), sym > 0.02, 1 - share(letters), share(digits) * 2, size < 40, again, ~ENDS[buf[last]] if len(end) else np.zeros(0), np.minimum(size / np.maximum(inside, 1) / 10, 2)], axis=1)
    return out, f.astype(np.float64), of, size


def _padded(f: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each line in its document, lines of each, first line of each)."""
    count = _per(of, n)
    first = np.cumsum(count) - count
    return np.arange(len(of)) - first[of], count, first


class LineField:
    """Two labels; score of a labelling: features by emission weights, and a weight for each pair of neighbours."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def viterbi(self, f: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The best labels; a tie is content. Documents advance together, longest first, a line a step."""
        score = f @ self.emit
        place, count, first = _padded(f, of, n)
        order = np.argsort(-count, kind="stable")
        lines, begin = count[order], first[order]
        labels = np.full(len(of), CONTENT)
        back = np.zeros((len(of), 2), np.int8)
        best = np.zeros((n, 2))
        longest = int(lines[0]) if n else 0
        alive = np.searchsorted(-lines, -np.arange(longest + 1), "left")  # documents with more than t lines
        for t in range(longest):
            k = alive[t]
            at = begin[:k] + t
            if t:
                to = best[:k, :, None] + self.move[None]
                take = to[:, CONTENT] >= to[:, BOILERPLATE]
                back[at] = take
                best[:k] = np.where(take, to[:, CONTENT], to[:, BOILERPLATE]) + score[at]
            else:
                best[:k] = score[at]
        state = (best[:, CONTENT] >= best[:, BOILERPLATE]).astype(np.int64)
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            at = begin[:k] + t
            labels[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return labels

    def gradient(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, its gradients by emit and by move) of labels y for features x (sequences, places, FEATURES), by forward and
        backward sums. Sequences have so many places, the longest come first."""
        n, longest = y.shape
        lse = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
        alive = np.searchsorted(-size, -np.arange(longest), "left")  # sequences with more than t places
        on = np.arange(longest) < size[:, None]
        s = x @ self.emit
        fwd, bwd = s.copy(), np.zeros_like(s)
        for t in range(1, longest):
            k = alive[t]
            fwd[:k, t] = lse(fwd[:k, t - 1, :, None] + self.move, 1) + s[:k, t]
        for t in range(longest - 2, -1, -1):
            k = alive[t + 1]
            bwd[:k, t] = lse(self.move[None] + (s[:k, t + 1] + bwd[:k, t + 1])[:, None, :], 2)
        z = lse(fwd[np.arange(n), size - 1], 1)
        p = np.exp(np.where(on[:, :, None], fwd + bwd - z[:, None, None], -np.inf))
        pair = on[:, 1:, None, None]
        both = np.exp(np.where(pair, fwd[:, :-1, :, None] + self.move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None], -np.inf))
        truth = np.zeros((n, longest, 2))
        np.put_along_axis(truth, y[:, :, None], 1, axis=2)
        truth *= on[:, :, None]
        moved = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
        likelihood = (s * truth).sum() + (moved * self.move).sum() - z.sum()
        return likelihood, np.einsum("ntf,nty->fy", x, truth - p), moved - both.sum(axis=(0, 1))

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> "LineField":
        """Gradient ascent on the conditional likelihood of (features, labels), all sequences side by side."""
        sequences = sorted(sequences, key=lambda q: -len(q[1]))
        size = np.array([len(y) for _, y in sequences])
        x, y = np.zeros((len(size), size[0], FEATURES)), np.zeros((len(size), size[0]), np.int64)
        for k, (f, labels) in enumerate(sequences):
            x[k, : len(f)], y[k, : len(f)] = f, labels
        for step in range(steps):
            _, emit, move = self.gradient(x, y, size)
            rate = RATE * 4 / (1 + step / 50)
            self.emit = self.emit + rate * (emit / size.sum() - DECAY * self.emit)
            self.move = self.move + rate * (move / size.sum() - DECAY * self.move)
        return self


def line_labels(docs: list[tuple[int, np.ndarray, np.ndarray]], field: LineField | None) -> list[np.ndarray]:
    """Of documents (quality, features, bytes of each line): a label for each line, by the rules at the top."""
    decoded = None
    if field is not None:
        count = [len(f) for _, f, _ in docs]
        decoded = np.split(field.viterbi(np.concatenate([f for _, f, _ in docs]), np.repeat(np.arange(len(docs)), count), len(docs)), np.cumsum(count)[:-1])
    out = []
    for k, (quality, f, size) in enumerate(docs):
        if quality == CONTENT:
            y = np.where(f[:, AGAIN] > 0, BOILERPLATE, CONTENT)
        else:
            y = np.full(len(f), BOILERPLATE)
            if decoded is not None and 2 * size[decoded[k] == BOILERPLATE].sum() > size.sum():
                y = decoded[k]
        out.append(y)
    return out


def spliced(docs: list[tuple[int, np.ndarray, np.ndarray]], labels: list[np.ndarray], seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bad document, one sequence of it between the lines of a good one; none where either kind is missing."""
    rng = np.random.default_rng(seed)
    good, bad = ([k for k, d in enumerate(docs) if d[0] == q] for q in (CONTENT, BOILERPLATE))
    out = []
    for k in bad if good else ():
        g = good[int(rng.integers(len(good)))]
        cut = int(rng.integers(0, len(labels[g]) + 1))
        out.append(tuple(np.concatenate([a[:cut], b, a[cut:]]) for a, b in ((docs[g][1], docs[k][1]), (labels[g], labels[k]))))
    return out


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> LineField:
    field = LineField()
    for k in range(rounds):
        labels = line_labels(docs, field if k else None)
        field.fit([(f, y) for (_, f, _), y in zip(docs, labels)] + spliced(docs, labels), STEPS if not k else STEPS // 3)
    return field


def _failed(c) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def fit(docs: DataFrame, labels: DataFrame) -> LineField:
    """From documents with a quality label, at most about DOCS_PER_LABEL of each, by a hash of doc_id. Those
    that fail the plain rules teach nothing. Without any, every line is content. labels may repeat a doc_id; its lowest quality counts."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {x["quality"]: x["n"] for x in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LineField()
    rate = F.create_map(*[F.lit(v) for k in sorted(counts) for v in (k, DOCS_PER_LABEL / counts[k])])
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(rate, F.col("quality")) * (1 << 20))
    # The sample's parameter bounds the chosen ids, so they are sent to the texts.
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def lines(batches):
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            c, f, of, size = analyse(buf, offs)
            f = np.column_stack([f, size])
            failed, out = _failed(c), []
            for k, (i, q) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist())):
                x = f[np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
                if len(x) and not failed[k]:
                    at = (i * 2654435761) % max(1, len(x) - LINES_PER_DOC + 1)
                    out.append((i, q, np.ascontiguousarray(x[at : at + LINES_PER_DOC]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "quality", "lines"])

    rows = sorted(map(tuple, pairs.mapInArrow(lines, "doc_id long, quality int, lines binary").collect()))
    if not rows:
        return LineField()
    lines = [(q, np.frombuffer(x, np.float64).reshape(-1, FEATURES + 1)) for _, q, x in rows]
    return train([(q, x[:, :-1], x[:, -1]) for q, x in lines])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, the counts, base_failed, content_share, kept) for each row of docs (doc_id, text; others are ignored).

    A null or blank text has no words and fails. Without lines the share is 0.
    """

    def run(batches):
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            n = batch.num_rows
            c, f, of, size = analyse(buf, offs)
            labels = field.viterbi(f, of, n)
            share = np.bincount(of, size * (labels == CONTENT), minlength=n) / np.maximum(np.bincount(of, size, minlength=n), 1)
            failed = _failed(c)
            cols = [batch.column("doc_id"), *(pa.array(c[k]) for k in _COUNTS), pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT_SHARE))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_COUNTS, "base_failed", "content_share", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits the field on labels (doc_id, quality) and judges every row of docs. An empty table gives an empty result."""
    return judge(docs, fit(docs, labels))
