"""Language identification by a small convolutional network over bytes, trained here in numpy.

Bytes are embedded, filtered at several widths, max-pooled and classified by softmax, over fixed windows that tile the whole
text. A document's prediction is the mean of its windows' probabilities.

Every language with a usable document is learned: the sample and the last layer grow with the number of languages, not with that of
documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, texts_of

WINDOW = 256
EMBED, FILTERS, WIDTHS = 4, 16, (2, 3, 4)
#: The fit's bound: documents of each language in its sample, and windows of each document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 1000, 2
EPOCHS, BATCH, RATE = 6, 64, 0.01
UND = "und"
#: with_language rejects a document whose likeliest language has less: less likely than not, whatever the number of languages.
MIN_SCORE = 0.5


def windows_of(buf: np.ndarray, offs: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, document): the text cut every width bytes, the last one moved back to the end, or padded with 0."""
    sizes = np.diff(offs)
    n = np.maximum(1, -(-sizes // width))
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = offs[doc] + np.maximum(0, np.minimum(k * width, sizes[doc] - width))
    padded = np.concatenate([buf, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[first]
    short = np.flatnonzero(sizes[doc] < width)
    if len(short):
        out = out.copy()
        out[short] *= np.arange(width) < sizes[doc][short, None]
    return out, doc


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32), "o": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "ob": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """(windows, places, w * EMBED) without a copy: a row of the embedded bytes from each place."""
        n, t, _ = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, t - w + 1, w * EMBED), (s[0], s[1], s[2]), writeable=False)

    def forward(self, win: np.ndarray, training: bool = False):
        x = np.ascontiguousarray(self.p["e"][win])
        pooled, tops = [], []
        for w in WIDTHS:
            z = np.matmul(self._columns(x, w), self.p[f"w{w}"])
            if training:
                tops.append(z.argmax(axis=1))
            pooled.append(np.maximum(z.max(axis=1) + self.p[f"b{w}"], 0))
        h = np.concatenate(pooled, axis=1)
        s = h @ self.p["o"] + self.p["ob"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        return (s, h, tops) if training else s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows x with languages y, by backpropagation through the pooled places."""
        s, h, tops = self.forward(x, True)
        s[np.arange(len(y)), y] -= 1
        s /= len(y)
        g = {"o": h.T @ s, "ob": s.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (s @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(y))[:, None]
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"b{w}"] = d.sum(axis=0)
            dw = np.zeros((w, EMBED, FILTERS), self.p["e"].dtype)
            kernel = self.p[f"w{w}"].reshape(w, EMBED, FILTERS)
            for k in range(w):
                b = x[rows, tops[j] + k]
                dw[k] = np.einsum("nfe,nf->ef", self.p["e"][b], d)
                np.add.at(g["e"], b, d[:, :, None] * kernel[k].T[None])
            g[f"w{w}"] = dw.reshape(w * EMBED, FILTERS)
        return g

    def fit(self, win: np.ndarray, lang: np.ndarray, seed: int = 11) -> "Network":
        """By Adam steps over shuffled batches."""
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = r.permutation(len(win))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                g = self.gradients(win[at], lang[at])
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out():
    """A document whose text and lang are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame) -> Network | None:
    """From text and lang of documents that are not held out. The sample takes documents by a hash of doc_id with a
    probability that gives about DOCS_PER_LANG of each language; None without any."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", "text")
    counts = {x["lang"]: x["n"] for x in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, DOCS_PER_LANG / counts[k])])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(rate, F.col("lang")) * (1 << 20))

    def cut(batches):
        for batch in in_blocks(batches):
            out = []
            for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                b = np.frombuffer(text.encode(), np.uint8)
                w, _ = windows_of(b, np.array([0, len(b)]))
                pick = np.random.default_rng(zlib.crc32(str(i).encode())).permutation(len(w))[:WINDOWS_PER_DOC]
                out += [(i, lang, w[k].tobytes()) for k in sorted(pick.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "win"])

    rows = sorted(map(tuple, chosen.mapInArrow(cut, "doc_id long, lang string, win binary").collect()))
    if not rows:
        return None
    win = np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(-1, WINDOW)
    return Network(langs).fit(win, np.array([langs.index(x[1]) for x in rows]))


def _verdict(network: Network | None, batch: pa.RecordBatch, letters: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row: the mean of its windows' probabilities."""
    lang, score = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
    if network is not None and letters.any():
        buf, offs = texts_of(batch.column(batch.schema.get_field_index(text)))
        win, doc = windows_of(buf, offs)
        p = np.concatenate([network.forward(win[i : i + 64]) for i in range(0, len(win), 64)]).astype(np.float64)
        mean = np.add.reduceat(p, np.searchsorted(doc, np.arange(batch.num_rows)), axis=0)
        mean /= mean.sum(axis=1, keepdims=True)
        lang = np.where(letters, np.array(network.langs, object)[mean.argmax(axis=1)], UND)
        score = np.where(letters, mean.max(axis=1), 0.0)
    return lang, np.clip(score, 0, 1)


def has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs' rows as (doc_id, held_out, lang_pred, score). A null text, or one without a letter, is und with score 0; so
    are all where nothing could be learned. A null doc_id is not held out; rows that repeat a doc_id are judged each for itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text", has_letter().alias("letters"))

    def run(batches):
        for batch in in_blocks(batches, 1 << 20):
            lang, score = _verdict(network, batch, batch.column("letters").to_numpy(zero_copy_only=False), "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on docs (doc_id, text, lang; other columns are ignored) and predicts every row. An empty table gives none."""
    return predict(docs, fit(docs))


def with_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that have no language to tell: null texts, those without a letter, and those whose likeliest language
    has a score below min_score.

    Each row is judged by its own text, whatever its doc_id, a null or a repeated one too. Where nothing could be learned (no row
    has a lang, an empty table) every row with a letter stays.
    """
    network, place = fit(docs), docs.columns.index("text")
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumnRenamed(f"c{place}", "text").where(has_letter())
    schema = rows.schema

    def run(batches):
        for batch in in_blocks(batches, 1 << 20):
            _, score = _verdict(network, batch, np.ones(batch.num_rows, bool), "text")
            yield batch.filter(pa.array(score >= min_score))

    return (rows.mapInArrow(run, schema) if network is not None else rows).toDF(*docs.columns)
