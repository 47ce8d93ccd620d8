"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens and has a weight: by default its share of all tokens, so that every window of `length`
tokens has the corpus's proportions. In a round every queue's deficit is raised by its quantum, a time step times its weight, and it
sends what rounds to whole tokens; the time step is the one that fills the window. What is left, half a token at most either way, is
the deficit that it carries to the next window. A queue that has run empty leaves its part to the others by their weights. All windows
but the last are full.

Partitions do this without each other: the deficits carried into any window follow from the queues' totals alone. By time v a queue of
weight w has sent the whole tokens nearest to w * v, so its token j (from 0) is due at (j + 1/2) / w, all tokens have one order by
due time and queue, and a window is the next `length` of them. What each queue has sent by a window is found by bisection over time.

The order within a queue is (partition, row) of the tokenised table, which is written once; only its totals by partition
and source are summed over the cluster.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finished, in_blocks, stored

LENGTH = 2048
END_ID = 1
#: Words whose ids a worker remembers before it forgets all.
REMEMBERED = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, by words: the tokenizer never joins across a space or a line feed, so each word is encoded once. Where the
    tokenizer's rules are STEPS, a word of SIMPLE characters is cut to PIECES here and each goes to the tokenizer's model; all
    other new words of a block are encoded in one call with a mark between them."""

    MARK = "~"
    #: Rules under which the words of SIMPLE are cut to PIECES: lower case, composed, runs of letters or marks and single digits; the
    #: apostrophe has rules of its own, and added tokens begin with <|.
    STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
    }
    SIMPLE = re.compile("(?:[a-z0-9!-&(-;=-@\\[-`{-~\xdf-\xf6\xf8-\xff]++|<(?!\\|))++")
    PIECES = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
    #: The characters that stand for the bytes of what isn't ASCII.
    BYTES = {**{b: 162 + b for b in range(128, 161)}, 173: 323}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.simple = all(rules.get(k) == v for k, v in self.STEPS.items()) and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
        self.simple = self.simple and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        self.known: dict[bytes, bytes] = {b"": b""}
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        # These hold for a tokenizer that lowers case, and parts a letter from a full stop or comma.
        self.lowers = self._ids("Aa Zz") == self._ids("aa zz")
        self.parts = {p: self._ids(f"az{p} a") == self._ids(f"az {p} a") for p in ".,"}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: bytes) -> bytes:
        """A-Z in lower case, but where that could join a letter with a mark after it, or make a special token."""
        return text if not self.lowers or b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()

    def _piece(self, text: str) -> bytes:
        """The ids of one of PIECES."""
        raw = text.encode()
        ids = self.known.get(raw)
        if ids is None:
            tokens = self.model.tokenize(text if text.isascii() else raw.decode("latin-1").translate(self.BYTES))
            ids = self.known[raw] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def _learn(self, words: set[bytes]) -> None:
        if self.simple:
            simple, pieces, piece, rest = self.SIMPLE.fullmatch, self.PIECES.findall, self._piece, set()
            for raw in words:
                if simple(w := raw.decode()):
                    self.known[raw] = piece(w) if w.isalpha() else b"".join(map(piece, pieces(w)))
                else:
                    rest.add(raw)
            words = rest
        known, ends = self.known, tuple(p.encode() for p, ok in self.parts.items() if ok)
        ended = {w for w in words if w.endswith(ends) and w[-2:-1].islower()} if ends else set()
        rest = (words - ended) | {w[:-1] for w in ended}
        texts = [w.decode() for w in sorted(rest) if w not in known]
        texts += [p.decode() for p in ends if p not in known and p.decode() not in texts]
        for w in texts:
            if self.mark is None or self.MARK in w:
                known[w.encode()] = np.array(self._ids(w), "<u4").tobytes()
        texts = [w for w in texts if self.MARK not in w] if self.mark is not None else []
        # The mark's id belongs to no word without the mark.
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            ids = np.array(self._ids(f" {self.MARK} ".join(part)), "<u4")
            raw, cut = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
            for w, x, y in zip(part, [-4, *cut], [*cut, len(raw)]):
                known[w.encode()] = raw[x + 4 : y]
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as little-endian unsigned 32 bits."""
        split = [self._plain(t).replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {b"": b""}
        known = self.known
        if new := set().union(*split).difference(known):
            self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def __call__(self, text: str) -> bytes:
        return self.all([text.encode()])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process: a worker's later partitions find the words that it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_TOKENS = "doc_id long, source string, part int, place long, n long, ids binary"


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Ids of each text with end_id behind, and where they begin in the queue of (part, source). Ids are kept as 16 bits
    where the vocabulary allows."""

    def run(batches):
        encode, served = encoder(path), {}
        wide = encode.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in in_blocks(batches):
            out = []
            texts = encode.all([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            for i, ids, source in zip(batch.column("doc_id").to_pylist(), texts, batch.column("source").to_pylist()):
                ids += end
                n = len(ids) // 4
                at = served.get(source, 0)
                served[source] = at + n
                out.append((i, source, part, at, n, ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "source", "part", "place", "n", "ids"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, _TOKENS)


class RoundRobin:
    """The rounds over queues of so many tokens. Times are compared as the same floating-point numbers everywhere."""

    #: Windows whose rounds are worked out together.
    CHUNK = 256
    #: Numbers of such chunks that are kept.
    KEPT = 1 << 20

    def __init__(self, totals, weights, length: int):
        self.totals, self.weights, self.length = np.asarray(totals, np.int64), np.asarray(weights, np.float64), length
        if len(self.totals) != len(self.weights) or not (self.weights > 0).all():
            raise ValueError("every source needs a positive weight")
        self.total, self._chunks, self._turns, self._last = int(self.totals.sum()), {}, {}, {}

    def _due(self, v: np.ndarray) -> np.ndarray:
        """(times, queues): how many tokens of each queue are due at time v or before."""
        v, w = np.asarray(v, np.float64)[:, None], self.weights
        n = np.clip(np.floor(v * w + 0.5), 0, self.totals)
        # The product's rounding may be one off the comparison of times.
        n += (n < self.totals) & ((n + 0.5) / w <= v)
        n -= (n > 0) & ((n - 0.5) / w > v)
        return n.astype(np.int64)

    def _search(self, t: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        """(what each queue has sent, a time) when t tokens have been sent, by bisection of times from lo (fewer due) to hi (as many)."""
        lo, hi, time = np.full(len(t), lo), np.full(len(t), hi), np.full(len(t), hi)
        out, open_ = np.zeros((len(t), len(self.totals)), np.int64), np.arange(len(t))
        while len(open_):
            mid = lo[open_] + (hi[open_] - lo[open_]) / 2
            n = self._due(mid)
            sum_ = n.sum(axis=1)
            enough = sum_ >= t[open_]
            lo[open_], hi[open_] = np.where(enough, lo[open_], mid), np.where(enough, mid, hi[open_])
            done = sum_ == t[open_]
            at = lo[open_] + (hi[open_] - lo[open_]) / 2
            stuck = (at <= lo[open_]) | (at >= hi[open_])
            out[open_[done]] = n[done]
            if len(tied := open_[stuck & ~done]):
                # Neighbouring times: of the tokens due at the later one the last queues' ones wait.
                n = self._due(hi[tied])
                due = n - self._due(lo[tied])
                waiting = np.cumsum(due[:, ::-1], axis=1)[:, ::-1]
                out[tied] = n - ((due > 0) & (waiting <= (n.sum(axis=1) - t[tied])[:, None]))
            time[open_] = hi[open_]
            open_ = open_[~(done | stuck)]
        return out, time

    def sent(self, t) -> np.ndarray:
        """(numbers, queues): what each queue has sent when t tokens have been sent in all; t ascends."""
        t = np.minimum(np.asarray(t, np.int64), self.total)
        last = float(((self.totals + 0.5) / self.weights).max(initial=0))
        _, ends = self._search(t[[0, -1]], -1.0, last)
        # The first time may have more due than its number of tokens: the search begins just before what can be due then.
        step = float((1 / self.weights).max(initial=0))
        return self._search(t, max(-1.0, ends[0] - 2 * step), ends[1])[0]

    def window_of(self, queue: int, place: int) -> int:
        """The window in which a queue sends its token at place: by the number of tokens due before it."""
        time = np.float64(place + 0.5) / self.weights[queue]
        upto, before = self._due(np.array([time, np.nextafter(time, -1)]))
        return int(upto[:queue].sum() + before[queue:].sum()) // self.length

    def turn(self, queue: int, window: int) -> tuple[int, int, int]:
        """(first token, tokens, offset in the window) of a queue in a window."""
        k, at = divmod(window, self.CHUNK)
        have = self._turns.get(queue)
        if have is None or have[0] != k:
            # Queues are at windows of their own: each keeps its turns of a chunk, and the chunks worked out last are kept whole.
            if k not in self._chunks:
                sent = self.sent(np.arange(k * self.CHUNK, (k + 1) * self.CHUNK + 1) * self.length)
                size = np.diff(sent, axis=0)
                while self._chunks and len(self._chunks) * sent.size > self.KEPT:
                    del self._chunks[next(iter(self._chunks))]
                self._chunks[k] = sent, size, np.cumsum(size, axis=1) - size
            have = self._turns[queue] = k, *(x[: self.CHUNK, queue].tolist() for x in self._chunks[k])
        return have[1][at], have[2][at], have[3][at]

    def pieces(self, queue: int, place: int, n: int):
        """(start, length, window, offset) of the pieces of n tokens from place of a queue."""
        # Documents of a queue mostly follow each other: the last one's window is where this one begins.
        ended, window = self._last.get(queue, (None, 0))
        start, window = 0, window if ended == place else self.window_of(queue, place)
        while start < n:
            first, have, offset = self.turn(queue, window)
            left = first + have - place
            if left > 0:
                size = min(left, n - start)
                yield start, size, window, offset + place - first
                start, place = start + size, place + size
                self._last[queue] = place, window
            window += 1


def weights_of(names: list, totals: list[int], weights: dict | None) -> list[float]:
    """By source; without any the totals, so that each window has the corpus's proportions."""
    if weights is None:
        return totals
    if missing := [n for n in names if n not in weights]:
        raise ValueError(f"sources without a weight: {missing[:10]}")
    return [weights[n] for n in names]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(totals: list[int], weights: list[float], names: list, length: int):
    def run(batches):
        rounds, queue = RoundRobin(totals, weights, length), {s: k for k, s in enumerate(names)}
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "at")))
            for doc, source, n, ids, at in rows:
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for start, size, w, offset in rounds.pieces(queue[source], at, n):
                    out.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, w, offset, source))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], names=_PIECE_NAMES)

    return run


_PIECE_NAMES = [x.split(" ")[0] for x in _PIECES.split(", ")]


@finished
def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, weights: dict | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, source; other columns are ignored) in sequences of length tokens.

    weights: by source, the proportions that every window is filled to while its queues last; None: those of all tokens. One that
    names not every source is an error. The sources' totals are collected, a few bytes for each.
    A null or empty text is its end_id alone. A null source is a queue of its own. Rows that repeat are packed as often.
    An empty table gives no piece. Only the last sequence can be short; it is padded to length unless its size is a
    power of two.
    """
    tokens = stored(tokenised(docs, path or tokenizer_path(), end_id), "tokens")
    sums = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    found = sums.groupBy("source").agg(F.sum("n").alias("own")).orderBy(F.col("source").asc_nulls_last()).collect()
    names, totals = [x["source"] for x in found], [x["own"] for x in found]
    weights = weights_of(names, totals, weights)
    base = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = sums.select(F.col("part").alias("_part"), F.col("source").alias("_source"), F.coalesce(base, F.lit(0)).alias("base"))
    # Written so that its size is known: small, it is broadcast; beyond the session's threshold both sides are shuffled.
    placed = tokens.join(stored(places, "places"), F.expr("part = _part and source <=> _source"))
    return placed.select("doc_id", "source", "n", "ids", (F.col("base") + F.col("place")).alias("at")).mapInArrow(_cut(totals, weights, names, length), _PIECES)
