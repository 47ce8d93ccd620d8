"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts earlier.

Which shard a string belongs to follows from its bytes: the smallest hash among its grams of `length - SLIDE + 1`
bytes. Neighbouring starts mostly have the same smallest gram, so a run of them with its text is one row, and equal
strings always meet in one shard.

1. Each block of texts finds its runs and sends the hashes of their grams, once each, to buckets that look for those
   of other blocks. A gram that occurs once can't be part of a repeat. A gram that repeats inside a block is known there.
2. Each document gets back its repeated grams; its runs are found in their sorted array by binary search. Runs with
   equal texts in a block are settled there, the rest goes to the gram's shard.
3. A shard joins its distinct run texts and builds their suffix array by Larsson-Sadakane refinement (prefix
   doubling that sorts only groups that are still tied), and common prefixes by Kasai's rule in the permuted form: a
   suffix whose left neighbour has the same predecessor shifted by one has one byte less, so only the others are
   compared. Starts between which all common prefixes reach `length` are equal strings; all but the first are removed.
4. Where there are many blocks, shards are split by block, each part with a suffix array of its own. What is first in its part is
   merged across the parts: a part's starts, in the order of their suffixes, are looked up by binary search among those merged before,
   string against string; of equal ones the earlier stays.

Grams are 64-bit hashes that say which strings may meet; whether they are equal is decided by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, bucketed, finished, in_blocks, mix, prefix_hashes, span_hashes, stored, text_bytes, texts_of

LENGTH = 100
#: Grams in a string: a larger number sends fewer, longer runs.
SLIDE = 61
#: Starts in one run at most; longer ones, of periodic texts, are cut.
RUN = 256
PER_BUCKET = 4_000_000
SHARD_BYTES = 3 << 20
SPLIT_BLOCKS = 4096


# ------------------------------------------------------------------ suffix arrays
def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane: a suffix's rank is its group's first place; each round sorts the tied
    groups by the rank of the suffix h bytes on and doubles h."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    # Bytes 0 and the end differ: the last 8 suffixes are put right by the rounds, whose missing rank is -1.
    sa = np.argsort(key)
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    tail = key[max(0, n - 7) :]
    for lo, hi in sorted(set(zip(np.searchsorted(k, tail).tolist(), np.searchsorted(k, tail, "right").tolist()))):
        group = sa[lo:hi]
        short = np.sort(group[group > n - 8])[::-1]
        sa[lo:hi] = np.concatenate([short, group[group <= n - 8]])
        new[lo : min(hi, lo + len(short) + 1)] = True
    del key, k, tail
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    size = np.append(new, True)
    tied = np.flatnonzero(~(size[:-1] & size[1:]))
    h = 8
    while len(tied):
        at = sa[tied]
        next_ = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        group = rank[at]
        order = np.argsort(group * (n + 1) + next_ + 1)
        at, group, next_ = at[order], group[order], next_[order]
        sa[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        size = np.append(new, True)
        tied = tied[~(size[:-1] & size[1:])]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[k] of the suffixes sa[k-1] and sa[k]; lcp[0] is 0. Kasai's rule: with i's predecessor that of i-1 shifted by
    one, and equal bytes before both, i has one byte less than i-1; only the other suffixes are compared, eight bytes a step."""
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    lead = np.ones(n, bool)
    lead[1:] = (before[1:] != before[:-1] + 1) | (before[1:] < 1) | (text[:-1] != text[before[1:] - 1])
    i = np.flatnonzero(lead & (before >= 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word[:n] = (word[:n] << np.uint64(8)) | padded[k : k + n]
    length = np.zeros(len(i), np.int64)
    active = np.arange(len(i))
    a, b = i.copy(), before[i]
    while len(active):
        x, y = a[active] + length[active], b[active] + length[active]
        differ = word[np.minimum(x, n)] ^ word[np.minimum(y, n)]
        same = 8 - (np.frexp(differ.astype(np.float64))[1] + 7) // 8
        # frexp rounds up only for values just below a power of two: then the byte count may be one too low.
        high = np.where(differ != 0, np.minimum(same, 7), 8)
        fix = (differ != 0) & (high < 7) & ((differ >> ((np.uint64(7) - high.astype(np.uint64)) * np.uint64(8))) == 0)
        high = np.where(fix, high + 1, high)
        high = np.minimum(high, n - np.maximum(x, y))
        length[active] += high
        active = active[(high == 8)]
    upto = np.full(n, -1)
    upto[i] = i + length
    plcp = np.maximum(np.maximum.accumulate(upto) - np.arange(n), 0)
    plcp[before < 0] = 0
    return plcp[sa]


# ------------------------------------------------------------------ runs
def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


def runs_of(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, document, first start, number of starts, whether its gram may occur in it twice) of every run; starts
    count in buf."""
    slide = min(SLIDE, length - 7)
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    if len(buf) < length:
        return none
    gram = length - slide + 1
    prefix = prefix_hashes(buf)
    at = np.arange(len(buf) - gram + 1)
    h = span_hashes(prefix, at, at + gram)
    g = _sliding_min(h, slide)
    # A position is the smallest of some start if the largest of its starts' minima is its own hash.
    low = np.concatenate([np.zeros(slide - 1, np.uint64), g, np.zeros(slide - 1, np.uint64)])
    chosen = np.flatnonzero(~_sliding_min(~low, slide)[: len(h)] == h)
    by = np.lexsort((chosen, h[chosen]))
    p = chosen[by]
    near = np.zeros(len(buf) + 2 * RUN, np.int32)
    near[p[:-1][(h[p[1:]] == h[p[:-1]]) & (p[1:] - p[:-1] < slide + RUN)] + 1] = 1
    near = np.cumsum(near)
    sizes = np.diff(offs)
    ok = np.zeros(len(g) + 1, bool)
    change = np.zeros(len(buf) + 2, np.int32)
    long = sizes >= length
    np.add.at(change, offs[:-1][long], 1)
    np.add.at(change, offs[1:][long] - length + 1, -1)
    ok[: len(g)] = np.cumsum(change)[: len(g)] > 0
    starts = ok[:-1].copy()
    starts[1:] &= (g[1:] != g[:-1]) | ~ok[:-2]
    edge = offs[:-1][long]
    starts[edge] = True
    s = np.flatnonzero(starts)
    if not len(s):
        return none
    ends = np.flatnonzero(ok[:-1] & (np.append(starts[1:], True) | ~ok[1:])) + 1
    n = ends - s
    pieces = -(-n // RUN)
    of = np.repeat(np.arange(len(s)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = s[of] + k * RUN
    size = np.minimum(n[of] - k * RUN, RUN)
    twice = near[first + size - 1 + slide] > near[first]
    return g[s[of]], np.searchsorted(offs, first, "right") - 1, first, size, twice


_SENT = "bucket int, ids binary, counts binary, grams binary, own_ids binary, own_counts binary, own_grams binary"
_SENT_NAMES = [x.split(" ")[0] for x in _SENT.split(", ")]


def _send(buckets: int, length: int):
    """A row for each block and bucket: the block's grams there, each once with its document; and, in one of the
    rows, the grams that repeat inside the block with all their documents."""

    def lists(doc, g, ids):
        """Sorted by document: ids, counts and grams as bytes."""
        has, count = np.unique(doc, return_counts=True)
        return ids[has].tobytes(), count.astype(np.uint32).tobytes(), g.tobytes()

    def run(batches):
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            ids = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
            g, doc, _, _, twice = runs_of(buf, offs, length)
            if not len(g):
                continue
            by = np.lexsort((doc, g))
            g, doc = g[by], doc[by]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            many = ~(new & np.append(new[1:], True)) | twice[by]
            by = np.flatnonzero(many)
            by = by[np.lexsort((g[by], doc[by]))]
            keep = by[np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (doc[by][1:] != doc[by][:-1])])] if len(by) else by
            own = lists(doc[keep], g[keep], ids)
            one, of = g[new], doc[new]
            where = (mix(one) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((of, where))
            one, of, where = one[by], of[by], where[by]
            cut = np.searchsorted(where, np.arange(buckets + 1))
            rows, home = [], int(where[0])
            for x in range(buckets):
                s = slice(cut[x], cut[x + 1])
                if cut[x] < cut[x + 1]:
                    rows.append((x, *lists(of[s], one[s], ids), *(own if x == home else (b"", b"", b""))))
            kinds = (pa.int32(),) + (pa.binary(),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_SENT_NAMES)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: each document's grams that occur in another block, and those that blocks know by themselves."""
    out = []
    for ids, counts, grams, shared in (("ids", "counts", "grams", True), ("own_ids", "own_counts", "own_grams", False)):
        ids, counts, g = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in ((ids, np.int64), (counts, np.uint32), (grams, np.int64)))
        doc = np.repeat(np.arange(len(ids)), counts)
        if shared and len(g):
            by = np.argsort(g, kind="stable")
            s = g[by]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            at = np.sort(by[~(new & np.append(new[1:], True))])
            doc, g = doc[at], g[at]
        has, begin = np.unique(doc, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(g)).astype(np.int32)), pa.array(g))
        out.append(pa.table({"row": pa.array(ids[has]), "grams": lists}))
    return pa.concat_tables(out)


_RUNS = "doc_id long, row long, at long, starts int, gram long, block long, body binary, ranks binary"
_RUN_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_RUN_NAMES = [x.split(" ")[0] for x in _RUNS.split(", ")]


def _rows(doc, row, at, starts, gram, block, body, ranks=None) -> pa.RecordBatch:
    """ranks: of each start of a run, its place among its part's starts by their suffixes."""
    cols = (doc, row, at, starts, gram, block, body, [None] * len(doc) if ranks is None else ranks)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _RUN_KINDS)], names=_RUN_NAMES)


def _none() -> pa.Table:
    return pa.Table.from_batches([], _rows(*[[]] * 7).schema)


def _found(length: int):
    """The runs whose gram repeats; a null body: all its starts are known to be repeats."""

    def run(batches):
        for batch in in_blocks(batches):
            lists = batch.column("grams").combine_chunks() if isinstance(batch.column("grams"), pa.ChunkedArray) else batch.column("grams")
            wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)) if lists.null_count < len(lists) else np.zeros(0, np.int64)
            if not len(wanted):
                continue
            buf, offs = texts_of(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
            g, doc, s, n, _ = runs_of(buf, offs, length)
            signed = g.astype(np.int64)
            k = np.minimum(np.searchsorted(wanted, signed), len(wanted) - 1)
            hit = wanted[k] == signed
            g, doc, s, n = signed[hit], doc[hit], s[hit], n[hit]
            if not len(g):
                continue
            e = s + n - 1 + length
            whole = span_hashes(prefix_hashes(buf), s, e)
            at = s - offs[doc]
            by = np.lexsort((at, keys[doc], ids[doc], whole))
            same = np.concatenate([[False], whole[by][1:] == whole[by][:-1]])
            # Rows that repeat a doc_id and its text have the same place: none of them is earlier.
            lead = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
            later = np.zeros(len(g), bool)
            later[by] = same & ~((ids[doc[by]] == ids[doc[lead]]) & (keys[doc[by]] == keys[doc[lead]]) & (at[by] == at[lead]))
            raw = buf.tobytes()
            first = np.arange(len(g))
            first[by] = lead
            for x in np.flatnonzero(later).tolist():  # equal hashes: the bytes decide
                later[x] = raw[s[x] : e[x]] == raw[s[first[x]] : e[first[x]]]
            body = [None if x else raw[i:j] for x, i, j in zip(later.tolist(), s.tolist(), e.tolist())]
            yield _rows(ids[doc], keys[doc], at, n, g, np.full(len(g), uuid.uuid4().int & 0x7FFFFFFF), body)

    return run


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in it) of every start of runs of n starts."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _again(cols, of, k, again) -> pa.RecordBatch:
    """Rows with a null body for the starts k of runs of that are repeats, neighbouring ones in one row."""
    doc, row, at, _, gram = cols
    by = np.flatnonzero(again)
    by = by[np.lexsort((k[by], of[by]))]
    o, k = of[by], k[by]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(o)), bool), (o[1:] != o[:-1]) | (k[1:] != k[:-1] + 1)]))
    r, size = o[new], np.diff(np.append(new, len(o)))
    return _rows(doc[r], row[r], at[r] + k[new], size, gram[r], np.zeros(len(r), np.int64), [None] * len(r))


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "row", "at", "starts", "gram")]


def _settle(length: int, final: bool):
    """Of a part of a shard: rows with a null body for starts that are repeats in it and, where other parts are to be merged, the runs
    that have a first occurrence, with the ranks of their starts."""

    def run(table: pa.Table) -> pa.Table:
        body = table.column("body").to_pylist()
        doc, row, at, n, gram = _columns(table)
        first, lead, copies = {}, [], []
        for k in np.lexsort((at, row, doc)).tolist():
            i = first.setdefault(body[k], k)
            if i == k:
                lead.append(k)
            elif doc[i] != doc[k] or row[i] != row[k] or at[i] != at[k]:
                copies.append(k)
        out = []
        if copies:
            c = np.array(copies)
            out.append(_rows(doc[c], row[c], at[c], n[c], gram[c], np.zeros(len(c), np.int64), [None] * len(c)))
        if lead:
            c = np.array(lead)
            sizes = np.array([len(body[k]) for k in lead])
            # A number after each text keeps any two suffixes apart soon after it.
            text = np.frombuffer(b"".join(body[k] + i.to_bytes(5, "big") for i, k in enumerate(lead)), np.uint8)
            begin = np.cumsum(sizes + 5) - sizes - 5
            sa, _ = suffix_array(text)
            lcp = common_prefixes(text, sa)
            group, place = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
            group[sa] = np.cumsum(lcp < length)
            place[sa] = np.arange(len(text))
            of, k = _spread(n[c])
            every, group, place = of, group[begin[of] + k], place[begin[of] + k]
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            group, of, k = group[several], of[several], k[several]
            d, r, start = doc[c][of], row[c][of], at[c][of] + k
            by = np.lexsort((start, r, d, group))
            g, d, r, start, of, k = group[by], d[by], r[by], start[by], of[by], k[by]
            head = np.maximum.accumulate(np.where(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]), np.arange(len(g)), 0))
            again = (d != d[head]) | (r != r[head]) | (start != start[head])
            cols = [x[c] for x in (doc, row, at, n, gram)]
            if again.any():
                out.append(_again(cols, of, k, again))
            if not final:
                # Runs that still have a first occurrence: some start was not found again.
                cut = np.cumsum(n[c])[:-1]
                ranks = [x.astype("<u4").tobytes() for x in np.split(place, cut)]
                left = np.flatnonzero(np.bincount(of[again], minlength=len(c)) < np.bincount(every, minlength=len(c)))
                block = np.full(len(left), table.column("part")[0].as_py() if len(left) else 0)
                out.append(_rows(*[x[left] for x in cols], block, [body[c[k]] for k in left.tolist()], [ranks[k] for k in left.tolist()]))
        return pa.Table.from_batches(out) if out else _none()

    return run


class Strings:
    """The strings of length bytes of a text, by their starts; compared eight bytes a step."""

    def __init__(self, text: np.ndarray, length: int):
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(len(text) + 1, np.uint64)
        for k in range(8):
            self.word[:-1] = (self.word[:-1] << np.uint64(8)) | padded[k : k + len(text)]
        self.steps = [*range(0, length - 8, 8), length - 8]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of starts."""
        out, open_ = np.zeros(len(a), np.int8), np.arange(len(a))
        for step in self.steps:
            x, y = self.word[a[open_] + step], self.word[b[open_] + step]
            differ = x != y
            out[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
            open_ = open_[~differ]
            if not len(open_):
                break
        return out

    def lower(self, ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each wanted start the first place in ordered whose string isn't smaller, by binary search."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered))
        while len(at := np.flatnonzero(lo < hi)):
            mid = (lo[at] + hi[at]) // 2
            small = self.compare(ordered[mid], wanted[at]) < 0
            lo[at[small]], hi[at[~small]] = mid[small] + 1, mid[~small]
        return lo


def _merge(length: int):
    """Of a shard: rows for the starts that were first in their part of it but have an equal string earlier in another part."""

    def run(table: pa.Table) -> pa.Table:
        body, ranks, part = (table.column(c).to_pylist() for c in ("body", "ranks", "block"))
        cols = _columns(table)
        doc, row, at, n, _ = cols
        text = np.frombuffer(b"".join(body), np.uint8)
        begin = np.cumsum([0] + [len(b) for b in body])[:-1]
        of, k = _spread(n)
        start, rank, part = begin[of] + k, np.frombuffer(b"".join(ranks), "<u4"), np.array(part)[of]
        strings, again = Strings(text, length), np.zeros(len(of), bool)

        def earlier(x, y):
            """Whether the starts x are before the starts y in the corpus."""
            d, r, p = doc[of], row[of], (at[of] + k)
            return (d[x] < d[y]) | (d[x] == d[y]) & ((r[x] < r[y]) | (r[x] == r[y]) & (p[x] < p[y]))

        def joined(a, b):
            """Two lists of starts, each in the order of its strings, as one; of equal strings only the earlier goes on."""
            if len(a) < len(b):
                a, b = b, a
            if not len(b):
                return a
            place = strings.lower(start[a], start[b])
            at_a = a[np.minimum(place, len(a) - 1)]
            equal = (place < len(a)) & (strings.compare(start[at_a], start[b]) == 0)
            x, y = at_a[equal], b[equal]
            first = earlier(x, y)
            again[np.where(first, y, x)[first | earlier(y, x)]] = True
            a = a.copy()
            a[place[equal]] = np.where(first, x, y)
            return np.insert(a, place[~equal], b[~equal])

        lists = []
        for p in np.unique(part):
            i = np.flatnonzero(part == p)
            i = i[np.argsort(rank[i], kind="stable")]
            # Equal strings of one part: its settling kept all but the first as repeats already.
            s = strings.compare(start[i][:-1], start[i][1:]) == 0
            head = np.maximum.accumulate(np.where(np.concatenate([[True], ~s]), np.arange(len(i)), 0))
            by = np.lexsort((at[of[i]] + k[i], row[of[i]], doc[of[i]], head))
            new = np.concatenate([[True], head[by][1:] != head[by][:-1]])
            lists.append(i[by[new]])
        while len(lists) > 1:
            lists = [joined(x, y) for x, y in zip(lists[::2], [*lists[1::2], np.zeros(0, np.int64)])]
        return pa.Table.from_batches([_again(cols, of[again], k[again], np.ones(again.sum(), bool))]) if again.any() else _none()

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(length: int, keep: bool):
    def run(batches):
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            raw, out = buf.tobytes(), []
            for i, a, b, spans in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), batch.column("spans").to_pylist()):
                body, gone, merged = raw[a:b], 0, []
                for s in sorted((x["at"], x["at"] + x["starts"] - 1 + length) for x in spans or () if x["doc_id"] == i):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                if merged:
                    cuts = [0, *(x for s in merged for x in s), len(body)]
                    gone = sum(y - x for x, y in merged)
                    body = b"".join(body[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                out.append((i, b - a, gone, len(merged), hashlib.sha256(body).hexdigest(), body if keep else None))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split(" ")[0] for x in _RESULT.split(", ")])

    return run


@finished
def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text; others are ignored).

    kept: the remaining bytes, null unless keep. A null text is empty; a text shorter than length loses nothing. Rows that
    repeat a doc_id with unlike texts are documents of their own, the one whose text has the smaller hash first; with equal texts
    they are one document in two rows, and none is earlier than the other. A row without a doc_id has no place: nothing is
    removed from it nor because of it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", key)
    total = text_bytes(docs)
    # The texts are dealt by row once, into a table that later joins by row read without another exchange.
    # With fewer buckets than shuffle partitions the joins would deal them again.
    parts = max(blocks_for(total, 24 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = bucketed(docs.where("doc_id is not null").repartition(parts, "row"), "texts", "row", parts)

    buckets = blocks_for(total // 25, PER_BUCKET)
    sent = texts.mapInArrow(_send(buckets, length), _SENT)
    grams = stored(sent.groupBy("bucket").applyInArrow(_meet, "row long, grams array<long>"), "grams")
    grams = grams.groupBy("row").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    found = texts.join(grams.hint("shuffle_hash"), "row").select("doc_id", "row", "text", "grams").mapInArrow(_found(length), _RUNS)
    found = stored(found, "runs")

    size = found.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = blocks_for(size, SHARD_BYTES)
    known, open_ = found.where("body is null"), found.where("body is not null")
    parts = blocks_for(total, SPLIT_BLOCKS * (4 << 20))
    shard = F.pmod("gram", F.lit(shards)).alias("shard")
    if parts > 1:
        dealt = open_.select("*", shard, (F.col("block") % parts).alias("part"))
        settled = stored(dealt.groupBy("shard", "part").applyInArrow(_settle(length, False), _RUNS), "settled")
        known = known.unionByName(settled.where("body is null"))
        known = known.unionByName(settled.where("body is not null").groupBy(shard).applyInArrow(_merge(length), _RUNS))
    else:
        known = known.unionByName(open_.groupBy(shard).applyInArrow(_settle(length, True), _RUNS))
    # Rows are named by a hash of both: its doc_id goes with a span, so that rows of other documents can't take it.
    spans = known.groupBy("row").agg(F.collect_list(F.struct("doc_id", "at", "starts")).alias("spans"))

    nameless = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<doc_id:long,at:long,starts:int>>"))
    rows = texts.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "spans").unionByName(nameless)
    return rows.mapInArrow(_removed(length, keep), _RESULT)
