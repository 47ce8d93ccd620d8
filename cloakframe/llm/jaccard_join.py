"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. Every text becomes a set of hashed word shingles. Equal sets are one class, so copies are never paired.
2. The shingles, without texts, are dealt by hash into buckets that find which occur in two documents or more.
   A shingle of one document can't be shared, so only sets with at least `threshold` of shared shingles go on.
3. The global order is (document frequency by powers of two, hash), cut at pivots into fragments: a set is a row for each fragment that
   it has shingles in. Two linked sets share a shingle among the first n - ceil(t n) + 1 of each; unshared ones come first and cost
   nothing.
4. Candidates of a shingle are a star around its earliest document. Each fragment counts the partial overlap of its candidates in a task of its
   own, and the partial counts are summed per pair. A document is compared with the earliest of its centres first, with the others only
   where that leaves it in another component than theirs.
5. Where a star leaves a shingle's documents in several components, the pairs between components are verified too;
   pairs inside a component can't change it. So no link between components is lost and a large group of near
   copies costs its size, not its square. A shingle of many such documents is dealt to blocks; each pair of blocks is a key of its own.
   Of these pairs only those are counted whose bitmaps allow a link: a set's bitmap has the parity of its shingles at each place, so two
   sets differ in as many shingles as their bitmaps in bits, at least. No link is lost by that.

A 64-bit hash stands for a shingle; of it 48 bits are compared at least, 58 from 1024 buckets on. Sets are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks_for, components, finished, in_blocks, mix, prefix_hashes, span_hashes, stored, text_bytes, texts_of, words_of

#: Shingles that one bucket holds, about: a bucket is one task's memory.
PER_BUCKET = 2_000_000
#: Bytes of text whose sets are sent together.
SET_BLOCK = 16 << 20
FRAGMENTS = 8
#: Documents of one shingle that are paired with each other in one block.
BLOCK = 1 << 14
ID_BITS = 58
#: Longs of a set's bitmap. Sets of more shingles than it has bits are hardly told apart by it, and counted.
MAP = 16
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than width the whole sequence is one."""
    low = LOWER[buf]
    a, b, doc = words_of(low, offs)
    n_docs = len(offs) - 1
    if not len(a):
        return [np.zeros(0, np.uint64)] * n_docs
    h = span_hashes(prefix_hashes(low), a, b)
    weights = np.resize(_WEIGHTS, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
    n = len(h) - width + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        acc += h[k : k + len(acc)] * weights[k]
    whole = mix(acc)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for d in range(n_docs):
        i, j = first[d], first[d + 1]
        if j - i >= width:
            out.append(np.unique(whole[i : j - width + 1]))
        elif j > i:
            out.append(mix((h[i:j] * weights[: j - i]).sum(keepdims=True, dtype=np.uint64) + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("sig", pa.binary()), ("counts", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])


def _deal(buckets: int, width: int):
    """Sets of many documents as a few wide rows, one for each bucket: ids, set sizes there and 48 bits of each hash."""
    bits = (buckets - 1).bit_length()

    def send(block, ids, keys, sizes, prints, sets):
        order = {}
        for k, (i, p) in enumerate(zip(ids, prints)):
            if p not in order or (i, keys[k]) < (ids[order[p]], keys[order[p]]):
                order[p] = k  # copies in a block send their shingles once, by the smallest row
        lead = sorted(order.values())
        sig = pa.array([b"".join(np.array(x, np.int64).tobytes() for x in (ids, keys, sizes)) + b"".join(prints)], pa.binary())
        flat = np.concatenate([sets[k] for k in lead]) if lead else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(lead)), [len(sets[k]) for k in lead])
        where = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
        by = np.argsort(where, kind="stable")
        flat, of, where = flat[by], of[by], where[by]
        cut = np.searchsorted(where, np.arange(buckets + 1))
        lead_ids = np.array(lead, np.int64)  # rows are named by their place in the block
        rows = {n: [] for n in _SENT.names}
        home = int(ids[0]) % buckets
        for x in range(buckets):
            s = slice(cut[x], cut[x + 1])
            if cut[x] == cut[x + 1] and x != home:
                continue
            h = flat[s] << np.uint64(bits)
            count = np.bincount(of[s], minlength=len(lead))
            has = np.flatnonzero(count)
            rows["bucket"].append(x)
            rows["block"].append(block)
            rows["ids"].append(lead_ids[has].tobytes())
            rows["sig"].append(sig[0].as_py() if x == home else None)
            rows["counts"].append(count[has].astype(np.uint32).tobytes())
            rows["high"].append((h >> np.uint64(32)).astype(np.uint32).tobytes())
            rows["low"].append(((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
        return pa.RecordBatch.from_pydict(rows, schema=_SENT)

    def run(batches):
        ids, keys, sizes, prints, sets, held = [], [], [], [], [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in in_blocks(batches):
            buf, offs = texts_of(batch.column("text"))
            for i, k, s in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), shingle_sets(buf, offs, width)):
                ids.append(i)
                keys.append(k)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sets.append(s)
            held += len(buf)
            if held >= SET_BLOCK:
                yield send(block, ids, keys, sizes, prints, sets)
                block += 1
                ids, keys, sizes, prints, sets, held = [], [], [], [], [], 0
        if ids:
            yield send(block, ids, keys, sizes, prints, sets)

    return run


_FOUND = "block long, sig binary, ids binary, counts binary, tokens binary"


def _shared(buckets: int):
    """Of one bucket: for each block its documents' shingles that two documents or more have, as tokens of the global order."""
    bits = (buckets - 1).bit_length()

    def run(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in ("bucket", "ids", "counts", "high", "low")}
        h = np.frombuffer(b"".join(cols["high"]), np.uint32).astype(np.uint64) << np.uint64(16)
        h |= np.frombuffer(b"".join(cols["low"]), np.uint16)
        h |= np.uint64(cols["bucket"][0]) << np.uint64(48)
        by = np.argsort(h)
        s = h[by]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
        df = np.diff(np.append(new, len(s)))
        token = np.zeros(len(h), np.int64)
        level = np.repeat(np.floor(np.log2(np.maximum(df, 1))).astype(np.uint64), df)
        token[by] = np.where(np.repeat(df, df) >= 2, (level << np.uint64(ID_BITS)) | (s >> np.uint64(max(0, bits + 48 - ID_BITS))), 0).astype(np.int64)
        rows, at = {n: [] for n in ("ids", "counts", "tokens")}, 0
        for ids, counts in zip(cols["ids"], cols["counts"]):
            ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)
            t = token[at : at + int(counts.sum())]
            at += len(t)
            doc = np.repeat(np.arange(len(ids)), counts)[t > 0]
            has, count = np.unique(doc, return_counts=True)
            rows["ids"].append(ids[has].tobytes())
            rows["counts"].append(count.astype(np.uint32).tobytes())
            rows["tokens"].append(t[t > 0].tobytes())
        return pa.table({"block": table.column("block"), "sig": table.column("sig"), **{n: pa.array(x, pa.binary()) for n, x in rows.items()}})

    return run


_SETS = "doc_id long, row long, n long, print1 long, print2 long, tokens array<long>"


def _assembled(percent: int):
    """Of one block: a row for each document, with its shared tokens in order where they are enough for a link."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        ids, counts, tokens = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("ids", np.int64), ("counts", np.uint32), ("tokens", np.int64)))
        owner = np.repeat(ids, counts)
        by = np.lexsort((tokens, owner))
        owner, tokens = owner[by], tokens[by]
        for sig in filter(None, table.column("sig").to_pylist()):
            n = len(sig) // 40
            ids, keys, sizes = np.frombuffer(sig, np.int64, 3 * n).reshape(3, n)
            prints = np.frombuffer(sig, np.int64, 2 * n, 24 * n).reshape(n, 2)
            lo, hi = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")
            enough = (100 * (hi - lo) >= percent * sizes) & (hi > lo)
            lists = pa.array([tokens[i:j] if e else None for i, j, e in zip(lo, hi, enough)], pa.list_(pa.int64()))
            out.append(pa.table({"doc_id": ids, "row": keys, "n": sizes, "print1": prints[:, 0], "print2": prints[:, 1], "tokens": lists}))
        return pa.concat_tables(out)

    return run


def _pivots(sets: DataFrame, fragments: int) -> list[int]:
    """Cuts of the global order at the documents' own quantiles: a few numbers, whatever the input."""
    size = F.size("tokens")
    found = sets.where(size > 0).select(
        *[F.percentile_approx(F.element_at("tokens", (F.floor(size * k / fragments) + 1).cast("int")), 0.5).alias(f"p{k}") for k in range(1, fragments)]
    ).first()
    return sorted({x for x in found or () if x is not None})


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union. Each fragment counts its part of a pair in a task of its
    own; a pair is the sum of its fragments' counts."""
    left = segments.select(F.col("doc_id").alias("a"), "f", F.col("part").alias("x"))
    right = segments.select(F.col("doc_id").alias("b"), "f", F.col("part").alias("y"))
    dealt = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    partial = dealt.join(left, ["a", "f"]).join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("c"))
    counted = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("common"))
    return counted.where(F.expr(f"100 * common >= {int(percent)} * (na + nb - common)")).select("a", "b")


def _between(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of the pairs (a, b, ...) those that grouped (node, component) leaves in different components."""
    for k in "ab":
        of = grouped.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
        pairs = pairs.join(of, k, "left").withColumn(f"_{k}", F.coalesce(f"_{k}", k))
    return pairs.where("_a <> _b").drop("_a", "_b")


def _segments(sets: DataFrame, pivots: list[int]) -> DataFrame:
    """(doc_id, f, part): the tokens of each set in each fragment of the global order, where it has any."""
    cuts = [None, *pivots, None]
    parts = []
    for lo, hi in zip(cuts, cuts[1:]):
        inside = lambda t, lo=lo, hi=hi: (F.lit(True) if lo is None else t >= F.lit(lo)) & (F.lit(True) if hi is None else t < F.lit(hi))
        parts.append(F.filter("tokens", _closed(inside)))
    return sets.select("doc_id", F.posexplode(F.array(*parts)).alias("f", "part")).where(F.size("part") > 0)


def _closed(f):
    return lambda t: f(t)


def _shared_among(sets: DataFrame, percent: int, least: Column) -> DataFrame:
    """sets less the documents that share no token of their prefix, and their tokens less those of one remaining document; who
    then has too few left goes too. No pair that links is lost: it shares a prefix token, and only what both hold counts."""
    prefix = sets.select("doc_id", F.explode(_prefix(percent)).alias("token"))
    met = prefix.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("token")
    some = prefix.join(met, "token", "left_semi").select("doc_id").distinct()
    left = sets.join(some, "doc_id", "left_semi")
    token = left.select("doc_id", "n", "o", F.explode("tokens").alias("token"))
    common = token.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("token")
    kept = token.join(common, "token", "left_semi").groupBy("doc_id", "n", "o").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return kept.where(F.size("tokens") >= least)


def _prefix(percent: int) -> Column:
    """Of a set of n the first n - ceil(percent of n) + 1 in the global order; tokens that it shares with none come first."""
    n = "cast(n as int)"
    return F.expr(f"slice(tokens, 1, greatest(0, {n} - {int(percent)} * {n} div 100 + 1 - ({n} - size(tokens))))")


def _apart(apart: DataFrame) -> DataFrame:
    """apart (token, doc_id, n, s, p, component), each token's documents in blocks: a row for each pair of blocks that it is in."""
    several = apart.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = apart.join(several.where("c1 < c2").select("token", "blocks"), "token").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(doc_id, m0, m1, ...): of each set the parity of its tokens at each of MAP * 64 places."""
    token = sets.select("doc_id", F.explode("tokens").alias("token"))
    bit, at = F.expr("shiftleft(1L, cast(token & 63 as int))"), F.expr(f"(token >> 6) & {MAP - 1}")
    return token.select("doc_id", at.alias("at"), bit.alias("bit")).groupBy("doc_id").agg(*[F.coalesce(F.bit_xor(F.when(F.col("at") == k, F.col("bit"))), F.lit(0)).alias(f"m{k}") for k in range(MAP)])


def _unlike() -> Column:
    return sum((F.bit_count(F.col(f"m{k}a").bitwiseXOR(F.col(f"m{k}b"))) for k in range(1, MAP)), F.bit_count(F.col("m0a").bitwiseXOR(F.col("m0b"))))


def _may_link(unlike: Column, percent: int) -> Column:
    """Whether the bitmaps of a and b leave enough for a link: of sa + sb shingles those that differ are in one only."""
    return (100 + int(percent)) * (F.col("sa") + F.col("sb") - unlike) >= 2 * int(percent) * (F.col("na") + F.col("nb"))


def _members(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, row, n, first) of every row of docs (doc_id, row, text): first is the smallest (doc_id, row) of its component."""
    wanted = blocks_for(text_bytes(docs) // 6, PER_BUCKET)
    buckets = 1 << (wanted - 1).bit_length()
    sent = docs.mapInArrow(_deal(buckets, width), "bucket int, block long, ids binary, sig binary, counts binary, high binary, low binary")
    found = sent.groupBy("bucket").applyInArrow(_shared(buckets), _FOUND)
    found = stored(found.groupBy("block").applyInArrow(_assembled(percent), _SETS), "shingles")
    sig = found.select("doc_id", "row", "n", "print1", "print2")
    prints = ["print1", "print2"]
    classes = sig.where("n > 0").groupBy(*prints).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n").alias("n"))
    # Numbered as they are written: a class is its number from here on.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = F.expr(f"cast((n * {int(percent)} + 99) div 100 as int)")
    of = classes.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.row").alias("row"), *prints, "node")
    sets = found.where("tokens is not null").join(of, ["doc_id", "row", *prints]).dropDuplicates(["doc_id", "row", *prints])
    sets = stored(sets.select(F.col("node").alias("doc_id"), "n", F.col("doc_id").alias("o"), "tokens").where(F.size("tokens") >= least), "sets")
    sets = stored(_shared_among(sets, percent, least), "sets")
    segments = stored(_segments(sets, _pivots(sets, FRAGMENTS)), "segments")
    # A document's other shingles are in no other set: they bound what two sets can share, and how small their union can be.
    prefix = sets.select("doc_id", "n", "o", F.size("tokens").cast("long").alias("s"), F.explode(_prefix(percent)).alias("token"))
    # The star's centre is the earliest document: copies are mostly most like what they were made from.
    star = prefix.groupBy("token").agg(F.min(F.struct("o", "doc_id")).alias("first"), F.count("*").alias("c")).where("c > 1").select("token", F.col("first.doc_id").alias("a"), F.col("first.o").alias("oa"))
    fits = F.expr(f"100 * least(sa, sb) >= {int(percent)} * (na + nb - least(sa, sb))")
    spokes = prefix.join(star, "token").where("doc_id <> a").select("a", "oa", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).distinct()
    pairs = spokes.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.size("tokens").cast("long").alias("sa")), "a").where(fits).select("a", "oa", "b", "na", "nb")
    pairs = stored(pairs, "pairs")
    nearest = pairs.groupBy("b", "nb").agg(F.min(F.struct("oa", "a", "na")).alias("first")).select("first.a", "b", "first.na", "nb")
    links = stored(_verified(nearest, segments, percent), "links")
    pairs = _between(pairs.select("a", "b", "na", "nb").join(nearest.select("a", "b"), ["a", "b"], "left_anti"), components(links))
    links = links.unionByName(stored(_verified(pairs, segments, percent), "links"))
    grouped = components(links)

    # What the stars left apart: pairs between components of one shingle.
    of = sets.select("doc_id").join(grouped, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    apart = prefix.drop("o").join(of, "doc_id")
    apart = stored(_apart(apart), "apart")
    held = apart.select("doc_id", "token").distinct().groupBy("doc_id").agg(F.collect_list("token").alias("p"))
    held = stored(held.join(_bitmaps(sets.join(held.select("doc_id"), "doc_id", "left_semi")), "doc_id"), "held")
    apart = apart.join(held, "doc_id")
    maps = [(f"m{k}", f"m{k}") for k in range(MAP)]
    named = lambda k: [F.col(c).alias(f"{n}{k}") for c, n in (("doc_id", "d"), ("n", "n"), ("s", "s"), ("p", "p"), ("component", "c"), ("block", "block_"), *maps)]
    x, y = (apart.select("token", "i", "j", *named(k)) for k in "ab")
    # Two sets meet at the first token that their prefixes share, once.
    once = F.expr("ca < cb and (i = j or block_a <> block_b)") & _may_link(_unlike(), percent) & fits & (F.array_min(F.array_intersect("pa", "pb")) == F.col("token"))
    pairs = x.join(y, ["token", "i", "j"]).where(once).select(F.col("da").alias("a"), F.col("db").alias("b"), "na", "nb", _unlike().alias("unlike"))
    pairs = stored(pairs, "pairs")
    # Each document with the likeliest other first: what these join isn't compared again.
    nearest = pairs.groupBy("b", "nb").agg(F.min(F.struct("unlike", "a", "na")).alias("first")).select("first.a", "b", "first.na", "nb")
    links = links.unionByName(stored(_verified(nearest, segments, percent), "links"))
    pairs = _between(pairs.drop("unlike").join(nearest.select("a", "b"), ["a", "b"], "left_anti"), components(links))
    grouped = components(links.unionByName(stored(_verified(pairs, segments, percent), "links")))

    whole = classes.join(grouped, "node", "left").select(*prints, "rep", F.coalesce("component", "node").alias("component"))
    whole = whole.join(whole.groupBy("component").agg(F.min("rep").alias("first")), "component").select(*prints, "first")
    return sig.join(whole, prints, "left").select("doc_id", "row", "n", F.coalesce("first", F.struct("doc_id", "row")).alias("first"))


def _named(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id; rows that share it are told apart by their texts."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


@finished
def ngram_jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Null and blank texts have no shingles and are their own component. A row without a doc_id can't be named: it comes
    back with nulls. Rows that repeat a doc_id are documents of their own if their texts differ, else one document in two rows. An
    empty table gives an empty result. Ties (equal sets) are one class.
    """
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    found = _members(_named(docs), percent, width).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return found.unionByName(nameless)


@finished
def keep_one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the rows that aren't the first of their component, by doc_id and then by the hash of the text. Rows equal in both stay
    or go together; rows without a doc_id, or without a word, stay."""
    found = _members(_named(docs), percent, width)
    extra = found.where("first.doc_id <> doc_id or first.row <> row").select(F.col("doc_id").alias("_extra"), F.col("row").alias("_row")).distinct()
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)]).withColumn("_key", F.xxhash64("text"))
    return plain.join(extra, F.expr("doc_id = _extra and _key = _row"), "left_anti").drop("_key").toDF(*docs.columns)
