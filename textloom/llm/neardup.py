"""Near-duplicate texts: an exact set-similarity join with rare-first prefix filtering.

A text is the set of its word n-grams (40-bit hashes). Two texts with Jaccard similarity >= t share
at least one n-gram among the rarest ``n - ceil(t n) + 1`` of each (prefix filter), have sizes within
a factor t (length filter), and their first shared n-gram leaves enough n-grams behind it in both
(positional filter). A parity bitmap of the whole set bounds the overlap of what is left (suffix
filter). All four only drop pairs that can't qualify, so no link is lost. What passes is verified once.

Scale. Rarity comes from a count sketch whose size follows the text, up to 2**24 counters (the only thing
broadcast). Copies - texts with one set - are joined once, under the hash of their set. A text is sent once
to each of R token partitions together with its bitmap, not once per token; R follows the number of n-grams,
so that a partition holds about ``per_part`` postings whatever the input. A token whose count is above ``hot``
(or eight times the sketch's mean count, above its noise) is cut into blocks of texts, and each pair of blocks
is another unit of work. Sets are shuffled only for texts that occur in a candidate pair (a Bloom filter that
follows the number of pairs, up to 2**24 bits), and pairs only as two hashes. Two different n-grams share a
40-bit hash with a chance of 1e-12, which can shift a similarity by one n-gram; two different sets share a
64-bit hash with a chance of 5e-20 a pair.

Defined results: null, blank and short texts (fewer than ``n`` words) have no set and no partner;
copies have similarity 1; repeated rows of one id are one row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..workspace import dropped, width, written
from .arrow import blocks, packed, unpacked
from .sketch import count_sketch
from .wordhash import buffers, mix, shingles, words

HASH_BITS = 40
_HASH = np.uint64((1 << HASH_BITS) - 1)


@dataclass(frozen=True)
class NearDup:
    """Parameters: n-gram length, similarity, least bits of the rarity sketch, bitmap bits per n-gram, hot-token block size, postings of a partition."""

    words: int = 5
    threshold: float = 0.8
    sketch_bits: int = 21
    bits_per_gram: int = 3
    hot: int = 20_000
    per_part: int = 500_000


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of each text's set; sorted, distinct."""
    doc, _, _, hashed = words(*buffers(column))
    doc, gram = shingles(doc, hashed, n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (gram & _HASH))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & _HASH


def _set_keys(doc: np.ndarray, gram: np.ndarray, texts: int) -> np.ndarray:
    """A 64-bit hash of each text's set, independent of order; 0 for an empty set."""
    out = np.zeros(texts, np.uint64)
    if len(doc):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        with np.errstate(over="ignore"):
            out[doc[at]] = mix(np.add.reduceat(mix(gram ^ np.uint64(0x5BF03635)), at)) | np.uint64(1)
    return out


def _classes(counts: np.ndarray) -> np.ndarray:
    """Counts as 8-bit rarity classes: 0 for at most one, then eight per doubling."""
    c = np.where(counts < 2, 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 2).astype(float)))).astype(int)
    return np.minimum(c, 255).astype(np.uint8)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with the text in lower case, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text")).where("id is not null and text is not null")


def near_duplicates(texts: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame, str]:
    """(links, members, path) of ``texts`` (id long, text in lower case).

    links: (a, b, jaccard) of different sets with similarity >= threshold, a < b, once each.
    members: (id, set) of every text that has a set. Both read tables in the shared folder; ``path``
    is the members' table, which the caller may drop when it is through with them.
    """
    spark = texts.sparkSession
    n, t, per_gram = p.words, p.threshold, p.bits_per_gram
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = min(24, max(p.sketch_bits, (chars // 64).bit_length()))

    def grams(batch: pa.RecordBatch) -> np.ndarray:
        out = [_sets(b["text"], n)[1] for b in blocks(batch, "text")]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    counts = count_sketch(texts.select("text"), grams, bits)
    total = int(counts.sum(dtype=np.int64))
    hot = max(p.hot, 8 * total // len(counts))
    parts = max(width(spark), int((1 - t) * total) // p.per_part)
    rare = spark.sparkContext.broadcast(_classes(counts))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = rare.value, set()
        for whole in batches:
            for batch in blocks(whole, "text"):
                out = _postings(batch["text"], table, sent, n, t, parts, per_gram, hot)
                if out is not None:
                    yield out

    routed = texts.select("text").mapInArrow(postings, "part int, key long, n int, bitmap binary, tokens binary, places binary")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # one token partition, of about ``per_part`` postings
        if rows:
            yield from _candidates(pa.Table.from_batches(rows), t)

    pairs = routed.repartitionById(parts, "part").mapInArrow(candidates, "a long, b long").distinct()
    pairs, pairs_path = written(pairs, "neardup-pairs")

    bloom_bits = min(24, max(22, (16 * pairs.count()).bit_length()))

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        return mix(np.concatenate([np.asarray(batch["a"]), np.asarray(batch["b"])]).astype(np.int64).view(np.uint64))

    wanted = spark.sparkContext.broadcast(np.packbits(count_sketch(pairs, ends, bloom_bits) > 0))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, sent = np.unpackbits(wanted.value), set()
        for whole in batches:
            for batch in blocks(whole, "text"):
                yield _members(batch, there, sent, n)

    known, known_path = written(texts.mapInArrow(members, "id long, key long, grams binary"), "neardup-members")
    sets = known.where("grams is not null").groupBy("key").agg(F.min("grams").alias("grams"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                yield _verified(whole.slice(k, 4096), t)

    both = (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("of_a")).hint("shuffle_merge"), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("grams").alias("of_b")).hint("shuffle_merge"), "b")
    )
    links, _ = written(both.mapInArrow(verified, "a long, b long, jaccard double"), "neardup-links")
    dropped(spark, pairs_path)
    return links, known.select("id", F.col("key").alias("set")).distinct(), known_path


def _postings(column: pa.Array, table: np.ndarray, sent: set, n: int, t: float, parts: int, per_gram: int, hot: int) -> pa.RecordBatch | None:
    doc, gram = _sets(column, n)
    keys = _set_keys(doc, gram, len(column))
    fresh = np.zeros(len(column), bool)
    for i, key in enumerate(keys.tolist()):
        if key and key not in sent:
            sent.add(key)
            fresh[i] = True
    keep = fresh[doc]
    doc, gram = doc[keep], gram[keep]
    if not len(doc):
        return None
    size = np.bincount(doc, minlength=len(column))
    # parity of the n-grams in each cell of the bitmap, whose width follows the set's size
    bits = _width(size, per_gram)
    first = np.cumsum(bits) - bits
    cells = np.bincount(first[doc] + (gram & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum()))
    bitmap = np.packbits((cells & 1).astype(bool))
    rarity = table[(gram & np.uint64(len(table) - 1)).astype(np.int64)]
    order = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS + 8)) | (rarity.astype(np.uint64) << np.uint64(HASH_BITS)) | gram)
    doc = (order >> np.uint64(HASH_BITS + 8)).astype(np.int64)
    rarity = ((order >> np.uint64(HASH_BITS)) & np.uint64(255)).astype(np.int64)
    gram = order & _HASH
    start = np.cumsum(size) - size
    place = np.arange(len(doc)) - start[doc]
    prefix = size[doc] - np.ceil(t * size[doc] - 1e-9).astype(np.int64) + 1
    keep = (place < prefix) & (rarity > 0)  # a sketch never counts too low: class 0 occurs in one set only
    doc, gram, rarity, place = doc[keep], gram[keep], rarity[keep], place[keep]
    # hot tokens: one unit for each pair of blocks of texts
    cuts = np.ceil(2.0 ** ((rarity - 1) / 8) / hot).astype(np.int64)
    if (cuts > 1).any():
        rep = np.repeat(np.arange(len(doc)), np.where(cuts > 1, cuts, 1))
        other = np.arange(len(rep)) - np.repeat(np.cumsum(np.where(cuts > 1, cuts, 1)) - np.where(cuts > 1, cuts, 1), np.where(cuts > 1, cuts, 1))
        doc, gram, place, cuts = doc[rep], gram[rep], place[rep], cuts[rep]
        own = (mix(keys[doc]) % cuts.astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        gram = np.where(cuts > 1, mix(gram ^ (low * 65_537 + high + 1).astype(np.uint64)) & _HASH, gram)
    part = (gram % np.uint64(parts)).astype(np.int64)
    token = (gram // np.uint64(parts)).astype(np.uint32)
    order = np.argsort(doc * parts + part, kind="stable")
    doc, part, token, place = doc[order], part[order], token[order], place[order]
    if not len(doc):
        return None
    group = doc * parts + part
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(at, len(group)))
    who = doc[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at].astype(np.int32)), pa.array(keys[who].view(np.int64)), pa.array(size[who].astype(np.int32)), packed(_taken(bitmap, first[who] // 8, bits[who] // 8), bits[who] // 8), packed(token, count), packed(place.astype(np.uint32), count)],
        ["part", "key", "n", "bitmap", "tokens", "places"],
    )


def _width(size: np.ndarray, per_gram: int) -> np.ndarray:
    """Bits of the bitmaps of sets of these sizes: a power of two, 128 to 2**17."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(per_gram * size, 1))), 7, 17).astype(np.int64)


def _taken(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of ``data``, one after another."""
    return data[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]


class _Bitmaps:
    """Bitmaps of several widths; two are compared at the smaller width, the wider one folded."""

    def __init__(self, column: pa.Array) -> None:
        raw, sizes = unpacked(column, np.uint8)
        first = np.cumsum(sizes) - sizes
        self.width = sizes
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(sizes).tolist():
            where = np.full(len(sizes), -1, np.int64)
            rows: list[np.ndarray] = []
            n = 0
            for own in np.unique(sizes[sizes >= w]).tolist():
                who = np.flatnonzero(sizes == own)
                bits = _taken(raw, first[who], sizes[who]).reshape(len(who), own // w, w)
                rows.append(np.bitwise_xor.reduce(bits, axis=1))
                where[who] = n + np.arange(len(who))
                n += len(who)
            self.level[w] = (where, np.ascontiguousarray(np.concatenate(rows)).view(np.uint64))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many cells differ: never more than the n-grams that only one of the sets has."""
        out = np.zeros(len(a), np.int32)
        w = np.minimum(self.width[a], self.width[b])
        for level in np.unique(w).tolist():
            at = np.flatnonzero(w == level)
            where, bits = self.level[level]
            out[at] = np.bitwise_count(bits[where[a[at]]] ^ bits[where[b[at]]]).sum(axis=1, dtype=np.int32)
        return out


def _candidates(rows: pa.Table, t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one token partition that pass the length, positional and suffix filters, once each."""
    rows = rows.combine_chunks()
    key = np.asarray(rows["key"]).astype(np.int64)
    # a key that several tasks sent: its postings count once
    _, first = np.unique(key, return_index=True)
    rows = rows.take(pa.array(np.sort(first))).combine_chunks()
    one = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
    flat = lambda c: (x.chunk(0) if isinstance(x := one(c), pa.ChunkedArray) else x)
    key, size = np.asarray(flat("key")).astype(np.int64), np.asarray(flat("n")).astype(np.int64)
    bitmaps = _Bitmaps(flat("bitmap"))
    token, counts = unpacked(flat("tokens"), np.uint32)
    place = unpacked(flat("places"), np.uint32)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(key)), counts)
    order = np.argsort((token.astype(np.uint64) << np.uint64(32)) | np.minimum(size[doc], 2**32 - 1).astype(np.uint64))
    doc, token, place = doc[order].astype(np.int32), token[order], place[order].astype(np.int32)
    length = size[doc].astype(np.int32)
    left = length - place - 1
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    group = np.diff(np.append(at, len(token)))
    end = np.repeat(at + group, group)
    active, step, share = np.flatnonzero(np.arange(len(token)) + 1 < end), 1, t / (1 + t)
    kept: list[np.ndarray] = []
    waiting: list[np.ndarray] = []
    while len(active):
        for k in range(0, len(active), 1 << 20):
            i = active[k: k + (1 << 20)]
            j = i + step
            total = length[i] + length[j]
            need = np.ceil(share * total - 1e-6).astype(np.int32)
            ok = (length[i] >= t * length[j] - 1e-6) & (1 + np.minimum(left[i], left[j]) >= need)
            i, j, total, need = i[ok], j[ok], total[ok], need[ok]
            a, b = doc[i], doc[j]
            ok = total - bitmaps.apart(a, b) >= 2 * need
            a, b = a[ok].astype(np.int64), b[ok].astype(np.int64)
            waiting.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        if sum(map(len, waiting)) > 1 << 21:
            kept, waiting = [np.unique(np.concatenate(kept + waiting))], []
        step += 1
        active = active[active + step < end[active]]
        active = active[length[active] >= t * length[active + step] - 1e-6]
    pairs = np.unique(np.concatenate(kept + waiting)) if kept or waiting else np.zeros(0, np.int64)
    a, b = key[pairs >> 32], key[pairs & 0xFFFFFFFF]
    a, b = np.minimum(a, b), np.maximum(a, b)
    for k in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k: k + 50_000]), pa.array(b[k: k + 50_000])], ["a", "b"])


def _members(batch: pa.RecordBatch, there: np.ndarray, sent: set, n: int) -> pa.RecordBatch:
    doc, gram = _sets(batch["text"], n)
    keys = _set_keys(doc, gram, batch.num_rows)
    has = keys != 0
    want = there[(mix(keys) & np.uint64(len(there) - 1)).astype(np.int64)].astype(bool) & has
    for i in np.flatnonzero(want).tolist():
        if int(keys[i]) in sent:
            want[i] = False
        sent.add(int(keys[i]))
    keep = want[doc]
    five = np.ascontiguousarray(gram[keep]).view(np.uint8).reshape(-1, 8)[:, :5]
    grams = packed(five, np.bincount(doc[keep], minlength=batch.num_rows))
    grams = pc.if_else(pa.array(want), grams, pa.scalar(None, grams.type))
    out = pa.RecordBatch.from_arrays([batch["id"], pa.array(keys.view(np.int64)), grams], ["id", "key", "grams"])
    return out.filter(pa.array(has))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, sizes = unpacked(column, np.uint8)
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view(np.uint64).reshape(-1), sizes // 5


def _verified(batch: pa.RecordBatch, t: float) -> pa.RecordBatch:
    ga, na = _grams(batch["of_a"])
    gb, nb = _grams(batch["of_b"])
    row = np.arange(batch.num_rows, dtype=np.uint64) << np.uint64(HASH_BITS)
    every = np.sort(np.concatenate([np.repeat(row, na) | ga, np.repeat(row, nb) | gb]))
    shared = every[1:][every[1:] == every[:-1]] >> np.uint64(HASH_BITS)
    overlap = np.bincount(shared.astype(np.int64), minlength=batch.num_rows)
    jaccard = overlap / np.maximum(1, na + nb - overlap)
    ok = overlap * (1 + t) >= t * (na + nb) - 1e-9
    out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(jaccard)], ["a", "b", "jaccard"])
    return out.filter(pa.array(ok))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """(id_a, id_b): every pair of rows, smaller id first, with similarity >= threshold; copies of one text included."""
    links, members, _ = near_duplicates(texts_of(df, id_col, text_col), p)
    m = members
    across = (
        links.join(m.select(F.col("set").alias("a"), F.col("id").alias("x")), "a")
        .join(m.select(F.col("set").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    many = m.groupBy("set").agg(F.count("*").alias("copies")).where("copies > 1").select("set")
    copies = m.join(many, "set", "left_semi")
    within = copies.select("set", F.col("id").alias("id_a")).join(copies.select("set", F.col("id").alias("id_b")), "set").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """(id, group_id, copies, links): one row per text that has a set.

    ``group_id`` is the smallest id of the texts linked with it, directly or through others;
    ``copies`` counts the rows with its set, ``links`` the different sets linked with its own.
    """
    from .components import components

    links, members, _ = near_duplicates(texts_of(df, id_col, text_col), p)
    sets = members.groupBy("set").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    name = sets.select("set", "node")
    edges = (
        links.join(name.select(F.col("set").alias("a"), F.col("node").alias("src")), "a")
        .join(name.select(F.col("set").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst")
    )
    degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    label = components(edges)
    return (
        members.join(sets, "set").join(degree, "set", "left").join(label, "node", "left")
        .select("id", F.coalesce("component", "node").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
