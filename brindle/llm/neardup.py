"""Near duplicates by min-max hashing.

A document is its set of k-word shingles.  Under each of PERMUTATIONS random
permutations both the least and the greatest value are kept, so half the hash
evaluations give 2 * PERMUTATIONS signature values, each equal for two sets
with the probability of their Jaccard similarity.  Bands of ROWS values (from
ROWS / 2 permutations) find candidates; candidates are confirmed on the full
sets, in integers.  At similarity 0.8 a pair shares no band with probability
(1 - 0.8**6)**48 = 4.7e-7.

1. Documents with equal sets are one class, whose least doc_id stands for it.
2. Within a bucket (equal band), every class is compared with the least one:
   a star, not all pairs.  Confirmed links give components.
3. Buckets that still hold several components are compared further, only
   across components: small ones pair by pair, large ones in blocks of bounded
   size.  Blocks meet with bitmaps of the sets first, which leave out only what
   cannot be similar, and texts follow only where someone is within reach.  No
   bucket is capped.
4. The links of 2 and 3 give the final components.

So a link is missed only if two sets share no band.  Values of one permutation
are not independent for small sets: sets of 4 and 5 shingles that share 4 are
missed with 8e-6, of 8 and 10 that share 8 with 2e-6, large ones as above.

Rows with null doc_id are linked with nothing and have no component; they are
kept.  Null texts and texts without words have empty sets; very long texts are
sets like others, permuted STRIP shingles at a time.  Rows that repeat a doc_id
belong to one document if their sets are equal, else doc_id stands for each of
the sets.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, lowered, materialise, sized, unused
from brindle.llm.components import components

PERMUTATIONS, ROWS = 144, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket that are compared pair by pair; larger ones go by blocks of so many members and shingles.
SMALL, BLOCK_MEMBERS, BLOCK_SHINGLES = 16, 1024, 1 << 18
#: Bits of a set's bitmap for each shingle, rounded up to a power of two, and its bounds.
BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 16
#: Shingles that are permuted at once.
STRIP = 2048

_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence if it is shorter; empty without words."""
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima and maxima of all permutations, as (PERMUTATIONS, 2)."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), STRIP):
        x = shingles[i : i + STRIP, None] * _A
        x += _B
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = (out ^ (rows[:, j] >> np.uint64(7))) * _MIX[j]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's hash, modulo the bitmap's width; halves folded onto each other give the narrower one."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * len(shingles) - 1).bit_length()))
    held = np.zeros(width, bool)
    held[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(held, bitorder="little").tobytes()


def digest_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for empty sets), bands, bits of every row."""

    def run(batches):
        for batch in batches:
            n, digest, bands, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                digest.append(digest_of(s))
                bands.append(band_keys(signature(s)) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, bits binary")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep, last, held = [], None, None
            for i in range(len(a)):
                if last is None or not y[i].equals(last):
                    last, held = y[i], shingle_set(y[i].as_py(), k)
                own = shingle_set(x[i].as_py(), k)
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def pairs_across(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, across labels within small buckets, from members (key, id, label, c)."""
    small = members.where(F.col("c") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    on = F.expr("x.key = y.key and x.id > y.id and x.label <> y.label")
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def dealt_out(members: DataFrame, sizes: DataFrame, keep: Scratch) -> DataFrame:
    """field, side, p, q, part, id, label: which members of large buckets meet in which group.

    Large buckets that share members form a field.  The members of its largest
    label need not meet each other: they are dealt into blocks of their own, and
    so are all others, each block of at most BLOCK_MEMBERS members and
    BLOCK_SHINGLES shingles on average.  Every two blocks of the others meet
    (side 0), and every one of them meets every block of the largest label (1).
    """
    low = members.groupBy("key").agg(F.min("id").alias("low"))
    star = members.join(low, "key").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    fields = components(star).withColumnRenamed("label", "field")
    # sizes are joined to members, of which each bucket has its own rows, only once each
    placed = keep(fields.join(members.select("id", "label").distinct(), "id").join(sizes, "id").distinct(), "fields")
    sums = placed.groupBy("field", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = sums.groupBy("field").agg(F.max(F.struct("c", "label"))["label"].alias("most"))
    placed = placed.join(most, "field").withColumn("big", F.col("label") == F.col("most"))
    size = placed.groupBy("field").agg(*(F.greatest(F.ceil(F.count(F.when(m, 1)) / BLOCK_MEMBERS), F.ceil(F.sum(F.when(m, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias(c) for c, m in (("b", F.col("big")), ("o", ~F.col("big")))))
    placed = keep(placed.join(size, "field").withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("big"), F.col("b")).otherwise(F.col("o"))).cast("int")), "dealt")
    to = lambda side, n: F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.lit(side).alias("side"), x.alias("other")))
    meets = F.when(F.col("big"), to(1, F.col("o"))).otherwise(F.concat(to(0, F.col("o")), to(1, F.col("b"))))
    rows = placed.select("*", F.inline(meets)).withColumn("first", (F.col("side") == 1) & ~F.col("big") | (F.col("side") == 0) & (F.col("part") <= F.col("other")))
    return rows.select("field", "side", F.when(F.col("first"), F.col("part")).otherwise(F.col("other")).alias("p"), F.when(F.col("first"), F.col("other")).otherwise(F.col("part")).alias("q"), "part", F.col("big").cast("int").alias("big"), "id", "label")


def within_reach(n: np.ndarray, bits: list[bytes], i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of `others`, those whose sets may be similar to set i by their sizes and bitmaps; no similar one is left out.

    Sets at the threshold differ in at most (|a| + |b|) * (100 - percent) / (100 + percent)
    shingles, and each bit in which their bitmaps differ takes a shingle of its own.
    """
    others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
    out = []
    for width in {len(bits[j]) for j in others}:
        same = others[[len(bits[j]) == width for j in others]]
        rows = np.frombuffer(b"".join(bits[j] for j in same), np.uint64).reshape(len(same), -1)
        own = np.frombuffer(bits[i], np.uint64)
        while rows.shape[1] > len(own):
            rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
        while len(own) > rows.shape[1]:
            own = own[: len(own) // 2] | own[len(own) // 2 :]
        apart = np.bitwise_count(rows ^ own).sum(axis=1, dtype=np.int64)
        out.append(same[(100 + percent) * apart <= (100 - percent) * (n[same] + n[i])])
    return np.concatenate(out) if out else others


def _sides(pdf, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and of the second block of a group."""
    if side:
        big = pdf["big"].to_numpy()
        return np.flatnonzero(big == 0), np.flatnonzero(big == 1)
    return np.flatnonzero(pdf["part"].to_numpy() == pdf["p"].iloc[0]), np.flatnonzero(pdf["part"].to_numpy() == pdf["q"].iloc[0])


def links_across(members: DataFrame, sketch: DataFrame, texts: DataFrame, k: int, percent: int, keep: Scratch) -> DataFrame | None:
    """Links (a, b) across labels within large buckets; None if there are none such.

    Groups of bounded size meet twice: first with sizes and bitmaps, which say
    who has someone within reach; then with the texts of those alone, whose full
    sets decide.  Links between what is linked already are not given again.
    """
    large = members.where(F.col("c") > SMALL)
    if large.isEmpty():
        return None
    met = keep(dealt_out(large, sketch.select("id", "n"), keep), "met")
    group = ["field", "side", "p", "q"]

    def near(key, pdf):
        bits, n, ids, labels = pdf["bits"].tolist(), pdf["n"].to_numpy(), pdf["id"].to_numpy(), pdf["label"].to_numpy()
        first, second = _sides(pdf, key[1])
        held = np.zeros(len(pdf), bool)
        for i in first:
            found = within_reach(n, bits, i, second[labels[second] != labels[i]], percent)
            held[found] = True
            held[i] |= len(found) > 0
        return pdf.loc[held, ["field", "side", "p", "q", "part", "big", "id", "label", "n", "bits"]]

    def compare(key, pdf):
        import pandas as pd

        bits, n, ids, labels = pdf["bits"].tolist(), pdf["n"].to_numpy(), pdf["id"].to_numpy(), pdf["label"].to_numpy().copy()
        first, second = _sides(pdf, key[1])
        sets, out = [shingle_set(t, k) for t in pdf["text"]], []
        for i in first:
            for j in within_reach(n, bits, i, second[labels[second] != labels[i]], percent):
                if labels[i] != labels[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                        labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(out, columns=["a", "b"])

    kind = "field long, side int, p int, q int, part int, big int, id long, label long, n long, bits binary"
    close = keep(met.join(sketch.select("id", "n", "bits"), "id").groupBy(*group).applyInPandas(near, kind), "near")
    held = close.join(texts.withColumnRenamed("doc_id", "id"), "id")
    return held.groupBy(*group).applyInPandas(compare, "a long, b long")


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest) of every row, and (digest, component_id) of every set."""
    with Scratch(docs.sparkSession) as keep:
        rows = materialise(sketches(docs, k), "sketches")
        sets = keep(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "sets")
        # the sketches of those that stand for their sets
        own = rows.alias("r").join(sets.alias("s"), F.expr("r.digest = s.digest and r.doc_id = s.id")).select("s.id", "s.digest", "r.bands", "r.bits", F.col("r.n_shingles").alias("n"))
        again = not rows.where("digest is not null and doc_id is not null").groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
        own = keep(own.dropDuplicates(["id", "digest"]) if again else own, "representatives")
        bands = own.select("id", F.explode("bands").alias("key"))
        buckets = keep(bands.groupBy("key").agg(F.min("id").alias("m"), F.count("*").alias("c")).where("c > 1"), "buckets")
        members = keep(bands.join(buckets, "key"), "members")
        star = keep(members.where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct(), "star-pairs")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
        texts = texts.join(keep(star.select("a").union(star.select("b")).distinct().withColumnRenamed("a", "doc_id"), "linked-ids"), "doc_id", "left_semi")
        texts = keep(texts.dropDuplicates(["doc_id", "text"]) if again else texts, "linked-texts")
        links = keep(confirm(star, texts, k, percent), "links")
        labels = components(links)
        held = members.where("c > 2").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"), "c")
        held = keep(held, "labelled-members")
        open_ = held.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        open_ = keep(held.join(open_, "key", "left_semi"), "open-members")
        more = confirm(pairs_across(open_).join(star, ["a", "b"], "left_anti"), texts, k, percent)
        other = links_across(open_, own, texts, k, percent, keep)
        more = keep(more if other is None else more.union(other), "more-links")
        if not more.isEmpty():
            labels = components(links.union(more))
        of = sets.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component_id"))
        return rows.select("doc_id", "n_shingles", "digest"), materialise(of, "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, of = link(docs, k, percent)
    out = rows.join(of, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of its least doc_id; the columns stay.

    Rows with a null doc_id and rows without words are linked with nothing and
    stay.  Where doc_ids repeat, rows are linked one by one under numbers of
    their own, so that each is judged by its own text and equal rows leave one.
    """
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = materialise(near_duplicates(docs, k, percent).where("not kept").select("doc_id"), "dropped")
        return docs.join(sized(gone), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    row = unused(docs, "row")
    numbered = materialise(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    linked = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), k, percent)
    gone = materialise(linked.where("not kept").select(F.col("doc_id").alias("gone")), "dropped")
    return numbered.join(sized(gone), F.col(row) == F.col("gone"), "left_anti").drop(row)
