"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash runs over words: h = (h << 1) + gear(word).  Its low bits depend
on the last words only, so a cut where they vanish falls at the same words
wherever a passage stands, and an insertion moves no cut but those next to it.
Chunks have MIN_WORDS to MAX_WORDS words.  Chunks are deduplicated by a 128-bit
digest of their words: the document with the least doc_id keeps a chunk, at its
first place there.

A span is a run of neighbouring chunks that all occur at another place too, in
another document or, `within` documents, in the same one; spans of at
least SPAN_WORDS words are reported, shorter ones are left alone.  Without
`within`, what repeats within one document alone is left to it.  Only chunks
that both places cut alike count, so a passage loses some words at its ends: of
random passages of 51 words in random texts 0.4 % fall below SPAN_WORDS in one of
their places, of 60 words none of 3,000.

Words are separated by bytes \\x20 and \\x09-\\x0D, A-Z lower-cased for the digest.
Null texts and texts without words have no chunks.  Rows with null doc_id take
no part.  Rows that repeat doc_id and text hold their chunks at the same
places and count as one document; rows that repeat a doc_id with another text
count as parts of one document.  Of equal chunks the first place is kept, so
there are no ties.  A very long text is cut like others, and its chunks leave the
worker ROWS at a time.  An empty table gives no rows.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import Scratch, lowered, materialise, unused

MIN_WORDS, MAX_WORDS, MASK_BITS = 4, 32, 2
#: Low bits of the rolling hash that are read, the highest MASK_BITS of them as the mask: they depend on as many words.
WINDOW = 4
#: Least words of a reported span.
SPAN_WORDS = 16
#: Chunks that a worker holds before it sends them on.
ROWS = 16_384

_SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def cuts(words: list[bytes]) -> list[int]:
    """Ends of the chunks, in words."""
    n = len(words)
    if not n:
        return []
    gear = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint64, n)
    low = np.zeros(n, np.uint64)
    for j in range(min(WINDOW, n)):  # the WINDOW low bits of the rolling hash: older words are shifted beyond them
        low[j:] += gear[: n - j] << np.uint64(j)
    at = np.flatnonzero((low >> np.uint64(WINDOW - MASK_BITS)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1
    out, start = [], 0
    for c in at.tolist():
        while c - start > MAX_WORDS:
            start += MAX_WORDS
            out.append(start)
        if c - start >= MIN_WORDS:
            out.append(c)
            start = c
    while n - start > MAX_WORDS:
        start += MAX_WORDS
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the chunk), word, n_words, digest, seen (earlier in the same text) of every chunk."""

    names = ["doc_id", "place", "word", "n_words", "digest", "seen"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def run(batches):
        out: list[list] = [[] for _ in names]

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words, doc = lowered(text.as_py()).split(), i.as_py()
                start, before = 0, set()
                for k, end in enumerate(cuts(words)):
                    digest = xxhash.xxh3_128_digest(b" ".join(words[start:end]))
                    for c, x in zip(out, (doc, k, start, end - start, digest, digest in before), strict=True):
                        c.append(x)
                    before.add(digest)
                    start = end
                    if len(out[0]) >= ROWS:
                        yield told()
        yield told()

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, place int, word int, n_words int, digest binary, seen boolean")


def repeated(docs: DataFrame, within: bool, keep: Scratch) -> DataFrame:
    """doc_id, place, word, n_words, seen, first_doc, of chunks that occur in two documents or more, or, `within` documents, at two places."""
    rows = keep(chunk_rows(docs), "chunks")
    if not within:
        rows = rows.withColumn("seen", F.lit(False))
    held = rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("seen").alias("again")).where("first_doc <> last_doc or again").select("digest", "first_doc")
    return rows.join(keep(held, "repeated-digests"), "digest").drop("digest")


def later() -> Column:
    """Whether a chunk has an earlier place."""
    return (F.col("first_doc") != F.col("doc_id")) | F.col("seen")


def runs(docs: DataFrame, within: bool, keep: Scratch) -> DataFrame:
    """repeated(), with the run of neighbouring chunks that each belongs to, and n_words 0 where a row repeats a place."""
    rows, order = repeated(docs, within, keep), Window.partitionBy("doc_id").orderBy("place", "word")
    step = F.col("place") - F.lag("place").over(order)
    again = (step == 0) & (F.col("word") == F.lag("word").over(order))
    rows = rows.withColumn("new", F.coalesce(step > 1, F.lit(True)).cast("int")).withColumn("n_words", F.when(again, 0).otherwise(F.col("n_words")))
    return rows.withColumn("run", F.sum("new").over(order)).drop("new")


def spans(docs: DataFrame, least: int = SPAN_WORDS, within: bool = False) -> DataFrame:
    """doc_id, start, words, removed (words that an earlier place holds), first_doc of every span of at least `least` words."""
    gone = F.when(later(), F.col("n_words")).otherwise(0)
    with Scratch(docs.sparkSession) as keep:
        out = runs(docs, within, keep).groupBy("doc_id", "run").agg(F.min("word").alias("start"), F.sum("n_words").alias("words"), F.sum(gone).alias("removed"), F.min("first_doc").alias("first_doc"))
        return materialise(out.where(F.col("words") >= least).drop("run"), "spans")


def repeats(docs: DataFrame, least: int = SPAN_WORDS, within: bool = False) -> DataFrame:
    """One row for each document that holds a reported span: doc_id, n_spans, repeated_words, removed_words, longest_words, first_docs."""
    found = spans(docs, least, within)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum("words").alias("repeated_words"),
        F.sum("removed").alias("removed_words"),
        F.max("words").alias("longest_words"),
        F.sort_array(F.collect_set("first_doc")).alias("first_docs"),
    )


def remove_repeats(docs: DataFrame, least: int = SPAN_WORDS, within: bool = True) -> DataFrame:
    """docs without the chunks of reported spans that an earlier place holds; words cut go with the white space after them, the columns stay."""
    key, cut = unused(docs, "chunk_doc"), unused(docs, "chunk_cuts")
    with Scratch(docs.sparkSession) as keep:
        run = runs(docs, within, keep).withColumn("words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
        gone = run.where((F.col("words") >= least) & later() & (F.col("n_words") > 0))
        gone = materialise(gone.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_set(F.struct("word", "n_words"))).alias(cut)), "cuts")
    names = docs.columns
    at, width = names.index("text"), len(names)

    def apply(batches):
        for batch in batches:
            texts = [cut_words(t, c) for t, c in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left").select(*(docs[c] for c in docs.columns), cut)
    return joined.mapInArrow(apply, T.StructType(docs.schema.fields))


def cut_words(text: str | None, spans) -> str | None:
    """text without the words of spans (word, n_words)."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _SPACED.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for s in spans:
        a, b = s["word"], min(s["word"] + s["n_words"], len(starts) - 1)
        if a < len(starts) and starts[a] >= at:
            out.append(raw[at : starts[a]])
            at = starts[b]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
