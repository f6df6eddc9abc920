"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are words, so a pattern is a window of benchmark words.  For each
window length a shift table under the hash of the last two words says how far to
jump (a word that no window holds allows a jump over itself), a bucket under the
same hash and the window's first word picks the windows that may end there, and
direct comparison of all words confirms each occurrence.

A block of windows is a few flat arrays, about 60 bytes a window, and holds
BLOCK_WINDOWS of them; a larger benchmark is searched for in several passes, and
between them what was found is written, so that a worker holds one block at a
time.  Equal windows are searched for once and name all their items.

Null texts have no words, very long ones are searched whole.  Items without
words or without item_id have no windows.  Rows with one item_id count as one
item.  Repeated documents are searched one by one.  An empty benchmark hits
nothing, an empty table gives no rows.  Columns beside doc_id, text and item_id
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import materialise, plain_words, unused

WINDOW = 8
#: Windows held by a worker at once, about 60 MB.
BLOCK_WINDOWS = 1_000_000
#: Multipliers of the hash of two words; least and most entries of a shift table, as powers of two.
_P, _Q, _LEAST, _MOST = 0x9E3779B1, 0x85EBCA6B, 10, 24


class Searcher:
    """All windows of one length, as numbers of words from 1 on; 0 is a word that no window holds."""

    def __init__(self, windows: np.ndarray, items: np.ndarray):
        """windows: a row of words each; items: the number of each one's item."""
        m = self.length = windows.shape[1]
        unique, of = np.unique(windows, axis=0, return_inverse=True)
        bits = min(_MOST, max(_LEAST, (4 * unique.size).bit_length()))
        self.mask = (1 << bits) - 1
        blocks = self._hash(unique[:, :-1].astype(np.uint64), unique[:, 1:].astype(np.uint64)) if m > 1 else unique.astype(np.uint64) & np.uint64(self.mask)
        shift = np.full(1 << bits, max(m - 1, 1), np.uint8)
        for k in range(blocks.shape[1]):  # later blocks have shorter jumps and overwrite
            shift[blocks[:, k]] = blocks.shape[1] - 1 - k
        self.shift = shift.tobytes()
        keys = blocks[:, -1] << np.uint64(32) | unique[:, 0].astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = array("Q", keys[order].tobytes()), np.ascontiguousarray(unique[order], np.int32).tobytes()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[of.ravel()], items], axis=1), axis=0)
        self.items = array("q", np.ascontiguousarray(pairs[:, 1]).tobytes())
        self.first = array("q", np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)).astype(np.int64).tobytes())

    def _hash(self, a, b):
        return (a * _P + b * _Q >> 7) & self.mask if isinstance(a, int) else (a * np.uint64(_P) + b * np.uint64(_Q) >> np.uint64(7)) & np.uint64(self.mask)

    def search(self, ids: list[int], raw: bytes):
        """Start and items' numbers of each occurrence in a text of words `ids`, whose bytes as int32 are `raw`."""
        m, shift, keys, rows, mask, i, end = self.length, self.shift, self.keys, self.rows, self.mask, self.length - 1, len(ids)
        while i < end:
            last = ids[i]
            if not last:
                i += m
                continue
            if m > 1:
                before = ids[i - 1]
                if not before:
                    i += m - 1
                    continue
                block = (before * _P + last * _Q >> 7) & mask
            else:
                block = last & mask
            jump = shift[block]
            if jump:
                i += jump
                continue
            start = i - m + 1
            key = block << 32 | ids[start]
            low = bisect_left(keys, key)
            if low < len(keys) and keys[low] == key:
                here = raw[4 * start : 4 * i + 4]
                for w in range(low, bisect_right(keys, key, low)):
                    if rows[4 * m * w : 4 * m * (w + 1)] == here:
                        yield start, self.items[self.first[w] : self.first[w + 1]]
                        break
            i += 1


class Block:
    """Searchers of all lengths, the numbers of their words and the names of their items."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        self.size = 0
        self._held: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.searchers: list[Searcher] = []

    def add(self, name: str, words: list[bytes], size: int) -> None:
        own = np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words), np.int32, len(words))
        windows = np.lib.stride_tricks.sliding_window_view(own, min(size, len(own)))
        self._held.setdefault(windows.shape[1], []).append((windows, len(self.names)))
        self.names.append(name)
        self.size += len(windows)

    def build(self) -> Block:
        for parts in self._held.values():
            self.searchers.append(Searcher(np.concatenate([w for w, _ in parts]), np.repeat([n for _, n in parts], [len(w) for w, _ in parts])))
        self._held = {}
        return self


def blocks_of(items, size: int = WINDOW, most: int = BLOCK_WINDOWS):
    """Blocks from (item_id, text), each of about `most` windows; an item is in one block."""
    held = Block()
    for item, text in items:
        words = plain_words(text)
        if words:
            held.add(str(item), words, size)
        if held.size >= most:
            yield held.build()
            held = Block()
    if held.size:
        yield held.build()


def find_hits(words: list[bytes], block: Block, covered: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans of all occurrences with those in `covered`, and the items."""
    spans, items = list(covered), set()
    get = block.ids.get
    ids = [get(w, 0) for w in words]
    raw = array("i", ids).tobytes()
    for s in block.searchers:
        for start, numbers in s.search(ids, raw):
            spans.append((start, start + s.length))
            items.update(numbers)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, {block.names[n] for n in items}


def search_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """docs with one struct column more (n_words, spans, items), and that column's name."""
    spark, name = docs.sparkSession, unused(docs, "found")
    kind = T.StructType.fromDDL("n_words long, spans array<struct<a: int, b: int>>, items array<string>")
    out = docs.withColumn(name, F.lit(None).cast(kind))
    rows = ((r.item_id, r.text) for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator())
    schema, at = out.schema, docs.columns.index("text")
    sent = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
    blocks = blocks_of(rows, size, most)
    block = next(blocks, Block())
    while block is not None:
        held, later = spark.sparkContext.broadcast(block), next(blocks, None)

        def run(batches, held=held):
            block = held.value
            for batch in batches:
                found = []
                for text, old in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    words = plain_words(text)
                    spans, items = find_hits(words, block, [(s["a"], s["b"]) for s in old["spans"]] if old else [])
                    items |= set(old["items"]) if old else set()
                    found.append({"n_words": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, sent)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
        if later is not None:
            out = materialise(out, "decontaminate")
        block = later
    return out, name


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, size: int = WINDOW) -> DataFrame:
    """docs without those in which windows of at least min_items items occur; the columns stay, and so do null and empty texts."""
    out, found = search_documents(docs, benchmark, size)
    return out.where(F.size(F.col(found)["items"]) < min_items).drop(found)


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    out, found = search_documents(docs.select("doc_id", "text"), benchmark, size)
    f = F.col(found)
    return out.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        F.aggregate(f["spans"], F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (F.size(f["items"]) >= min_items).alias("contaminated"),
    )


def sha256_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
