"""Token counts that follow edits.

A text is split into pre-tokens by a fixed pattern, and each is encoded by byte
pair merges on its own.  A TokenTree keeps, for leaves of LEAF pre-tokens, their
characters and tokens in a segment tree.  An edit re-splits from the leaf that
holds the CONTEXT characters before it (a pre-token's match reads at most two
characters beyond its end) until a pre-token ends where an old leaf did behind
the edit; only that region is encoded again, and the sums above it are updated.
Edits whose regions touch are one region, encoded once, and the text is put
together once, so any number of edits costs at most one pass over the text.

Trees are kept: store() writes them beside their texts as a table, and edited()
takes such a table, whenever it was written, with edits by a function of the
text or from a table of edits, and gives the table after them.

The vocabulary is a file of ranks whose path is a parameter.  The driver
reads it and broadcasts its bytes (under a megabyte, refused beyond
VOCABULARY_BYTES), so executors need no file.

Null texts count as empty: no pre-tokens, no tokens.  Rows are counted one by
one, so repeated rows and null doc_ids need no care; edits of a table go to every
row of their doc_id, none to rows without one.  A very long text has a larger
tree, of four numbers for every LEAF pre-tokens.  An empty table gives no rows.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import materialise

# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
LEAF, CONTEXT = 32, 2
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: Rows whose trees a worker holds at once.
ROWS = 256

#: What the query redacts.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}")
REDACTED = "<email>"

_SPLIT = regex.compile(PATTERN)


class Encoder:
    """Counts tokens of pre-tokens."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._known) < REMEMBERED:
                self._known[piece] = n
        return n


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One for each process and vocabulary."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


Edit = tuple[int, int, str]


class TokenTree:
    """Sums of characters and tokens over leaves of a text, as heaps: the children of node i are 2i and 2i + 1, leaves have the numbers from `width` on."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self._build(leaves)

    @classmethod
    def of(cls, text: str, enc: Encoder) -> TokenTree:
        pieces = _SPLIT.findall(text)
        tree = cls(_leaves(pieces, LEAF, enc))
        tree.pieces = len(pieces)
        return tree

    @classmethod
    def kept(cls, chars: list[int], tokens: list[int], pieces: int) -> TokenTree:
        """A tree as it was stored."""
        tree = cls.__new__(cls)
        tree.width, tree.chars, tree.tokens, tree.pieces = len(chars) // 2, chars, tokens, pieces
        return tree

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        n = 1
        while n < max(1, len(leaves)):
            n *= 2
        self.width, self.pieces = n, 0
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (c, t) in enumerate(leaves):
            self.chars[n + i], self.tokens[n + i] = c, t
        for i in range(n - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if position >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, text: str, start: int, end: int, put: str, enc: Encoder) -> tuple[str, int]:
        """edit_all() of one edit."""
        return self.edit_all(text, [(start, end, put)], enc)

    def edit_all(self, text: str, edits: Iterable[Edit], enc: Encoder) -> tuple[str, int]:
        """The text after edits (start, end, put) that do not overlap, all by places in the given text, and how many pre-tokens were encoded for it."""
        edits = _checked(sorted(edits, key=lambda e: e[:2]), len(text))
        if not edits:
            return text, 0
        parts, at = [], 0
        for start, end, put in edits:
            parts += (text[at:start], put)
            at = end
        new = "".join([*parts, text[at:]])
        regions, encoded, count, moved, k = [], 0, self.pieces, 0, 0
        while k < len(edits):
            first, begin = self.leaf_at(max(0, edits[k][0] - CONTEXT))
            last, old_end, behind = first, begin + self.chars[self.width + first], 0
            pieces, over = [], begin + moved
            for m in _SPLIT.finditer(new, over):
                pieces.append(m.group())
                over = m.end()
                while True:  # up to the leaf whose end is not left of the pre-token's, with the edits that reach into the leaves so far
                    while k < len(edits) and edits[k][0] - CONTEXT < old_end:
                        moved += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                        behind = edits[k][1]
                        k += 1
                    if last + 1 < self.width and (old_end + moved < over or old_end < behind):
                        last += 1
                        old_end += self.chars[self.width + last]
                    else:
                        break
                if old_end >= behind and old_end + moved == over:
                    break
            if over == len(new):  # the end: what is left of the old leaves has gone
                last, old_end, k = self.width - 1, len(text), len(edits)
            regions.append((first, last, pieces))
            encoded += len(pieces)
            count += len(pieces) - sum(1 for _ in itertools.takewhile(lambda m, end=old_end: m.start() < end, _SPLIT.finditer(text, begin)))
        self._put(regions, enc)
        self.pieces = count
        return new, encoded

    def _put(self, regions: list[tuple[int, int, list[str]]], enc: Encoder) -> None:
        """New leaves for regions of old ones, and the sums above them, each once; a new tree if a region has outgrown its leaves."""
        if any(len(pieces) > 4 * LEAF * (last - first + 1) for first, last, pieces in regions):
            leaves, at = [], 0
            own = list(zip(self.chars[self.width :], self.tokens[self.width :], strict=True))
            for first, last, pieces in regions:
                leaves += [*own[at:first], *_leaves(pieces, LEAF, enc)]
                at = last + 1
            self._build([x for x in (*leaves, *own[at:]) if x[0]])
            return
        touched = set()
        for first, last, pieces in regions:
            slots = last - first + 1
            leaves = _leaves(pieces, max(LEAF, -(-len(pieces) // slots)), enc)
            for j in range(slots):
                i, new = self.width + first + j, leaves[j] if j < len(leaves) else (0, 0)
                if (self.chars[i], self.tokens[i]) != new:
                    self.chars[i], self.tokens[i] = new
                    touched.add(i)
        while touched and touched != {1}:
            touched = {i // 2 for i in touched}
            for i in touched:
                self._sum(i)


def _checked(edits: list[Edit], length: int) -> list[Edit]:
    at = 0
    for start, end, _ in edits:
        if not at <= start <= end <= length:
            raise ValueError(f"edits overlap or lie outside the text: {start} to {end}")
        at = end
    return edits


def _leaves(pieces: list[str], size: int, enc: Encoder) -> list[tuple[int, int]]:
    counts, out = list(map(enc.count, pieces)), []
    for i in range(0, len(pieces), size):
        out.append((sum(map(len, pieces[i : i + size])), sum(counts[i : i + size])))
    return out


def redactions(text: str) -> list[Edit]:
    return [(*m.span(), REDACTED) for m in EMAIL.finditer(text)]


def vocabulary_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary of at most VOCABULARY_BYTES, which the driver reads by any path that Spark knows; a plain path is a file of its own."""
    if "://" not in path:
        path = f"file://{path}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).getLen() > VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


#: A row of a table of trees, all of the text as it stands.
STORED = "text string, pretokens long, chars array<int>, tokens array<int>"


def _schema(docs: DataFrame, more: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(more)])


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, pretokens, chars, tokens (the tree) of every row: a table to keep."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(docs.sparkSession, vocabulary))

    def run(batches):
        enc = encoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [TokenTree.of(t or "", enc) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([t.pieces for t in made], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in ([t.chars for t in made], [t.tokens for t in made]))],
                    names=["doc_id", "text", "pretokens", "chars", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, STORED))


def edited(stored: DataFrame, edits: DataFrame | Callable[[str], list[Edit]], vocabulary: str = VOCABULARY) -> DataFrame:
    """A table of trees after edits, with the columns n_edits, reencoded (pre-tokens encoded for them), pretokens_before and tokens_before.

    `edits` is a function of the text or a table (doc_id, start, end, put) of
    places in the texts of `stored`.  Only regions that edits touch are encoded.
    """
    held = stored.sparkSession.sparkContext.broadcast(vocabulary_bytes(stored.sparkSession, vocabulary))
    of = edits if callable(edits) else None
    rows = stored.select("doc_id", "text", "pretokens", "chars", "tokens")
    if of is None:
        each = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("edit_id")).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "put")).alias("edits"))
        rows = rows.join(each, rows["doc_id"] == each["edit_id"], "left").drop("edit_id")

    def run(batches):
        enc = encoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield after(batch.slice(at, ROWS), enc)

    def after(part: pa.RecordBatch, enc: Encoder) -> pa.RecordBatch:
        texts, counts, heaps, told = [], [], ([], []), ([], [], [], [])
        columns = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
        for text, pieces, chars, tokens, *more in zip(*columns, strict=True):
            tree = TokenTree.kept(chars, tokens, pieces)
            before = tree.total
            changes = of(text or "") if of else [(e["start"], e["end"], e["put"]) for e in more[0] or ()]
            new, encoded = tree.edit_all(text or "", changes, enc)
            texts.append(None if text is None and not changes else new)
            counts.append(tree.pieces)
            heaps[0].append(tree.chars)
            heaps[1].append(tree.tokens)
            for column, value in zip(told, (len(changes), encoded, pieces, before), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), *(pa.array(h, pa.list_(pa.int32())) for h in heaps), *(pa.array(c, pa.int64()) for c in told)],
            names=["doc_id", "text", "pretokens", "chars", "tokens", "n_edits", "reencoded", "pretokens_before", "tokens_before"],
        )

    return rows.mapInArrow(run, _schema(stored, f"{STORED}, n_edits long, reencoded long, pretokens_before long, tokens_before long"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, edits=redactions) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_edits, tokens_after, reencoded for every row: the table of trees is written, then edited."""
    stored = materialise(trees(docs, vocabulary), "token-trees")
    out = edited(stored, edits, vocabulary)
    return out.select("doc_id", F.col("pretokens_before").alias("n_pretokens"), F.col("tokens_before").alias("n_tokens"), "n_edits", F.col("tokens")[1].cast("long").alias("tokens_after"), "reencoded")
