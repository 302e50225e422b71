"""Edit-aware token counts (operator 1).

A document keeps a segment tree over its pre-tokens: leaves are blocks of LEAF adjacent pre-tokens, twice as many
at most, with their text and numbers of characters and tokens; inner nodes hold sums.  An edit costs what its
leaves cost: texts are not copied, and what it puts in becomes leaves of its own.  The leaves are two arrays of a row, so trees
live in a table beside the documents.  An edit finds its leaf by descending the sums of characters,
re-encodes from that leaf on until a pre-token ends where an untouched leaf begins, and updates sums on
the paths of the leaves it changed.  A pre-token depends on no more than the two characters behind its
end, so that much boundary context before the edit is encoded again; from a common boundary on the
remaining texts are equal, and so are their pre-tokens.

Cases: a null text is empty and has no tokens; edits are clipped to the text; an edit may insert, delete
or replace, also at both ends; a document without edits keeps its count; repeated rows are counted each;
null ids are carried along; the input's other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.byte_bpe import ByteBpe, bpe_of, slices, texts_of

#: Pre-tokens of a leaf.
LEAF = 64
#: Characters behind a pre-token's end on which it may depend.
CONTEXT = 2


class PieceTree:
    """Sums of characters and tokens over blocks of pre-tokens of one text; each block has its part of the text."""

    def __init__(self, bpe: ByteBpe, text: str, chars: list[int], tokens: list[int]):
        self.bpe = bpe
        self.reencoded = 0
        at = list(accumulate(chars, initial=0))
        self.build([text[a:b] for a, b in pairwise(at)] or [text], list(tokens) or [0])

    def build(self, parts: list[str], tokens: list[int]) -> None:
        n = 1
        while n < len(parts):
            n *= 2
        self.n, self.parts = n, parts
        self.chars = [0] * n + list(map(len, parts)) + [0] * (n - len(parts))
        self.tokens = [0] * n + tokens + [0] * (n - len(parts))
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def used(self) -> int:
        return len(self.parts)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def leaf_of(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins; the last leaf for the end."""
        i, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while i < self.n:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def put(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        i = leaf + self.n
        more, most = len(part) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += most
            i //= 2

    def replace(self, leaf: int, stop: int, parts: list[str], tokens: list[int]) -> None:
        """Other leaves in the place of leaf .. stop; the tree is built anew only where they are more."""
        if len(parts) > stop - leaf:
            counts = self.tokens[self.n : self.n + self.used]
            kept = [(p, t) for p, t in zip([*self.parts[:leaf], *parts, *self.parts[stop:]], [*counts[:leaf], *tokens, *counts[stop:]], strict=True) if p]
            self.build([p for p, _ in kept], [t for _, t in kept])
            return
        for i in range(leaf, stop):
            part, n = (parts[i - leaf], tokens[i - leaf]) if i - leaf < len(parts) else ("", 0)
            self.put(i, part, n)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters start .. stop by new."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        leaf, begin = self.leaf_of(max(0, start - CONTEXT - 1)) if size else (0, 0)
        nxt, old = leaf, begin  # the next untouched leaf, and where it begins
        while nxt < self.used and (old < stop or nxt == leaf):
            old += self.chars[nxt + self.n]
            nxt += 1
        region = "".join(self.parts[leaf:nxt])
        region = region[: start - begin] + new + region[stop - begin :]
        # pre-tokens from the leaf's beginning on, until one ends where the next untouched leaf begins
        ends, counts, at = [0], [], 0
        memo = self.bpe.memo
        while True:
            while nxt < self.used and len(region) < at + 1:  # nothing is left before the boundary, or it was reached over
                if at == len(region):
                    break
                region += self.parts[nxt]
                nxt += 1
            if at == len(region):
                break
            ahead, k = "", nxt
            while k < self.used and len(ahead) <= CONTEXT:
                ahead += self.parts[k]
                k += 1
            for m in self.bpe.pattern.finditer(region + ahead, at):
                if k < self.used and m.end() + CONTEXT > len(region) + len(ahead):  # more text may change it
                    region += ahead
                    nxt = k
                    break
                counts.append(len(memo[m[0]]) // 4)
                self.reencoded += 1
                at = m.end()
                ends.append(at)
                if at >= len(region):
                    break
        parts, tokens = [], []
        step = LEAF if len(counts) > 2 * LEAF else max(1, len(counts))
        for i in range(0, len(counts), step):
            j = min(i + step, len(counts))
            parts.append(region[ends[i] : ends[j]])
            tokens.append(sum(counts[i:j]))
        self.replace(leaf, nxt, parts or [""], tokens or [0])

    @property
    def total(self) -> int:
        return self.tokens[1]


def leaves(bpe: ByteBpe, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf of a text."""
    pieces = bpe.find(text)
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    chars = np.fromiter(map(len, pieces), np.int32, len(pieces))
    tokens = np.fromiter(map(len, map(bpe.memo.__getitem__, pieces)), np.int32, len(pieces)) // 4
    at = np.arange(0, len(pieces), LEAF)
    return np.add.reduceat(chars, at), np.add.reduceat(tokens, at)


def build_trees(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and text with n_tokens and the leaves' sums: leaf_chars, leaf_tokens. One narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(held.value, pattern)
        for batch in slices(batches):
            made = [leaves(bpe, t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(t.sum()) for _, t in made], pa.int64()), pa.array([c for c, _ in made], pa.list_(pa.int32())), pa.array([t for _, t in made], pa.list_(pa.int32()))], names=["id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def apply_edits(trees: DataFrame, vocabulary: bytes, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """trees: rows of build_trees() with edits_col, an array of (start, stop, new) applied one after another.

    Returns id_col, n_tokens, n_edits, n_tokens_edited, n_reencoded (pre-tokens) and, with_text, the text
    and leaves after the edits.
    """
    held = trees.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(held.value, pattern)
        for batch in slices(batches):
            counts, after, again, texts, chars, tokens = [], [], [], [], [], []
            for i, edits in enumerate(batch.column(5).to_pylist()):
                counts.append(len(edits or []))
                if not edits and not with_text:
                    after.append(batch.column(2)[i].as_py())
                    again.append(0)
                    continue
                tree = PieceTree(bpe, batch.column(1)[i].as_py() or "", batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                after.append(tree.total)
                again.append(tree.reencoded)
                texts.append(tree.text)
                chars.append(tree.chars[tree.n : tree.n + tree.used])  # empty leaves stay, they cost nothing
                tokens.append(tree.tokens[tree.n : tree.n + tree.used])
            out = [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(after, pa.int64()), pa.array(again, pa.int64())]
            names = ["id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]
            if with_text:
                out += [pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
                names += ["text", "leaf_chars", "leaf_tokens"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(trees.dtypes)[id_col]
    more = ", text string, leaf_chars array<int>, leaf_tokens array<int>" * with_text
    rows = trees.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "n_tokens", "leaf_chars", "leaf_tokens", F.col(edits_col).alias("edits"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long{more}").withColumnRenamed("id", id_col)


def edits_by_rule(rows: DataFrame, rules: list[tuple[str, str]], text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """rows with the edits that replace each match of the rules' patterns, rule after rule; a column of that name gives way."""
    rows = rows.drop(edits_col)
    compiled = [(re.compile(p), new) for p, new in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(where).to_pylist():
                edits, text = [], text or ""
                for pattern, new in compiled:
                    shift, found = 0, list(pattern.finditer(text))
                    for m in found:
                        edits.append({"start": m.start() + shift, "stop": m.end() + shift, "new": new})
                        shift += len(new) - (m.end() - m.start())
                    if found:
                        text = pattern.sub(lambda m: new, text)  # noqa: B023
                out.append(edits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())])))], names=[*batch.schema.names, edits_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, `{edits_col}` array<struct<start:int,stop:int,new:string>>")
