"""Byte-level BPE encoding and decoding (operator 4).

A text is cut into pieces by the tokenizer's pattern and every piece is encoded on its own.  Token
bytes are read as Latin-1 text, so that a pyahocorasick automaton finds, for every start, the longest
token that begins there.  A piece is then written greedily from longest matches; whenever a token can
not follow the one before it (the pair would not survive BPE's merge order) the shorter prefixes are
tried and at last the previous token is taken back.  Positions that led nowhere are marked, so each is
tried once and the work is linear in the piece.  Pair compatibility is memoised.  The ids equal those
of running the merges by rank.

Cases: a null text counts as empty (no ids); a piece that is itself a token is that token, whatever its
merges; repeated rows give repeated results; the input's other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each of the two generations of the piece memo in a worker.
MEMO_ENTRIES = 400_000
#: Pieces longer than this are encoded afresh each time, so that the memo's size in bytes is bounded.
MEMO_PIECE_CHARS = 64


def read_ranks(path: str) -> bytes:
    """The vocabulary file's bytes, read on the driver; executors get them by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes by rank file lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain BPE: the adjacent pair of lowest rank is merged first, the leftmost on ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: Fixed value: the pattern that the fast splitter stands for.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into the pattern's matches.

    The usual pattern has an equal in the standard library's faster engine for texts of characters below
    U+0250 that both engines class alike; other texts and patterns take the regex module.
    """
    import regex

    whole = regex.compile(pattern).findall
    if pattern != USUAL_PATTERN:
        return whole
    classes = [(r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")]
    alike = [c for c in map(chr, range(0x250)) if all(bool(regex.fullmatch(a, c)) == bool(re.fullmatch(b, c)) for a, b in classes)]
    other = re.compile("[^" + "".join(map(re.escape, alike)) + "]").search
    fast = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    return lambda text: whole(text) if other(text) else fast(text)


class ByteBpe:
    """Encoder and decoder for one vocabulary; built once per Python worker."""

    def __init__(self, blob: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks = parse_ranks(blob)
        self.find, self.pattern = splitter(pattern), regex.compile(pattern)
        self.token = {i: t for t, i in self.ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.of_chars: dict[str, int] = {}
        reachable = set()
        for t, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                split = self._split(t, i, reachable)
                if split is None:
                    continue  # no merge makes it: only a piece equal to it has this id
                self.parts[i] = split
                self.joined[split] = i
            reachable.add(t)
            self.of_chars[t.decode("latin-1")] = i
            self.automaton.add_word(t.decode("latin-1"), i)
        for t in reachable:
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in reachable:
                    self.shorter[self.ranks[t]] = self.ranks[t[:n]]
                    break
        self.most = max(map(len, reachable))
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = PieceMemo(self)

    def _split(self, t: bytes, rank: int, reachable: set[bytes]) -> tuple[int, int] | None:
        """The two tokens whose merge makes t."""
        if len(t) == 2:
            return self.ranks[t[:1]], self.ranks[t[1:]]
        for n in range(len(t) - 1, 0, -1):
            a, b = t[:n], t[n:]
            if a in reachable and b in reachable:
                x, y = self.ranks[a], self.ranks[b]
                if x < rank and y < rank and self._survives(x, y):
                    return x, y
        parts = merge_by_rank(t, self.ranks, rank)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _survives(self, left: int, right: int) -> bool:
        """True if BPE leaves left and right side by side in their joint bytes.

        Both tokens are undone merge by merge, latest merge first. Were there a token across the cut of
        a rank below what has been undone so far, BPE would have made it first.
        """
        ceiling = 1 << 62
        parts, joined = self.parts, self.joined
        while True:
            across = joined.get((left, right))
            if across is not None and across < ceiling:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    if left in parts:
                        ceiling, left = left, parts[left][1]
                        break
                elif right in parts:
                    # on equal ranks the left one is merged first
                    ceiling, right = right + 1, parts[right][0]
                    break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        chars, most, prefix, ids = piece.decode("latin-1"), self.most, self.automaton.longest_prefix, self.of_chars

        def longest(at: int) -> int:
            """The longest token that begins at at, by a walk down the automaton's trie."""
            length = prefix(chars[at : at + most])
            while (i := ids.get(chars[at : at + length], -1)) < 0:
                length -= 1
            return i

        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        token, shorter, fits = self.token, self.shorter, self.fits
        pos, now = 0, longest(0)
        while pos < n:
            last = out[-1] if out else -1
            while now >= 0:
                end = pos + len(token[now])
                if open_at[end]:
                    if last < 0:
                        break
                    ok = fits.get((last, now))
                    if ok is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        ok = fits[last, now] = self._survives(last, now)
                    if ok:
                        break
                now = shorter.get(now, -1)
            if now >= 0:
                out.append(now)
                pos = end
                now = longest(pos) if pos < n else -1
            else:
                open_at[pos] = 0
                now = out.pop()
                pos -= len(token[now])
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class PieceMemo(dict):
    """Ids of pieces seen; two generations, so that its size is bounded and frequent pieces stay."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            ids = self.bpe.encode_piece(piece.encode("utf-8", "surrogateescape"))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_PIECE_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


_built: dict[tuple[int, str], ByteBpe] = {}


def bpe_of(blob: bytes, pattern: str) -> ByteBpe:
    key = (hash(blob), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = ByteBpe(blob, pattern)
    return _built[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, so that what a worker makes of one stays small; an empty batch stays."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(i, rows)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one, null as empty."""
    for x in column.cast(pa.large_binary()):
        b = x.as_py()
        yield b.decode("utf-8", "surrogateescape") if b else ""


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (binary, little-endian
    unsigned 32-bit). One narrow pass: no shuffle, memory of one Arrow batch and the memo.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(held.value, pattern)
        for batch in slices(batches):
            counts, shas, decoded, packed = [], [], [], []
            for text in texts_of(batch.column(1)):
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
                if with_ids:
                    packed.append(ids)
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from packed ids: id_col, text. Null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(held.value, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
