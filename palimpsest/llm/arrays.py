"""Vectorised pieces shared by the operators: words, hashes and packed integers over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The mixing constants of splitmix64 and an odd base for polynomial hashes.
MIX_A, MIX_B, MIX_C, BASE = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), 0xD1342543DE82EF95
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that are hashed at once; bounds the temporary arrays whatever a text's length.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = x + MIX_A
        x = (x ^ (x >> U64(30))) * MIX_B
        x = (x ^ (x >> U64(27))) * MIX_C
        return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, U64)
    step = base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * U64(step)])
            step = step * step % (1 << 64)
    return out[:n]


_POW: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for offsets within a step and what may hang over."""
    if not _POW:
        n = 2 * STEP
        _POW["up"], _POW["down"] = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
    return _POW["up"], _POW["down"]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as one byte array and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ and, for each document, the number of the first word."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and do not overlap."""
    up, down = powers()
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + STEP, "right")))
            if ends[j - 1] - base > len(up):  # one span longer than the tables
                x, h = data[base : ends[j - 1]], U64(0)
                for k in range(0, len(x), STEP):
                    part = x[k : k + STEP].astype(U64)
                    h = h * up[len(part)] + ((part + U64(1)) * up[: len(part)][::-1]).sum(dtype=U64)
                out[i] = h
            else:
                part = data[base : ends[j - 1]].astype(U64)
                total = np.zeros(len(part) + 1, U64)
                np.cumsum((part + U64(1)) * up[: len(part)], out=total[1:])
                s, e = starts[i:j] - base, ends[i:j] - base
                out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out + (ends - starts).astype(U64) * MIX_C)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k adjacent words within a document and each one's document number.

    A document with fewer words than k has its whole sequence as one; one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    start = first[:-1][doc] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    have = np.minimum(counts, k)[doc]
    h = have.astype(U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = j < have
            nxt = h * U64(BASE) + words[np.minimum(start + j, len(words) - 1)] if len(words) else h
            h = np.where(inside, nxt, h)
    return mix(h), doc


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w adjacent values, by doubling; len(x) - w + 1 results."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


def in_turn(keys: np.ndarray, bits: int) -> np.ndarray:
    """np.argsort(keys, kind="stable") of hashes of so many bits.

    Their highest 32 bits are sorted with their places behind them, as one number each, which is several times
    faster; the few keys that only lower bits tell apart are put in order after that.
    """
    if bits <= 32 or len(keys) >= 1 << 32:
        return np.argsort(keys, kind="stable")
    both = np.sort(keys >> U64(bits - 32) << U64(32) | np.arange(len(keys), dtype=U64))
    order = (both & U64((1 << 32) - 1)).astype(np.int64)
    lead = np.append(True, both[1:] >> U64(32) != both[:-1] >> U64(32))[: len(keys)]
    k = keys[order]
    unlike = np.flatnonzero(~lead[1:] & (k[1:] != k[:-1]))
    if len(unlike):
        run = np.cumsum(lead)
        again = np.flatnonzero(np.isin(run, run[unlike]))
        order[again] = order[again][np.lexsort((k[again], run[again]))]
    return order


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences of as few whole bytes as the largest needs, byte by byte, compressed."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=U64(0))
    first, steps = steps[0], steps[1:]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)  # high bytes are mostly zero
    return bytes([width]) + first.astype("<u8").tobytes() + squeeze(planes.ravel())


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width = blob[0]
    body = unsqueeze(blob[9:], "u1")[0].reshape(width, -1).T
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    with np.errstate(over="ignore"):
        return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; unsqueeze() takes their types."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    body = head + b"".join(a.tobytes() for a in arrays)
    return np.array([len(body)], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unsqueeze(blob: bytes, *types: str) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, "<i8", 1)[0])
    body = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    sizes, out, at = np.frombuffer(body, "<i8", n, 8), [], 8 * (n + 1)
    for t, size in zip(types, sizes, strict=True):
        out.append(np.frombuffer(body, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Integer arrays less their least values, in as few bytes each as the largest needs, byte by byte, compressed."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        low = int(a.min()) if len(a) else 0
        width = max(1, ((int(a.max()) - low).bit_length() + 7) // 8) if len(a) else 1
        body = (a.astype(np.int64).view(U64) - np.int64(low).view(U64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        parts += [np.array([low, len(a), width], "<i8").tobytes(), np.ascontiguousarray(body.T).tobytes()]
    return squeeze(np.frombuffer(b"".join(parts), "u1"))


def unpack_ints(blob: bytes) -> list[np.ndarray]:
    body = unsqueeze(blob, "u1")[0]
    n, at, out = int(body[:8].view("<i8")[0]), 8, []
    for _ in range(n):
        low, size, width = (int(x) for x in np.frombuffer(body[at : at + 24].tobytes(), "<i8"))
        at += 24
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = body[at : at + size * width].reshape(width, size).T
        with np.errstate(over="ignore"):
            out.append((wide.view("<u8").ravel() + np.int64(low).view(U64)).view(np.int64))
        at += size * width
    return out


def groups(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values of a sorted array."""
    cuts = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else np.zeros(0, int)
    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        if b > a:
            yield keys[a], slice(a, b)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and a count of each as one blob."""
    body = pack_sorted(keys)
    return np.array([len(body)], "<i8").tobytes() + body + squeeze(counts.astype("<u4"))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(blob, "<i8", 1)[0])
    return unpack_sorted(blob[8 : 8 + size]), unsqueeze(blob[8 + size :], "<u4")[0]


def ranges(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Bounds within ascending keys of n equal ranges of the numbers of so many bits."""
    edges = [-(-(b << bits) // n) for b in range(n)]
    return np.append(np.searchsorted(keys, np.array(edges, U64)), len(keys))


def totals(came: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each pack's keys and counts, the counts summed over all packs."""
    got = [unpack_counts(blob) for _, blob in came]
    _, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([g[1] for g in got]))[inverse]
    at = 0
    for (pack, _), (keys, _) in zip(came, got, strict=True):
        yield pack, total[at : at + len(keys)]
        at += len(keys)
