"""Suffix-array removal of repeated substrings (operator 7).

Every string of `width` bytes that also begins in a document with a smaller id is removed; the first
document keeps it.  In the order of all suffixes, the longest factor at a suffix that begins in an earlier
document is the longer common prefix with the nearest suffixes before and after it that belong to smaller
documents (its previous and next smaller positions); where that longest previous factor reaches `width`
bytes, the string there is removed.

The order is built in parts: windows of `width` bytes are dealt by the least hash of the grams within
them, so equal windows meet, and a run of neighbouring windows with one least hash travels as one
string.  Within a pack equal strings travel once, for the smallest document.  Runs whose least hash
came from a single document are dropped; over the others a suffix array is built by prefix doubling, common
prefixes are read off its levels, and smaller positions are found by jumping over those that are not smaller.
Strings that are held for equal by a 64-bit hash are compared byte by byte.

Cases: null text is empty; a text shorter than the width is kept whole; rows of one id never remove
from each other; rows with a null id remove nothing and lose nothing; the input's other columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import STEP, U64, flat, mix, pack_counts, powers, ranges, sliding_min, squeeze, totals, unsqueeze
from palimpsest.llm.exchange import exchange

#: Bytes of the grams whose least hash decides where a window goes.
GRAM = 24
#: Bits of a least hash by which its holders are counted; a collision only makes a run travel in vain.
KEY_BITS = 46
#: Documents' ids are compared as signed 64-bit integers; this one stands for no id.
NO_DOC = np.int64(np.iinfo(np.int64).max)


def runs_of(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least gram hash: first byte, number of windows, hash.

    No run crosses documents; the bytes are taken a step at a time, so long texts need no more memory.
    """
    starts, counts, keys = [], [], []
    up, down = powers()
    n_grams = width - GRAM + 1
    edge = at[1:] - width  # the last window of each document
    base = 0
    with np.errstate(over="ignore"):
        while base + width <= len(data):
            part = data[base : base + STEP + width - 1].astype(U64)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum((part + U64(1)) * up[: len(part)], out=total[1:])
            h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
            least = sliding_min(h, n_grams)
            n = len(least)
            inside = np.zeros(n + 1, np.int32)
            lo, hi = np.searchsorted(at[1:], base, "right"), np.searchsorted(at[:-1], base + n)
            for d in range(lo, hi):
                a, b = max(at[d], base) - base, min(edge[d] + 1, base + n) - base
                if b > a:
                    inside[a] += 1
                    inside[b] -= 1
            ok = np.cumsum(inside[:-1]) > 0
            begin = ok.copy()
            begin[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
            first_of = at[lo:hi][(at[lo:hi] >= base) & (at[lo:hi] < base + n)] - base
            begin[first_of] = ok[first_of]
            s = np.flatnonzero(begin)
            stop = np.append(s[1:], n)
            ends = np.append(np.flatnonzero(ok[:-1] & ~ok[1:]) + 1, n if n and ok[-1] else n + 1)
            c = np.minimum(stop, ends[np.searchsorted(ends, s, "right")] if len(s) else s) - s
            starts.append(s + base)
            counts.append(c)
            keys.append(least[s])
            base += STEP
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that may overlap."""
    up, down = powers()
    out = np.zeros(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, base + STEP // 2, "right")))
            part = data[base : ends[i:j].max()].astype(U64)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum((part + U64(1)) * up[: len(part)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out + (ends - starts).astype(U64))


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans one after another."""
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0)
    index += np.repeat(starts - (ends - sizes), sizes)
    return index


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans one after another."""
    return data[places(starts, sizes)]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of so many bytes at a and b are equal; STEP bytes are compared at once."""
    out = np.ones(len(a), bool)
    i = 0
    upto = np.cumsum(sizes)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
        equal = gather(data, a[i:j], sizes[i:j]) == gather(data, b[i:j], sizes[i:j])
        head = np.cumsum(sizes[i:j]) - sizes[i:j]
        some = sizes[i:j] > 0
        out[i:j][some] = np.logical_and.reduceat(equal, head[some]) if some.any() else True
        i = j
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans numbered a and b are equal; a span is equal to itself unread."""
    out = a == b
    i = np.flatnonzero(~out)
    i = i[size[a[i]] == size[b[i]]]
    out[i] = same_bytes(data, start[a[i]], start[b[i]], size[a[i]])
    return out


def suffix_levels(data: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(n, ranks of the strings of n bytes at each place, in order and equal for equal strings) for n = 8, 16, 32 .. width, by prefix doubling."""
    have = 8
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    key = np.zeros(len(data), U64)
    for i in range(have):
        key = (key << U64(8)) | padded[i : i + len(data)].astype(U64)
    out = [(have, np.unique(key, return_inverse=True)[1])]
    n = U64(len(data) + 1)
    while have < width:
        shift = min(have, width - have)
        rank = out[-1][1].astype(U64)
        nxt = np.zeros(len(data), U64)
        nxt[: len(data) - shift] = rank[shift:] + U64(1)
        have += shift
        out.append((have, np.unique(rank * n + nxt, return_inverse=True)[1]))
    return out


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], order: np.ndarray, least: int = 1) -> np.ndarray:
    """Common prefix of each place in suffix order with the one before it, up to the width; 0 for the first, and for one that doesn't reach a least of the whole width."""
    width = levels[-1][0]
    a, b = order[:-1], order[1:]
    if least >= width:
        same = levels[-1][1][a] == levels[-1][1][b] if len(order) > 1 else np.zeros(0, bool)
        return np.append(np.zeros(1, np.int64), np.where(same, width, 0))[: len(order)]
    got = np.where(levels[-1][1][a] == levels[-1][1][b], width, 0) if len(order) > 1 else np.zeros(0, np.int64)
    for n, rank in levels[-2::-1]:
        more = np.flatnonzero(got < width)
        i, j = a[more] + got[more], b[more] + got[more]
        inside = np.maximum(i, j) < len(data)
        more, i, j = more[inside], i[inside], j[inside]
        got[more[rank[i] == rank[j]]] += n
    for _ in range(8):
        more = np.flatnonzero(got < width)
        i, j = a[more] + got[more], b[more] + got[more]
        inside = np.maximum(i, j) < len(data)
        more = more[inside]
        more = more[data[i[inside]] == data[j[inside]]]
        if not len(more):
            break
        got[more] += 1
    return np.append(np.zeros(1, np.int64), np.minimum(got, width))[: len(order)]


def longest_previous(doc: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """By place in suffix order, the longest factor that a smaller document has too; 0 where it is shorter than least.

    A place's previous smaller position is reached by jumps: from a neighbour that is not smaller to where that
    one would go on, the common prefix being the least on the way; jumps whose prefix is too short end.  All
    places jump at once, so the rounds grow with the logarithm of the longest way.
    """
    n = len(doc)
    out = np.zeros(n, np.int64)
    for side in (-1, 1):
        d, l = (doc, lcp) if side < 0 else (doc[::-1], np.append(lcp[1:], 0)[::-1])
        to, common = np.arange(n) - 1, l.copy()
        common[:1] = 0
        going = np.flatnonzero(common >= least)
        while len(going):
            going = going[d[to[going]] >= d[going]]
            at = to[going]
            common[going], to[going] = np.minimum(common[going], common[at]), to[at]
            going = going[(common[going] >= least) & (to[going] >= 0)]
        found = np.where((common >= least) & (to >= 0), common, 0)
        out = np.maximum(out, found if side < 0 else found[::-1])
    return out


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carried: list[str] | None = None, renamed: bool = True, **sizes: int) -> DataFrame:
    """Returns id_col, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the text that is left; then the columns carried along, under names _c0, _c1, .. if not renamed.

    with_text decodes what is left as UTF-8; characters cut apart are dropped from the text (the hash is
    that of the bytes). sizes: pack_bytes and bucket_bytes of the exchange.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")

    def parts(table: pa.Table) -> tuple:
        """A pack's runs, and of equal strings which one asks: (data, at, ids, start, count, key, doc, asks, covered)."""
        data, at = flat(table["text"])
        ids = np.array([NO_DOC if x is None else x for x in table["id"].to_pylist()], np.int64)
        start, count, key = runs_of(data, at, width)
        doc = np.searchsorted(at, start, "right") - 1
        known = ids[doc] != NO_DOC if len(doc) else np.zeros(0, bool)
        start, count, key, doc = start[known], count[known], key[known], doc[known]
        same = string_hashes(data, start, start + count + width - 1)
        order = np.argsort(same, kind="stable")  # the rows are in the order of ids
        lead = np.append(True, same[order][1:] != same[order][:-1]) if len(order) else np.zeros(0, bool)
        owner = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
        # a hash that different strings share: each of them asks for itself
        alike = equal_spans(data, start, count + width - 1, owner, order)
        lead, owner = lead | ~alike, np.where(alike, owner, order)
        asks = np.zeros(len(start), bool)
        covered = np.zeros(len(start), bool)
        later = ids[doc[order]] > ids[doc[owner]]
        covered[order] = later
        asks[order] = ids[doc[order]] == ids[doc[owner]]
        asks[order] &= lead | ~later
        return data, at, ids, start, count, key, doc, asks, covered

    def dealt(key: np.ndarray, asks: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        who = np.flatnonzero(asks)
        bucket = (key[who] % U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, who[order[cuts[b] : cuts[b + 1]]]

    def holders(table: pa.Table) -> tuple:
        """A pack's runs (parts), their shortened keys in order, and in how many documents each occurs."""
        got = parts(table)
        short, doc = got[5] >> U64(64 - KEY_BITS), got[6]
        order = np.argsort(short, kind="stable")  # runs come in the order of documents
        k, d = short[order], doc[order]
        lead = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        other = lead | np.append(True, d[1:] != d[:-1]) if len(k) else lead
        head = np.flatnonzero(lead)
        return got, short, k[head], np.add.reduceat(other.astype(np.int64), head) if len(head) else head

    def ask_holders(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
        _, _, keys, docs = holders(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        for b in range(n_buckets):
            if cut[b + 1] > cut[b]:
                yield b, pack_counts(keys[cut[b] : cut[b + 1]], docs[cut[b] : cut[b + 1]])

    def tell_shared(came: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        for pack, total in totals(came):
            shared = total > 1
            yield pack, squeeze(np.packbits(shared)) if shared.any() else b""

    def send_runs(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
        (data, at, ids, start, count, key, doc, asks, _), short, keys, _ = holders(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        shared = np.zeros(len(keys), bool)
        for b, blob in replies.items():
            shared[cut[b] : cut[b + 1]] = np.unpackbits(unsqueeze(blob, "u1")[0])[: cut[b + 1] - cut[b]]
        for b, i in dealt(key, asks & shared[np.searchsorted(keys, short)] if len(keys) else asks, n_buckets):
            yield b, squeeze(i.astype("<i8"), key[i], ids[doc[i]], count[i].astype("<i4"), gather(data, start[i], count[i] + width - 1))

    def find_repeats(came: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        got = [unsqueeze(blob, "<i8", "<u8", "<i8", "<i4", "u1") for _, blob in came]
        run, key, ids, count = (np.concatenate([g[k] for g in got]) for k in range(4))
        data = np.concatenate([g[4] for g in got])
        count = count.astype(np.int64)
        size = count + width - 1
        start = np.cumsum(size) - size
        # Of equal strings only the smallest document's goes on; the others are repeats as a whole.
        same = string_hashes(data, start, start + size)
        order = np.lexsort((ids, same, key))
        k, s = key[order], same[order]
        lead = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
        owner = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        alike = equal_spans(data, start, size, owner, order)
        lead, owner = lead | ~alike, np.where(alike, owner, order)
        whole = np.zeros(len(key), bool)
        whole[order] = ids[order] > ids[owner]
        firsts = order[lead]
        k, d = key[firsts], ids[firsts]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        mixed = np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head)
        chosen = firsts[np.repeat(mixed, np.diff(np.append(head, len(k))))]
        hit = np.repeat(whole, count)
        first = np.cumsum(count) - count
        if len(chosen):
            body, windows = gather(data, start[chosen], size[chosen]), count[chosen]
            own = np.cumsum(size[chosen]) - size[chosen]
            begins = places(own, windows)
            levels = suffix_levels(body, width)[-1:]  # the whole width decides; the other levels are not read
            by_suffix = np.argsort(levels[-1][1][begins], kind="stable")
            factor = longest_previous(np.repeat(ids[chosen], windows)[by_suffix], common_prefixes(body, levels, begins[by_suffix], width), width)
            found = np.zeros(len(hit), bool)
            found[places(first[chosen], windows)[by_suffix]] = factor >= width
            # A row of the same document and string as its owner shares its verdict.
            twin = np.flatnonzero(~whole)
            of = np.empty(len(key), np.int64)
            of[order] = owner
            hit[places(first[twin], count[twin])] = gather(found, first[of[twin]], count[twin])
        some = np.add.reduceat(hit.astype(np.int64), first) > 0
        at = 0
        for (pack, _), g in zip(came, got, strict=True):
            i = at + np.flatnonzero(some[at : at + len(g[0])])
            yield pack, squeeze(run[i], count[i].astype("<i4"), np.packbits(gather(hit, first[i], count[i]))) if len(i) else b""
            at += len(g[0])

    def finish(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> pa.Table:
        data, at, ids, start, count, key, doc, asks, covered = parts(table)
        hit = np.zeros(len(data) + 1, np.int32)  # +1 where a removed string begins, -1 after its end
        np.add.at(hit, start[covered], 1)
        np.add.at(hit, start[covered] + count[covered] + width - 1, -1)
        for blob in replies.values():
            run, windows, bits = unsqueeze(blob, "<i8", "<i4", "u1")
            bits = np.unpackbits(bits)[: int(windows.sum())].astype(bool)
            place = places(start[run], windows.astype(np.int64))[bits]
            np.add.at(hit, place, 1)
            np.add.at(hit, place + width, -1)
        gone = np.cumsum(hit[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = at[:-1][np.diff(at) > 0]
        edge[starts] = gone[starts]
        spans, removed = np.concatenate([[0], np.cumsum(edge)]), np.concatenate([[0], np.cumsum(gone)])
        out = {"id": table["id"], "n_bytes": np.diff(at), "n_removed": np.diff(removed[at]), "n_spans": np.diff(spans[at])}
        kept = [data[a:b][~gone[a:b]].tobytes() if n else data[a:b].tobytes() for a, b, n in zip(at[:-1], at[1:], out["n_removed"], strict=True)]
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in kept]
        if with_text:
            out["kept_text"] = [x.decode("utf-8", "ignore") for x in kept]
        return pa.table(out | {f"_c{i}": table[f"_c{i}"] for i in range(len(more))})

    more = carried or []
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(more)))
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", _c{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(more))
    out = exchange(rows, [(ask_holders, tell_shared), (send_runs, find_repeats)], finish, schema, 1.5, **sizes).withColumnRenamed("id", id_col)
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(more)}) if renamed else out


def cleaned(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """docs with each text less its repeats; a document of which nothing is left stays, empty, and null texts stay null. A column n_chars follows the text."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(id_col, text_col, *others, F.col(text_col).isNull().alias("is null"))
    out = remove_repeats(rows, width, id_col, text_col, with_text=True, carried=[*others, "is null"], renamed=False, **sizes)
    text = F.when(~F.col(f"_c{len(others)}"), F.col("kept_text"))

    def column(c: str):
        if c in (id_col, text_col):
            return F.col(id_col) if c == id_col else text.alias(c)
        own = F.col(f"_c{others.index(c)}")
        return (F.when(F.col("n_removed") > 0, F.length(text)).otherwise(own).cast(dict(docs.dtypes)[c]) if c == "n_chars" else own).alias(c)

    return out.select(*map(column, docs.columns))
