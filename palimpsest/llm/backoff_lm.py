"""Stupid-backoff language-model scores (operator 5).

The corpus's n-grams of one to `order` words are counted in tables partitioned by the n-gram's hash; each
pack of documents joins its distinct n-grams with them, and the scores of its exploded n-grams are summed
for each document.  A word scores count(n-gram) / count(context) for the longest n-gram that the rest of
the corpus has, times `backoff` for each order given up; a word that the rest does not have counts as
seen once.  The document's own n-grams are left out of the counts, else no text would look unlikely.

The tables travel packed, a blob of sorted n-grams and counts for each pack and bucket, and are joined and summed
as arrays: a row for each n-gram and pack took twice the disk (the README has figures).

N-grams are known by 58-bit hashes: among 10**9 different ones a given one is mistaken for another with
a probability of 3 * 10**-9.

Cases: null or empty texts and texts without words have no words and a null score; equal documents count
each other; repeated rows of one id are separate documents; an empty table gives an empty result; the
input's other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import BASE, U64, flat, mix, pack_counts, ranges, span_hashes, squeeze, totals, unsqueeze, word_spans
from palimpsest.llm.exchange import exchange
from palimpsest.llm.shared import saved

KEY_BITS = 58


def score_documents(docs: DataFrame, order: int = 2, backoff: float = 0.4, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Returns id_col, n_words, log_score (natural logarithm of the product) and mean_log_score. sizes: pack_bytes and bucket_bytes of the exchange."""

    def grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(first word of each document, document of each word, hash of the k-gram that ends at each word, words before it)."""
        data, at = flat(table["text"])
        starts, ends, first = word_spans(data, at)
        words = span_hashes(data, starts, ends)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        before = np.arange(len(words)) - first[:-1][doc]
        out = [mix(words + U64(1))]
        with np.errstate(over="ignore"):
            for k in range(2, order + 1):
                prior = np.append(np.zeros(1, U64), out[-1][:-1]) if len(words) else out[-1]
                out.append(mix(prior * U64(BASE) + words + U64(k)))
        return first, doc, [h >> U64(64 - KEY_BITS) for h in out], before

    def keyed(table: pa.Table) -> tuple:
        first, doc, hashes, before = grams(table)
        used = [h[before >= k] for k, h in enumerate(hashes)]
        keys, inverse, counts = np.unique(np.concatenate(used), return_inverse=True, return_counts=True)
        return first, doc, before, keys, inverse, counts

    def send(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
        *_, keys, _, counts = keyed(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        for b in range(n_buckets):
            if cut[b + 1] > cut[b]:
                yield b, pack_counts(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]])

    def reduce(came: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        for pack, total in totals(came):
            yield pack, squeeze(total.astype("<i8"))

    def finish(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> pa.Table:
        first, doc, before, keys, inverse, _ = keyed(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        total = np.zeros(len(keys), np.int64)
        for b, blob in replies.items():
            total[cut[b] : cut[b + 1]] = unsqueeze(blob, "<i8")[0]
        best = np.zeros(len(doc))
        counts: list[np.ndarray] = []
        at = 0
        for k in range(order):
            where = np.flatnonzero(before >= k)
            at, i = at + len(where), inverse[at : at + len(where)]
            c = total[i]
            if leave_out:
                _, pair, own = np.unique(doc[where] * (len(keys) + 1) + i, return_inverse=True, return_counts=True)
                c = c - own[pair]
            count = np.zeros(len(doc), np.int64)
            count[where] = c
            counts.append(count)
            if k == 0:
                best = np.log(np.maximum(count, 1)) + np.minimum(before, order - 1) * np.log(backoff)
            else:
                seen = np.flatnonzero(count > 0)
                orders_given_up = np.minimum(before[seen], order - 1) - k
                best[seen] = np.log(count[seen]) - np.log(counts[k - 1][seen - 1]) + orders_given_up * np.log(backoff)
        longer = np.zeros(len(doc), bool)
        for c in counts[1:]:
            longer |= c > 0
        n = len(table)
        return pa.table({"id": table["id"], "n": np.diff(first), "part": np.bincount(doc, best, n), "single": np.bincount(doc, ~longer, n).astype(np.int64)})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # A pack's n-grams are mostly its own: about five bytes for each of `order` n-grams a word.
    parts = saved(exchange(rows, [(send, reduce)], finish, f"id {kind}, n long, part double, single long", 0.9 * order, **sizes))
    words = parts.agg(F.sum("n")).first()[0] or 0
    rest = F.greatest(F.lit(words) - F.when(F.lit(leave_out), F.col("n")).otherwise(0), F.lit(1))
    score = F.when(F.col("n") > 0, F.col("part") - F.col("single") * F.log(rest))
    return parts.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), score.alias("log_score"), (score / F.col("n")).alias("mean_log_score"))
