"""An exchange between packs of documents and buckets of keys.

Several operators ask the whole corpus about many small keys (how often does this shingle occur, does
an earlier document hold this string).  One row for each key would cost many times the text.  Here
documents are dealt to packs of a few megabytes by a hash of their id; a pack merges its own equal keys
and sends each bucket of keys one compressed blob; the bucket answers each pack in one blob; and the
pack, read again from the same shuffle, goes on with the answers.

A key as frequent as a third of all rows reaches its bucket once for each pack, not once for each row,
so buckets stay even.  Memory is that of one pack, or one bucket, for each task.  By default a pack has
LEAST_PACK bytes, or more where a blob would else have fewer than BLOB: with p bytes in a pack and three
times as many in a bucket, a blob has about 3 * p * p / total, so packs grow with the root of the input
(6 MB for 30 GB, 40 MB for 1 TB, 370 MB for 100 TB, with executors to match).  A document larger than a
pack makes a pack of its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PACK, BLOB = 4 << 20, 4 << 10

#: (bucket, blob) for each bucket that a pack asks, from its rows and the answers of the step before
Send = Callable[[pa.Table, dict[int, bytes], int], Iterator[tuple[int, bytes]]]
#: answers by pack for what the packs sent to one bucket
Reduce = Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]
#: rows for a pack and its answers by bucket
Finish = Callable[[pa.Table, dict[int, bytes], int], Iterator[pa.RecordBatch] | pa.Table]


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one column is read, one number comes back."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def pack_size(total: int) -> int:
    return max(LEAST_PACK, math.isqrt(total * BLOB // 3))


def packs(total: int, pack_bytes: int | None = None) -> int:
    return max(1, -(-total // (pack_bytes or pack_size(total))))


def in_packs(docs: DataFrame, n_packs: int) -> DataFrame:
    """docs with the pack that each row is dealt to."""
    return docs.select(F.pmod(F.xxhash64("id", F.length("text")), F.lit(n_packs)).cast("int").alias("pack"), *docs.columns)


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a pack in one order however the shuffle delivered them, so that answers fit."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def exchange(docs: DataFrame, steps: list[tuple[Send, Reduce]], finish: Finish, schema: str, sent_share: float, pack_bytes: int | None = None, bucket_bytes: int | None = None, total: int | None = None) -> DataFrame:
    """docs: columns id and text. steps: questions and answers, each step knowing the last one's answers.

    sent_share: bytes that a step sends for each byte of text, for the number of buckets. pack_bytes and
    bucket_bytes: bytes of text in a pack and bytes sent to a bucket. total: bytes of all texts, if they are
    known. A pack's rows come with their column pack.
    """
    total = text_bytes(docs, "text") if total is None else total
    n_packs = packs(total, pack_bytes)
    bucket_bytes = bucket_bytes or 3 * (pack_bytes or pack_size(total))
    n_buckets = max(1, int(total * sent_share) // bucket_bytes + 1)
    packed = in_packs(docs, n_packs)

    def by_bucket(table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True))

    def asks(send: Send, replies: DataFrame | None) -> DataFrame:
        def ask(key: tuple, table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
            rows = [(b, blob) for b, blob in send(in_order(table), answers, n_buckets) if blob] if table.num_rows else []
            return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "pack": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        kind = "bucket int, pack int, blob binary"
        if replies is None:
            return packed.groupBy("pack").applyInArrow(lambda key, table: ask(key, table, {}), kind)
        return packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(lambda key, left, right: ask(key, left, by_bucket(right)), kind)

    def answers(sent: DataFrame, reduce: Reduce) -> DataFrame:
        def answer(key: tuple, table: pa.Table) -> pa.Table:
            came = sorted(zip(table["pack"].to_pylist(), table["blob"].to_pylist(), strict=True))
            rows = [(p, blob) for p, blob in reduce(came) if blob]
            return pa.table({"pack": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        return sent.groupBy("bucket").applyInArrow(answer, "pack int, bucket int, blob binary")

    replies = None
    for send, reduce in steps:
        replies = answers(asks(send, replies), reduce)
    return packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(lambda key, left, right: finish(in_order(left), by_bucket(right), n_buckets), schema)
