"""N-gram Jaccard join (operator 6).

A document is the set of its distinct word shingles.  Shingles are ordered rarest first by their exact
number of sets in the corpus; two sets as similar as asked share a shingle among their first few
(the prefix), so only sets that meet in a prefix shingle are candidates.  Length, positional and suffix
filters (the last from counts of shingles by hash class, which bound the overlap from above) cut
candidates before each remaining pair is verified once on the shingles themselves.

Equal sets are one class; links and components are those of classes, and every document of a class has
its class's component.  In each list of sets that share a prefix shingle, the sets of one length band are
first verified against the band's first set.  What these links already join needs no more pairs.  Of the
pairs of a list between different components a small share, drawn by hash, is verified next, then more,
and at last all that are left, so no link that matters for a component is lost and a large group of near
copies does not give all its pairs.

Cases: null or empty texts and texts without words have no shingle and link with nothing; fewer words
than a shingle has count as one shingle; repeated rows and copies fall into one class; rows with a null
id link with nothing and are their own component (null); other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import LOWER, U64, flat, mix, pack_counts, ranges, shingles, span_hashes, squeeze, totals, unsqueeze, word_spans
from palimpsest.llm.exchange import exchange, packs, text_bytes
from palimpsest.llm.shared import components, saved

#: Bits of a shingle's hash by which it is counted; a collision can only make a shingle seem less rare.
KEY_BITS = 46
#: Hash classes of the suffix filter, and a count that stands for any number.
SKETCH, FULL = 512, 255
#: Of a list's pairs between components, one in 512 is verified first, then 16 in 512, then all others;
#: lists of up to SMALL sets are verified at once.
LEVELS, SMALL = (1, 16, 512), 16
#: Members of a list that one task compares with a set.
BLOCK = 512


def shingle_sets(table: pa.Table, words_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in the order of (document, hash), their documents' bounds, set sizes and classes."""
    data, at = flat(table["text"])
    data = LOWER[data]
    starts, ends, first = word_spans(data, at)
    h, doc = shingles(span_hashes(data, starts, ends), first, words_each)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    bounds = np.searchsorted(doc, np.arange(len(at)))
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h), dtype=U64)])
        cls = mix((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(U64))
    return h, bounds, n, cls


def link_sets(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> tuple[DataFrame, DataFrame, int]:
    """(members, links, tasks): members has id, n_shingles and class for each row; links has the verified pairs (a, b) of classes; tasks is the number of packs, beyond which no table is saved in parts. sizes: pack_bytes and bucket_bytes of the exchange."""

    def owners(cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first document of each class in a pack that has a shingle."""
        where = np.flatnonzero(n > 0)
        return np.sort(where[np.unique(cls[where], return_index=True)[1]])

    def keyed(table: pa.Table) -> tuple:
        h, bounds, n, cls = shingle_sets(table, words_each)
        own = owners(cls, n)
        inside = np.zeros(len(h) + 1, np.int8)
        np.add.at(inside, bounds[own], 1)
        np.add.at(inside, bounds[own + 1], -1)
        keys, inverse, counts = np.unique(h[np.cumsum(inside[:-1], dtype=np.int64) > 0] >> U64(64 - KEY_BITS), return_inverse=True, return_counts=True)
        return h, bounds, n, cls, own, keys, inverse, counts

    def send(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
        *_, keys, _, counts = keyed(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        for b in range(n_buckets):
            if cut[b + 1] > cut[b]:
                yield b, pack_counts(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]])

    def reduce(came: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        for pack, total in totals(came):
            yield pack, squeeze(total.clip(max=2**32 - 1).astype("<u4"))

    def finish(table: pa.Table, replies: dict[int, bytes], n_buckets: int) -> pa.Table:
        h, bounds, n, cls, own, keys, inverse, _ = keyed(table)
        cut = ranges(keys, KEY_BITS, n_buckets)
        total = np.ones(len(keys), np.uint32)
        for b, blob in replies.items():
            total[cut[b] : cut[b + 1]] = unsqueeze(blob, "<u4")[0]
        toks: list[bytes | None] = [None] * len(n)
        alone = np.zeros(len(n), np.int64)
        at = 0
        for d in own:
            own_h = h[bounds[d] : bounds[d + 1]]
            df = total[inverse[at : at + len(own_h)]]
            at += len(own_h)
            shared = df > 1
            alone[d] = len(own_h) - shared.sum()
            if alone[d] < prefix(int(n[d])):
                x, f = own_h[shared], df[shared]
                toks[d] = x[np.lexsort((x, f))].tobytes()
        return pa.table({"id": table["id"], "n": n, "cls": cls.view(np.int64), "alone": alone, "toks": pa.array(toks, pa.binary())})

    def prefix(n: int) -> int:
        return n - (percent * n + 99) // 100 + 1

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = text_bytes(rows, "text")
    tasks = packs(total, sizes.get("pack_bytes"))
    sets = saved(exchange(rows, [(send, reduce)], finish, f"id {kind}, n long, cls long, alone long, toks binary", 0.7, total=total, **sizes), tasks)
    # The sets that others may resemble, once each, with what the filters need.
    classes = sets.where("toks IS NOT NULL AND id IS NOT NULL").dropDuplicates(["cls"]).select("cls", "n", "alone", "toks")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, who, size, pos = [], [], [], []
            for c, n, alone, toks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(toks, "<i8")[: prefix(n) - alone]
                tok.append(x)
                who.append(np.full(len(x), c, np.int64))
                size.append(np.full(len(x), n, np.int64))
                pos.append(alone + np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (tok, who, size, pos)], names=["tok", "cls", "n", "pos"])

    entries = classes.mapInArrow(listed, "tok long, cls long, n long, pos long")
    counts = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = saved(entries.join(counts, "tok").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))), tasks)

    # smallest overlap o with 100 o >= percent (n + m - o), for pairs with the shared shingle at pos and pos2
    needed = f"ceil({percent} * (n + n2) / {100 + percent})"
    possible = F.expr(f"least(n, n2) * 100 >= greatest(n, n2) * {percent} AND least(n - pos, n2 - pos2) >= {needed}")
    pair = [F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")]
    hubs = entries.groupBy("tok", "band").agg(F.min(F.struct("n", "cls", "pos")).alias("hub"))
    near = entries.join(hubs, ["tok", "band"]).select("*", F.col("hub.n").alias("n2"), F.col("hub.cls").alias("cls2"), F.col("hub.pos").alias("pos2"))
    first = saved(near.where("cls <> cls2").where(possible).select(*pair).distinct(), tasks)
    sketches = saved(classes.select("cls", "n", "toks").mapInArrow(sketched, "cls long, n long, sketch binary"), tasks)
    links = verified(saved(sifted(first, sketches, percent), tasks), classes, percent, tasks)

    # Later rounds: pairs of a list whose sets are in different components, a growing share of them at a time.
    for level in range(len(LEVELS)):
        placed = entries.join(components(links, tasks).select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        parts = placed.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = parts.groupBy("tok").agg(F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("tok", F.col("main.comp").alias("main"))
        mixed = saved(placed.join(main, "tok").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).select("tok", "cls", "n", "pos", "m", "comp", "main", "blocks"), tasks)
        n_mixed = mixed.count()
        if not n_mixed:  # every list lies within one component: no pair is left
            break
        # A set outside the list's main component is compared with every block of the list.
        members = mixed.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("probe", F.lit(False))
        probes = mixed.where("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
        columns = ["tok", "block", "probe", "cls", "n", "pos", "m", "comp"]
        both = members.select(columns).union(probes.select(columns)).join(sketches.select("cls", "sketch"), "cls")
        n_tasks = n_mixed // 20_000 + 1
        pairs = both.groupBy(F.pmod(F.xxhash64("tok", "block"), F.lit(n_tasks)).alias("task")).applyInArrow(crossing(percent, level), "a long, b long")
        links = saved(links.union(verified(saved(pairs.distinct(), tasks), classes, percent, tasks)), tasks)
    return members_of(sets), links, tasks


def members_of(sets: DataFrame) -> DataFrame:
    return sets.select("id", F.col("n").alias("n_shingles"), F.col("cls").alias("class"))


def most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets from rows of their sketches; a full sketch bounds nothing."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    return np.where((x[:, 0] == FULL) & (y[:, 0] == FULL), np.iinfo(np.int64).max >> 8, most)


def similar_enough(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (percent + 100) * shared.astype(np.float64) >= percent * (n + m).astype(np.float64)


def crossing(percent: int, level: int):
    """The pairs of a list's different components that pass the length, positional and suffix filters and belong to this level."""

    def of_tasks(key: tuple, table: pa.Table) -> pa.Table:
        tok, block, probe = (table[c].to_numpy() for c in ("tok", "block", "probe"))
        order = np.lexsort((probe, block, tok))
        cls, n, pos, m, comp = (table[c].to_numpy()[order] for c in ("cls", "n", "pos", "m", "comp"))
        tok, block, probe = tok[order], block[order], probe[order]
        sketch = np.frombuffer(b"".join(table["sketch"].take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, SKETCH)
        cuts = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (block[1:] != block[:-1])))
        found = []
        for lo, hi in zip(cuts, [*cuts[1:], len(tok)], strict=True):
            split = lo + int(np.searchsorted(probe[lo:hi], True))
            for p in range(split, hi):
                q = np.arange(lo, split)
                q = q[(comp[q] != comp[p]) & (np.minimum(n[q], n[p]) * 100 >= np.maximum(n[q], n[p]) * percent)]
                needed = -(-percent * (n[q] + n[p]) // (100 + percent))
                q = q[np.minimum(n[q] - pos[q], n[p] - pos[p]) >= needed]
                a, b = np.minimum(cls[q], cls[p]), np.maximum(cls[q], cls[p])
                with np.errstate(over="ignore"):
                    draw = mix(a.view(U64) ^ mix(b.view(U64))) % U64(LEVELS[-1])
                mine = (np.searchsorted(LEVELS, draw, "right") if m[p] > SMALL else np.zeros(len(q), int)) == level
                q, a, b = q[mine], a[mine], b[mine]
                for k in range(0, len(q), 4096):
                    ok = similar_enough(most_shared(sketch[q[k : k + 4096]], sketch[p : p + 1]), n[q[k : k + 4096]], n[p], percent)
                    found.append(np.stack([a[k : k + 4096][ok], b[k : k + 4096][ok]]))
        pairs = np.unique(np.hstack(found), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return of_tasks


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a set fall into each hash class; those that no other set has are left out."""
    for batch in batches:
        out = []
        for x in batch.column(2).to_pylist():
            counts = np.bincount((np.frombuffer(x, "<u8") % U64(SKETCH)).astype(np.int64), minlength=SKETCH)
            out.append((counts if counts.max() < FULL else np.full(SKETCH, FULL)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["cls", "n", "sketch"])


def sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
            ok = similar_enough(most_shared(x, y), n, m, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    joined = pairs.join(side(sketches, "a", "n", "sketch"), "a").join(side(sketches, "b", "n", "sketch"), "b")
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(passing, "a long, b long")


def side(df: DataFrame, c: str, *more: str) -> DataFrame:
    return df.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))


def verified(pairs: DataFrame, classes: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """The pairs whose shingles are similar enough. tasks: see saved."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_pylist() for i in range(4))
            ok = []
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (4, 5))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (n[i] + m[i] - same))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, o in zip(x, ok, strict=True) if o], pa.int64()) for x in (a, b)], names=["a", "b"])

    both = pairs.join(side(classes, "a", "n", "toks"), "a").join(side(classes, "b", "n", "toks"), "b")
    return saved(both.select("a", "b", "n_a", "n_b", "toks_a", "toks_b").mapInArrow(checked, "a long, b long"), tasks)


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Returns id_col, n_shingles, component_id: the least id reachable by links and equal sets, itself included."""
    members, links, tasks = link_sets(docs, words_each, percent, id_col, text_col, **sizes)
    joined = components(links, tasks).select(F.col("node").alias("class"), "component")
    # A document without shingles and a row without an id stand alone.
    placed = members.join(joined, "class", "left").withColumn("part", F.when(F.col("n_shingles") > 0, F.coalesce("component", "class")))
    least = placed.where("part IS NOT NULL AND id IS NOT NULL").groupBy("part").agg(F.min("id").alias("least"))
    return placed.join(least, "part", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows of docs whose id is the least of its component; of repeated rows of one id all stay, as do null ids."""
    found = near_duplicates(docs, words_each, percent, id_col, text_col, **sizes)
    later = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(later, id_col, "left_anti")
