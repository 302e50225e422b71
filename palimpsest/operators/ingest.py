"""From text to rows: chunks, sentences, trees of headings, quality of chunkings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def chunk_sizes(target: int = 500, overlap: int = 100) -> tuple[int, int]:
    """Words of a chunk's window and of the step to the next one, for a target of estimated tokens."""
    fresh = next(n for n in range(1, target + 1) if ceil((n + overlap) * 1.3) >= target)
    return fresh + overlap, fresh


def chunk_plain(episodes: DataFrame, target: int = 500, overlap: int = 100) -> DataFrame:
    """Overlapping windows of words of plain texts (id, content): episode_id, chunk_no, text, n_words.

    A window starts at each step while it would hold words that the one before it did not.
    """
    window, step = chunk_sizes(target, overlap)
    w = episodes.select(F.col("id").alias("episode_id"), T.words(F.col("content")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - F.lit(overlap)) / F.lit(step)).cast("int") - 1)
    rows = w.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).withColumn("_c", F.slice("w", F.col("chunk_no") * step + 1, F.lit(window)))
    return rows.select("episode_id", "chunk_no", F.array_join("_c", " ").alias("text"), F.size("_c").alias("n_words"))


def chunk_markdown(episodes: DataFrame, target: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks of marked-up texts with the path of headings they stand under; a heading ends a chunk's path, not the overlap."""
    window, step = chunk_sizes(target, overlap)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for episode, content in zip(pdf["id"], pdf["content"], strict=True):
                path: list[tuple[int, str]] = []
                words: list[str] = []
                fresh = no = 0
                at_start: list[str] = []
                for line in (content or "").split("\n"):
                    if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
                        path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2])]
                        if not fresh:
                            at_start = [t for _, t in path]
                        continue
                    for x in line.split():
                        if not fresh:
                            at_start = [t for _, t in path]
                        words.append(x)
                        fresh += 1
                        if ceil(len(words) * 1.3) >= target:
                            rows.append((episode, no, " ".join(words), len(words), at_start))
                            no, words, fresh = no + 1, words[-overlap:], 0
                if fresh:
                    rows.append((episode, no, " ".join(words), len(words), at_start))
            yield pd.DataFrame(rows, columns=["episode_id", "chunk_no", "text", "n_words", "heading_path"])

    kind = dict(episodes.dtypes)["id"]
    return episodes.select("id", "content").mapInPandas(run, f"episode_id {kind}, chunk_no int, text string, n_words int, heading_path array<string>")


#: Words after which a full stop does not end a sentence, and the bytes below which a fragment joins a neighbour.
ABBREVIATIONS = frozenset({
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "rev", "gen", "sgt", "cpl", "pvt", "st", "dept", "approx", "inc", "corp", "ltd", "co", "vs", "etc", "i.e", "e.g", "fig", "no", "vol", "pp",
    "para", "avg", "max", "min", "est", "gov", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
})
LEAST_FRAGMENT = 12


def paragraphs_of(text: str) -> list[str]:
    """Paragraphs and list items of a marked-up text, each on one line; headings are left out."""
    out: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        if not line.strip() or re.match(r" {0,3}#{1,6}(\s|$)", line):
            out.append([])
        elif item := re.match(r"\s*(?:[-*+]|\d{1,9}[.)])\s+(.*)", line):
            out.append([item[1].strip()])
        else:
            out[-1].append(line.strip())
    return [" ".join(p) for p in out if p]


def sentences_of(text: str) -> list[str]:
    """Sentences of each paragraph: a full stop before a digit, after an abbreviation or an initial ends none; short fragments join the sentence before them, or else the one after."""
    out: list[str] = []
    for paragraph in paragraphs_of(text):
        cuts = [0]
        last = 0  # behind the mark before
        for m in re.finditer(r"[.!?]", paragraph):
            # no mark is part of a word, so the word before this one begins behind the last
            before, last = last, m.end()
            if m[0] == ".":
                word = word_before(paragraph, before, m.start())
                if paragraph[m.end() : m.end() + 1].isdigit() or word.lower() in ABBREVIATIONS or len(word) == 1 and word.isupper():
                    continue
            cuts.append(m.end())
        held: list[list[str]] = []  # each sentence's parts
        size = 0  # bytes of the first sentence, up to where it is long enough
        for a, b in zip(cuts, [*cuts[1:], len(paragraph)], strict=True):
            if part := paragraph[a:b].strip():
                if held and (len(part.encode()) < LEAST_FRAGMENT or len(held) == 1 and size < LEAST_FRAGMENT):
                    held[-1].append(part)
                    size += 1 + len(part.encode())
                else:
                    size = len(part.encode()) if not held else size
                    held.append([part])
        out += map(" ".join, held)
    return out


def word_before(text: str, begin: int, end: int) -> str:
    """The letters that stand before a place, blanks apart; nothing before begin is read."""
    while end > begin and text[end - 1].isspace():
        end -= 1
    at = end
    while at > begin and text[at - 1].isalnum() and not text[at - 1].isdecimal():
        at -= 1
    return text[at:end]


def first_sentence(text: Column) -> Column:
    """Up to the first closing punctuation that blanks or the end follow."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"^\s*([\s\S]*?[.!?]+)(?:\s|$)", 1)), F.lit("")), F.trim(text))


def sentences(episodes: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(sentences_of)

    return episodes.select(F.col("id").alias("episode_id"), F.posexplode(cut("content")).alias("sentence_no", "sentence"))


def size_compliance(chunks: DataFrame, low: float = 0.5, high: float = 1.2, target: int = 500) -> DataFrame:
    """The share of each episode's chunks whose estimated size lies within bounds of the target."""
    t = F.ceil(F.col("n_words") * F.lit(1.3))
    ok = t.between(int(target * low), int(target * high))
    return chunks.groupBy("episode_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(ok.cast("double")), 6).alias("size_compliance"))


#: Words at a chunk's beginning that point to what stands before it.
ONSET_PRONOUNS = ("he", "she", "they", "it", "this", "its", "their", "these", "those", "which", "who")


def size_score(n_words: Column, target: int = 500) -> Column:
    """How near a chunk's estimated tokens are to the target: 1 there, 0 from twice of it on."""
    t = F.ceil(n_words * F.lit(1.3))
    return F.greatest(F.lit(0.0), 1 - F.abs(t - F.lit(target)) / F.lit(float(target)))


def reference_score(text: Column, names: list[str] | None = None) -> Column:
    """0.3 for a chunk that begins with a pronoun, or if names are given with one of them; 1 otherwise."""
    if names is None:
        first = F.regexp_replace(F.lower(F.element_at(F.split(F.concat(F.trim(text), F.lit(" ")), r"\s+"), 1)), r"[^\p{L}]+$", "")
        return F.when(first.isin(*ONSET_PRONOUNS), 0.3).otherwise(1.0)
    severed = "|".join(re.escape(n) for n in names if n)
    return F.when(F.lit(bool(severed)) & text.rlike(rf"^\s*(?:{severed})(?![\p{{L}}\p{{N}}_])"), 0.3).otherwise(1.0)


def block_score(chunk: Column, content: Column) -> Column:
    """1 for a chunk that ends within two characters of a paragraph's end, 0.5 for one that does not, 0.75 for one not found as it is."""
    start = F.position(chunk, content)
    rest = F.substring(content, start + F.length(chunk), F.lit(2147483647))
    ends = (F.length(rest) <= 2) | rest.rlike(r"^[^\n]{0,2}\n[ \t]*(\n|$)") | F.right(F.concat(F.lit(" "), chunk), F.lit(4)).rlike(r"\n[ \t]*\n")
    return F.when((F.length(chunk) == 0) | (F.length(content) == 0), 1.0).when(start == 0, 0.75).when(ends, 1.0).otherwise(0.5)


def cohesion(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """The mean cosine of all pairs of a group's vectors, mapped to 0 .. 1; 1 for a single vector.

    The pairs' cosines sum to half of what the squared length of the sum of unit vectors has beyond their number, so no pair is made.
    """
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select(by, F.transform(v, lambda x: F.when(length < 1e-12, 0.0).otherwise(x / length)).alias("_u"), (length >= 1e-12).cast("long").alias("_l"))
    size = unit.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_l").alias("_l"))
    sums = unit.select(by, F.posexplode("_u").alias("_i", "_x")).groupBy(by, "_i").agg(F.sum("_x").alias("_x")).groupBy(by).agg(F.sum(F.col("_x") * F.col("_x")).alias("_s"))
    n = F.col("_n").cast("double")
    mean = F.when(n <= 1, 1.0).otherwise((F.coalesce("_s", F.lit(0.0)) - F.col("_l")) / (n * (n - 1)))
    return size.join(sums, by, "left").select(by, F.round(F.when(n <= 1, 1.0).otherwise((mean + 1) / 2), 6).alias("cohesion"))


def contrast(vectors: DataFrame, by: str, order: str, vector: str = "embedding") -> DataFrame:
    """How sharply a group's neighbouring chunks differ: the mean of 1 less their cosine, held within 0 .. 1; 1 for a single chunk."""
    w = Window.partitionBy(by).orderBy(order)
    rows = vectors.withColumn("_p", F.lag(vector).over(w))
    sharp = F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cosine(F.col("_p"), F.col(vector)))))
    return rows.groupBy(by).agg(F.round(F.coalesce(F.avg(sharp), F.lit(1.0)), 6).alias("contrast"))


def size_variant(episodes: DataFrame, factor: float = 2.0, target: int = 500, overlap: int = 100) -> DataFrame:
    """The plain chunking for a multiple of the target."""
    return chunk_plain(episodes, max(1, int(target * factor)), overlap)


def _estimate(text: str) -> int:
    return ceil(len(text.split()) * 1.3)


def split_merged(text: str, target: int = 500) -> list[str]:
    """Sentences, those over the target cut at words, joined up while they stay within the target."""
    pieces: list[str] = []
    for s in sentences_of(text):
        words, most = s.split(), max(1, int(target / 1.3))
        pieces += [" ".join(words[i : i + most]) for i in range(0, len(words), most)] if _estimate(s) > target else [s]
    out: list[str] = []
    for p in pieces:
        if out and _estimate(f"{out[-1]} {p}") <= target:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


def at_breaks(sentences: list[str], embeddings: list, least: float = 0.5) -> list[str]:
    """Sentences joined up, a new chunk beginning where the cosine with the sentence before is below least."""
    import numpy as np

    out: list[str] = []
    for i, s in enumerate(sentences):
        if i and len(embeddings) >= len(sentences):
            a, b = (np.asarray(embeddings[k], float) for k in (i - 1, i))
            n = np.linalg.norm(a) * np.linalg.norm(b)
            near = len(a) == len(b) and n >= 1e-12 and a @ b / n >= least
        else:
            near = bool(i)
        out[-1:] = [f"{out[-1]} {s}"] if near else [*out[-1:], s]
    return out


def chunk_candidates(episodes: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, target: int = 500, overlap: int = 100) -> DataFrame:
    """All candidate chunkings of texts (id, content): episode_id, candidate, chunk_no, text, n_words.

    structural and size-variant are plain expressions; recursive and, with an embedder, semantic-breakpoint cut at sentences.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for episode, content in zip(pdf["id"], pdf["content"], strict=True):
                made = {"recursive": split_merged(content or "", target)}
                if embed is not None:
                    units = sentences_of(content or "")
                    made["semantic-breakpoint"] = at_breaks(units, embed(units) if units else [])
                rows += [(episode, name, no, t, len(t.split())) for name, texts in made.items() for no, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["episode_id", "candidate", "chunk_no", "text", "n_words"])

    kind = dict(episodes.dtypes)["id"]
    cut = episodes.select("id", "content").mapInPandas(run, f"episode_id {kind}, candidate string, chunk_no int, text string, n_words int")
    plain = lambda df, name: df.select("episode_id", F.lit(name).alias("candidate"), "chunk_no", "text", "n_words")
    return plain(chunk_plain(episodes, target, overlap), "structural").union(plain(size_variant(episodes, 2.0, target, overlap), "size-variant")).union(cut)


def candidate_scores(candidates: DataFrame, target: int = 500) -> DataFrame:
    """The means of each candidate's chunks: size and reference scores."""
    size, reference = size_score(F.col("n_words"), target), reference_score(F.col("text"))
    return candidates.groupBy("episode_id", "candidate").agg(F.avg(size).alias("size"), F.avg(reference).alias("reference"))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and vanishing vectors; held within -1 .. 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm < 1e-12), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def adjacent_coherence(vectors: DataFrame, by: str, order: str, vector: str = "embedding") -> DataFrame:
    """The mean cosine of neighbours in each group."""
    w = Window.partitionBy(by).orderBy(order)
    pairs = vectors.withColumn("_p", F.lag(vector).over(w)).where("_p IS NOT NULL")
    return pairs.groupBy(by).agg(F.round(F.avg(cosine(F.col("_p"), F.col(vector))), 6).alias("coherence"))


def bakeoff(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of each episode's candidate chunkings the one of greatest weighted score; the first on ties."""
    total = F.round(sum((F.col(c) * F.lit(float(x)) for c, x in weights.items()), F.lit(0.0)), 6)
    w = Window.partitionBy("episode_id").orderBy(F.desc("total"), "candidate_no")
    return scores.withColumn("total", total).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("episode_id", "candidate_no", "total")


def heading_parents(headings: DataFrame, by: str = "episode_id", order: str = "seq", level: str = "level", levels: int = 6) -> DataFrame:
    """Each heading's parent: the last one before it of a smaller level, of 1 .. levels.

    The last place of each level is a running maximum, so a heading costs the levels there are, whatever stands before it.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > n, F.max(F.when(F.col(level) == n, F.col(order))).over(before)) for n in range(1, levels)]
    return headings.withColumn("parent", F.greatest(*last))


def descendants_summary(chunks: DataFrame, by: str, order: str, most: int = 2048) -> DataFrame:
    """First sentences of a section's chunks, joined and cut to a number of bytes that are whole characters."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, first_sentence(F.col("text")).alias("s")))), lambda x: x["s"]), " ")
    text = F.when(F.trim(parts) == "", F.lit("[empty section]")).otherwise(parts)
    return chunks.groupBy(by).agg(T.byte_prefix(text, most).alias("summary"))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 32) -> DataFrame:
    """rows with an embedding of each text, made in batches; a failing batch is tried text by text."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].fillna("").tolist()
                try:
                    got = embed(some)
                    if len(got) != len(some):
                        raise ValueError("wrong number of embeddings")
                except Exception:  # noqa: BLE001 an embedder may fail in any way
                    got = [embed([t])[0] for t in some]
                out += got
            yield pd.Series(out)

    return rows.withColumn("embedding", run(text_col))


def stub_embed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Deterministic unit vectors from a text's hash: one of 256 centres and some jitter."""
    import hashlib

    import numpy as np

    out = []
    for t in texts:
        h = hashlib.sha256(t.encode()).digest()
        v = np.random.default_rng(h[0]).standard_normal(dim) + 0.15 * np.random.default_rng(list(h)).standard_normal(dim)
        out.append((v / np.linalg.norm(v)).astype("float32").tolist())
    return out
