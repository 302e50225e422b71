"""Edit-aware counts against a full recount, and BPE against the public library."""

import random

import pytest
import public_tokenizers
import tiktoken

from palimpsest.llm import byte_bpe, token_counts

BLOB, PATTERN = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(BLOB, PATTERN)


@pytest.fixture(scope="module")
def public(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(blob):
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


def test_encoding_equals_the_library(bpe, public):
    r = random.Random(0)
    tokens = list(bpe.token.values())
    texts = ["", " ", "'s 't", "a" * 5000, "éß日本 \U0001f600​\n\n  x", "<|endoftext|>"]
    texts += [b"".join(r.choice(tokens) for _ in range(r.randint(1, 30))).decode("utf-8", "ignore") for _ in range(1500)]
    for t in texts:
        assert ids(bpe.encode(t)) == public.encode_ordinary(t), repr(t)


def test_edits_equal_a_recount(bpe):
    r = random.Random(1)
    bits = ["word", " ", "  ", "\n", "'", "l", "ll", "'re", "12", ".", "!!", "été", "\t ", "s", "   \n  "]
    for case in range(400):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 5, 300, 2000])))
        chars, tokens = token_counts.leaves(bpe, text)
        tree = token_counts.PieceTree(bpe, text, chars.tolist(), tokens.tolist())
        for _ in range(r.randint(1, 6)):
            a = r.randint(0, len(text) + 2)
            b = a + r.choice([0, 0, 1, 3, 40, 10**6 if r.random() < 0.05 else 2])
            new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 30])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text
            assert tree.total == int(token_counts.leaves(bpe, text)[1].sum()), case
            assert tree.chars[1] == len(text)


def test_an_edit_re_encodes_little(bpe):
    text = "some ordinary words here " * 20000
    chars, tokens = token_counts.leaves(bpe, text)
    tree = token_counts.PieceTree(bpe, text, chars.tolist(), tokens.tolist())
    tree.edit(200_000, 200_003, "xyz")
    assert tree.reencoded <= 3 * token_counts.LEAF


def test_over_tables(spark, bpe):
    rows = [(1, "mail me at a.b@c.org now. " * 50), (2, None), (3, ""), (None, "x@y.zz"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_tokens")
    trees = token_counts.build_trees(df, BLOB, PATTERN)
    edited = token_counts.edits_by_rule(trees, [(r"[\w.]+@[\w.]+\w", "<EMAIL>")])
    for x in token_counts.apply_edits(edited, BLOB, PATTERN, with_text=True).collect():
        assert x.n_tokens_edited == len(bpe.encode(x.text)) // 4
        assert "@" not in x.text
    assert token_counts.apply_edits(edited, BLOB, PATTERN).count() == 5
    assert token_counts.build_trees(df.limit(0), BLOB, PATTERN).collect() == []


def test_round_trip_over_tables(spark, public):
    import hashlib

    rows = [(1, "héllo  wörld\n"), (2, None), (3, ""), (3, ""), (None, "\U0001f600" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS ids")
    got = byte_bpe.encode_documents(df, BLOB, PATTERN, with_ids=True)
    for x in got.collect():
        text = dict(rows)[x.doc_id] or ""
        assert ids(x.ids) == public.encode_ordinary(text) and x.n_tokens == len(x.ids) // 4
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and x.ids_sha256 == hashlib.sha256(x.ids).hexdigest()
    back = {x.doc_id: x.text for x in byte_bpe.decode_documents(got, BLOB, PATTERN).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_long_insertions_make_leaves_of_their_own():
    import random

    from palimpsest.llm import byte_bpe, token_counts
    from palimpsest.llm.queries import tokenizer

    bpe = byte_bpe.bpe_of(*tokenizer())
    r = random.Random(6)
    text = "a short text of a few words. " * 20
    tree = token_counts.PieceTree(bpe, text, *(x.tolist() for x in token_counts.leaves(bpe, text)))
    more = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(20_000))
    tree.edit(100, 120, more)
    want = text[:100] + more + text[120:]
    for _ in range(60):
        before = tree.reencoded
        at = r.randint(0, len(want))
        stop, new = min(len(want), at + r.choice([0, 0, 1, 5])), r.choice(["", "x", " ", "\n\n", "word ", "'s"])
        tree.edit(at, stop, new)
        want = want[:at] + new + want[stop:]
        assert tree.reencoded - before <= 6 * token_counts.LEAF
    assert tree.text == want and tree.total == sum(t.sum() for t in [token_counts.leaves(bpe, want)[1]])
    assert max(len(bpe.find(p)) for p in tree.parts) <= 2 * token_counts.LEAF + 2
