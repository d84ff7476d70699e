import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, packing, tokens
from lodestar.llm._common import shared_path

TEXTS = ["don't we're x'y it's, a'll", "_a_ b_c  d", "é² ²x àb", "<|endoftext|> hi", " x y z", "a\r\nb\tc", "日本 語 x", "Ⅷ x½ y", "I'M 'S", "", "a\n\nb", "x" * 5000, " " * 300, "word, word. (word)", "naïve café", "a\tb\td\n\n c", "hello <|endoftext|> world", "a\x1cb c", " a", "a ", "\na", "a\n", "a \nb c\td"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(tokens.BYTE_BPE))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def multi():
    return bpe.Vocabulary.load(tokens.vocabulary(bpe.MULTI_BPE))


def test_chunks_encode_as_the_whole(plain):
    enc = tokens.ChunkEncoder(tokens.vocabulary(tokens.BYTE_BPE))
    assert [np.frombuffer(d, "<u2").tolist() for d in enc.encode_all(TEXTS)] == [plain(t) for t in TEXTS]


def test_random_strings_encode_as_the_whole(plain):
    enc, r = tokens.ChunkEncoder(tokens.vocabulary(tokens.BYTE_BPE)), random.Random(7)
    parts = [*"ab é1'.,<|\u180e\u200b\x85\xa0\u2003\u3000\x1c\t\r日²", *" " * 8, *"\n\n\n", "<|endoftext|>", "word", " the", "'s", "ing"]
    for few in (parts, [" ", "\n", "a", "the", "b1", "é", ".", "'s", "<|endoftext|>"]):
        texts = ["".join(r.choice(few) for _ in range(r.randint(0, 25))) for _ in range(3000)]
        assert [np.frombuffer(d, "<u2").tolist() for d in enc.encode_all(texts)] == [plain(t) for t in texts]


def test_files_round_trip(spark, table, odd, plain):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS))]
    folder = shared_path(spark, "tokens")
    tokens.write_token_files(table(rows), folder, tokens.vocabulary(tokens.BYTE_BPE), end_id=2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(spark, folder).collect())
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    ids = [g[1] for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((str(i), len(t := plain(x) + [2]), zlib.crc32(np.array(t, "<u4").tobytes())) for i, x in rows)
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == want


def test_no_documents(spark, table):
    folder = shared_path(spark, "tokens")
    empty = table([(1, "x")]).limit(0)
    tokens.write_token_files(empty, folder, tokens.vocabulary(tokens.BYTE_BPE), end_id=2)
    assert tokens.read_token_files(spark, folder).count() == 0
    assert packing.best_fit_packing(empty).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    r = random.Random(5)
    for _ in range(60):
        lengths = np.array([r.randint(1, 100) for _ in range(r.randint(1, 80))])
        bins, offsets, count = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= count <= 1.3 * packing.lower_bound(lengths, 100) + 1
        assert np.bincount(bins, lengths).max() <= 100
    assert packing.lower_bound(np.array([60] * 7 + [40] * 3), 100) == 7
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)]


def test_packing_is_gapless(table, odd, plain, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 20)
    rows = [*odd, *((100 + i, "word " * (i * 37 % 900)) for i in range(90))]
    got = packing.best_fit_packing(table(rows), capacity=512).collect()
    assert sum(r.length for r in got) == sum(len(plain(t)) + 1 for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for g in by.values():
        at = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    bound = packing.lower_bound(np.array([r.length for r in got]), 512)
    assert bound <= len(by) <= bound + 6


def test_pieces_hold_the_ids_of_their_documents(spark, plain, tmp_path):
    import zlib as z

    rows = [(i, t, i, i) for i, t in enumerate([None, "", "hello <|endoftext|> world", "a\tb\td\n\n c", "word " * 700, "word " * 699, "the\n" * 3000])] + [(None, "a", 1, 1), (3, "b", 1, 1)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, offset int").write.parquet(path)
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packing.best_fit_packing(spark.read.parquet(path), capacity=512).collect())
    want = []
    for i, t, *_ in rows:
        ids = plain(t) + [0]
        first = (len(ids) - 1) % 512 + 1
        cuts = [0, *range(first, len(ids), 512), len(ids)]
        want += [(str(i), n, a, b - a, z.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)


def test_equal_ids_keep_their_order(spark, table):
    folder = shared_path(spark, "tokens")
    rows = table([(1, "a b"), (1, "a"), (None, "x y z"), (0, "q")], "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("id", F.lit(2)).coalesce(1)
    tokens.write_token_files(rows, folder, tokens.vocabulary(tokens.BYTE_BPE), end_id=2)
    got = tokens.read_token_files(spark, folder, rows=1).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] in ([(None, 4), (0, 2), (1, 3), (1, 2)], [(None, 4), (0, 2), (1, 2), (1, 3)])


def test_prefix_table_appends_and_edits(multi):
    r = random.Random(1)
    for _ in range(60):
        w = "".join(r.choice("abcdefé ñ01.,ing theß") for _ in range(r.randint(1, 80))).encode()
        t = bpe.PrefixTable(multi, w[:10])
        t.append(w[10:])
        assert t.last == bpe.PrefixTable(multi, w).last and b"".join(multi.bytes[i] for i in t.ids()) == w
        at = r.randint(0, len(w))
        gone = r.randint(0, len(w) - at)
        t.edit(at, gone, b"xyz")
        assert t.last == bpe.PrefixTable(multi, w[:at] + b"xyz" + w[at + gone :]).last


def test_an_edit_computes_only_its_surroundings(multi):
    w = b"the thing with the other thing " * 60
    t = bpe.PrefixTable(multi, w)
    assert t.edit(500, 1, b"q") <= 4 * multi.longest + 10
    assert t.last == bpe.PrefixTable(multi, w[:500] + b"q" + w[501:]).last


def test_encoding_equals_tiktoken(spark, table, odd):
    import public_tokenizers
    import tiktoken

    path = tokens.vocabulary(bpe.MULTI_BPE)
    ranks = bpe.Vocabulary.load(path).ranks
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = bpe.bpe_encode(table(rows), path, public_tokenizers.PATTERN).collect()
    want = [(i, k.encode_ordinary(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted((str(r.doc_id), r.ids, hashlib.md5(bytes(r.decoded)).hexdigest()) for r in got) == sorted((str(a), b, c) for a, b, c in want)
