"""SentencePiece ids, the trie of conversations and the audit of filters, against the library and plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from rookery.llm import filter_audit, pieces, prefix_trie, queries
from tests.llm import brute
from tests.llm.test_operators import EDGE, edge, none  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return pieces.PieceEncoder(f.read())


def test_pieces_round_trip(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_piece_round_trip(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want


ODD = [" ", "  ", "a ", "a  ", " a", "▁", "▁▁ ▁x", "a▁", "x\0y", "\n\t", "中文没有空格的文本" * 30, "x" * 3000, " " * 200, "é😀​", "</s> <unk> <0x41>", "of the of the " * 400]


def test_pieces_edges(spark, edge, none, library):  # noqa: F811
    texts = dict(EDGE) | {100 + i: t for i, t in enumerate(ODD)}
    df = edge.select("doc_id", "text", F.lit("y").alias("ids"), F.lit(1).alias("decoded")).union(spark.createDataFrame([(100 + i, t, "y", 1) for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string, decoded int"))
    for end in (None, 2):
        rows = pieces.encode_pieces(df, MODEL, end_id=end, decode=True).collect()
        assert len(rows) == len(EDGE) + 1 + len(ODD)
        for r in rows:
            ids = library.encode(texts.get(r.doc_id) or "") + ([] if end is None else [end])
            assert r.ids == ids and r.decoded == library.decode(ids), r.doc_id
    assert pieces.encode_pieces(none, MODEL).count() == 0
    lists = spark.createDataFrame([(1, [1, 6312, 2]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode_pieces(lists, MODEL).collect()} == {1: "hell", 2: "", 3: None}


def test_both_agendas_agree_with_the_library(encoder, library):
    """Words up to the length at which each has a heap of its own, and beyond; with forgetting in between."""
    rng = random.Random(5)
    letters = "etaoinshrdlu" * 3 + "EQZéßяж中😀̀"
    made = [" " + "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 5, 9, 30, 47, 48, 49, 120)))) for _ in range(3000)]
    for w, ids in zip(made, encoder.word_ids(made), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(w[1:]), w
        symbols = encoder.merged(w.replace(" ", pieces.SPACE))
        assert "".join(symbols) == w.replace(" ", pieces.SPACE)


def test_words_are_remembered_up_to_a_bound(encoder, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "WORDS", 20)
    for lo in range(0, 200, 10):
        texts = [f"word{i} again{i % 7}" for i in range(lo, lo + 10)]
        flat, n = encoder.texts(pa.array(texts, pa.large_string()), True)
        assert flat.tolist() == [x for t in texts for x in library.encode(t)]
        assert len(encoder.known) <= 20 + 20


def test_wrong_ids_and_other_models_are_refused(spark, none, tmp_path):  # noqa: F811
    import pyarrow as pa

    with open(MODEL, "rb") as f:
        raw = f.read()
    wrong = pieces.PieceEncoder(raw)
    wrong.pair_rank[:-1] = wrong.pair_rank[:-1].max() - wrong.pair_rank[:-1]
    with pytest.raises(RuntimeError, match="encodes words otherwise"):
        wrong.texts(pa.array(["something entirely ordinary"], pa.large_string()), True)

    def change(fn):
        m = sentencepiece_model_pb2.ModelProto.FromString(raw)
        fn(m)
        path = tmp_path / "other.model"
        path.write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            pieces.encode_pieces(none, str(path))

    change(lambda m: setattr(m.trainer_spec, "model_type", 1))
    change(lambda m: setattr(m.trainer_spec, "byte_fallback", False))
    change(lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True))
    change(lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False))
    change(lambda m: setattr(m.pieces[500], "type", 4))
    change(lambda m: setattr(m.pieces[500], "piece", "a▁b"))


TRIE = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r[c] for c in TRIE) for r in rows}
    assert len(out) == len(rows)
    return out


def test_prefix_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op12_prefix_trie(spark, sf)) == brute.prefix_trie(rows)


def conversations():
    """Long and short conversations with shared heads, turns without number, role or text, repeated rows and rows without conv_id."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 240), -7, -100, -150, 1 << 40]:
        n = rng.choice((1, 2, 3, 5, 8, 9, 16, 17, 33))
        rows += [(c, k if k % 5 else None, rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", "", None, "é" * 9))) for k in range(n)]
    rows += [(300, k, "user", f"turn {k % 11}") for k in range(150)] + [(301, k, "user", f"turn {k % 11}") for k in range(150)] + [(302, k, "user", f"turn {k % 11}") for k in range(149)]
    return rows + [(400, 1, "user", "same")] * 20 + [(None, 1, "user", "lost")] * 3


def test_trie_of_long_conversations_ties_and_nulls(spark, monkeypatch):
    """Ranges, stretches and pieces are made so small that conversations go over many of each."""
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", 60)
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 1)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, pos int, block string").repartition(5)
    assert nodes(prefix_trie.prefix_trie(df)) == brute.prefix_trie(rows)


def test_trie_with_the_given_bounds(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert nodes(prefix_trie.prefix_trie(df)) == brute.prefix_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_ends_of_many_members_are_hashed_in_order(spark):
    df = spark.range(30_000).select((F.col("id") * 7 - 50_000).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = nodes(prefix_trie.prefix_trie(df.repartition(7)))
    assert got == brute.prefix_trie([(i * 7 - 50_000, 1, "user", "hi") for i in range(30_000)])


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in df.collect()}


def test_filter_audit(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = audit(queries.op13_filter_audit(spark, sf))
    assert got == brute.filter_interactions(docs, labels) and len(got) == 600 * len({d[2] for d in docs})


def test_filter_audit_edges(spark, edge, none):  # noqa: F811
    long = " ".join(f"w{i}" for i in range(250))
    more = [(20, long, "en"), (21, long, "de"), (21, long, "de"), (21, long, None), (22, long, "en"), (None, long, "en"), (None, long, "fr"), (30, "|" + long, "fr"), (31, "A" * 20 + long, ""), (32, "same " * 300, "en"), (None, "only here", "fr")]
    docs = [(i, t, None) for i, t in EDGE] + [(None, None, None)] + more
    df = edge.select("doc_id", "text", "lang", "shard", F.lit(1).alias("mask")).union(spark.createDataFrame([(*r, 1, 1) for r in more], "doc_id bigint, text string, lang string, shard int, mask int"))
    given = [(20, 1, 0), (21, 0, 1), (21, 1, None), (22, None, None), (None, 1, 1), (9, 1, 1), (13, None, 1)]
    labels = spark.createDataFrame([(*r, 1) for r in given], "doc_id bigint, quality int, toxic int, n int")
    want = brute.filter_interactions(docs, given)
    assert audit(filter_audit.filter_interactions(df, labels)) == want
    assert audit(filter_audit.filter_interactions(df.repartition(6), labels, shard_bytes=300)) == want
    assert filter_audit.filter_interactions(none, labels).count() == 0
    assert audit(filter_audit.filter_interactions(df, labels.limit(0))) == brute.filter_interactions(docs, [])


def test_matrix_counts_words(spark, edge):  # noqa: F811
    """Each word of the table has one term, and a document's entries are its words with their numbers."""
    shards, dictionary = filter_audit.document_term_matrix(edge.repartition(3), shard_bytes=500)
    words = {r.term: r.word for r in dictionary.collect()}
    want = Counter(t or "" for _, t in [*EDGE, (None, None)])
    assert sorted(words.values()) == sorted({w for t in want for w in brute.words(t)})
    got = []
    for s in shards.collect():
        for row, a, b in zip(s.rows, s.first, s.first[1:], strict=False):
            assert s.terms[a:b] == sorted(s.terms[a:b])
            got.append((bytes(row.digest), frozenset((words[t], n) for t, n in zip(s.terms[a:b], s.counts[a:b], strict=True))))
    assert Counter(got) == Counter({(hashlib.sha256(t.encode()).digest(), frozenset(Counter(brute.words(t)).items())): n for t, n in want.items()})
    assert shards.count() > 1
