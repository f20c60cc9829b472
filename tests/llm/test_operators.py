"""Each query against plain Python over the small tables, and edge cases of each operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rookery.llm import bpe, components, embeddings, mixing, near_dup, pii, queries, quality, repeats, sharding, token_files, urls
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, id string, shard int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (6, "ONE Two three"),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y Z!"),
    (9, LONG), (10, LONG + " tail"), (11, "mail a.b@c.de_f@g.hi call +49 (30) 1234567 or 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256"),
    (12, "é ü 中文 <|endoftext|> x́ İstanbul ΣΑΣ"), (13, "same line\nsame line\n\n" * 5), (13, "same line\nsame line\n\n" * 5),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, very long and repeated texts, ties, a row of nulls, and extra columns whose names operators use inside."""
    rows = [(i, t, None, None if i % 3 == 0 else "s" * (i % 2 + 1), None, i, "x", i) for i, t in EDGE]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r[df.columns[0]]: tuple(r[c] for c in cols) for r in df.collect()}


def test_mixture_meets_targets(spark, sf):
    rows = queries.op1_mix_sources(spark, sf).collect()
    sizes = {r.doc_id: r.size for r in rows}
    assert sizes == {r.doc_id: len(brute.words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target = {}, {}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    words = {}
    for i, n in sizes.items():
        words[source[i]] = words.get(source[i], 0) + n
    assert target == pytest.approx(brute.source_targets(words)) and {r.doc_id: r.source_size for r in rows} == {i: words[source[i]] for i in sizes}
    assert {r.doc_id: r.taken for r in queries.op1_mix_sources(spark, sf).repartition(3).collect()} == {r.doc_id: r.taken for r in rows}


def test_targets_stop_at_three_times_the_source(spark):
    sized = spark.createDataFrame([(1, 1, "a", 1000), (2, 1, "b", 10), (3, 1, "c", 10), (4, 1, None, 980)], "id long, row long, source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got == {"a": pytest.approx(970), "b": 30, "c": 30, None: pytest.approx(970)}


def test_mixture_edges(edge, none):
    rows = mixing.mix_sources(edge).collect()
    assert len(rows) == len(EDGE) + 1 and all(r.copies * r.size + r.part <= 3 * r.size for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns
    # each row has its own copies: together they are those of the mix, repeated rows and ids included
    mixed, sized = mixing.mixed_documents(edge), mixing.pivotal_copies(mixing.sized_rows(edge), mixing.source_targets(mixing.sized_rows(edge)), split_last=False)
    assert mixed.count() == sum(r.copies for r in sized.collect())


def test_pivotal_tree_has_several_levels(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 17 as int)) text", "cast(id % 2 as string) source")
    rows = mixing.mix_sources(docs).collect()
    for s in ("0", "1"):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size + r.part for r in mine) - mine[0].target) <= 1


def test_token_files(spark, sf, docs, tmp_path):
    want = brute.encoded(docs, Tokenizer.from_file(PATH), 2)
    got = by_id(queries.op2_token_files(spark, sf), "start", "n_tokens", "ids_crc32")
    assert got == {k: v[:3] for k, v in want.items()}
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), path, PATH, shard_ids=5000)
    i, t = docs[7]
    assert token_files.read_document(spark, path, i) == Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids + [2]
    assert token_files.read_document(spark, path, -5) is None


def test_token_files_edges(spark, edge, none, tmp_path):
    token_files.write_token_files(none, str(tmp_path / "none"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
    token_files.write_token_files(edge, str(tmp_path / "edge"), PATH)
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "edge")).collect(), key=lambda r: r.start)
    assert len(rows) == len(EDGE) + 1 and rows[0].doc_id is None and rows[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.array([5], "<u4"), np.full(999, 7, "<u4"), np.tile(rng.integers(0, 50, 300), 40).astype("<u4"), rng.integers(0, 49_000, 5000).astype("<u4")):
        base, symbols, rules, lengths = token_files.compress(ids)
        assert (token_files.expand(symbols, base, rules) == ids).all()
        assert (token_files.unplanes(token_files.planes(symbols)) == symbols).all()
        for lo, hi in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 1), len(ids))):
            assert (token_files.expand_range(symbols, base, rules, lengths, lo, hi) == ids[lo:hi]).all()
    assert len(token_files.compress(np.tile(np.arange(100), 100).astype("<u4"))[1]) < 1000


def test_near_duplicates(spark, sf, docs):
    assert by_id(queries.op3_near_duplicates(spark, sf), "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)


def test_near_duplicates_edges(edge, none):
    got = by_id(near_dup.near_duplicates(edge, 4), "n_shingles", "component_id", "kept")
    want = brute.near_duplicates(dict(EDGE).items())
    assert {k: v for k, v in got.items() if k is not None} == want
    assert near_dup.near_duplicates(none).count() == 0
    assert got[None] == (0, None, True)
    kept = near_dup.without_near_duplicates(edge, 4)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(k for k, v in want.items() if v[2])


def test_near_duplicates_under_one_id_and_none(spark):
    """Different texts under one doc_id are judged each for itself, and rows without a doc_id link like others."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (None, b), (None, c), (None, c), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (0, 1, False), (0, None, True), (0, None, True), (5, 5, True), (5, 5, True)], key=str)
    kept = sorted(map(tuple, near_dup.without_near_duplicates(df, 4).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (5, None), (5, "")], key=str)


def test_near_copies_in_one_large_group(spark):
    """A group whose members link in chains only, larger than a block."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        t = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            t[k] = f"x{rng.integers(9)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(near_dup.near_duplicates(df, 4), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)


def test_personal_data(spark, sf, docs):
    got = by_id(queries.op4_personal_data(spark, sf), "n_email", "n_ip", "n_card", "n_phone", "spans", "base_sha256")
    for i, t in docs:
        s = brute.spans(t)
        assert got[i][:4] == tuple(sum(k == x[0] for x in s) for k in brute.PLAIN)
        base = [x for x in got[i][4].split(",") if x and not x.startswith("term:")]
        assert base == [f"{a}:{b}:{c}" for a, b, c in s]
        assert got[i][5] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_personal_data_edges(spark, edge, none):
    rows = [r for r in pii.find_personal_data(edge).collect() if r.doc_id == 11]
    assert [(s.kind, s.start, s.end) for s in rows[0].spans] == brute.spans(dict(EDGE)[11])
    assert pii.find_personal_data(none).count() == 0 and pii.find_personal_data(edge).count() == len(EDGE) + 1
    out = pii.redacted_documents(edge)
    assert out.columns == edge.columns and out.count() == len(EDGE) + 1
    text = next(r.text for r in out.collect() if r.doc_id == 11)
    assert text == "mail <EMAIL><EMAIL> call <PHONE> or <CARD> at <IP> not 10.0.0.256"
    odd = ["1" * 30_000, "a@" * 5000, "1.1.1.1.1.1.1.1", "+1+2+3456789012", "x" * 50_000 + "@", "4111-1111-1111-1111 4111 1111 1111 1112", "a@b.c.d-e..f", "😀 a@b.cd 😀 +123456789"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute.spans(odd[r.doc_id])


def test_revealing_terms(spark):
    """`zebra` stands beside one address in four different texts and nowhere else; `the` stands everywhere."""
    rows = [(i, f"note {i} the zebra writes from jo@ex.am with the letter {i * 7}") for i in range(4)]
    rows += [(i, f"the plain text number {i} from the author with the letter and a note") for i in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == "term"} for r in pii.find_personal_data(df).collect()}
    assert all(found[i] == {"zebra", "writes"} for i in range(4)) and not any(found[i] for i in range(4, 60))
    assert "<TERM> <TERM> from <EMAIL> with" in {r.doc_id: r.text for r in pii.redacted_documents(df).collect()}[0]


def test_revealing_terms_anywhere(spark):
    """A name on another line, a short one far away and a number, all of their occurrences, but not where the value is missing."""
    far = "plain words " * 20
    rows = [(i, f"Name: Quagga {i}x\nEmail: jo@ex.am\n{far}by Bo, plot 4711. QUAGGA quagga@ex.am-quagga {i}y") for i in range(4)]
    rows += [(i, f"name and email by {far} plot {i}x") for i in range(4, 300)]
    df = spark.createDataFrame([*rows, (300, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i in (0, 1, 2, 3, 300):
        text = got[i].text
        assert [text[s.start : s.end] for s in got[i].spans if s.kind == "term"] == ["Quagga", "Bo", "4711", "QUAGGA"]
    assert not any(got[i].spans for i in range(4, 300))
    out = {r.doc_id: r.text for r in pii.redacted_documents(df).collect()}
    assert out[1] == f"Name: <TERM> 1x\nEmail: <EMAIL>\n{far}by <TERM>, plot <TERM>. <TERM> <EMAIL> 1y"


def test_near_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert by_id(queries.op5_near_vectors(spark, sf), "n_links", "component_id", "kept") == brute.vectors(rows)


def crowd(n, seed, dim=16):
    """Vectors in groups of near copies about n / 5 centres, some pairs just above and some just below the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 5, dim))
    return [(i, (centres[i % len(centres)] + rng.choice((0.03, 0.12, 0.2)) * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "window"), [(700, 16), (3000, 64), (6000, 32)])
def test_near_vectors_recall(spark, n, window):
    """Real passes at every size, and no link lost or added against brute force."""
    vecs = crowd(n, n)
    passes, run_bits = embeddings.plan_passes(n, 0.95, 48, window, 1e-6)
    assert passes > 10 and run_bits > 4 and n > 20 * window
    want = brute.vectors(vecs)
    assert sum(w[0] for w in want.values()) > n / 2
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    assert by_id(embeddings.near_duplicate_vectors(df, window=window, stretch=256), "n_links", "component_id", "kept") == want


def test_near_vectors_edges(spark):
    vecs = crowd(400, 5)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [None] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    rows = vecs + odd + [(2008, vecs[0][1]), (2008, vecs[0][1])]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, n=1, rank=2) for i, v in rows], "vec_id long, embedding array<double>, n int, rank int")
    got = by_id(embeddings.near_duplicate_vectors(df, window=16, stretch=64), "n_links", "component_id", "kept")
    want = brute.vectors(vecs)
    same = {j for j in want if j and np.dot(vecs[0][1], vecs[j][1]) >= 0.95 * np.linalg.norm(vecs[0][1]) * np.linalg.norm(vecs[j][1])} | {0}
    assert all(got[i] == (want[i][0] + 2 * (i in same), *want[i][1:]) for i in want)  # 2008 stands twice
    assert all(got[i] == (0, i, True) for i in range(2000, 2006)) and got[2006] == (1, 2006, True) and got[2007] == (1, 2006, False)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0
    ends = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308]), (7, [-1e-200, 0.0])]
    wide = spark.createDataFrame(ends, "vec_id long, embedding array<double>")
    assert by_id(embeddings.near_duplicate_vectors(wide), "n_links", "component_id") == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (2, 1), 7: (0, 7)}
    # two different vectors under one id, and null ids
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [0.0, 1.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<double>")
    rows = embeddings.near_duplicate_vectors(twice).collect()
    assert len(rows) == 5 and {r.n_links for r in rows if r.vec_id is None} <= {0, 1, 2}


def test_near_vectors_in_large_groups(spark):
    """Every link of a group of different near copies far larger than all windows of all passes together, settled in many blocks."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    vecs = [(i, (centre + 0.1 * rng.standard_normal(16)).tolist()) for i in range(600)] + [(i, rng.standard_normal(16).tolist()) for i in range(600, 900)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    want = brute.vectors(vecs)
    assert max(w[0] for w in want.values()) > 400
    for window, stretch in ((4, 16), (8, 64), (100, 128)):
        assert embeddings.plan_passes(900, 0.95, 48, window, 1e-6)[0] > 8
        assert by_id(embeddings.near_duplicate_vectors(df, window=window, stretch=stretch), "n_links", "component_id", "kept") == want


def test_quality_rules(spark, sf, docs):
    got = by_id(queries.op6_quality_rules(spark, sf), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality_base(t) for i, t in docs}


def test_quality_verdicts_are_those_of_the_best_path(spark, sf, docs):
    """Each verdict from the fitted weights by a plain search for the best path over the document's lines."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    crf = quality.fit_line_crf(table, spark.read.parquet(f"{sf}/labels.parquet"))
    got = by_id(queries.op6_quality_rules(spark, sf), "base_failed", "kept")
    for i, t in docs:
        lines = (t or "").encode().split(b"\n")
        states = brute.best_states(quality.line_features(lines), crf.emit, crf.move)
        n = [len(line.split()) for line in lines]
        share = sum(a for a, s in zip(n, states, strict=True) if s) / sum(n) if sum(n) else 1.0
        assert got[i][1] == (not got[i][0] and share >= 0.5)


def test_quality_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, junk = [[r.kept for r in rows if r.quality == q] for q in (1, 0)]
    assert np.mean(good) >= 0.99 and np.mean(junk) <= 0.3


def test_quality_edges(edge, none, spark):
    rows = quality.quality_rules(edge).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted([(0, 0), *((i, len(brute.words(t))) for i, t in EDGE)])
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.accepted(edge, labels).columns == edge.columns


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    crf = quality.LineCrf(rng.standard_normal(15), rng.standard_normal((2, 2)))
    for n in (1, 2, 5, 8):
        f = rng.integers(0, 2, (n, 15)).astype(float)
        score = lambda s: sum(f[i] @ crf.emit * s[i] for i in range(n)) + sum(crf.move[s[i], s[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=score)
        assert crf.viterbi(f).tolist() == best
    assert crf.viterbi(np.zeros((0, 15))).tolist() == []


def test_crf_fit_raises_likelihood_gradient_to_zero():
    rng = np.random.default_rng(3)
    docs = []
    for n in (3, 7, 5, 6) * 10:
        y = (rng.random(n) < 0.5).astype(int)
        f = np.zeros((n, 15))
        f[:, 0] = 1
        f[:, 5] = (y == 0) & (rng.random(n) < 0.9)
        docs.append((f, y))
    crf = quality.LineCrf.fit(docs)
    assert np.mean([(crf.viterbi(f) == y).mean() for f, y in docs]) > 0.9


def test_url_rules(spark, sf):
    rows = {r.page_id: r for r in queries.op7_url_rules(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow") for r in rows.values())


def test_url_aliases(spark):
    canonical = lambda u: f'<html><link href="{u}" rel="canonical"></html>'
    pages = [
        (1, "https://a.org/x", canonical("https://b.org/y")), (2, "http://b.org/y#f", None), (3, "https://c.org/z", '<meta http-equiv="refresh" content="0; url=https://shop.net/fr/1">'),
        (4, "https://c.org/z?q=1", canonical("/z")), (5, "https://shop.net/fr/1", ""), (6, "https://www.example.com/en/1", canonical("https://c.org/z")),
        (7, "https://x.example.com/en/1", ""), (8, "HTTPS://EXAMPLE.COM/en", ""), (9, None, None), (10, "no scheme", canonical("https://c.org/z")), (10, "no scheme", None), (11, "https://d.net", ""), (12, "ftp://Fnet/es/1", ""),
    ]
    df = spark.createDataFrame([(*p, 1, "h") for p in pages], "page_id long, url string, html string, node int, host string")
    got = by_id(urls.url_verdicts(df), "host", "path", "rule", "verdict")
    assert got == {
        1: ("a.org", "/x", None, "allow"), 2: ("b.org", "/y", None, "allow"), 3: ("c.org", "/z", None, "block"), 4: ("c.org", "/z", None, "block"), 5: ("shop.net", "/fr/1", "net/fr/", "block"),
        6: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 7: ("x.example.com", "/en/1", "example.com/en/", "block"), 8: ("example.com", "/en", "com/", "allow"),
        9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("d.net", "", None, "allow"), 12: ("fnet", "/es/1", None, "allow"),
    }
    assert urls.url_verdicts(df.limit(0)).count() == 0
    extra = spark.createDataFrame([("https://a.org/x", "https://y.net/es/")], "from_url string, to_url string")
    assert by_id(urls.url_verdicts(df, redirects=extra), "verdict")[2] == ("block",)


def test_links_are_resolved(spark):
    """Relative references from a base with path and query, and character references."""
    base = "https://a.org/b/c/d;p?q#z"
    cases = {
        "g": "a.org/b/c/g", "./g": "a.org/b/c/g", "g/": "a.org/b/c/g/", "/g": "a.org/g", "//g": "g/", "?y": "a.org/b/c/d;p?y", "g?y": "a.org/b/c/g?y", "#s": "a.org/b/c/d;p?q",
        ".": "a.org/b/c/", "./": "a.org/b/c/", "..": "a.org/b/", "../": "a.org/b/", "../g": "a.org/b/g", "../..": "a.org/", "../../g": "a.org/g", "../../../g": "a.org/g",
        "/./g": "a.org/g", "/../g": "a.org/g", "g.": "a.org/b/c/g.", "..g": "a.org/b/c/..g", "./../g": "a.org/b/g", "g/./h": "a.org/b/c/g/h", "g/../h": "a.org/b/c/h",
        "?a=1&amp;b=2": "a.org/b/c/d;p?a=1&b=2", "http://X.org/&#x26;": "x.org/&", "mailto:x@y": None,
    }
    df = spark.createDataFrame([(k, base) for k in cases], "link string, url string")
    tag = F.concat(F.lit('<link rel="canonical" href="'), "link", F.lit('">'))
    got = {r.link: r.key for r in df.select("link", urls.alias_key(urls.absolute(urls.link_targets(tag)[0], F.col("url"))).alias("key")).collect()}
    assert got == cases


def test_repeated_passages(spark, sf, docs):
    assert by_id(queries.op8_repeated_passages(spark, sf), "n_words", "n_removed", "kept_sha256") == brute.repeats(docs)


def test_repeated_passages_edges(spark, edge, none):
    got = {(r.doc_id, r.n_words): r.n_removed for r in repeats.remove_repeats(edge).collect()}
    assert got[(10, 40_001)] == 40_000 and got[(9, 40_000)] == brute.repeats([(9, LONG)])[9][1] and got[(None, 0)] == 0
    assert repeats.remove_repeats(none).count() == 0
    rows = [(i, " ".join(["spam"] * 70 + [f"end{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(df, chunk_bytes=512).collect()} == {k: v[:2] for k, v in want.items()}


def test_repeated_passages_with_prefixes_of_both_lengths(spark, docs):
    """Groups so small that some prefixes (64) or all (1) are lengthened to the whole window, over many chunks."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: v[:2] for k, v in brute.repeats(docs).items()}
    for group in (64, 1):
        assert {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(df, chunk_bytes=100_000, group=group).collect()} == want


def test_repeats_of_rows_with_one_id(spark):
    """Different rows under one doc_id, and none: each is a document, reruns and partitions change nothing."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, f"{a} x"), (1, f"y {a}"), (1, b), (None, b), (None, f"{a} {b}"), (0, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, repeats.remove_repeats(d).collect()), key=str) for d in (df, df.orderBy("text"))]
    for got in found:
        assert len(got) == 6 and sum(r[2] for r in got) == 40 + 40 + 30 + 30
        assert all(r[2] == r[1] or r[2] >= 30 for r in got if r[0] is None)


def test_partitions_change_no_row(spark, tmp_path):
    """Twenty different texts under one doc_id share a passage, and a row stands many times: which keep it, and which come first, is the same."""
    shared = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"t{k} {shared}") for k in range(20)] + [(None, f"n{k} {shared}") for k in range(5)] + [(2, f"same {shared} here")] * 150 + [(3, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    passages, files = [], []
    for k in (1, 3, 7):
        passages.append(sorted(map(tuple, repeats.remove_repeats(df.repartition(k)).collect()), key=str))
        token_files.write_token_files(df.repartition(k), str(tmp_path / f"f{k}"), PATH)
        files.append(sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, str(tmp_path / f"f{k}")).collect()), key=lambda r: r[1]))
    assert passages[0] == passages[1] == passages[2] and files[0] == files[1] == files[2]
    assert len(passages[0]) == len(files[0]) == len(rows) and sum(r[2] == 0 for r in passages[0]) == 4


def test_bpe_round_trip(spark, sf, docs):
    want = brute.encoded(docs, Tokenizer.from_file(PATH))
    got = by_id(queries.op9_bpe_round_trip(spark, sf), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {k: (v[1], v[3], v[4]) for k, v in want.items()}


def test_bpe_edges(edge, none):
    tok = Tokenizer.from_file(PATH)
    rows = bpe.decode_documents(bpe.encode_documents(edge, PATH), PATH).collect()
    texts = dict(EDGE)
    assert len(rows) == len(EDGE) + 1
    for r in rows:
        ids = tok.encode(texts.get(r.doc_id) or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.decode_documents(bpe.encode_documents(none, PATH), PATH).count() == 0


def test_byte_shards(spark, sf, docs):
    rows = sorted(queries.op10_byte_shards(spark, sf).collect(), key=lambda r: r.doc_id)
    texts = dict(docs)
    assert [(r.doc_id, r.size, r.text_crc32) for r in rows] == [(i, len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode())) for i in sorted(texts)]
    shards = [r.shard for r in rows]
    assert shards == sorted(shards) and set(shards) <= set(range(8))
    for k in set(shards):
        assert [r.slot for r in rows if r.shard == k] == list(range(shards.count(k)))
        assert abs(sum(r.size for r in rows if r.shard == k) - sum(r.size for r in rows) / 8) <= max(r.size for r in rows)


def test_byte_shards_edges(spark, edge, none):
    rows = sharding.byte_shards(edge, 3).collect()
    assert len(rows) == len(EDGE) + 1 and {r.size for r in rows if r.doc_id in (1, 2, None)} == {1}
    assert sharding.byte_shards(none).count() == 0
    same = spark.range(1000).selectExpr("cast(1 as bigint) doc_id", "'x' text")
    got = sharding.byte_shards(same, 8).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(125)]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)] + [(1, None), (None, None), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    clean = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == brute.components({x for e in clean for x in e}, clean)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_buckets_largest_component_is_not_compared_with_itself(spark):
    """Every pair of different components meets in a cell, and rows grow with a bucket of nearly one component, not with its square."""
    from itertools import combinations

    from rookery.llm.near_dup import block_cells

    members = [(k, i, 0 if i % 50 else i) for k, n in ((1, 400), (2, 30)) for i in range(1, n)] + [(2, 50, 50), (2, 99, 99)]
    rows = block_cells(spark.createDataFrame(members, "key long, rep long, comp long"), 8).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.key, r.i, r.j), []).append((r.id, r.comp))
    met = {(k, *sorted((a, b))) for (k, *_), xs in cells.items() for (a, ca), (b, cb) in combinations(xs, 2) if ca != cb}
    want = {(k, *sorted((a, b))) for (k, a, ca), (q, b, cb) in combinations(members, 2) if k == q and ca != cb}
    assert met == want
    assert len(rows) < 3 * len(members)
