"""The pipeline against each stage stated plainly, and its stages on empty and odd input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rookery.llm import quality
from tests.llm import brute


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(docs)
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    good = {r.doc_id: r.text for r in outs[0].collect()}
    assert good == {i: t for i, t in first.items() if verdict[i]}
    single = {r.doc_id: r.text for r in outs[1].collect()}
    assert set(single) == {i for i, v in brute.near_duplicates(good.items(), 5).items() if v[2]}
    clean = {r.doc_id: r for r in outs[2].collect()}
    assert set(clean) == set(single)
    for i, r in clean.items():
        assert (r.text == single[i]) == (not brute.spans(single[i])) and r.n_chars == len(r.text) and not [s for s in brute.spans(r.text) if s[0] in ("email", "ip", "phone")]
    mixed = outs[3].collect()
    assert outs[3].columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert {r.doc_id for r in mixed} <= set(clean) and all(r.text == clean[r.doc_id].text for r in mixed)
    words = sum(len(brute.words(r.text)) for r in clean.values())
    assert abs(sum(len(brute.words(r.text)) for r in mixed) - words) < 0.5 * words
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    last = outs[4].collect()
    assert len(last) == len(mixed)
    for r in last:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "ids", "decoded", "n_tokens"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
