"""The stages against plain code, one after the other."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sitescope.llm.common import read

from .test_decontaminate import brute as windows
from .test_minhash import brute as groups


def test_stages(spark, tmp_path, texts):
    sf_dir = "/root/testdata/sf0.01"
    docs, kept = read(spark, sf_dir, "documents"), [dict(texts)]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    start, told, single, clean, private, last = kept
    assert told == {k: t for k, t in start.items() if any(c.isalpha() for c in t or "")}
    assert set(single) == {k for k, _, _, stays in groups(sorted(told.items()), 5, 80) if stays}
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").collect()]
    hit = {w[0]: w[2] / max(1, w[1]) for w in windows(sorted(single.items()), items)}
    assert set(clean) == {k for k in single if hit[k] <= 0.5}
    assert all(clean[k] == single[k] for k in clean if not hit[k])
    assert not any(w[5] for w in windows(sorted(clean.items()), items))
    assert set(private) == set(clean) == set(last) and private != clean
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in docs.collect():
        assert r.decoded == r.text and r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
