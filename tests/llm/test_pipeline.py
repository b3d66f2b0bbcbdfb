"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

import corpus_pipeline as pipeline
from flowspark.llm import secret_scan, sentencepiece_codec as codec, simhash, toxicity
from flowspark.session import materialize
from test_text_operators import _brute_overlaps, _brute_spans, _groups

SF_DIR = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF_DIR), name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        seen.append((name, before.collect(), docs.collect()))
    steps = {name: (before, after) for name, before, after in seen}

    before, after = steps["toxicity"]
    lexicon = toxicity.toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    work = lexicon.automaton()
    assert {r.doc_id for r in after} == {
        r.doc_id for r in before if toxicity.probability(toxicity.burden(r.text, work), lexicon) < 0.5}

    before, after = steps["simhash_near_dedup"]
    fps = [simhash.fingerprint(r.text) for r in before]
    groups = _groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(r.doc_id for r in after) == sorted(
        {min(r.doc_id for r, k in zip(before, groups) if k == g) for g in groups})

    before, after = steps["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    counts = {r.doc_id: _brute_overlaps(r.text, items) for r in before}
    assert {r.doc_id for r in after} == {i for i, (w, h, _) in counts.items() if not (h and 20 * h >= w)}

    before, after = steps["secret_scan"]
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not _brute_spans(r.text)
        if _brute_spans(old[r.doc_id].text):
            assert secret_scan.MASK in r.text and r.n_chars == len(r.text)
        else:
            assert r == old[r.doc_id]

    before, after = steps["sentencepiece"]
    model = codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.round_trip for r in after)
    assert all(r.ids == model.library.encode(texts[r.doc_id]) for r in after)


def test_run_is_all_stages(spark):
    got = pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert got.count() > 0


def test_nulls_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", None, 0), (None, "x y", None, "s", 3), (2, "token=abcdefgh é", "en", "s", 16)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        sf_dir = str(tmp_path / f"t{len(given)}")
        spark.createDataFrame(given, schema).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
        got = pipeline.run(spark, sf_dir).collect()
        assert len(got) == (3 if given else 0)  # the null and the empty text are one group
        assert not any(re.search("nan", str(np.array(r.ids))) for r in got)
