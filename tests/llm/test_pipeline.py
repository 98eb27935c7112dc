"""Each stage of the pipeline against brute force on what it was given."""

from __future__ import annotations

from collections import Counter

import pytest
from test_duplicates import contaminated, one_kept
from test_secret_candidates import plain_candidates
from test_tokens import check_packing

import corpus_pipeline
from thermoband.llm import quality, secret_scan


@pytest.fixture(scope="module")
def stages(spark, sf_dir, documents, tmp_path_factory):
    """For each stage what it was given and what it returned; each is run once."""
    folder, out, docs = tmp_path_factory.mktemp("stages"), {}, documents
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_only_take_away(stages, documents):
    sizes = []
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema.simpleString() == documents.schema.simpleString(), name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    for name in ("quality", "near_duplicates", "benchmark"):  # whole rows, unchanged
        before, after = map(rows_of, stages[name])
        assert all(before[k] == r for k, r in after.items())


def test_quality_keeps_what_scores_half(spark, sf_dir, stages):
    before, after = stages["quality"]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    good = {k for (k, _), s in zip(texts, model([t for _, t in texts]), strict=True) if s >= 0.5}
    assert good == set(rows_of(after))


def test_one_of_each_component_stays(stages):
    before, after = stages["near_duplicates"]
    groups = one_kept(before.select("doc_id", "text").collect())
    assert {members[0][2] for members in groups.values()} == set(rows_of(after))


def test_no_benchmark_passage_stays(spark, sf_dir, stages):
    before, after = stages["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {k for k, r in rows_of(before).items() if not contaminated(r.text, items)[1]}
    assert clean == set(rows_of(after))


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = (rows_of(x) for x in stages["secrets"])
    scanner = secret_scan.fit(stages["secrets"][0])
    for k, r in before.items():
        text = r.text or ""
        spans = [tuple(c) for c in plain_candidates(text)]
        found = scanner.find(text, r.source)
        assert [tuple(c) for c, _ in found] == spans
        secret = [c for c, p in found if p >= 0.5]
        want, at = "", 0
        for c in secret:  # in order; one that starts in another adds nothing but its end
            if c.start >= at:
                want += text[at : c.start] + secret_scan.MASK
            at = max(at, c.end)
        want += text[at:]
        got = after[k].text or ""
        assert got == want
        assert after[k].n_chars == (len(got) if got != text else r.n_chars)


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    rows = after.collect()
    pieces = check_packing(rows, before.select("doc_id", "text").collect())
    assert len(pieces) == -(-sum(r.length for r in rows) // 2048)


def test_run_is_the_stages_in_a_row(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rs: Counter((r.doc_id, r.doc_tokens) for r in rs if r.start == 0)
    assert key(got) == key(stages["packing"][1].collect())
