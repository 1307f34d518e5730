"""The pipeline against brute force, stage by stage."""
from __future__ import annotations

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from auditframe.llm import bpe, quality
from tests.llm.conftest import SMALL
from tests.llm.test_copies import brute, brute_hits, shingles


def test_pipeline_equals_brute_force(spark, documents, texts):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={}
    )
    good = {r.doc_id for r in corpus_pipeline.good_quality(spark, documents, SMALL).collect()}
    assert len(good) > 0.7 * len(texts)
    first = {}
    for d in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    groups = brute({d: shingles(texts[d]) for d in first.values()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [d for d, c in groups.items() if d == c and not brute_hits(texts[d], items)[1]]
    want = set()
    for d in kept:
        ids = library.encode_ordinary(texts[d])
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_of_edge_cases(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edge, empty):
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0
    assert len(quality.STATISTICS) > 10
