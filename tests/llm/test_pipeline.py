from __future__ import annotations

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from gritstone.llm.byte_bpe import read_ranks
from tests.llm.test_near_dups import brute as near
from tests.llm.test_substrings import brute as repeats


def test_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.saved(stage(spark, seen[-1], sf), name)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        seen.append(out)
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels.get(i, 0) == 0 for i in rows[0].keys() - rows[1].keys()) and all(labels.get(i, 1) for i in rows[1])
    assert set(rows[2]) == {i for i, v in near([(i, r.text) for i, r in rows[1].items()]).items() if v[2]}
    want = repeats([(i, r.text) for i, r in rows[2].items()])
    for i, (_, removed, sha) in want.items():
        text = rows[3][i].text
        assert text == rows[2][i].text if not removed else hashlib.sha256(text.encode()).hexdigest() == sha
        assert rows[3][i].n_chars == len(text)
    assert 0 < len(rows[4]) <= len(rows[3])
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert set(rows[5]) == set(rows[4]) and all(r.n_tokens == len(own.encode_ordinary(rows[4][i].text)) for i, r in rows[5].items())
