import hashlib

import numpy as np

import corpus_pipeline as cp
from tests.llm.cases import documents, hard


def test_encoded_documents_are_decoded_again(spark):
    for docs in (hard(spark).filter("doc_id not in (7, 8, 11) or doc_id is null"), documents(spark).limit(50)):
        docs = docs.select(*cp.COLUMNS).cache()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        got = cp.encode_stage(spark, docs, "").collect()
        assert sorted(r.decoded_sha256 for r in got) == sorted(sha((r.text or "").encode()) for r in docs.collect())
        assert all(r.ids_sha256 == sha(np.array(r.ids, "<u4").tobytes()) for r in got)
