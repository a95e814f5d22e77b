"""The pipeline against its parts."""

import zlib

import numpy as np

import corpus_pipeline
from opportunity.llm.common import table
from opportunity.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, seen[-1], SF).cache()
        assert kept.columns == docs.columns
        seen.append(kept)
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    left = {r.doc_id for r in seen[1].collect()}
    assert len(toxic - left) > 0.8 * len(toxic)
    assert len(left) > 0.8 * docs.count()
    assert seen[2].count() < seen[1].count()
    assert {r.doc_id for r in seen[3].collect()} == {r.doc_id for r in seen[4].collect()}
    final = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, at = [], 0
    for r in seen[4].orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(final) == sorted(want)
