"""What Python workers hold once their tasks are over."""

import public_tokenizers
import pyarrow as pa

from evigrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_workers_forget_encodings_after_their_task(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', 'w' || id * 7919, 'x' || id * 104729) AS text").repartition(4)
    assert tokens.encoded(docs, PATH).selectExpr("sum(size(ids))").first()[0] > 0
    assert tokens.round_trips(docs, PATH).selectExpr("sum(n_tokens)").first()[0] > 0

    def held(batches):
        from evigrid.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(v.known) - len(v.special) + len(v.fits) for v in bpe._loaded.values())]})

    assert spark.range(16).repartition(16).mapInArrow(held, "n long").selectExpr("max(n)").first()[0] == 0
