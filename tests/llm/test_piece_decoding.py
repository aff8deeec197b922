import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import piece_decoding, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")


def binary(ids):
    return bytearray(np.array(ids, dtype="<u4").tobytes())


def test_ids_of_the_library_and_of_samples_become_their_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    texts = ["", "one", " two  spaces ", "line\nbreak", "中文 😀 ü", "x" * 3000] + ["".join(rng.choices("abc üé中\n😀.", k=rng.randrange(40))) for _ in range(60)]
    rows = [(k, binary(model.encode(t)), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, ids binary, `a.b` string")
    out = piece_decoding.decode_ids(df, PATH, text_col="decoded").collect()
    assert {r["key"]: r["decoded"] for r in out} == {k: model.decode(model.encode(t)) for k, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    samples = segmentations.encode_samples(docs, PATH).select("doc_id", F.explode("samples").alias("s")).select("doc_id", "s.ids")
    got = piece_decoding.decode_ids(samples, PATH).collect()
    assert len(got) > len(texts) and all(r["text"] == texts[r["doc_id"]].removeprefix(" ") or r["text"] == texts[r["doc_id"]] for r in got)


def test_nulls_unknown_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, binary([])), (3, binary([0, 1, 2]))], "key long, ids binary")
    assert {r["key"]: r["text"] for r in piece_decoding.decode_ids(df, PATH).collect()} == {1: None, 2: "", 3: "⁇ "}
    assert piece_decoding.decode_ids(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="name of the result"):
        piece_decoding.decode_ids(df.withColumnRenamed("key", "Text"), PATH)
    with pytest.raises(Exception, match="not in the vocabulary"):
        piece_decoding.decode_ids(spark.createDataFrame([(1, binary([10**6]))], "key long, ids binary"), PATH).collect()
