"""The pipeline against plain steps over the same rows."""

import hashlib
import random

import numpy as np
import sentencepiece

import corpus_pipeline
from inkgrid.llm import quality, sentencepiece_codec
from inkgrid.llm.queries import op2_sentencepiece
from tests.llm.test_operators import DOCS, brute_groups, brute_removed, labelled, words


def kept_texts(rows):
    """Rows (id, text) in order, without what stands earlier; rows that lose everything go."""
    seen, out = set(), []
    for i, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone) if not g)
        if left or not b:
            out.append((i, left.decode(errors="ignore") if any(gone) else text))
    return out


def test_pipeline_is_its_plain_version(spark, tmp_path):
    d, labels = labelled(spark, 300)
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    clean = [t for i, t in rows if i % 3][:60]
    item, passage = words(rng, 25), words(rng, 55)
    more = [clean[0], clean[1].replace(".", " end."), clean[2] + " " + passage, passage + " " + clean[3], clean[4] + " " + item, words(rng, 80) + ".", passage]
    rows += [(1000 + k, t) for k, t in enumerate(more)]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    for name, df in (("documents", made), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id bigint, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    good = {r["doc_id"] for r in quality.judge(made, labels).filter("predicted = 1").collect()}
    left = [(i, t) for i, t in rows if i in good]
    groups = brute_groups(left)
    left = sorted((i, t) for i, t in left if groups[t][0] == i)
    left = [(i, t) for i, t in kept_texts(left) if item not in t]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = {i: hashlib.sha256(np.array(model.encode(t), "<i4").tobytes()).hexdigest() for i, t in left}
    assert {i: r["ids_sha256"] for i, r in got.items()} == want
    assert 1000 not in got and 1004 not in got and 1005 in got and len(got) > 150


def test_pipeline_ends_in_texts_and_ids(spark):
    rows = [(1, "some text, é"), (2, "x\u2581y"), (3, ""), (4, None)]
    made = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = {i: (t, model.encode(t or "")) for i, t in rows}
    got = corpus_pipeline.encode(spark, made, "").collect()
    assert {r["doc_id"]: (r["text"], r["ids"]) for r in got} == want


def test_codec_query_gives_ids_and_decoded_texts(spark, tmp_path):
    rows = [(1, "some text, é"), (2, "x\u2581y"), (3, ""), (4, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = {r["doc_id"]: r for r in op2_sentencepiece(spark, str(tmp_path)).collect()}
    assert {i: (r["ids"], r["decoded"]) for i, r in got.items()} == {i: (ids := model.encode(t or ""), model.decode(ids)) for i, t in rows}
    assert {i: r["round_trip"] for i, r in got.items()} == {1: True, 2: False, 3: True, 4: True}


def test_stages_keep_the_columns(spark, tmp_path):
    d, labels = labelled(spark, 90)
    for name, df in (("labels", labels), ("benchmark", spark.createDataFrame([(1, None)], "item_id bigint, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_brute_force_agrees_with_itself():
    text = "x" * 300
    assert brute_removed([text])[0][1] == 299 and kept_texts([(1, text)]) == [(1, "x")]
