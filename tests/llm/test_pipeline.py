"""The pipeline's stages on odd documents and on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import sentence

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if name == "toxicity":
            assert out.count() == odd_docs.count()  # none of them is toxic
        if name == "near_duplicates":
            assert out.count() == 25
        if name == "repeated_passages":
            assert out.count() == docs.count() and out.filter("n_chars != length(text)").count() == 0
        docs = out
    assert docs.filter("NOT round_trip").count() == 0


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k, n in enumerate([50, 51, 52, 55, 60, 70]):
        passage = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))
        for i in (2 * k, 2 * k + 1):
            head, tail = sentence(rng, 30), sentence(rng, 30)
            rows.append((i, f"{head} {passage} {tail}"))
            want[i] = [*head.split(), *(passage.split() if n == 50 else []), *tail.split()]
    long = "字" * 140  # few words, but over 400 bytes
    rows += [(i, f"{i} {long} {i}") for i in (20, 21)]
    want |= {i: [f"{i}{str(i)[1:]}"] for i in (20, 21)}  # the spaces repeat, too, and so does the 2 after them
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    assert got == want


def test_mix_is_in_order_and_cut_at_a_word(spark):
    """Rows by slot and place as the operator gives them; whole texts but for the last of a source, with their white space."""
    rng = random.Random(4)
    rows = [(i, "\n ".join(sentence(rng, rng.randint(1, 40)).split(" ")), "en", f"s{i % 3}" if i % 4 else None, 0) for i in range(120)]
    rows += [rows[7]] * 3 + [(7, rows[7][1], "en", "s0", 0), (None, None, None, None, None), (500, "", None, "s9", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = []
    for r in corpus_pipeline.mixing.mix(docs.withColumn("text_", F.col("text"))).collect():
        for turn in (0, 1):
            of = sorted((x["first"], x["slot"], x["place"], x["n"]) for x in r["pieces"] if x["turn"] == turn)
            if of:
                words = r["row"]["text_"].split()[: sum(x[3] for x in of)]
                whole = r["row"]["text_"] if len(words) == r["size"] else "\n ".join(words)
                want.append((of[0][1:3], r["row"]["doc_id"], r["row"]["source"], whole))
    got = [(r["doc_id"], r["source"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert got == [x[1:] for x in sorted(want, key=lambda x: x[0])]
    assert len({r[2] for r in got if r[0] == 7}) <= 2 and sum(r[0] == 7 for r in got) >= 5


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    assert sum(i not in kept for i, t in toxic.items() if t) >= 0.85 * sum(toxic.values())
    assert all(i in kept for i, t in toxic.items() if not t)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, odd_docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd_docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.filter("NOT round_trip").count() == 0
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in __spark_entry__.queries()}
