"""Documents to training tokens: toxicity, near-duplicates, repeated passages, mixing, BPE.

Each stage takes all that its predecessor kept, and all but the last return the columns of documents.  Stages keep the
operators' rules for nulls, empty and very long texts, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, neardup, suffix, toxicity
from tessera.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that a model, learned from four fifths of the labels, scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, labels.filter(train))
    name = "score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, out=name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of exact and near copies."""
    return neardup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of over 50 words, or of 400 bytes or more, that stand elsewhere too; no document goes."""
    out = suffix.remove(docs, words=suffix.Params(length=51, gram=32, words=True)).drop("cut")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix goes through a document, in the order of the mix: by the slot of its first block
    and its place in it.  The last document of a source may be cut after a word; its white space up to there stays.

    Rows that are equal in all columns are interchangeable: one of them carries the text for all, with a row for each.
    """
    keys = [F.xxhash64(F.lit(i), *docs.columns).alias(f"k{i}") for i in (1, 2)]
    mixed = mixing.mix(docs.select(*keys, "doc_id", "text", "source"))

    def time_through(turn: int):
        of = F.filter("pieces", lambda x: x["turn"] == turn)
        start = F.array_min(F.transform(of, lambda x: F.struct(x["first"], x["slot"], x["place"])))
        return F.struct(start["slot"].alias("slot"), start["place"].alias("place"), F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"), "size")

    times = F.filter(F.array(time_through(0), time_through(1)), lambda x: x["n"] > 0)
    taken = materialize(mixed.select("row.k1", "row.k2", F.explode(times).alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("xs")), "taken")
    # The limit is applied in the map tasks first, and the join takes the rows as they are dealt.
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    one = docs.select(*keys, F.struct(*docs.columns).alias("row")).withColumn("nth", nth).filter("nth = 1").drop("nth")
    rows = one.join(taken, ["k1", "k2"]).select("row", F.explode("xs").alias("x"))
    some = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("x.n").cast("int")), "")
    text = F.when(F.col("x.n") < F.col("x.size"), some).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    rows = rows.select(F.struct(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]).alias("row"), "x.slot", "x.place")
    # Slots are evenly filled, so equal stretches of them are partitions of about equal size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = taken.select(F.max(F.array_max(F.transform("xs", lambda x: x["slot"])))).first()[0] or 0
    part = F.least(F.lit(parts - 1), F.floor(F.col("slot") / (last + 1) * parts)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("slot", "place").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    return bpe.encode_checked(docs, bpe.Params(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages' models, hashes and encodings are not expressible in SQL; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
