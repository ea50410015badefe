"""Assembly tables derived from the driver's tables, each over its whole table.

The grid is the smallest square that holds all vectors: vec_id n stands at row n div W, column n mod W.  A piece is the
same vector seen turned by a quarter (cyclic shift), so its best place is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vector import cosine, piece_type, shift


SIDE = 10  # of a puzzle


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vectors(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
        w = self.table("embeddings").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w"))
        return e.join(F.broadcast(w)).withColumns({"row": F.floor(F.col("vec_id") / F.col("w")).cast("long"), "col": F.pmod("vec_id", "w").cast("long")})

    def cells(self) -> DataFrame:
        return self.vectors().select("row", "col", F.col("v").alias("cls"))

    def pieces(self) -> DataFrame:
        return self.vectors().select(F.col("vec_id").alias("piece_id"), shift(F.col("v"), F.size("v") / 4).alias("cls"), (F.col("label") % 3).alias("flat_side_count"))

    def matches(self) -> DataFrame:
        v = self.vectors()
        conf = (1 + cosine(shift(F.col("v"), F.size("v") / 4), F.col("v"))) / 2
        return v.select(F.col("vec_id").alias("piece_id"), "row", "col", F.lit(0).cast("long").alias("rot"), F.round(conf, 9).alias("confidence"), (F.col("label") % 3).alias("flat_side_count"))

    def placed(self) -> DataFrame:
        """Matches sure enough to be placed; the others leave holes in the grid."""
        return self.matches().filter("confidence >= 0.45")

    def puzzles(self) -> DataFrame:
        """job_id, piece_id, row, col, v and the matches' columns: every SIDE * SIDE consecutive ids are a puzzle of their own."""
        n = SIDE * SIDE
        k = F.pmod("piece_id", F.lit(n))
        places = {"row": F.floor(k / SIDE).cast("long"), "col": (k % SIDE).cast("long")}
        m = self.matches().withColumns(places).withColumn("job_id", F.floor(F.col("piece_id") / n).cast("long"))
        kind = piece_type(F.col("row"), F.col("col"), F.lit(SIDE), F.lit(SIDE))
        return m.withColumn("piece_type", kind).join(self.vectors().select(F.col("vec_id").alias("piece_id"), "v"), "piece_id")

    def seated(self) -> DataFrame:
        """Pieces of puzzles that are sure enough to be placed."""
        return self.puzzles().drop("v").filter("confidence >= 0.45")

    def profiles(self, n: int = 16) -> DataFrame:
        """job_id, piece_id, sides: a vector cut in four."""
        cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * n + 1, n))
        return self.puzzles().select("job_id", "piece_id", cut.alias("sides"))

    def sides(self, n: int = 16) -> DataFrame:
        """vec_id, side, idx, k: a vector cut in four."""
        v = self.vectors().select("vec_id", F.posexplode("v").alias("p", "k"))
        return v.select("vec_id", F.floor(F.col("p") / n).cast("long").alias("side"), (F.col("p") % n).cast("long").alias("idx"), "k")

    def pixels(self) -> DataFrame:
        v = F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 105000 * 256)).cast("long")
        return self.table("lineitem").select(F.col("l_returnflag").alias("img"), F.col("l_linestatus").alias("c"), v.alias("v"), F.col("l_orderkey").alias("block"))

    def raster(self) -> DataFrame:
        return self.vectors().select("row", "col", F.round(127.5 * (1 + F.element_at("v", 1))).alias("v"))

    def raster_mask(self) -> DataFrame:
        return self.vectors().select("row", "col", (F.col("label") >= 3).cast("long").alias("m"))

    def contours(self) -> DataFrame:
        """user_id, idx, x (minutes since the event before), y (value): events in order of time."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        e = self.table("events").select("user_id", "event_id", "ts", us.alias("us"), F.col("value").alias("y"))
        x = F.coalesce((F.col("us") - F.lag("us").over(w)) / 60_000_000, F.lit(0.0))
        return e.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), x.alias("x"), "y")

    def mask_rows(self) -> DataFrame:
        """mask_id, area, w, h, solidity, from orders."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(k.alias("mask_id"), F.floor("o_totalprice").cast("long").alias("area"), (1 + c % 50).alias("w"), (1 + k % 50).alias("h"), ((k % 100) / 100).alias("solidity"))

    def mask_children(self) -> DataFrame:
        child = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
        return self.table("lineitem").select(F.col("l_orderkey").alias("parent_id"), child.alias("child"), F.floor("l_extendedprice").cast("long").alias("area")).distinct()

    def mask_sets(self) -> DataFrame:
        """mask_id, px: orders as sets of parts."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("mask_id"), F.col("l_partkey").alias("px")).distinct()

    def boxes(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(k.alias("box_id"), (c % 1900).alias("x"), (k % 1060).alias("y"), (1 + c % 50).alias("w"), (1 + k % 50).alias("h"))

    def counts(self) -> DataFrame:
        return self.table("customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("piece_count"))

    def job_events(self) -> DataFrame:
        """job_id, ts, seq, stage, progress, error, payload from the event stream."""
        return events_of(self.table("events"))

    def files(self) -> DataFrame:
        """id, path, content (first bytes), size, from pages."""
        path = F.regexp_replace("url", r"^[a-z]+://[^/]*/?", "")
        return self.table("pages").select(F.col("page_id").alias("id"), path.alias("path"), F.col("html").cast("binary").alias("content"))

    def corrections(self) -> DataFrame:
        """Pieces of label 7, moved to the mirrored column."""
        m = self.vectors().filter("label = 7")
        return m.select(F.col("vec_id").alias("piece_id"), "row", (F.col("w") - 1 - F.col("col")).alias("col"))


def events_of(events: DataFrame) -> DataFrame:
    """The same for a batch or a stream of events."""
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "queued").when(kind == "view", "preprocessing").when(kind == "click", "matching").when(kind == "purchase", "done").when(kind == "error", "failed")
    progress = F.when(F.col("event_id") % 4 != 0, F.least(F.lit(100), F.floor("value")).cast("long"))
    return events.select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), stage.alias("stage"), progress.alias("progress"),
        F.when(kind == "error", F.col("props")).alias("error"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("payload"),
    )
