"""Views of the driver's tables in the shapes that the operators take, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width and height of a tile.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines from events: frame_id, node_id, x, y, event_type."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")  # y is read before rows are sorted, as its text is longer
    return e.select(F.col("user_id").alias("frame_id"), (F.row_number().over(w) - 1).cast("long").alias("node_id"), F.col("value").alias("x"), "y", "event_type")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: track, Frame, Longitudinal, Transverse."""
    return nodes(spark, sf_dir).select(F.col("frame_id").alias("track"), F.col("node_id").alias("Frame"), (F.col("x") - 50).alias("Longitudinal"), (F.col("y") - 50).alias("Transverse"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels from embeddings: frame_id, x, y, v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("i", "e")).select(
        "frame_id", (F.col("i") % SIDE).cast("long").alias("x"), F.floor(F.col("i") / SIDE).alias("y"), F.floor((F.col("e").cast("double") + 1) * 127.5).alias("v"),
    )


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with three channels."""
    return tiles(spark, sf_dir).select("frame_id", "x", "y", F.col("v").alias("r"), (F.col("v") * 7 % 256).alias("g"), (F.col("v") * 13 % 256).alias("b"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples: sample_id, label, score in (0, 1), part (doc_id % 3)."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"), (F.col("doc_id") % 3).alias("part"),
    )


def files(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """File names: of customers ('u'), suppliers ('l') or, with repeated frame numbers, of documents ('d')."""
    if which == "d":
        return table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png")).alias("name"))
    name, column = ("customer", "c_name") if which == "u" else ("supplier", "s_name")
    return table(spark, sf_dir, name).select(F.col(column).alias("name"))


#: The same in SQL, to be set after WITH.
CTE = {
    "sk": "sk AS (SELECT user_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS node_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type FROM events)",
    "tr": "tr AS (SELECT frame_id AS track, node_id AS \"Frame\", x - 50 AS \"Longitudinal\", y - 50 AS \"Transverse\" FROM sk)",
    "tile": "tile AS (SELECT frame_id, i % 8 AS x, i // 8 AS y, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS v FROM (SELECT vec_id AS frame_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings))",
    "rgb": "rgb AS (SELECT frame_id, x, y, v AS r, v * 7 % 256 AS g, v * 13 % 256 AS b FROM tile)",
    "smp": "smp AS (SELECT doc_id AS sample_id, quality AS label, n_chars / (n_chars + 2000.0::DOUBLE) AS score, doc_id % 3 AS part FROM labels JOIN documents USING (doc_id))",
    "fu": "fu AS (SELECT c_name AS name FROM customer)",
    "fl": "fl AS (SELECT s_name AS name FROM supplier)",
    "fd": "fd AS (SELECT source || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.png' AS name FROM documents)",
}
_NEEDS = {"tr": ["sk"], "rgb": ["tile"]}


def with_(*names: str) -> str:
    """``WITH`` and the named views with what they need."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "WITH " + ",\n".join(CTE[n] for n in order)
