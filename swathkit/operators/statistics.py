"""Statistics of footprints and coverings by level, and tables of measurements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathkit.functions import cells as C
from swathkit.functions.sphere import area, ring_of


LEAST_CELLS = 5  # coverings of so few cells say nothing about a level yet


def footprint_levels(products: DataFrame, levels: range = range(20), enough: float = 1.05) -> DataFrame:
    """path, level, area, cells, cover_area, ratio, interior_cells, bytes, denorm_cells, denorm_interior_cells of each footprint by level.

    cells counts a covering whose cells, four of one parent, are merged (bytes: four a cell); denorm_cells those of the level
    itself. Levels go on to the first with more than LEAST_CELLS cells and a ratio below `enough`, that one included.
    """
    fields = "path string, level int, area double, cells long, cover_area double, ratio double, interior_cells long, bytes long, denorm_cells long, denorm_interior_cells long"

    def run(batches):
        for pdf in batches:
            out = []
            for path, wkt in zip(pdf["path"], pdf["wkt"], strict=True):
                ring = ring_of(wkt)
                a = area(ring)
                for level, whole, n, flat, inner, flat_inner in C.refined(ring, max(levels, default=-1)):
                    ratio = whole / a if a else np.inf
                    if level in levels:
                        out.append((path, level, a, n, whole, ratio, inner, 4 * n, flat, flat_inner))
                    if level >= levels[0] and n > LEAST_CELLS and ratio < enough:
                        break
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in fields.split(", ")])

    return products.select("path", "wkt").mapInPandas(run, fields)


def level_stats(rows: DataFrame) -> DataFrame:
    """Smallest, largest, mean, sum and number of ratios and bytes by level."""
    return rows.groupBy("level").agg(
        F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.avg("ratio").alias("mean_ratio"), F.sum("ratio").alias("sum_ratio"),
        F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"), F.sum("bytes").alias("sum_bytes"), F.count("*").alias("n"),
    )


def sample_per_list(rows: DataFrame, n: int = 100, least_area: float = 1e-7) -> DataFrame:
    """The first n footprints of each list (list_no) that are larger than least_area; a sampling operator."""
    order = F.row_number().over(Window.partitionBy("list_no").orderBy("ingest_seq"))
    return rows.filter(F.col("area") > least_area).withColumn("_k", order).filter(F.col("_k") <= n).drop("_k")


def until_ratio(rows: DataFrame, below: float = 1.2) -> DataFrame:
    """Each footprint's levels up to the first whose ratio is below a bound."""
    hit = F.min(F.when(F.col("ratio") < below, F.col("level"))).over(Window.partitionBy("path"))
    return rows.withColumn("_stop", hit).filter(F.col("_stop").isNull() | (F.col("level") <= F.col("_stop"))).drop("_stop")


def storage_levels(rows: DataFrame, most: float = 2.0, enough: float = 1.05) -> DataFrame:
    """Each footprint's levels worth storing: those before the first of more than LEAST_CELLS cells where the size stays or the ratio is below `enough`, without ratios over `most`."""
    w = Window.partitionBy("path").orderBy("level")
    ends = (F.col("bytes") > 4 * LEAST_CELLS) & ((F.col("bytes") == F.lag("bytes").over(w)) | (F.col("ratio") < enough))
    stop = F.min(F.when(F.col("_ends"), F.col("level"))).over(Window.partitionBy("path"))
    return rows.withColumn("_ends", ends).withColumn("_stop", stop).filter((F.col("_stop").isNull() | (F.col("level") < F.col("_stop"))) & (F.col("ratio") <= most)).drop("_ends", "_stop")


def measurement_table(rows: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Tests by engine: the first time and number of products of each (rows: seq, test, engine, ms, products)."""
    cell = lambda c: F.min_by(c, "seq").alias(c)
    return rows.groupBy("test").pivot("engine", engines).agg(cell("ms"), cell("products"))
