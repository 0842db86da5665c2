import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L, subtree as U
from hexlytics.sources.layers import write_clustered


def finest(spark, size=60):
    """All finest cells of a square, with their ancestors."""
    df = spark.range(4 * size * size).select(
        (F.col("id") % (2 * size) - size).alias("_i"),
        (F.floor(F.col("id") / (2 * size)) - size).alias("_j"))
    cells = L.with_levels(df)
    return cells.select(*[
        L.cell_id(r, F.col(f"i{r}"), F.col(f"j{r}")).alias(f"c{r}") for r in K.RESOLUTIONS])


def keyed(df, res):
    c = F.col(f"c{res}")
    return U.with_subtree_key(df, L.id_part(c, 2), L.id_part(c, 3), res, f"k{res}")


def test_descendants_are_one_range(spark):
    df = finest(spark)
    for res in K.RESOLUTIONS:
        df = keyed(df, res)
    rows = df.toPandas()
    assert rows["k10"].is_unique
    for res in K.RESOLUTIONS:
        width = U.subtree_width(res)
        assert (rows[f"k{res}"] % width == 0).all()
        assert (rows[f"k{res}"] == rows["k10"] // width * width).all()
        pairs = rows[[f"c{res}", f"k{res}"]].drop_duplicates()
        assert pairs[f"c{res}"].is_unique and pairs[f"k{res}"].is_unique
    for res, cell in ((7, "7:0:0"), (8, "8:1:-2")):
        low, high = U.subtree_range(spark, cell)
        inside = rows[(rows["k10"] >= low) & (rows["k10"] < high)]
        assert len(inside) == U.subtree_width(res)
        assert set(inside["c10"]) == set(rows.loc[rows[f"c{res}"] == cell, "c10"])


def test_null_cells_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a"), ("6:1:2", "b")], "c6 string, k6 string")
    keys = [r["k6"] for r in keyed(df, 6).collect()]
    assert keys[0] is None and keys[1] % U.subtree_width(6) == 0


def test_a_drill_reads_a_small_share(spark, folder):
    """The range reaches the scan, and few files hold it."""
    path = folder("clustered")
    table = keyed(finest(spark), 10).select(F.lit(2024).alias("year"), "c10", "k10")
    # Small partitions would share one file; as many tasks as partitions stand for a large table.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_clustered(table.withColumnRenamed("k10", "subtree"), path, ["year"], "subtree")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    drilled = U.below(spark.read.parquet(path), "7:0:0")
    assert drilled.count() == 343
    plan = drilled._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(subtree," in plan and "LessThan(subtree," in plan
    low, high = U.subtree_range(spark, "7:0:0")
    groups = []
    for file in glob.glob(f"{path.removeprefix('file:')}/year=2024/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("subtree")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups.append(s.min < high and s.max >= low)
    assert len(groups) == 4 and sum(groups) <= 2
