"""What a cell is like: period totals, typical values, share of the selected offenses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions import lattice as L
from hexlytics.functions.features import title_case

# Source column and output name of each typical value.
CONTEXT_FIELDS = [
    ("primary_type", "common_crime"),
    ("street_norm", "signature_street"),
    ("block_address", "signature_block"),
    ("district_id", "district_id"),
    ("ward_id", "ward_id"),
    ("community_area_id", "community_area_id"),
]
NUMBER_FIELDS = {"district_id", "ward_id", "community_area_id"}


def top_value(df: DataFrame, cell: str, value: str, alias: str) -> DataFrame:
    """Most frequent value per cell with its count; the smallest value on ties."""
    counts = (
        df.where(F.col(cell).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(cell).alias("cell"), F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("r"), "value"))
    return counts.groupBy("cell").agg(best.alias("b")).select(
        F.col("cell").alias(cell), F.col("b.value").alias(alias),
        (-F.col("b.r")).alias(f"{alias}_count"),
    )


def _top_values(df: DataFrame, cell: str, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """Most frequent value of many fields in one pass: a struct (r, number, text) per field.

    Values are counted per (cell, field, value) with map-side sums, so a cell that holds much
    of the table reaches the second step as one row per distinct value and task.
    """
    nothing = F.lit(None)
    # The blank entry keeps a cell that has no value in any field.
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                (column if name in NUMBER_FIELDS else nothing).cast("bigint").alias("number"),
                (nothing if name in NUMBER_FIELDS else column).cast("string").alias("text"),
            )
            for name, column in [*fields, ("", nothing)]
        ]
    )
    known = F.col("number").isNotNull() | F.col("text").isNotNull()
    counts = (
        df.where(F.col(cell).isNotNull())
        .select(F.col(cell).alias("h3_id"), F.inline(entries))
        .groupBy("h3_id", "field", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    )
    entry = F.struct((-F.col("n")).alias("r"), "number", "text")
    best = [F.min(F.when((F.col("field") == name) & known, entry)).alias(name) for name, _ in fields]
    return counts.groupBy("h3_id").agg(F.sum("n").alias("entries"), *best)


def build_context(df: DataFrame, cell: str) -> DataFrame:
    """Typical offense, street, block, district, ward and area per cell, with counts."""
    present = [(c, a) for c, a in CONTEXT_FIELDS if c in df.columns]
    if not present:
        return df.select(F.col(cell).alias("h3_id")).limit(0)
    best = _top_values(df, cell, [(c, F.col(c)) for c, _ in present])
    known = [F.col(c).isNotNull() for c, _ in present]
    out = best.where(F.coalesce(*[F.when(k, True) for k in known], F.lit(False)))
    columns = [F.col("h3_id")]
    for name, alias in present:
        kind = "number" if name in NUMBER_FIELDS else "text"
        value = F.col(f"{name}.{kind}")
        columns += [
            (value if kind == "number" else F.coalesce(value, F.lit(K.UNKNOWN))).alias(alias),
            (-F.col(f"{name}.r")).alias(f"{alias}_count"),
        ]
    return out.select(*columns)


def period_summary(gold: DataFrame, weighted: bool = True, digits: int = 3) -> DataFrame:
    """Totals per cell over the period, rates averaged by incidents (or plainly), and the
    cell's centre. A rate column the table lacks becomes null."""
    weight = F.greatest(F.col("n_crimes"), F.lit(1)) if weighted else F.lit(1)
    rates = []
    for name in ("smoothed_rate", "pooled_smoothed"):
        if name in gold.columns:
            mean = F.sum(F.col(name) * weight) / F.sum(F.when(F.col(name).isNotNull(), weight))
        else:
            mean = F.lit(None).cast("double")
        rates.append(mean.alias(name))
    summary = (
        gold.where(F.col("cell").isNotNull()).groupBy(F.col("cell").alias("h3_id"))
        .agg(
            F.sum("n_crimes").alias("n_crimes"),
            F.sum("n_arrests").alias("n_arrests"),
            F.bround(F.avg(F.col("low_conf").cast("int")), digits).alias("low_conf_share"),
            *rates,
        )
    )
    return L.id_centre(summary, "h3_id")


def focus_share(df: DataFrame, cell: str, focus: Column | None, digits: int | None = 3
                ) -> DataFrame:
    """Incidents per cell, how many match the focus (all without one), and the share."""
    hits = F.count_if(focus) if focus is not None else F.count(F.lit(1))
    share = F.col("focus_count") / F.col("incident_total")
    return (
        df.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("h3_id"))
        .agg(F.count(F.lit(1)).alias("incident_total"), hits.alias("focus_count"))
        .withColumn("focus_share", share if digits is None else F.bround(share, digits))
    )


def density(summary: DataFrame, res: int) -> DataFrame:
    """Share of cells with 5 or more incidents, and whether that is too thin at this level."""
    ratio = F.coalesce(
        F.avg((F.col("n_crimes") >= K.LOW_CONFIDENCE_BELOW).cast("int")), F.lit(0.0)
    )
    return summary.agg(ratio.alias("density_ratio")).withColumn(
        "too_sparse", (F.lit(res) >= 10) & (F.col("density_ratio") < 0.2)
    )


SHARE_METRICS = ("focus_share", "smoothed_rate", "pooled_smoothed", "n_arrests")


def colour_range(summary: DataFrame, metric: str) -> DataFrame:
    """(low, high) of the map colours for a metric; (0, 1) without cells."""
    value = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    if metric in SHARE_METRICS:
        top = F.max(value)
        high = F.when(top.isNull(), 1.0).otherwise(F.greatest(top, F.lit(0.1)))
        return summary.agg(F.lit(0.0).alias("low"), high.alias("high"))
    # One row per distinct count: counts that add up to N take at most sqrt(2N) values.
    counted = summary.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.max("v").alias("top"), F.percentile("v", 0.9, F.col("n")).alias("q90")
    ).select(
        F.lit(0.0).alias("low"),
        F.when(F.col("top").isNull(), 1.0)
        .when(F.col("top") > 0, F.greatest("q90", F.col("top") * 0.6, F.lit(1.0)))
        .otherwise(1.0).alias("high"),
    )


def scope_centre(summary: DataFrame, parent: str | None = None) -> DataFrame:
    """Mean centre of the cells in scope, else the drilled parent's centre, else the city's."""
    spark = summary.sparkSession
    if parent is not None:
        fallback = L.id_centre(spark.createDataFrame([(parent,)], "cell string"), "cell").select(
            F.col("lat").alias("lat0"), F.col("lon").alias("lon0")
        )
    else:
        fallback = spark.createDataFrame([K.CITY_CENTRE], "lat0 double, lon0 double")
    means = summary.agg(F.avg("lat").alias("lat1"), F.avg("lon").alias("lon1"))
    stacked = means.unionByName(fallback, allowMissingColumns=True)
    return stacked.agg(
        F.coalesce(F.max("lat1"), F.max("lat0")).alias("lat"),
        F.coalesce(F.max("lon1"), F.max("lon0")).alias("lon"),
    )


# --- fixed values: wording of labels and sentences ---------------------------------------------
AREA_WORDS = [
    ("district_id", "District %02d"), ("community_area_id", "Community Area %02d"),
    ("ward_id", "Ward %02d"),
]
AREA_FALLBACK = "%s hotspot"
PLACEHOLDER_BLOCK = "0X0X0X"


def area_labels(df: DataFrame, res: int) -> DataFrame:
    """A readable name for every cell of a level: block or street at fine levels, else
    district, community area, ward, else the level's own label."""
    cell = f"h3_r{res}"
    guide = {r: label for r, label, _ in K.RESOLUTION_GUIDE}.get(res, f"r{res}")
    fields: list[tuple[str, Column]] = []
    if res >= 9:
        for name, empty in (("block_address", None), ("street_norm", "")):
            if name in df.columns:
                usable = F.col(name) != K.UNKNOWN
                if empty is not None:
                    usable = usable & (F.col(name) != empty)
                fields.append((name, F.when(usable, F.col(name))))
    for name in ("district_id", "community_area_id", "ward_id"):
        if name in df.columns:
            fields.append((name, F.col(name)))
    best = _top_values(df, cell, fields)
    have = [name for name, _ in fields]
    choices = []
    if "block_address" in have:
        block = F.trim(F.col("block_address.text"))
        # Placeholder blocks name no place.
        choices.append(
            F.when((block != "") & ~F.upper(block).startswith(PLACEHOLDER_BLOCK), title_case(block))
        )
    if "street_norm" in have:
        choices.append(title_case(F.col("street_norm.text")))
    for name, words in AREA_WORDS:
        if name in have:
            number = F.col(f"{name}.number")
            choices.append(F.when(number.isNotNull(), F.format_string(words, number)))
    return best.select("h3_id", F.coalesce(*choices, F.lit(AREA_FALLBACK % guide)).alias("label"))


def percent_text(share: Column) -> Column:
    return F.concat(F.bround(share * 100.0).cast("bigint").cast("string"), F.lit("%"))


def narrative(summary: DataFrame, lines: int = 3) -> DataFrame:
    """One sentence for each of the busiest cells: place, incidents, offense, focus share."""
    named = summary
    for name, kind in (
        ("signature_block", "string"), ("signature_street", "string"), ("common_crime", "string"),
        ("district_id", "bigint"), ("focus_share", "double"),
    ):
        if name not in named.columns:
            named = named.withColumn(name, F.lit(None).cast(kind))

    def known(name: str) -> Column:
        return F.when(F.col(name) != K.UNKNOWN, F.col(name))

    street = F.coalesce(known("signature_block"), known("signature_street"))
    place = (
        F.when(street.isNotNull(), F.concat(F.lit("around **"), street, F.lit("**")))
        .when(F.col("district_id").isNotNull(),
              F.concat(F.lit("in District "), F.col("district_id").cast("string")))
        .otherwise(F.lit("in this area"))
    )
    share = F.when(
        F.col("focus_share") != 0,
        F.concat(F.lit(" (selected crimes share "), percent_text(F.col("focus_share")), F.lit(")")),
    ).otherwise(F.lit(""))
    return (
        named.orderBy(F.col("n_crimes").desc(), "h3_id").limit(lines)
        .select(
            "h3_id", "n_crimes",
            # The wording of the line.
            F.concat(
                F.lit("- "), place, F.lit(" we saw **"), F.col("n_crimes").cast("string"),
                F.lit(" incidents**; most common offense: **"),
                F.coalesce(known("common_crime"), F.lit("mixed offenses")), F.lit("**"),
                share, F.lit("."),
            ).alias("line"),
        )
    )


def resolution_guide(df: DataFrame, res: str = "res") -> DataFrame:
    """Label, size and use of the level of each row. The guide has five rows."""
    guide = df.sparkSession.createDataFrame(
        K.RESOLUTION_GUIDE, "res int, label string, size string"
    )
    return df.join(F.broadcast(guide.withColumnRenamed("res", res)), res, "left")
