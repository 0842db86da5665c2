"""The hotspot view: one selection of period, level, offenses and drill scope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K
from hexlytics.functions.features import category_of
from hexlytics.operators import context as X, profiles as P
from hexlytics.operators.onerow import beside
from hexlytics.session import checkpointed


@dataclass(frozen=True)
class Drill:
    """A parent cell and a frame of its children (column ``child``). A parent has seven, but any
    frame is accepted, so joins with it are left to the optimizer, which checks sizes."""

    parent_res: int
    parent: str
    children: DataFrame


@dataclass(frozen=True)
class HotspotView:
    """Named lazy frames over serving rows and gold daily rows of one level.

    Types win over categories; categories stand for their types; neither means no focus.
    """

    incidents: DataFrame
    gold: DataFrame
    res: int
    types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    drill: Drill | None = None
    map_limit: int = field(default=K.MAP_CELL_LIMIT)

    @property
    def cell(self) -> str:
        return f"h3_r{self.res}"

    @property
    def matches(self) -> Column | None:
        """Row condition of the selection."""
        if self.types:
            return F.coalesce(F.col("primary_type").isin(list(self.types)), F.lit(False))
        if self.categories:
            offense = F.col("primary_type")
            return offense.isNotNull() & category_of(offense).isin(list(self.categories))
        return None

    def filtered(self) -> DataFrame:
        return self.incidents if self.matches is None else self.incidents.where(self.matches)

    def focus_types(self) -> DataFrame:
        """The offense types in effect (none without a focus)."""
        if self.types:
            return self.incidents.sparkSession.createDataFrame(
                [(t,) for t in sorted(set(self.types))], "primary_type string"
            )
        if self.categories:
            return self.filtered().select("primary_type").distinct()
        return self.incidents.select("primary_type").limit(0)

    def focused(self) -> Column:
        """Whether a focus is in effect. A category without any row means none."""
        if self.types:
            return F.lit(True)
        if self.categories:
            hit = self.filtered().limit(1).agg((F.count(F.lit(1)) > 0).alias("hit"))
            return hit.scalar()
        return F.lit(False)

    # ------------------------------------------------------------------ cell frames

    def _in_scope(self, df: DataFrame, cell: str) -> DataFrame:
        if self.drill is None:
            return df
        children = self.drill.children.select(F.col("child").alias(cell))
        return df.join(children, cell, "left_semi")

    def share(self) -> DataFrame:
        focus = None if self.matches is None else (self.matches | ~self.focused())
        return self._in_scope(X.focus_share(self.incidents, self.cell, focus), "h3_id")

    def context(self) -> DataFrame:
        source = self.incidents
        if self.matches is not None:
            source = source.where(self.matches | ~self.focused())
        return X.build_context(source, self.cell)

    def selected_counts(self) -> DataFrame:
        return (
            self.filtered().where(F.col(self.cell).isNotNull())
            .groupBy(F.col(self.cell).alias("h3_id"))
            .agg(F.count(F.lit(1)).alias("selection_n_crimes"))
        )

    def summary(self) -> DataFrame:
        """Period totals, context, focus share and selected count per cell in scope."""
        base = self._in_scope(X.period_summary(self.gold), "h3_id")
        joined = base.join(self.context(), "h3_id", "left").join(self.share(), "h3_id", "left")
        if self.matches is None:
            return joined.withColumn("selection_n_crimes", F.col("n_crimes"))
        # With a focus in effect the selected count of a cell is its focus count.
        on = self.focused()
        return joined.withColumns(
            {
                "focus_share": F.coalesce("focus_share", F.when(on, F.lit(0.0))),
                "selection_n_crimes": F.when(
                    on, F.coalesce("focus_count", F.lit(0).cast("bigint"))
                ).otherwise(F.col("n_crimes")),
            }
        )

    def map_cells(self) -> DataFrame:
        """Cells on the map: the busiest ones when a fine level is shown without a drill."""
        summary = self.summary()
        if self.res > 7 and self.drill is None:
            return summary.orderBy(F.col("n_crimes").desc(), "h3_id").limit(self.map_limit)
        return summary

    # ------------------------------------------------------------------ rows in view

    def rows(self) -> DataFrame:
        """Selected rows within the drill scope. An empty selection means all rows. An empty
        scope falls back to the parent's rows, then to all; one pass decides, one pass reads."""
        match = F.lit(True) if self.matches is None else self.matches
        if self.drill is None:
            if self.matches is None:
                return self.incidents
            found = self.filtered().limit(1).agg((F.count(F.lit(1)) > 0).alias("found")).scalar()
            return self.incidents.where(match | ~found)

        flagged = self._flagged(self.incidents.columns)
        return flagged.where(self._keep(flagged)).drop("_m", "_c", "_p")

    def _flagged(self, columns) -> DataFrame:
        """Rows with ``_m`` (selected), ``_c`` (in a drilled cell), ``_p`` (in the parent)."""
        match = F.lit(True) if self.matches is None else self.matches
        if self.drill is None:
            return self.incidents.select(
                *columns, match.alias("_m"), F.lit(True).alias("_c"), F.lit(True).alias("_p"))
        children = self.drill.children.select(
            F.col("child").alias(self.cell), F.lit(True).alias("_in")).distinct()
        parent_column = f"h3_r{self.drill.parent_res}"
        return self.incidents.join(children, self.cell, "left").select(
            *columns, match.alias("_m"), F.coalesce("_in", F.lit(False)).alias("_c"),
            F.coalesce(F.col(parent_column) == self.drill.parent, F.lit(False)).alias("_p"),
        )

    def _keep(self, flagged: DataFrame) -> Column:
        """Which flagged rows are in view; decided by one aggregate over their flags."""
        any_match = F.coalesce(F.max("_m"), F.lit(False))
        if self.drill is None:
            found = flagged.agg(any_match.alias("found")).scalar()
            return F.col("_m") | ~found
        any_both = F.coalesce(F.max(F.col("_m") & F.col("_c")), F.lit(False))
        any_child = F.coalesce(F.max("_c"), F.lit(False))
        any_parent = F.coalesce(F.max("_p"), F.lit(False))
        shown = self._in_scope(
            self.gold.select(F.col("cell").alias("h3_id")), "h3_id"
        ).limit(1).agg((F.count(F.lit(1)) > 0).alias("shown"))
        choice = flagged.agg(
            F.when(any_match & any_both, "selected children")
            .when(~any_match & any_child, "children")
            .when(~shown.scalar(), "none")
            .when(any_parent, "parent")
            .otherwise("all").alias("choice")
        ).scalar()
        # A map of the choices asks for the one-row result once.
        kept = F.create_map(
            F.lit("selected children"), F.col("_m") & F.col("_c"), F.lit("children"), F.col("_c"),
            F.lit("parent"), F.col("_p"), F.lit("all"), F.lit(True),
        )
        return F.coalesce(F.try_element_at(kept, choice), F.lit(False))

    # ------------------------------------------------------------------ key figures

    def _tally(self) -> DataFrame:
        """(date, h3_id, _m, _c, _p, incidents, arrests): counts from one scan of the incidents,
        pinned, as long as the daily table at most."""
        at = "datetime" if "datetime" in self.incidents.columns else "date"
        flagged = self._flagged([F.to_date(at).alias("date"), F.col(self.cell).alias("h3_id"),
                                 P.arrest(self.incidents).alias("_a")])
        return checkpointed(
            flagged.groupBy("date", "h3_id", "_m", "_c", "_p")
            .agg(F.count(F.lit(1)).alias("incidents"), F.sum("_a").alias("arrests")))

    @staticmethod
    def _trend(rows: DataFrame) -> DataFrame:
        """One row from counts per date: totals, and last-week minus first-week daily means."""
        daily = rows.where("date is not null").groupBy("date").agg(
            F.sum("incidents").alias("incidents"), F.sum("arrests").alias("arrests"))
        first = daily.orderBy("date").limit(7)
        last = daily.orderBy(F.col("date").desc()).limit(7)

        def means(df: DataFrame, tag: str) -> DataFrame:
            return df.agg(
                F.avg("incidents").alias(f"i_{tag}"), F.avg("arrests").alias(f"a_{tag}")
            )

        totals = daily.agg(F.coalesce(F.sum("arrests"), F.lit(0)).alias("total_arrests"))
        return beside(totals, means(first, "first"), means(last, "last")).select(
            "total_arrests",
            (F.col("i_last") - F.col("i_first")).alias("incident_trend"),
            (F.col("a_last") - F.col("a_first")).alias("arrest_trend"),
        )

    def trend(self) -> DataFrame:
        """One row: totals, and last-week minus first-week daily means (0 under seven days)."""
        return self._trend(P.daily_series(self.rows()))

    def kpis(self) -> DataFrame:
        """One row of key figures over all cells in scope. Share figures are null without a
        focus. Runs a job when called: every figure comes from one tally of the incidents."""
        tally = self._tally()
        rows = tally.where(self._keep(tally))
        total = rows.agg(F.coalesce(F.sum("incidents"), F.lit(0)).alias("total_incidents"))
        cells = self._in_scope(X.period_summary(self.gold), "h3_id").select("h3_id", "n_crimes")
        if self.matches is None:
            lead = cells.agg(
                F.coalesce(F.max("n_crimes"), F.lit(0).cast("bigint")).alias("busiest_cell_count"),
                F.min_by("h3_id", F.struct((-F.col("n_crimes")).alias("r"), "h3_id"))
                .alias("leading_cell"),
                F.lit(None).cast("double").alias("average_focus_share"),
                F.lit(None).cast("double").alias("leading_share"),
            )
        else:
            on = F.lit(True) if self.types else tally.agg(
                F.coalesce(F.max("_m"), F.lit(False)).alias("on")).scalar()
            counted = tally.where("h3_id is not null").groupBy("h3_id").agg(
                F.sum("incidents").alias("_all"),
                F.sum(F.when(F.col("_m"), F.col("incidents")).otherwise(0)).alias("focus_count"))
            cells = cells.join(counted, "h3_id", "left").select(
                "h3_id", "n_crimes", F.coalesce("focus_count", F.lit(0)).alias("focus_count"),
                F.coalesce(F.bround(F.col("focus_count") / F.col("_all"), 3), F.lit(0.0))
                .alias("focus_share"))
            rank = F.when(on, -F.col("focus_count")).otherwise(-F.col("n_crimes"))
            top = F.min_by(
                F.struct("h3_id", "focus_share"), F.struct(rank.alias("r"), "h3_id")
            )
            lead = cells.agg(
                F.coalesce(-F.min(rank), F.lit(0)).cast("bigint").alias("busiest_cell_count"),
                F.avg("focus_share").alias("mean_share"),
                top.alias("top"),
            ).select(
                "busiest_cell_count", F.col("top.h3_id").alias("leading_cell"),
                F.when(on, F.col("mean_share")).alias("average_focus_share"),
                F.when(on, F.col("top.focus_share")).alias("leading_share"),
            )
        return beside(total, lead, self._trend(rows)).withColumn(
            "leading_delta", F.col("leading_share") - F.col("average_focus_share")
        )

    def signature_streets(self, limit: int = 20) -> DataFrame:
        """Busiest of all cells in scope with their anchor block and typical values, share as
        text."""
        cells = self.summary()
        order = F.col("n_crimes")
        if self.matches is not None:
            order = F.when(self.focused(), F.col("selection_n_crimes")).otherwise(order)
        return (
            cells.orderBy(order.desc(), "h3_id").limit(limit)
            .select(
                "h3_id",
                F.coalesce("signature_block", F.lit(K.UNKNOWN)).alias("signature_block"),
                "n_crimes", "selection_n_crimes",
                F.coalesce("common_crime", F.lit(K.UNKNOWN)).alias("common_crime"),
                "district_id", "ward_id",
                X.percent_text(F.coalesce("focus_share", F.lit(0.0))).alias("focus_share"),
            )
        )

    def narrative(self) -> DataFrame:
        return X.narrative(self.summary())


