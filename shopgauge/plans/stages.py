"""The layered model: raw tables → staged tables → core views.

``RetailModel`` wires the cleaning operators together lazily.  Each
stage is a DataFrame built on first use and reused afterwards.  A view of the
last days cleans only the sales of those days: thresholds are by (region, day)
and dedupe by (store, day), so a date range passes through all of cleaning.

``materialize()`` writes ``sales_enriched`` (the one persist point of the
design) as parquet, partitioned by month, into the shared checkpoint folder;
every later view then reads it with partition pruning and pushed-down filters.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..operators import cleaning, views
from ..operators.joins import row_count, side
from ..session import new_path, remove_written, write_and_reload, write_at, write_counted
from ..sources import files, tpch_adapter


class RetailModel:
    def __init__(self, regions: DataFrame, stores: DataFrame, sales: DataFrame,
                 params: Params = Params(), share_intermediates: bool = False,
                 bounds: dict[str, DataFrame] | None = None):
        """``bounds``: tables with at least as many rows as a dimension, cheaper to count than it."""
        self.regions, self.stores, self.sales = regions, stores, sales
        self.params = params
        self.share_intermediates = share_intermediates
        self.bounds = {"stores": stores, "regions": regions} | (bounds or {})
        self._enriched: DataFrame | None = None
        self._enriched_path: str | None = None
        self._bucketed: str | None = None
        self._written: list[DataFrame] = []

    # ---- construction -------------------------------------------------
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, params: Params | None = None):
        regions, stores, sales = tpch_adapter.retail_tables(spark, sf_dir)
        p = params or Params(as_of=tpch_adapter.AS_OF)
        return cls(regions, stores, sales, p, bounds=tpch_adapter.dimension_bounds(spark, sf_dir))

    @classmethod
    def from_csv(cls, spark: SparkSession, regions_path: str, stores_path: str,
                 sales_path: str, params: Params | None = None):
        regions, stores, sales = files.read_raw(spark, regions_path, stores_path, sales_path)
        return cls(regions, stores, sales, params or Params())

    # ---- staged tables ------------------------------------------------
    @cached_property
    def dim_rows(self) -> dict:
        """Row bounds of the dimensions, counted as the rows pass (one job each).

        They decide the dimension broadcasts, and the region count also
        bounds every region-grain aggregate of the facts (the inner join
        admits no other region), so those joins need no count of their own.
        """
        return {name: row_count(df) for name, df in self.bounds.items()}

    @cached_property
    def store_facts(self) -> DataFrame:
        return cleaning.store_facts(self.stores, self.regions, self.params, self.dim_rows)

    @cached_property
    def flagged(self) -> DataFrame:
        return cleaning.sales_flagged(self.sales, self.stores, self.regions, self.params,
                                      self.dim_rows)

    @cached_property
    def thresholds(self) -> DataFrame:
        return cleaning.rev_thresholds(self.flagged, self.params)

    def _clean(self, thresholds: DataFrame, rows: int | None) -> DataFrame:
        return cleaning.sales_cleaned(self.flagged, thresholds, self.params,
                                      keep_raw=self.params.keep_raw_revenue, threshold_rows=rows)

    @cached_property
    def cleaned(self) -> DataFrame:
        """Over the whole history: thresholds are a written table, counted as it is written."""
        table, rows = write_counted(self.thresholds, "rev_thresholds")
        self._written.append(table)
        return self._clean(table, rows)

    def _dedup(self, cleaned: DataFrame) -> DataFrame:
        return cleaning.sales_dedup(cleaned, self.params, self.store_facts, self.dim_rows)

    @cached_property
    def dedup(self) -> DataFrame:
        return self._dedup(self.cleaned)

    @property
    def enriched(self) -> DataFrame:
        if self._enriched is None:
            self._enriched = cleaning.derive(self.dedup.drop("rn"))
        return self._enriched

    def since(self, start: date) -> DataFrame:
        """``sales_enriched`` from a day on, from the written table or by cleaning just those days, in one plan."""
        if self._enriched is not None:
            return self._enriched
        cache = self.__dict__.setdefault("_since", {})
        if self.share_intermediates:  # one table for all views of the last days
            start = min(self.params.window_start, self.params.quarter_start, start)
        if start not in cache:
            part = RetailModel(self.regions, self.stores, self.sales.where(F.col("date") >= F.lit(start)), self.params)
            part.__dict__.update(dim_rows=self.dim_rows, store_facts=self.store_facts)
            recent = cleaning.derive(part._dedup(part._clean(part.thresholds, None)).drop("rn"))
            cache[start] = self.keep(write_and_reload(recent, "sales_recent")) if self.share_intermediates else recent
        return cache[start]

    def sharing(self, whole_history: bool = False) -> "RetailModel":
        """A model of the same tables whose intermediates are written once and shared (this one if it does so)."""
        if self.share_intermediates:
            return self
        found = self.__dict__.get("_sharing")
        if found is None:
            found = RetailModel(self.regions, self.stores, self.sales, self.params, True)
            found._enriched, found._written = self._enriched, self._written
            found.__dict__.update(dim_rows=self.dim_rows, store_facts=self.store_facts)
            self.__dict__["_sharing"] = found
        if whole_history and found._enriched is None:
            found.materialize()
        return found

    def materialize(self) -> DataFrame:
        """Write ``sales_enriched`` partitioned by month and read it back.

        Rows are dealt by month first, before their derived columns are made:
        each task then holds one or a few months and writes a date-sorted file
        for each instead of a small file per month per task.  Spark splits a
        large month among tasks and joins small ones (``REBALANCE``), from the
        sizes of the exchange: unlike a range layout this needs no sample, for
        which all of cleaning after the dedupe exchange would run once more.
        """
        self._enriched_path = new_path(self.sales.sparkSession, "sales_enriched")
        rows = cleaning.derive(by_month(self.dedup.drop("rn"))) if self._enriched is None else by_month(self._enriched)
        self._enriched = self.keep(write_at(with_month(rows), self._enriched_path, [views.PARTITION_COLUMN]))
        return self._enriched

    def materialize_by_store(self, buckets: int) -> DataFrame:
        """Write ``sales_enriched`` bucketed by store_id, for work that groups by store.

        Store totals, store-weeks and all that starts from them then need no
        exchange of the facts.  The layout by month (``materialize``) serves
        date ranges instead; a chain keeps the one its reports use most.
        """
        spark = self.sales.sparkSession
        path = new_path(spark, "sales_by_store")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        table = self.enriched.repartition(buckets, "store_id").sortWithinPartitions("store_id", "date")
        table.write.bucketBy(buckets, "store_id").sortBy("store_id", "date").option("path", path).saveAsTable(name)
        self._enriched_path, self._bucketed = None, name
        self._enriched = self.keep(spark.table(name))
        return self._enriched

    def refresh(self, new_sales: DataFrame) -> DataFrame:
        """Adds sales to a materialised model and cleans again only what they touch.

        A sale changes the thresholds of its region and day, hence all rows of
        that region-day, and the survivor of its store-day, which lies in it.
        So the region-days of the new sales are cleaned from the raw sales of
        their months; other rows of those months are taken as they are, and
        just those months are replaced.  The result equals a rebuild.

        The new sales, their region-days and the raw sales of these are each
        written once: what follows reads them several times, and the whole
        sales are read once.
        """
        if self._enriched_path is None:
            raise ValueError("refresh needs a materialised model")
        new_sales = new_sales.select(*self.sales.columns)
        arrived = write_and_reload(new_sales, "new-sales")
        region_of = side(self.store_facts.select("store_id", "region"), self.params.broadcast_max_rows, self.dim_rows["stores"])
        touched = write_and_reload(arrived.join(region_of, "store_id").select("region", "date").distinct(), "touched-days")
        months = [r[0] for r in touched.select(_month().alias("m")).distinct().collect()]  # calendar months
        old, sales, self.sales = self._enriched, self.sales.unionByName(arrived), self.sales.unionByName(new_sales)
        if months:
            def within(c: F.Column) -> F.Column:
                dated = c.isin([m for m in months if m is not None])
                return dated | c.isNull() if None in months else dated
            there = F.broadcast(touched) if touched.count() <= self.params.broadcast_max_rows else touched
            raw = sales.where(within(_month())).join(region_of, "store_id")
            raw = raw.join(there.withColumnsRenamed({"region": "_region", "date": "_date"}),
                           (F.col("region") == F.col("_region")) & F.col("date").eqNullSafe(F.col("_date")), "left_semi")
            raw = write_and_reload(raw.select(*self.sales.columns), "touched-sales")
            part = RetailModel(self.regions, self.stores, raw, self.params)
            part.__dict__.update(dim_rows=self.dim_rows, store_facts=self.store_facts)
            again = cleaning.derive(part._dedup(part._clean(part.thresholds, None)).drop("rn"))
            rest = old.where(within(F.col(views.PARTITION_COLUMN))).join(
                there.withColumnsRenamed({"region": "_region", "date": "_date"}),
                (F.col("region") == F.col("_region")) & F.col("date").eqNullSafe(F.col("_date")), "left_anti")
            # written apart first: the months' old files are read here and replaced below
            fresh = write_and_reload(again.unionByName(rest.drop(views.PARTITION_COLUMN)), "sales_refreshed")
            self._enriched = write_at(with_month(by_month(fresh)), self._enriched_path, [views.PARTITION_COLUMN], only_partitions=True)
            remove_written(raw)
            remove_written(fresh)
        remove_written(arrived)
        remove_written(touched)
        for name in ("_memo", "_since", "_sharing", "flagged", "thresholds", "cleaned", "dedup"):
            self.__dict__.pop(name, None)
        return self._enriched

    def keep(self, table: DataFrame) -> DataFrame:
        """Notes a written table for ``release``."""
        self._written.append(table)
        return table

    # ---- core views ---------------------------------------------------
    @property
    def last90(self) -> DataFrame:
        return views.sales_last90(self.since(self.params.window_start), self.params)

    @property
    def clean_alltime(self) -> DataFrame:
        return views.sales_clean_alltime(self.enriched)

    @property
    def anomalies(self) -> DataFrame:
        return views.sales_anomalies(self.enriched)

    @property
    def quarter(self) -> DataFrame:
        return views.current_quarter(views.core(self.since(self.params.quarter_start)), self.params)

    @property
    def enriched_view(self) -> DataFrame:
        return views.visible(self.enriched)

    def release(self) -> None:
        """Deletes the tables that this model has written; its DataFrames can no longer be read."""
        for df in self._written:
            remove_written(df)
        if self._bucketed:
            self.sales.sparkSession.sql(f"DROP TABLE IF EXISTS {self._bucketed}")
            self._bucketed = None
        self._written, self._enriched, self._enriched_path = [], None, None
        for name in ("_memo", "_since", "_sharing", "cleaned", "dedup"):
            self.__dict__.pop(name, None)

    def register(self) -> None:
        """Temp views named as in the reference."""
        views.register_views({
            "v_stores": self.stores, "v_regions": self.regions,
            "v_sales_last90": self.last90, "v_sales_clean_alltime": self.clean_alltime,
            "v_sales_anomalies": self.anomalies, "sales_enriched": self.enriched_view,
        })


def _month() -> F.Column:
    return F.trunc(F.col("date"), "month")


def by_month(rows: DataFrame) -> DataFrame:
    """The rows dealt by month, a large month to several tasks and small ones together."""
    return rows.withColumn(views.PARTITION_COLUMN, _month()).hint("rebalance", F.col(views.PARTITION_COLUMN))


def with_month(rows: DataFrame) -> DataFrame:
    """The rows with their month, each task's in order, for a table partitioned by it."""
    return rows.withColumn(views.PARTITION_COLUMN, _month()).sortWithinPartitions(views.PARTITION_COLUMN, "date")
