"""Landed listings as a stream: dedup on URL in keyed state, counts kept up to date, refresh of what was touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gavelwork.functions import text
from gavelwork.operators import ingest, market, series, versioned
from gavelwork.session import TIDY, scratch_path, settings

#: State of streams: on the executors' disks in RocksDB, changes saved to the checkpoint with every batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Staged bytes of the first batch to a state partition; every partition opens a store in every batch.
STATE_BYTES = 16 << 20


def state_partitions(spark: SparkSession, folder: str) -> int:
    """Partitions of a stream that starts with the staged ``folder``: one for each core, more for many bytes.

    The checkpoint keeps the number. Adaptive execution is off in batches of streams with state, so all shuffles
    of a batch, and the buckets of the tables it makes, have as many tasks, however few rows they hold.
    """
    return max(spark.sparkContext.defaultParallelism, -(-versioned.Files(spark, folder).size("") // STATE_BYTES))


def landed(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Listings from parquet files as they land."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def unseen(staged: DataFrame) -> DataFrame:
    """Rows whose URL the stream has not given out before. The state is the URLs alone; it has no
    watermark, so no listing is dropped for its age."""
    return staged.dropDuplicates(["listing_url"])


def start_ingest(listings: DataFrame, table: str, checkpoint: str,
                 on_new: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append unseen listings to ``table``, then hand them to ``on_new``; one pass over what is there.

    Every batch is first cut to the first listing of each URL, with the rank limit before the
    shuffle, and staged. A second stream with keyed state takes what is staged and lets URLs pass that
    it has not seen, so a batch costs its own rows and their look-ups, however large the stored
    table is; that table is not read.

    A batch that is repeated after a failure finds its staged rows, or stages them anew when they
    have already been passed on, in which case the state knows all their URLs. Each pass of the second
    stream replaces its own ``batch_id`` partition, and ``on_new`` is called again with the same id.
    """
    staging, state = f"{checkpoint}/staged", f"{checkpoint}/urls"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{table}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if on_new is not None:
            on_new(spark.read.schema(batch.schema).parquet(target), batch_id)

    def stage(batch: DataFrame, batch_id: int) -> None:
        # the stream's own session: that of a batch holds on to the number of state partitions of the outer stream
        spark, folder = listings.sparkSession, f"{staging}/batch-{batch_id}"
        if not committed(spark, folder):
            ingest.first_per_url(batch).write.mode("overwrite").parquet(folder)
        with settings(spark, {**STATE, **TIDY, "spark.sql.shuffle.partitions": str(state_partitions(spark, folder))}):
            staged = spark.readStream.schema(batch.schema).parquet(f"{staging}/*")
            unseen(staged).writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        remove(spark, folder)

    with settings(listings.sparkSession, TIDY):  # a stream keeps the settings it starts with
        return (
            listings.filter(F.coalesce("listing_url", F.lit("")) != "")
            .writeStream.foreachBatch(stage)
            .option("checkpointLocation", f"{checkpoint}/source")
            .trigger(availableNow=True)
            .start()
        )


def committed(spark: SparkSession, folder: str) -> bool:
    return versioned.Files(spark, folder).exists("_SUCCESS")


def remove(spark: SparkSession, folder: str) -> None:
    versioned.Files(spark, folder).remove("")


def refresh_touched(counts_path: str, series_path: str, summary_path: str, as_of, run: str = "ingest") -> Callable[[DataFrame, int], None]:
    """Batch step: keep series and market summary of the products in the new rows up to date.

    The new rows are counted by series key, strategy, sale date and price and added to the stored counts.
    Medians are exact: they and the summaries are read off the counts of the touched products, of
    whose buckets alone files are read. A repeated batch is counted once. Counts are read for the series and
    again for the summaries, and not kept in between: of a large batch they would fill the executors' disks.
    """
    def refresh(new_rows: DataFrame, batch_id: int) -> None:
        ingest.store_counts(counts_path, series.count_rows(new_rows), run, batch_id)
        touched = new_rows.select(text.product_key().alias("product_id")).distinct()
        # dealt by product once: series and summaries add them up, group and order them within products
        counts = ingest.read_merged(new_rows.sparkSession, counts_path, touched, parts=True)
        ingest.store_series(series_path, series.series_of_counts(counts), run, batch_id)
        ingest.store_market_summaries(summary_path, market.summary_of_counts(counts, as_of), run, batch_id)

    return refresh


def count_days(batch: DataFrame, time: str = "sold_date") -> DataFrame:
    """Listings and the sum of their prices per product and day, as numbers that can be added up."""
    cents = F.round(F.col("price") * 100).cast("long")
    return batch.groupBy(F.to_date(time).alias("day"), "product_type", "product_id").agg(
        F.count("*").alias("listings"), F.count("price").alias("priced"), F.sum(cents).alias("cents"))


def start_daily_counts(listings: DataFrame, table: str, checkpoint: str, time: str = "sold_date", run: str = "days") -> StreamingQuery:
    """Add up counts per product and day in ``table``; one pass over what is there. The stream has no
    state: each batch adds its own counts, once, however late its rows are."""
    def add(batch: DataFrame, batch_id: int) -> None:
        at = versioned.table(batch.sparkSession, table, ["product_type", "product_id", "day"], ["product_id"], sums=["listings", "priced", "cents"])
        versioned.write(at, count_days(batch, time), run=run, batch=batch_id)

    return listings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(spark: SparkSession, table: str) -> DataFrame:
    """(day, product_type, product_id, listings, avg_price) as stored by ``start_daily_counts``."""
    rows = ingest.read_merged(spark, table)
    return rows.select("day", "product_type", "product_id", "listings", F.try_divide(F.col("cents"), F.col("priced") * 100).alias("avg_price"))


def ingest_once(spark: SparkSession, stream: DataFrame, name: str = "ingest") -> DataFrame:
    """Run one pass into a fresh table of the shared folder and read it back."""
    table, checkpoint = scratch_path(spark, f"{name}-table"), scratch_path(spark, f"{name}-state")
    start_ingest(stream, table, checkpoint).awaitTermination()
    return spark.read.parquet(table)
