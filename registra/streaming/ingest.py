"""Incremental jobs as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from registra.functions.labels import nz
from registra.functions.storage import settled
from registra.operators.maintenance import append_subcontractors, expand_subcontractors, merge_contracts, record_key
from registra.sources.model import backfill_defaults

from .store import BUCKETS, BucketTable

PAGE = 40  #: bits of seq that a page's own row numbers take; the page's number stands above them


def stream_contracts(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Files of contracts as they arrive, ``per_trigger`` at a time: as many as a page has."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def merge_page(table: BucketTable, page: DataFrame, number: int, subcontracts: BucketTable | None = None) -> None:
    """One page, filled with defaults and merged into the contracts of the buckets that its keys fall into; other buckets are not read.

    ``number`` is the page's version, above those before. What was committed under it already is left alone, so a page that is run
    again after a failure goes on where it broke off. With ``subcontracts`` the merged contracts are then expanded, and rows whose (contract,
    name, ICO) is new there are added; contracts of other buckets were expanded by the page that changed them last.
    """
    key = lambda df: F.to_json(record_key(df))
    base = table.manifest(before=number)
    if number not in table.versions():
        rows = backfill_defaults(page)
        touched = [r[0] for r in rows.select(table.bucket(key(rows), base)).distinct().collect()]  # at most one row a bucket
        before = table.read(only=touched, m=base) if base else rows.limit(0)
        order = F.col("merged_ord")
        merged = merge_contracts(before, rows)
        merged = merged.withColumn("seq", order["seq"] + F.when(order["_src"] == 1, F.lit(number << PAGE)).otherwise(F.lit(0))).drop("merged_ord")
        table.commit(number, merged, key(merged), base)
    if subcontracts is not None and number not in subcontracts.versions():
        now = table.manifest(version=number)
        changed = [b for b, layers in now.layers.items() if number in layers]
        contracts = table.read(only=changed, m=now)
        expanded = expand_subcontractors(contracts)
        home = F.coalesce(F.col("contract_id").cast("string"), F.lit(""))
        known = subcontracts.manifest(before=number)
        named = nz(F.trim(F.col("scanned_subcontractors").cast("string"))).isNotNull()  # what else has no subcontractors needs no parsing here
        at = [r[0] for r in contracts.filter(named).select(subcontracts.bucket(home, known)).distinct().collect()] if known else []
        old = subcontracts.read(only=at, m=known) if known else expanded.limit(0)
        fresh = append_subcontractors(old, expanded).filter("is_new").drop("is_new")
        subcontracts.commit(number, fresh, home, known, append=True)


def merge_ingest(pages: DataFrame, target: str, checkpoint: str, subcontracts: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Each page is merged into the contracts before it, as ``merge_page`` does; the first one into none.

    The work of a page follows the buckets that it touches, not the whole of the contracts. A batch is a version of the table: one
    that is run again after a failure gives the same state. ``seq`` is unique over all pages and rises with them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge_page(BucketTable(spark, target, buckets), batch, number, BucketTable(spark, subcontracts, buckets) if subcontracts else None)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The rows as the newest committed page left them."""
    return BucketTable(spark, target).read()


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose streams keep state in RocksDB: on disk, so that the ids of a large dataset need not fit into memory."""
    session = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(k, spark.conf.get(k))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def dedup_ids(stream: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows whose contract id was not seen before, in this run or an earlier one, and every row without an id.

    The state holds ids only and is kept with the checkpoint; an empty id is none. The ids of ``existing`` rows are written once as a
    narrow table, which every page is then joined with; ``existing`` itself is not read again. A large dataset wants a stream of a ``stateful_session``.
    """
    known = stream.filter(nz("contract_id").isNotNull())
    if existing is not None:
        ids = settled(existing.select(F.col("contract_id").cast("string").alias("contract_id")).filter(nz("contract_id").isNotNull()).distinct())
        # sorted and merged, by the hash that the state is dealt by: ids pack well, so a file that looks small may hold millions
        known = known.join(ids.hint("merge"), "contract_id", "left_anti").select(*stream.columns)
    return known.dropDuplicates(["contract_id"]).union(stream.filter(nz("contract_id").isNull()))


def running_usage(stream: DataFrame) -> DataFrame:
    """Tokens, cost and requests per session so far, and its last request (the one with the largest seq)."""
    return stream.groupBy("session_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(28,6)")).cast("double"), 6).alias("cost_usd"),
        F.count(F.lit(1)).alias("requests"),
        F.max_by(F.struct("prompt_tokens", "completion_tokens", "cost_usd"), "seq").alias("last"),
    )


def usage_ingest(usage: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps each session's newest row in buckets of sessions: a batch rewrites those that its sessions fall into, and readers see one row a session.

    Files do not grow with batches; a batch that is run again after its commit changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        table, key = BucketTable(batch.sparkSession, target, buckets), F.col("session_id").cast("string")
        if number in table.versions():
            return
        base = table.manifest(before=number)
        rows = batch.withColumn("_new", F.lit(True))
        if base is not None:
            touched = [r[0] for r in batch.select(table.bucket(key, base)).distinct().collect()]  # at most one row a bucket
            rows = rows.unionByName(table.read(only=touched, m=base).withColumn("_new", F.lit(False)))
        values = [c for c in batch.columns if c != "session_id"]
        newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*values), "_new").alias("r")).select("session_id", "r.*")
        table.commit(number, newest.select(batch.columns), key, base)

    return usage.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_usage(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of each session."""
    return BucketTable(spark, target).read()
