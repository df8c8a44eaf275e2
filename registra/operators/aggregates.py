"""Grouped statistics: summaries, facets, treemaps, trends, profiles and comparisons of contracts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.labels import category_label, group_key, nz, period_key, service_subtype, service_type
from registra.functions.numbering import first_numbered, numbered

from .filters import FilterState, apply

PRICE = "price_numeric_eur"


def cents(c: Column | str = PRICE) -> Column:
    """A price in whole cents: longs add up exactly, in any order, and without decimals."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def money_sum(c: Column | str = PRICE) -> Column:
    """An exact sum of cents, as a double; 0 without rows."""
    return F.coalesce(F.sum(cents(c)) / F.lit(100.0), F.lit(0.0))


def _mean(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def summary_columns() -> list[Column]:
    """Spend, number of contracts, average and maximum; the last two over priced contracts, zero where nothing is priced."""
    return [
        money_sum().alias("total_spend"),
        F.count(F.lit(1)).alias("contract_count"),
        _mean(money_sum(), F.count(PRICE)).alias("avg_value"),
        F.coalesce(F.max(PRICE), F.lit(0.0)).alias("max_value"),
    ]


def direct_rate() -> Column:
    return F.coalesce(F.try_divide(F.count_if(F.col("award_type") == "direct_award").cast("double"), F.count(F.lit(1))), F.lit(0.0))


def aggregate(df: DataFrame) -> DataFrame:
    return df.agg(*summary_columns())


def with_key(df: DataFrame, field: str, name: str = "group_value") -> DataFrame:
    return df.withColumn(name, group_key(df, field))


def group_by(df: DataFrame, field: str) -> DataFrame:
    """Groups in first-seen order: key, rows and the first row; null keys are dropped, empty ones kept."""
    keyed = with_key(df, field).filter("group_value IS NOT NULL")
    return keyed.groupBy("group_value").agg(F.count(F.lit(1)).alias("contract_count"), F.min("seq").alias("first_seq"))


def aggregate_groups(df: DataFrame, field: str) -> DataFrame:
    """Summary per group with its place: most spend first, ties as first seen."""
    keyed = with_key(df, field).filter("group_value IS NOT NULL")
    groups = keyed.groupBy("group_value").agg(*summary_columns(), F.min("seq").alias("first_seq"))
    placed = numbered(groups, [F.desc("total_spend"), F.asc("first_seq")])
    return placed.select(F.lit(field).alias("group_key"), "group_value", "contract_count", "total_spend", "avg_value", "max_value", "ord")


def aggregations_with_total(df: DataFrame, field: str) -> DataFrame:
    """Groups and, in the same pass, the total of all rows, those without a key included."""
    keyed = with_key(df, field)
    both = keyed.groupingSets([["group_value"], []], "group_value").agg(*summary_columns(), F.grouping("group_value").alias("is_total"))
    return both.filter("is_total = 1 OR group_value IS NOT NULL").withColumn("is_total", F.col("is_total").cast("int"))


def parties(df: DataFrame, column: str, ico: str) -> DataFrame:
    """Name, first ICO that is not empty, number of contracts, spend and first row of each party."""
    named = df.filter(F.col(column).isNotNull())
    return named.groupBy(F.col(column).alias("name")).agg(
        F.min_by(nz(ico), F.when(nz(ico).isNotNull(), F.col("seq"))).alias("ico"),
        F.count(F.lit(1)).alias("contract_count"),
        money_sum().alias("total_spend"),
        F.min("seq").alias("first_seq"),
    )


def _by_spend() -> list[Column]:
    """Most spend first, ties as first seen."""
    return [F.desc("total_spend"), F.asc("first_seq")]


def institutions(df: DataFrame) -> DataFrame:
    """All buyers with their places, most spend first."""
    return numbered(parties(df, "buyer", "ico_buyer"), _by_spend()).drop("first_seq")


def vendors(df: DataFrame) -> DataFrame:
    """All suppliers with their places, most spend first."""
    return numbered(parties(df, "supplier", "ico_supplier"), _by_spend()).drop("first_seq")


def top_vendors(df: DataFrame, n: int = 10) -> DataFrame:
    """The n suppliers with most spend."""
    return first_numbered(parties(df, "supplier", "ico_supplier"), _by_spend(), n).drop("first_seq")


def ico_map(df: DataFrame) -> DataFrame:
    """Names with their ICOs, institutions and vendors."""
    sides = [parties(df, c, ico).select(F.lit(kind).alias("kind"), "name", "ico") for kind, c, ico in (("institution", "buyer", "ico_buyer"), ("vendor", "supplier", "ico_supplier"))]
    return sides[0].union(sides[1]).filter("ico IS NOT NULL")


def direct_award_rate(df: DataFrame) -> DataFrame:
    return df.agg(direct_rate().alias("direct_award_rate"))


def vendor_concentration(df: DataFrame, entity: str | None = None, top_n: int = 3) -> DataFrame:
    """Share of the top vendors' spend in all spend, per entity or of everything; supplier and price must be there."""
    keys = [entity] if entity else []
    rows = df.filter(nz("supplier").isNotNull() & F.col(PRICE).isNotNull())
    spend = rows.groupBy(*keys, "supplier").agg(F.sum(cents()).alias("spend"), F.min("seq").alias("first_seq"))
    if entity:
        top = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("spend"), "first_seq")) <= top_n
        sums = spend.withColumn("top", top).groupBy(entity).agg(F.sum(F.when(F.col("top"), F.col("spend"))).alias("some"), F.sum("spend").alias("all"))
    else:  # n rows by a bounded sort against the whole
        some = spend.orderBy(F.desc("spend"), "first_seq").limit(top_n).agg(F.sum("spend").alias("some"))
        sums = spend.agg(F.sum("spend").alias("all")).crossJoin(some)
    share = F.try_divide(F.col("some").cast("double"), F.col("all").cast("double"))
    return sums.select(*keys, F.coalesce(share, F.lit(0.0)).alias("vendor_concentration"))


def _middle(df: DataFrame, entity: str | None) -> DataFrame:
    """(entity, price, below, n): the price in place n div 2 of the sorted prices (from zero) and how many prices are smaller.

    Prices are counted by range first (a fiftieth of a doubling each, so there are a few thousand ranges whatever the data), and
    only the range that holds the middle is then looked at price by price.
    """
    keys = [entity] if entity else []
    size = F.floor(F.log2(F.abs(F.col(PRICE)) + 1) * 50)
    prices = df.filter(F.col(PRICE).isNotNull()).groupBy(*keys, PRICE).agg(F.count(F.lit(1)).alias("k"))
    prices = prices.withColumn("range", F.when(F.col(PRICE) < 0, -size).otherwise(size))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # over ranges
    ranges = prices.groupBy(*keys, "range").agg(F.sum("k").alias("k"))
    ranges = ranges.withColumns({"upto": F.sum("k").over(whole.orderBy("range")), "n": F.sum("k").over(whole)}).withColumn("before", F.col("upto") - F.col("k"))
    place = F.floor(F.col("n") / 2) + 1
    ranges = ranges.filter((F.col("before") < place) & (place <= F.col("upto"))).select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("range").alias("r_range"), "before", "n")
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]
    inside = prices.join(ranges, [F.col("range") == F.col("r_range"), *same])
    upto = F.col("before") + F.sum("k").over(Window.partitionBy(*keys, "range").orderBy(PRICE))
    inside = inside.withColumn("upto", upto).filter(F.col("upto") >= place)
    found = inside.groupBy(*keys).agg(F.min(F.struct(F.col(PRICE).alias("price"), (F.col("upto") - F.col("k")).alias("below"), "n")).alias("m"))
    return found.select(*keys, "m.*")


def upper_median(df: DataFrame, entity: str | None = None) -> DataFrame:
    """The price in place n div 2 of the sorted prices, counted from zero, per entity or of everything."""
    keys = [entity] if entity else []
    return _middle(df, entity).select(*keys, F.col("price").alias("upper_median"), F.col("n").alias("priced"))


def fragmentation_score(df: DataFrame, entity: str | None = None) -> DataFrame:
    """Share of priced contracts that are strictly below the upper median; 0 where that is 0."""
    keys = [entity] if entity else []
    score = F.when(F.col("price") == 0, 0.0).otherwise(F.col("below") / F.col("n"))
    return _middle(df, entity).select(*keys, score.alias("fragmentation_score"))


FACETS = {
    "institutions": (lambda df: F.col("buyer"), "institutions"),
    "categories": (category_label, "categories"),
    "scanned_service_types": (service_type, "scanned_service_types"),
    "scanned_service_subtypes": (service_subtype, "scanned_service_subtypes"),
    "vendors": (lambda df: F.col("supplier"), "vendors"),
    "award_types": (lambda df: F.col("award_type"), "award_types"),
    "institution_icos": (lambda df: F.col("ico_buyer"), "institution_icos"),
}


def filter_options(df: DataFrame, state: FilterState) -> DataFrame:
    """(dim, value, contract_count): values of seven dimensions, each under all predicates but its own, in one scan.

    The predicates are evaluated once a row, as bits of those that fail: a row counts in every dimension when none fails, and only
    in the dimension of its own predicate when that one fails alone.
    """
    tests = {k: F.coalesce(v, F.lit(False)) for k, v in state.predicates(df).items()}
    bit = {k: 1 << i for i, k in enumerate(tests)}
    failed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(v, 0).otherwise(bit[k]) for k, v in tests.items()], F.lit(0))
    own_bits = [bit[own] for _, own in FACETS.values() if own in bit]
    rows = df.select(*[nz(F.trim(value(df))).alias(dim) for dim, (value, _) in FACETS.items()], failed.alias("failed")).filter(F.col("failed").isin([0, *own_bits]))
    entries = [F.when((F.col("failed") == 0) | (F.col("failed") == bit.get(own, 0)), F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("value"))) for dim, (_, own) in FACETS.items()]
    kept = F.filter(F.array(*entries), lambda x: x["value"].isNotNull())
    return rows.select(F.explode(kept).alias("f")).groupBy("f.dim", "f.value").agg(F.count(F.lit(1)).alias("contract_count"))


def categories(df: DataFrame) -> DataFrame:
    labels = df.select(category_label(df).alias("category")).filter("category <> ''").distinct()
    return numbered(labels, [F.asc("category")])


def treemap(df: DataFrame, first: str, second: str | None = None) -> DataFrame:
    """(level, g1, g2, value, contract_count): the root, groups and groups within groups.

    Rows without a second key count in their group, rows without a first key in the root only.
    """
    keyed = df.withColumn("g1", group_key(df, first)).withColumn("g2", group_key(df, second) if second else F.lit(None).cast("string"))
    sets = [["g1", "g2"], ["g1"], []] if second else [["g1"], []]
    names = ["g1", "g2"] if second else ["g1"]
    rows = keyed.groupingSets(sets, *names).agg(money_sum().alias("value"), F.count(F.lit(1)).alias("contract_count"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, len(names)).when(F.col("gid") == (1 if second else -1), 1).otherwise(0)
    rows = rows.withColumn("level", level.cast("int"))
    known = F.col("g1").isNotNull() & (F.col("g2").isNotNull() | (F.col("level") < 2)) if second else F.col("g1").isNotNull()
    rows = rows.filter((F.col("level") == 0) | known)
    return rows.select("level", "g1", *(["g2"] if second else []), "value", "contract_count")


def nested_treemap(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row per group with its children, most spend first; children are groups, not contracts."""
    flat = treemap(df, first, second)
    children = flat.filter("level = 2").groupBy("g1").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("key"), "g2", "value", "contract_count"))).alias("children"))
    return flat.filter("level = 1").select("g1", "value", "contract_count").join(children, "g1", "left").orderBy(F.desc("value"), "g1")


# ---------------------------------------------------------------- metrics

#: Metrics of one group that a plain aggregate gives, by name; add to it to extend comparisons, trends and rankings.
METRICS: dict[str, Callable[[], Column]] = {
    "total_spend": money_sum,
    "contract_count": lambda: F.count(F.lit(1)).cast("double"),
    "avg_value": lambda: _mean(money_sum(), F.count(PRICE)),
    "max_value": lambda: F.coalesce(F.max(PRICE), F.lit(0.0)),
    "direct_award_rate": direct_rate,
}
#: Metrics that need a plan of their own: (contracts, entity) -> (entity, metric).
PLANNED = {"vendor_concentration": vendor_concentration, "fragmentation_score": fragmentation_score}


def entity_metrics(df: DataFrame, entity: str, metrics: Sequence[str]) -> DataFrame:
    """(name, metrics..., first_seq, spend, n) per entity; plain metrics come from one aggregate, the others are joined."""
    plain = [m for m in metrics if m in METRICS]
    out = df.filter(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("name")).agg(
        *[METRICS[m]().alias(m) for m in plain], F.min("seq").alias("first_seq"), money_sum().alias("spend"), F.count(F.lit(1)).alias("n")
    )
    for m in metrics:
        if m in PLANNED:
            own = PLANNED[m](df, entity).withColumnRenamed(entity, "name")
            out = out.join(own, "name", "left").withColumn(m, F.coalesce(m, F.lit(0.0)))
        elif m not in plain:
            out = out.withColumn(m, F.lit(0.0))
    return out


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The asked-for names with their places; repeats stay."""
    rows = df.sparkSession.createDataFrame(list(enumerate(names)), "req int, name string")
    return F.broadcast(rows)


def compare(df: DataFrame, names: Sequence[str], metric: str) -> DataFrame:
    """Each asked-for institution's value, largest first, ties as asked; absent names and unknown metrics count 0."""
    known = df.filter(F.col("buyer").isin(list(names)))
    value = entity_metrics(known, "buyer", [metric]).select("name", F.col(metric).alias("value"))
    rows = _named(df, names).join(value, "name", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.select("name", F.lit(metric).alias("metric"), "value", F.row_number().over(Window.orderBy(F.desc("value"), "req")).alias("ord"))


def benchmark(df: DataFrame, state: FilterState, names: Sequence[str], metric: str, min_contracts: int) -> DataFrame:
    """``compare`` under the benchmark filter, of institutions with enough contracts there."""
    base = apply(df, state.for_benchmark())
    counts = base.filter(F.col("buyer").isin(list(names))).groupBy(F.col("buyer").alias("name")).agg(F.count(F.lit(1)).alias("contract_count"))
    rows = compare(base, names, metric).join(counts, "name", "left").withColumn("contract_count", F.coalesce("contract_count", F.lit(0)))
    return rows.filter(F.col("contract_count") >= min_contracts)


def compare_multi(df: DataFrame, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Several metrics per asked-for institution, in the order asked."""
    value = entity_metrics(df.filter(F.col("buyer").isin(list(names))), "buyer", metrics)
    rows = _named(df, names).join(value, "name", "left")
    return rows.select("req", "name", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])


def trend(df: DataFrame, granularity: str = "month", metrics: Sequence[str] = ("total_spend",)) -> DataFrame:
    """Metrics per period; unknown ones become total_spend."""
    keyed = df.withColumn("period", period_key(granularity)).filter("period IS NOT NULL")
    return keyed.groupBy("period").agg(*[METRICS.get(m, money_sum)().alias(m) for m in metrics])


def trend_summary(df: DataFrame, granularity: str = "month") -> DataFrame:
    periods = trend(df, granularity)
    return periods.agg(F.count(F.lit(1)).alias("periods"), F.round(F.coalesce(F.sum("total_spend"), F.lit(0.0)), 2).alias("total"), F.coalesce(F.max("total_spend"), F.lit(0.0)).alias("peak"))


def trend_overlays(df: DataFrame, events: DataFrame, granularity: str = "month") -> DataFrame:
    """Periods of the trend with the titles of dated events (event_date, title) that fall in them."""
    keyed = events.withColumn("published_date", F.col("event_date")).withColumn("period", period_key(granularity)).select("period", "title")
    return trend(df, granularity).join(keyed, "period", "left")


def peer_group(df: DataFrame, target: str, min_contracts: int) -> DataFrame:
    """Other buyers with enough contracts, most spend first."""
    named = df.filter(nz("buyer").isNotNull() & (F.col("buyer") != target))
    peers = named.groupBy("buyer").agg(F.count(F.lit(1)).alias("contract_count"), money_sum().alias("total_spend"), F.min("seq").alias("first_seq"))
    peers = peers.filter(F.col("contract_count") >= min_contracts)
    return numbered(peers, _by_spend()).drop("first_seq")


def profile(contracts: DataFrame, name: str, ico: str) -> DataFrame:
    """One row about an entity's contracts: first name and ICO, and the summary."""
    first = [F.min_by(nz(c), F.when(nz(c).isNotNull(), F.col("seq"))).alias(a) for c, a in ((name, "name"), (ico, "ico"))]
    return contracts.agg(*first, *summary_columns())


def compare_sets(primary: DataFrame, secondary: DataFrame | None, field: str) -> DataFrame:
    """``compare_sides`` of two datasets."""
    sides = [(primary, "primary")] + ([(secondary, "secondary")] if secondary is not None else [])
    keyed = [with_key(df, field).select("group_value", "seq", PRICE, F.lit(side).alias("side")) for df, side in sides]
    return _side_by_side(reduce(DataFrame.unionByName, keyed))


def compare_sides(rows: DataFrame, field: str) -> DataFrame:
    """Groups of contracts (``side`` primary) beside the same groups of subcontracts (secondary); what one side lacks counts 0.

    Most primary spend first; ties as first seen among the contracts, groups that only subcontracts have by their spend there. One pass over
    the rows of both sides.
    """
    return _side_by_side(with_key(rows, field).select("group_value", "seq", PRICE, "side"))


def _side_by_side(keyed: DataFrame) -> DataFrame:
    sums = keyed.filter("group_value IS NOT NULL").groupBy("group_value", "side").agg(money_sum().alias("total_spend"), F.count(F.lit(1)).alias("contract_count"), _mean(money_sum(), F.count(PRICE)).alias("avg_value"), F.min("seq").alias("first_seq"))
    rows = sums.groupBy("group_value").agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for side in ("primary", "secondary") for c in ("total_spend", "contract_count", "avg_value", "first_seq")
    ])
    values = [F.coalesce(F.col(f"{side}_{c}"), F.lit(0).cast(kind)).alias(f"{side}_{c}") for side in ("primary", "secondary") for c, kind in (("total_spend", "double"), ("contract_count", "bigint"), ("avg_value", "double"))]
    order = [F.desc("primary_total_spend"), F.asc_nulls_last("primary_first_seq"), F.desc("secondary_total_spend"), F.asc("secondary_first_seq")]
    return numbered(rows.select("group_value", *values, "primary_first_seq", "secondary_first_seq"), order).drop("primary_first_seq", "secondary_first_seq")


def scope_summary(df: DataFrame) -> DataFrame:
    return df.agg(*summary_columns(), F.min(nz("published_date")).alias("date_min"), F.max(nz("published_date")).alias("date_max"))


def category_breakdown(df: DataFrame) -> DataFrame:
    groups = with_key(df, "category", "category").groupBy("category").agg(F.count(F.lit(1)).alias("contract_count"), money_sum().alias("total_spend"), F.min("seq").alias("first_seq"))
    return numbered(groups, [F.desc("contract_count"), F.asc("first_seq")]).drop("first_seq")


def top_contracts(df: DataFrame, n: int = 20) -> DataFrame:
    """The n most valuable contracts, a missing price as 0, ties in input order."""
    value = F.coalesce(F.col(PRICE), F.lit(0.0))
    return first_numbered(df, [value.desc(), F.asc("seq")], n)


def remainder_summary(df: DataFrame, n: int = 20) -> DataFrame:
    """Number and spend of the contracts beyond the first n: all less the first n, without a global sort."""
    whole = df.agg(F.count(F.lit(1)).alias("a"), F.sum(cents()).alias("b"))
    top = top_contracts(df, n).agg(F.count(F.lit(1)).alias("c"), F.sum(cents()).alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.crossJoin(top).select((F.col("a") - F.col("c")).alias("remaining"), ((zero("b") - zero("d")) / 100.0).alias("remaining_total"))


def session_usage(usage: DataFrame) -> DataFrame:
    """Tokens, cost and requests per session, and the cost of its last request."""
    return usage.groupBy("session_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(28,6)")).cast("double"), 6).alias("cost_usd"),
        F.count(F.lit(1)).alias("requests"),
        F.max_by("cost_usd", "seq").alias("last_cost_usd"),
    )
