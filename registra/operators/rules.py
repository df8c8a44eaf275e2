"""Red-flag rules: each gives one row per flag; rules are kept in a registry by id."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.labels import nz
from registra.functions.storage import settled

from .aggregates import PRICE
from .ranking import first_contract_per_vendor

COLUMNS = ["rule_id", "severity", "contract_id", "vendor", "institution", "details"]


def _flag(rows: DataFrame, rule: str, severity: float, contract: bool = True, **details: Column) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule_id"),
        F.lit(severity).alias("severity"),
        (F.col("contract_id") if contract else F.lit(None).cast("string")).alias("contract_id"),
        F.col("supplier").alias("vendor"),
        F.col("buyer").alias("institution"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in details]), F.array(*[v.cast("string") for v in details.values()])).alias("details"),
    )


Flag = tuple[Column, float, dict[str, Column]]  # when, severity, details


def _row_flags(df: DataFrame, rule: str, flag: Flag) -> DataFrame:
    when, severity, details = flag
    return _flag(df.filter(when), rule, severity, **details)


def _money(c: Column | str) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"))


# ---------------------------------------------------------------- what rules say about a row


def _near_threshold(threshold_eur: float = 100_000, proximity_pct: float = 10) -> Flag:
    low = threshold_eur * (1 - proximity_pct / 100)
    return (F.col(PRICE) >= low) & (F.col(PRICE) < threshold_eur), 0.6, {"value": F.col(PRICE), "threshold": F.lit(float(threshold_eur)), "pct": F.lit(float(proximity_pct))}


def _instant(c: str) -> Column:
    """One of three formats, else null."""
    text = nz(c)
    return F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(fmt)) for shape, fmt in (
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
        (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
        (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )])


def _with_hours(df: DataFrame) -> DataFrame:
    """``hours`` from being concluded to being published."""
    return df.withColumn("hours", (F.unix_timestamp(_instant("published_date")) - F.unix_timestamp(_instant("date_concluded"))) / 3600)


def _overnight(max_hours: float = 24) -> Flag:
    return (F.col("hours") >= 0) & (F.col("hours") < max_hours), 0.3, {"hours": F.round("hours", 1)}


def _named_pair() -> Column:
    return nz("buyer").isNotNull() & nz("supplier").isNotNull()


def _in_pieces(min_contracts: int = 3, max_value_eur: float = 50_000, n: str = "n", total: str = "total") -> Flag:
    when = _named_pair() & (F.col(PRICE) <= max_value_eur) & (F.col(n) >= min_contracts)
    return when, 0.4, {"count": F.col(n), "total": F.col(total).cast("double")}


def _is_round(round_modulus: float) -> Column:
    return (F.col(PRICE) > 0) & (F.col(PRICE) % round_modulus == 0)


def _round(round_modulus: float = 1000, min_round_pct: float = 60, min_contracts: int = 5, n: str = "n", rounds: str = "rounds") -> Flag:
    pct = F.try_divide(F.col(rounds), F.col(n)) * 100
    when = _is_round(round_modulus) & (F.col(n) >= min_contracts) & (pct >= min_round_pct)
    return when, 0.3, {"value": F.col(PRICE), "round_pct": F.round(pct, 1), "total": F.col(n)}


# ---------------------------------------------------------------- what rules say about sums over buyers and suppliers


def _top_shares(pairs: DataFrame, top_n: int = 1, max_share_pct: float = 60) -> DataFrame:
    """(buyer, supplier, spend, first_seq) of priced contracts."""
    buyer = Window.partitionBy("buyer")
    ranked = pairs.withColumn("rn", F.row_number().over(buyer.orderBy(F.desc("spend"), "first_seq"))).withColumn("total", F.sum("spend").over(buyer))
    top = ranked.filter(F.col("rn") <= top_n).withColumn("top", F.sum("spend").over(buyer)).filter("total > 0")
    share = F.col("top").cast("double") / F.col("total").cast("double") * 100
    return _flag(top.filter(share > max_share_pct), "vendor_concentration", 0.5, contract=False, share_pct=F.round(share, 1), vendor_spend=F.col("spend").cast("double"))


def _large_first(firsts: DataFrame, min_value_eur: float = 100_000) -> DataFrame:
    return _flag(firsts.filter(F.col(PRICE) >= min_value_eur), "new_vendor_large_contract", 0.5, value=F.col(PRICE), first_date=F.col("published_date"))


# ---------------------------------------------------------------- the rules one by one


def threshold_proximity(df: DataFrame, threshold_eur: float = 100_000, proximity_pct: float = 10) -> DataFrame:
    """Prices just below a threshold."""
    return _row_flags(df, "threshold_proximity", _near_threshold(threshold_eur, proximity_pct))


def vendor_concentration(df: DataFrame, top_n: int = 1, max_share_pct: float = 60) -> DataFrame:
    """The top vendors of a buyer who together have more than a share of its spend; one flag for each."""
    rows = df.filter(_named_pair() & F.col(PRICE).isNotNull())
    return _top_shares(rows.groupBy("buyer", "supplier").agg(_money(PRICE).alias("spend"), F.min("seq").alias("first_seq")), top_n, max_share_pct)


def fragmentation(df: DataFrame, min_contracts: int = 3, max_value_eur: float = 50_000) -> DataFrame:
    """Many small contracts between one buyer and one supplier; counts come from an aggregate, so frequent pairs are not windowed."""
    rows = df.filter(_named_pair() & (F.col(PRICE) <= max_value_eur))
    pairs = rows.groupBy("buyer", "supplier").agg(F.count(F.lit(1)).alias("n"), _money(PRICE).alias("total")).filter(F.col("n") >= min_contracts)
    return _row_flags(rows.join(pairs, ["buyer", "supplier"]), "fragmentation", _in_pieces(min_contracts, max_value_eur))


def overnight_turnaround(df: DataFrame, max_hours: float = 24) -> DataFrame:
    """Published within hours of being concluded."""
    return _row_flags(_with_hours(df), "overnight_turnaround", _overnight(max_hours))


def new_vendor_large_contract(df: DataFrame, min_value_eur: float = 100_000) -> DataFrame:
    """Vendors whose first dated contract is large."""
    return _large_first(first_contract_per_vendor(df), min_value_eur)


def round_number_clustering(df: DataFrame, round_modulus: float = 1000, min_round_pct: float = 60, min_contracts: int = 5) -> DataFrame:
    """All round prices, if they are a large share of enough prices."""
    stats = df.agg(F.count_if(F.col(PRICE) > 0).alias("n"), F.count_if(_is_round(round_modulus)).alias("rounds"))
    return _row_flags(df.crossJoin(F.broadcast(stats)), "round_number_clustering", _round(round_modulus, min_round_pct, min_contracts))


#: Rules by id; add to it to extend the engine.
RULES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (threshold_proximity, vendor_concentration, fragmentation, overnight_turnaround, new_vendor_large_contract, round_number_clustering)
}


#: The rules that a list evaluates together.
TOGETHER = dict(RULES)


def evaluate(df: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Flags of a list of {"id", "params"} in rule order; None means all rules with their defaults.

    Unknown ids are left out, a parameter that a rule does not take is an error, an empty list has no flags. The engine's own rules are evaluated
    together, in two passes over the contracts: one aggregates them by buyer and supplier, the other gives each row the flags of
    all rules. Rules that were added are evaluated one by one.
    """
    rules = [{"id": k} for k in RULES] if rules is None else rules
    together, found = [], []
    for n, rule in enumerate(rules):
        if (f := RULES.get(rule["id"])) is None:
            continue
        params = rule.get("params") or {}
        bound = inspect.signature(f).bind(df, **params)
        bound.apply_defaults()
        if TOGETHER.get(rule["id"]) is f:
            together.append((n, rule["id"], {k: v for k, v in bound.arguments.items() if k != "df"}))
        else:
            found.append(f(df, **params).withColumn("rule_ord", F.lit(n)))
    if together:
        found.insert(0, _together(df, together))
    if not found:
        return _flag(df.limit(0), "", 0.0, none=F.lit("")).withColumn("rule_ord", F.lit(0))
    return reduce(DataFrame.unionByName, found)


def _together(df: DataFrame, rules: list[tuple[int, str, dict]]) -> DataFrame:
    """Flags of the engine's own rules: place in the list, id and all parameters."""
    sums, flags, out = [], [], []
    for n, rule, given in rules:
        if rule == "threshold_proximity":
            flags.append((n, rule, _near_threshold(**given)))
        elif rule == "overnight_turnaround":
            flags.append((n, rule, _overnight(**given)))
        elif rule == "fragmentation":
            small = F.when(F.col(PRICE) <= given["max_value_eur"], F.col(PRICE))
            sums += [F.count(small).alias(f"n{n}"), _money(small).alias(f"total{n}")]
            flags.append((n, rule, _in_pieces(**given, n=f"n{n}", total=f"total{n}")))
        elif rule == "round_number_clustering":
            sums.append(F.count_if(_is_round(given["round_modulus"])).alias(f"rounds{n}"))
            flags.append((n, rule, _round(**given, n="priced_n", rounds=f"rounds{n}")))
    ids = {rule for _, rule, _ in rules}
    rows, pairs = df, None
    if ids - {"threshold_proximity", "overnight_turnaround"}:
        if "vendor_concentration" in ids:
            sums += [_money(PRICE).alias("spend"), F.min(F.when(F.col(PRICE).isNotNull(), F.col("seq"))).alias("first_seq")]
        if "new_vendor_large_contract" in ids:
            dated = nz("supplier").isNotNull() & nz("published_date").isNotNull()
            sums.append(F.min(F.when(dated, F.struct("published_date", "seq", "contract_id", PRICE))).alias("first"))
        sums.append(F.count_if(F.col(PRICE) > 0).alias("priced_n"))
        pairs = settled(df.groupBy("buyer", "supplier").agg(*sums))  # a row for each buyer and supplier
    for n, rule, given in rules:
        if rule == "vendor_concentration":
            out.append(_top_shares(pairs.filter(_named_pair() & F.col("spend").isNotNull()), **given).withColumn("rule_ord", F.lit(n)))
        elif rule == "new_vendor_large_contract":
            firsts = pairs.filter("first IS NOT NULL").groupBy("supplier").agg(F.min_by(F.struct("first", "buyer"), F.struct("first.published_date", "first.seq")).alias("f"))
            out.append(_large_first(firsts.select("supplier", "f.buyer", "f.first.*"), **given).withColumn("rule_ord", F.lit(n)))
    pieces = [(n, given) for n, rule, given in rules if rule == "fragmentation"]
    if pieces:
        many = reduce(Column.__or__, [F.col(f"n{n}") >= given["min_contracts"] for n, given in pieces])
        kept = pairs.filter(_named_pair() & many).select("buyer", "supplier", *[f"{c}{n}" for n, _ in pieces for c in ("n", "total")])
        rows = rows.join(kept, ["buyer", "supplier"], "left")
    rounds = [n for n, rule, _ in rules if rule == "round_number_clustering"]
    if rounds:
        names = ["priced_n", *[f"rounds{n}" for n in rounds]]
        rows = rows.crossJoin(F.broadcast(pairs.agg(*[F.sum(c).alias(c) for c in names])))
    if "overnight_turnaround" in ids:
        rows = _with_hours(rows)
    if flags:
        text = lambda details: F.map_from_arrays(F.array(*map(F.lit, details)), F.array(*[v.cast("string") for v in details.values()]))
        each = [F.when(when, F.struct(F.lit(n).alias("rule_ord"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), text(details).alias("details"))) for n, rule, (when, severity, details) in flags]
        seen = rows.select("contract_id", "supplier", "buyer", F.explode(F.array_compact(F.array(*each))).alias("f"))
        out.append(seen.select("f.rule_id", "f.severity", "contract_id", F.col("supplier").alias("vendor"), F.col("buyer").alias("institution"), "f.details", "f.rule_ord"))
    return reduce(DataFrame.unionByName, out)


def _severity(flags: DataFrame, key: str) -> DataFrame:
    known = flags.filter(nz(key).isNotNull())
    return known.groupBy(key).agg(F.round(F.least(F.lit(1.0), F.sum("severity")), 6).alias("severity"), F.count(F.lit(1)).alias("n_flags"))


def severity_by_contract(flags: DataFrame) -> DataFrame:
    return _severity(flags, "contract_id")


def severity_by_vendor(flags: DataFrame) -> DataFrame:
    return _severity(flags, "vendor")


def flags_for(flags: DataFrame, key: str, value: str) -> DataFrame:
    return flags.filter(nz(key) == value)


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_flags"))


def contract_severities(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Contracts with the severity that their flags add up to, capped at one."""
    return df.select("seq", "contract_id").join(severity_by_contract(flags).select("contract_id", "severity"), "contract_id")
