"""Data-quality rules. Each rule becomes a row of one ``checks`` table.

All rules of a dataset are evaluated in one aggregate pass. Example ids come from a second pass
over violating rows only, and at most five per rule leave each task.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.constants import (
    CREDIT_RESTRICTED_STATES, FEATURE_STORE_VERSION, FRAUD_CORRELATION_SIGNS, FRAUD_SIGNAL_DIRECTIONS,
    HOP_SENTINEL, TELEMATICS_SIGNALS, US_STATES,
)
from riskspark.functions.values import correlation

EXAMPLES = 5
NODE_LABELS = ["Claimant", "Claim", "Attorney", "Vehicle", "Entity"]
RELATIONSHIPS = ["FILED", "REPRESENTED_BY", "INVOLVES", "SHARES"]
CHECK_COLUMNS = ["check_id", "dataset", "status", "observed", "threshold", "n_bad", "examples"]


@dataclass
class Rule:
    """One check. ``violation`` is a row predicate; ``observed`` an aggregate (the violation count
    when absent); ``status`` maps the two columns (observed, n_bad) to a status."""

    check_id: str
    threshold: str
    violation: Column | None = None
    observed: Column | None = None
    status: object = None


def fail_on_rows(observed: Column, n_bad: Column) -> Column:
    return F.when(n_bad > 0, "FAIL").otherwise("PASS")


def warn_on_rows(observed: Column, n_bad: Column) -> Column:
    return F.when(n_bad > 0, "WARN").otherwise("PASS")


def info(observed: Column, n_bad: Column) -> Column:
    return F.lit("INFO")


def grade(fail=None, warn=None):
    """A status from tests on the observed value; a missing value is a skip."""

    def status(observed: Column, n_bad: Column) -> Column:
        chain = F.when(observed.isNull(), "SKIP")
        if fail is not None:
            chain = chain.when(fail(observed), "FAIL")
        if warn is not None:
            chain = chain.when(warn(observed), "WARN")
        return chain.otherwise("PASS")

    return status


def run_rules(df: DataFrame, dataset: str, id_column: str, rules: list[Rule]) -> DataFrame:
    aggregates = []
    for i, rule in enumerate(rules):
        bad = F.count_if(rule.violation) if rule.violation is not None else F.lit(None)
        seen = rule.observed if rule.observed is not None else bad
        aggregates += [bad.cast("bigint").alias(f"bad_{i}"), F.round(seen.cast("double"), 6).alias(f"seen_{i}")]
    one_row = df.agg(*aggregates)
    table = F.array(*[
        F.struct(
            F.lit(rule.check_id).alias("check_id"),
            F.lit(dataset).alias("dataset"),
            (rule.status or fail_on_rows)(F.col(f"seen_{i}"), F.col(f"bad_{i}")).alias("status"),
            F.col(f"seen_{i}").alias("observed"),
            F.lit(rule.threshold).alias("threshold"),
            F.col(f"bad_{i}").alias("n_bad"),
        )
        for i, rule in enumerate(rules)
    ])
    checks = one_row.select(F.inline(table))
    with_rows = [rule for rule in rules if rule.violation is not None]
    if not with_rows:
        return checks.withColumn("examples", F.lit(None).cast("string"))
    return checks.join(F.broadcast(_examples(df, id_column, with_rows)), "check_id", "left").select(CHECK_COLUMNS)


def _examples(df: DataFrame, id_column: str, rules: list[Rule]) -> DataFrame:
    """The smallest violating ids per rule. The rank limit is applied before the shuffle."""
    broken = F.array_compact(F.array(*[F.when(rule.violation, F.lit(rule.check_id)) for rule in rules]))
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.explode(broken).alias("check_id"))
    order = Window.partitionBy("check_id").orderBy("id")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EXAMPLES)
    return first.groupBy("check_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))


def failures(checks: DataFrame) -> DataFrame:
    """Failing and warning rules with how many further records their examples leave out."""
    more = F.greatest(F.col("n_bad") - EXAMPLES, F.lit(0))
    return checks.where(F.col("status").isin("FAIL", "WARN")).withColumn("n_more", more)


def _share(condition: Column, of: Column | None = None) -> Column:
    """Share of rows meeting a condition, among those meeting ``of``; null when there are none."""
    flag = condition if of is None else F.when(of, condition)
    return F.avg(F.coalesce(flag, F.when(of, F.lit(False)) if of is not None else F.lit(False)).cast("int"))


def _raw_telematics_mixed() -> Column:
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in TELEMATICS_SIGNALS])
    return ~missing.isin(0, len(TELEMATICS_SIGNALS))


def check_quotes(quotes: DataFrame) -> DataFrame:
    restricted = F.coalesce(F.col("state"), F.lit("")).isin(CREDIT_RESTRICTED_STATES)
    rules = [
        Rule("V1", "state in list", ~F.coalesce(F.col("state"), F.lit("")).isin(US_STATES)),
        Rule("V2", "[500,850]", (F.col("credit_score") < 500) | (F.col("credit_score") > 850)),
        Rule("V22", "all or none", _raw_telematics_mixed()),
        Rule("V23", "present", ~restricted & F.col("credit_score").isNull()),
        Rule("V23_restricted", "info", observed=F.count_if(restricted), status=info),
    ]
    if "claim_occurred" in quotes.columns:
        rate = F.avg(F.col("claim_occurred").cast("int"))
        rules.append(Rule("V3", "[0.02,0.25]", observed=rate, status=grade(warn=lambda o: (o < 0.02) | (o > 0.25))))
    else:
        rules.append(Rule("V3", "[0.02,0.25]", observed=F.lit(None), status=lambda o, b: F.lit("WARN")))
    return run_rules(quotes, "quotes", "quote_id", rules)


def check_claims(claims: DataFrame) -> DataFrame:
    fraud, loss = F.col("is_fraud"), F.col("incurred_loss_usd")
    rules = [
        Rule("V4", "[0.15,0.45]", observed=F.avg(fraud.cast("int")), status=grade(warn=lambda o: (o < 0.15) | (o > 0.45))),
        Rule("V5", ">=0", F.col("policy_inception_days") < 0),
        Rule("V6", ">=0", F.col("reporting_delay_days") < 0),
        Rule("V22", "all or none", _raw_telematics_mixed()),
    ]
    if "incurred_loss_usd" in claims.columns:
        gap = F.avg(F.when(fraud, loss)) - F.avg(F.when(~fraud, loss))
        rules += [
            Rule("V7", "not null", loss.isNull()),
            Rule("V7b", ">0", loss <= 0),
            Rule("V8", "fraud mean above", observed=gap, status=grade(warn=lambda o: o <= 0)),
        ]
    else:
        rules.append(Rule("V7", "not null", observed=F.lit(None), status=lambda o, b: F.lit("WARN")))
    return run_rules(claims, "claims", "claim_id", rules)


def check_graph_features(claims: DataFrame) -> DataFrame:
    hop, central, shared = (
        F.col("graph_hop_distance"), F.col("attorney_centrality_score"), F.col("shared_attribute_count"),
    )
    sentinel = hop == HOP_SENTINEL
    # A hop or shared count takes few distinct values, so an exact median holds a small map.
    real_hop = F.when(~sentinel, hop)
    rules = [
        Rule("V9", "0.2/0.5", observed=_share(sentinel), status=grade(fail=lambda o: o > 0.5, warn=lambda o: o > 0.2)),
        Rule("V9_min", "info", observed=F.min(real_hop), status=info),
        Rule("V9_median", "info", observed=F.median(real_hop), status=info),
        Rule("V9_max", "info", observed=F.max(real_hop), status=info),
        Rule("V10", "[0,1]", (central < 0) | (central > 1)),
        Rule("V11", ">=0", shared < 0),
        Rule("V39", "<1", observed=_share(sentinel), status=grade(warn=lambda o: o >= 1.0)),
    ]
    return run_rules(claims, "graph_features", "claim_id", rules)


def check_graph_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Emptiness, counts, fraud seeds and isolated claimants."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    # Stacked and grouped by node: one shuffle finds claimants no edge touches, without an anti join.
    stacked = nodes.select(
        "node_id", (F.col("label") == "Claimant").alias("claimant"), "is_fraud", F.lit(0).alias("touches")
    ).unionByName(ends.select(
        "node_id", F.lit(None).cast("boolean").alias("claimant"), F.lit(None).cast("boolean").alias("is_fraud"),
        F.lit(1).alias("touches"),
    ))
    # Claimant ids never repeat across labels. A mark of fixed width: the greatest of strings would have all ends sorted first.
    per_node = stacked.groupBy("node_id").agg(
        F.max("claimant").alias("claimant"), F.max("is_fraud").alias("is_fraud"), F.sum("touches").alias("degree")
    ).where(F.col("claimant").isNotNull())
    claimant = F.col("claimant")
    above_zero = grade(fail=lambda o: o == 0)
    rules = [
        Rule("V12_nodes", ">0", observed=F.count(F.lit(1)), status=above_zero),
        Rule("V12_edge_ends", ">0", observed=F.coalesce(F.sum("degree"), F.lit(0)), status=above_zero),
        Rule(
            "V13", "5", observed=F.count_if(claimant & F.col("is_fraud")),
            status=grade(fail=lambda o: o == 0, warn=lambda o: o < 5),
        ),
        Rule("V14", "0", claimant & (F.col("degree") == 0), status=warn_on_rows),
    ]
    return run_rules(per_node, "graph", "node_id", rules).unionByName(check_graph_counts(nodes, edges))


def check_graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each label and relationship type the graph can have, with its number of nodes or edges."""

    def counted(rows: DataFrame, column: str, kinds: list[str], prefix: str) -> DataFrame:
        one = rows.agg(*[F.count_if(F.col(column) == kind).alias(kind) for kind in kinds])
        cells = F.array(*[F.struct(F.lit(f"{prefix}_{kind}").alias("check_id"), F.col(kind).cast("double").alias("observed")) for kind in kinds])
        return one.select(F.inline(cells))

    # Bare pairs of ends have no type to count by.
    typed = edges if "rel_type" in edges.columns else edges.withColumn("rel_type", F.lit(None).cast("string"))
    found = counted(nodes, "label", NODE_LABELS, "V12_nodes").unionByName(counted(typed, "rel_type", RELATIONSHIPS, "V12_edges"))
    return found.select(
        "check_id", F.lit("graph").alias("dataset"), F.lit("INFO").alias("status"), "observed", F.lit("info").alias("threshold"),
        F.lit(None).cast("bigint").alias("n_bad"), F.lit(None).cast("string").alias("examples"),
    )


def check_entities(vehicles: DataFrame, persons: DataFrame, addresses: DataFrame, phones: DataFrame, policies: DataFrame) -> DataFrame:
    repeated = F.count("person_id") - F.count_distinct("person_id")
    parts = [
        run_rules(vehicles, "vehicles", "quote_id", [Rule("V16", "not null", F.col("vin").isNull())]),
        run_rules(persons, "persons", "person_id", [
            Rule("V17", "0", observed=repeated, status=grade(fail=lambda o: o > 0)),
        ]),
        run_rules(addresses, "addresses", "address_id", [Rule("V18", "not null", F.col("address_hash").isNull())]),
        run_rules(phones, "phones", "phone_id", [
            Rule("V19", "info", observed=F.avg(F.col("is_valid").cast("int")), status=info),
        ]),
        run_rules(policies, "policies", "policy_id", [
            Rule("V20", "inception<=expiration", F.col("inception_date") > F.col("expiration_date")),
        ]),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_presence(spark, paths: dict[str, str]) -> DataFrame:
    """One row per table name: FAIL when nothing is there."""
    from riskspark.sources.tables import MissingUpstreamTable, read

    rows = []
    for name, path in sorted(paths.items()):
        try:
            read(spark, path)
            rows.append(("V15", name, "PASS", 1.0, "present", 0, None))
        except MissingUpstreamTable:
            rows.append(("V15", name, "FAIL", 0.0, "present", 1, None))
    return spark.createDataFrame(
        rows, "check_id string, dataset string, status string, observed double, threshold string, n_bad bigint, examples string"
    )


def _as_number(claims: DataFrame, name: str) -> Column:
    return F.col(name).cast("int").cast("double") if dict(claims.dtypes)[name] == "boolean" else F.col(name).cast("double")


def check_fraud_signals(claims: DataFrame) -> DataFrame:
    """Directions of the class means, signs of the correlations, attorney and sentinel coherence."""
    fraud = F.col("is_fraud")
    label = fraud.cast("int").cast("double")
    rules = []
    for name, direction in FRAUD_SIGNAL_DIRECTIONS.items():
        if name not in claims.columns:
            rules.append(Rule(f"V24_{name}", direction, observed=F.lit(None), status=grade()))
            continue
        value = _as_number(claims, name)
        gap = F.avg(F.when(fraud, value)) - F.avg(F.when(~fraud, value))
        # Without rows of both classes nothing can be told apart: not a number, which fails.
        gap = F.when((F.count_if(fraud) > 0) & (F.count_if(~fraud) > 0), gap).otherwise(F.lit(float("nan")))
        inverted = (lambda o: F.isnan(o) | (o <= 0)) if direction == "greater" else (lambda o: F.isnan(o) | (o >= 0))
        rules.append(Rule(f"V24_{name}", direction, observed=gap, status=grade(fail=inverted)))
    for name, sign in FRAUD_CORRELATION_SIGNS.items():
        threshold = "positive" if sign > 0 else "negative"
        if name not in claims.columns:
            rules.append(Rule(f"V25_{name}", threshold, observed=F.lit(None), status=grade()))
            continue
        value = _as_number(claims, name)
        pairs = F.count_if(value.isNotNull() & label.isNotNull())
        r = correlation(value, label)
        rules.append(Rule(
            f"V25_{name}", threshold, observed=F.when(pairs >= 10, r),
            # Too weak to call comes before the sign test.
            status=lambda o, b, sign=sign: F.when(o.isNull(), "SKIP").when(F.abs(o) < 0.01, "WARN")
            .when(o * sign < 0, "FAIL").otherwise("PASS"),
        ))
    attorney, central = F.col("attorney_present"), F.col("attorney_centrality_score")
    sentinel = F.col("graph_hop_distance") == HOP_SENTINEL
    rules += [
        Rule("V28_zero", "0.2", observed=_share(central == 0, attorney), status=grade(warn=lambda o: o > 0.2)),
        Rule("V28_high", "0.1", observed=_share(central > 0.3, ~attorney), status=grade(warn=lambda o: o > 0.1)),
        Rule("V29_fraud", "0.3", observed=_share(sentinel, fraud), status=grade(fail=lambda o: o > 0.3)),
        Rule(
            "V29_gap", "legit above fraud", observed=_share(sentinel, ~fraud) - _share(sentinel, fraud),
            status=grade(warn=lambda o: o < 0),
        ),
    ]
    return run_rules(claims, "claims", "claim_id", rules)


def orphan_claims(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """Distinct quote ids of claims that no quote has."""
    wanted = claims.where(F.col("quote_id").isNotNull()).select("quote_id").distinct()
    return wanted.join(quotes.select("quote_id"), "quote_id", "left_anti")


def risk_agreement(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """Claim-quote pairs, and those whose issuance scores differ."""
    pairs = claims.select("claim_id", "quote_id", F.col("risk_score_at_issuance").alias("claim_risk")).join(
        quotes.select("quote_id", F.col("risk_score_at_issuance").alias("quote_risk")), "quote_id"
    )
    differs = F.abs(F.col("claim_risk") - F.col("quote_risk")) > 1e-6
    return pairs.select("claim_id", "quote_id", F.coalesce(differs, F.lit(False)).alias("differs"))


def check_spine(claims: DataFrame, quotes: DataFrame, suffix: str = "") -> DataFrame:
    orphans = run_rules(
        orphan_claims(claims, quotes), "claims", "quote_id", [Rule(f"V26{suffix}", "0", F.col("quote_id").isNotNull())]
    )
    agreement = run_rules(
        risk_agreement(claims, quotes), "claims", "claim_id", [Rule(f"V27{suffix}", "1e-6", F.col("differs"))]
    )
    return orphans.unionByName(agreement)


def trio_violations(available: Column, missing: Column, signals: list[Column]) -> dict[str, Column]:
    any_raw = F.coalesce(*signals).isNotNull()
    return {
        "available": available & ~any_raw,
        "missing": missing & available,
        "neither": ~available & ~missing & any_raw,
    }


def check_trio(features: DataFrame, dataset: str, id_column: str) -> DataFrame:
    """The derived telematics flags against the raw signals of flat feature rows."""
    broken = trio_violations(
        F.col("telematics_available"), F.col("telematics_enrolled_but_missing"), [F.col(c) for c in TELEMATICS_SIGNALS]
    )
    return run_rules(features, dataset, id_column, [Rule(f"V21_{k}", "0", v) for k, v in broken.items()])


def check_snapshots(snapshots: DataFrame, record_type: str) -> DataFrame:
    """Envelope, version, schema, mask, trio, ranges and NaN of one record type's snapshots.

    ``missing_envelope`` and ``missing_features`` columns, as the JSON loader adds them, take part
    in the key checks; for typed tables the schema decides.
    """
    quote = record_type == "quote"
    required = schemas.REQUIRED_QUOTE_FEATURES if quote else schemas.REQUIRED_CLAIM_FEATURES
    present = {f.name for f in snapshots.schema["features"].dataType}
    absent = [name for name in required if name not in present]

    def feature(name: str, dtype: str) -> Column:
        return F.col(f"features.{name}").cast(dtype) if name in present else F.lit(None).cast(dtype)

    no_keys = F.lit(False)
    if "missing_envelope" in snapshots.columns:
        no_keys = F.size("missing_envelope") > 0
    envelope = (
        no_keys | F.col("record_id").isNull() | F.col("timestamp").isNull()
        | F.coalesce(F.col("record_type") != record_type, F.lit(True)) | F.col("features").isNull()
    )
    if "_corrupt" in snapshots.columns:
        envelope = envelope | F.col("_corrupt").isNotNull()
    incomplete = F.size("missing_features") > 0 if "missing_features" in snapshots.columns else F.lit(bool(absent))
    doubles = [f.name for f in snapshots.schema["features"].dataType if f.dataType.typeName() == "double"]
    nan = reduce(lambda a, b: a | b, [F.coalesce(F.isnan(F.col(f"features.{c}")), F.lit(False)) for c in doubles])
    broken = trio_violations(
        feature("telematics_available", "boolean"), feature("telematics_enrolled_but_missing", "boolean"),
        [feature(c, "double") for c in TELEMATICS_SIGNALS],
    )
    risk = feature("risk_score_at_issuance", "double")
    if quote:
        age, ratio = feature("driver_age", "int"), feature("vehicle_msrp_power_ratio", "double")
        ranges = (risk < 0) | (risk > 1) | ((age > 0) & (age < 15)) | (ratio < 0)
    else:
        hop, central = feature("graph_hop_distance", "int"), feature("attorney_centrality_score", "double")
        ranges = reduce(lambda a, b: a | b, [
            feature(c, "int") < 0 for c in ("policy_inception_days", "reporting_delay_days", "shared_attribute_count")
        ]) | (central < 0) | (central > 1) | (hop < 0) | (hop == HOP_SENTINEL)
    sound = ~F.coalesce(envelope, F.lit(True))

    def among_sound(violation: Column) -> Column:
        return sound & F.coalesce(violation, F.lit(False))

    rules = [
        Rule("V30", "complete", ~sound),
        Rule("V31", FEATURE_STORE_VERSION, among_sound(~F.col("feature_store_version").eqNullSafe(FEATURE_STORE_VERSION))),
        Rule("V32", "all keys", among_sound(incomplete)),
        Rule("V34", "0", among_sound(reduce(lambda a, b: a | b, [F.coalesce(v, F.lit(False)) for v in broken.values()]))),
        Rule("V35", "in range", among_sound(ranges)),
        Rule("V36", "no NaN", among_sound(nan)),
    ]
    if quote:
        restricted = F.coalesce(F.col("state"), F.lit("")).isin(CREDIT_RESTRICTED_STATES)
        eligible = feature("credit_eligible", "boolean")
        masked = F.when(
            restricted, feature("credit_score", "int").isNotNull() | ~F.coalesce(~eligible, F.lit(False))
        ).otherwise(~F.coalesce(eligible, F.lit(False)))
        rules.append(Rule("V33", "masked", among_sound(masked)))
    else:
        missing = feature("telematics_enrolled_but_missing", "boolean")
        rules += [
            Rule("V37", "0", among_sound(risk.isNull()), status=warn_on_rows),
            Rule("V38", ">0", observed=F.count_if(missing), status=grade(fail=lambda o: o == 0)),
        ]
    return run_rules(snapshots, f"{record_type}_snapshots", "record_id", rules)


def check_snapshot_spine(claim_snapshots: DataFrame, quote_snapshots: DataFrame) -> DataFrame:
    """The issuance score of each claim snapshot against its quote's snapshot."""

    def flat(snapshots: DataFrame, id_column: str) -> DataFrame:
        return snapshots.select(
            F.col("record_id").alias(id_column), F.col("quote_id").alias("linked_quote"),
            F.col("features.risk_score_at_issuance").alias("risk_score_at_issuance"),
        )

    claims = flat(claim_snapshots, "claim_id").withColumnRenamed("linked_quote", "quote_id")
    return check_spine(claims, flat(quote_snapshots, "quote_id"), "_snapshots")
