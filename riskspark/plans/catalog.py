"""Registered queries over the test tables, each with its SQL twin where there is one."""

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.constants import MAX_HOPS, MODEL_FEATURES, TELEMATICS_SIGNALS
from riskspark.functions.scoring import policy_tier, rule_risk_score
from riskspark.functions.values import correlation
from riskspark.operators import components, entities, features, graph, metrics, models, monitor, ordered, quality, serving
from riskspark.operators.communities import label_communities
from riskspark.operators.components import connected_components
from riskspark.plans import oracle as sql
from riskspark.plans import pipeline
from riskspark.session import bound_tasks, clean_up, materialise, scratch_path, tune
from riskspark.sources import feature_store, graph_store
from riskspark.sources import fixture as fx
from riskspark.sources.tables import MissingUpstreamTable, read, write
from riskspark.streaming import bursts, late
from riskspark.streaming import features as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = date(2024, 6, 30)
STAMP = datetime(2024, 6, 30)
# A moment inside the events, so some keys have expired and some have not.
ONLINE_AT = "2024-01-30 12:00:00"
ONLINE_TTL = 6 * 3600
GIVEN = models.Calibration(a=1.1, b=-0.3, bias=1.2)


def query(body: str | None = None, needs: str = "", name: str | None = None):
    """Register a query under its function's name, with the SQL body of its twin."""

    def register(build):
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            bound_tasks(spark)
            clean_up(spark)
            return build(spark, sf_dir)

        QUERIES[key] = run
        if body is not None:
            ORACLES[key] = sql.assemble(body, needs)
        return build

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def as_text(df: DataFrame, *columns: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumns({c: F.date_format(c, pattern) for c in columns})


# Scalar projections ------------------------------------------------------------------------------

@query("SELECT quote_id, risk_score_at_issuance AS risk_score FROM quotes_scored", "quotes_scored", name="rule_risk_score")
def rule_risk(spark, sf):
    return fx.quotes(spark, sf).select("quote_id", rule_risk_score().alias("risk_score"))


@query("SELECT quote_id, policy_tier_at_issuance AS policy_tier FROM quotes", "quotes", name="policy_tier")
def policy_tiers(spark, sf):
    return fx.quotes(spark, sf).select("quote_id", policy_tier(F.col("risk_score_at_issuance")).alias("policy_tier"))


@query(f"""SELECT quote_id, {sql.SIGNALS}, {sql.ANY_SIGNAL} AS telematics_available,
 telematics_enrolled AND NOT ({sql.ANY_SIGNAL}) AS telematics_enrolled_but_missing FROM quotes""", "quotes")
def telematics_trio(spark, sf):
    quotes = fx.quotes(spark, sf)
    return quotes.select("quote_id", *[c.alias(n) for n, c in features.telematics_trio(quotes).items()])


@query(f"""SELECT quote_id, state, CASE WHEN state NOT IN {sql.RESTRICTED} THEN credit_score END AS credit_score,
 state NOT IN {sql.RESTRICTED} AS credit_eligible FROM quotes""", "quotes")
def regulatory_mask(spark, sf):
    return features.regulatory_mask(fx.quotes(spark, sf).select("quote_id", "state", "credit_score"))


_VECTOR = "* EXCLUDE (vin), CAST(NULL AS VARCHAR) AS vin"


@query(f"SELECT {_VECTOR} FROM quote_vectors", "quote_vectors")
def quote_features(spark, sf):
    return features.quote_features(fx.quotes(spark, sf))


@query("SELECT * EXCLUDE (state) FROM claim_vectors", "claim_vectors")
def claim_features(spark, sf):
    quotes = fx.quotes(spark, sf)
    return features.claim_features(fx.claims(spark, sf, quotes), quotes).drop("_state")


@query("""SELECT quote_id, vin, msrp AS vehicle_msrp, horsepower AS vehicle_power, adas_score AS vehicle_adas_score,
 vehicle_age_years FROM vehicles""", "vehicles")
def vehicle_override_join(spark, sf):
    quotes = fx.quotes(spark, sf)
    merged = features.override_vehicle(quotes, entities.vehicles(quotes))
    return merged.select("quote_id", "vin", "vehicle_msrp", "vehicle_power", "vehicle_adas_score", "vehicle_age_years")


def _flat_snapshot(snapshots: DataFrame) -> DataFrame:
    envelope = [c for c in snapshots.columns if c != "features"]
    names = [f.name for f in snapshots.schema["features"].dataType if f.name != "state"]
    flat = snapshots.select(*envelope, *[F.col(f"features.{n}").alias(n) for n in names])
    return as_text(flat, "timestamp", pattern="yyyy-MM-dd'T'HH:mm:ss'Z'")


_ENVELOPE = """AS record_id, '{0}' AS record_type, '2024-06-30T00:00:00Z' AS "timestamp", 'v1.0.0' AS feature_store_version, {1} AS regulatory_mask_applied"""


@query(f"SELECT quote_id {_ENVELOPE.format('quote', 'true')}, * FROM quote_vectors", "quote_vectors")
def quote_snapshot_rows(spark, sf):
    quotes = fx.quotes(spark, sf)
    merged = features.override_vehicle(quotes, entities.vehicles(quotes))
    return _flat_snapshot(features.snapshots(features.quote_features(merged), "quote", F.lit(STAMP)))


@query(f"SELECT claim_id {_ENVELOPE.format('claim', 'false')}, * EXCLUDE (claim_id) FROM claim_vectors_enriched", "claim_vectors_enriched")
def claim_snapshot_rows(spark, sf):
    quotes = materialise(fx.quotes(spark, sf), "quotes")
    vectors = features.claim_features(_enriched(spark, sf, quotes), quotes)
    return _flat_snapshot(features.snapshots(vectors, "claim", F.lit(STAMP)))


@query(f"""SELECT sum(credit_score) AS credit, count(*) AS n, round(sum(vehicle_msrp_power_ratio), 2) AS ratio,
 round(sum(telematics_enrolled), 2) AS enrolled FROM model_rows""", "model_rows")
def model_feature_totals(spark, sf):
    rows = features.model_features(fx.quotes(spark, sf))
    return rows.agg(
        F.sum("credit_score").alias("credit"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("vehicle_msrp_power_ratio"), 2).alias("ratio"), F.round(F.sum("telematics_enrolled"), 2).alias("enrolled"),
    )


# Entities ----------------------------------------------------------------------------------------

@query("SELECT * FROM vehicles", "vehicles")
def vin_decode(spark, sf):
    return entities.vehicles(fx.quotes(spark, sf))


@query("SELECT * FROM phone_links", "phone_links")
def phone_normalise(spark, sf):
    return entities.phone_links(fx.contacts(spark, sf))


@query("SELECT source_id, address_normalized, address_id FROM address_links", "address_links")
def address_normalise(spark, sf):
    return entities.address_links(fx.contacts(spark, sf)).select("source_id", "address_normalized", "address_id")


@query("SELECT source_id, role, person_id, CAST(('0x' || substr(person_id, 3, 16))::UBIGINT AS DECIMAL(20,0)) AS key_prefix FROM person_links", "person_links")
def person_bridge(spark, sf):
    links = entities.person_links(fx.contacts(spark, sf), fx.claimants(spark, sf))
    prefix = F.conv(F.substring("person_id", 3, 16), 16, 10).cast("decimal(20,0)")
    return links.select("source_id", "role", "person_id", prefix.alias("key_prefix"))


@query("SELECT * FROM persons", "persons")
def person_dedup(spark, sf):
    return entities.persons(entities.person_links(fx.contacts(spark, sf), fx.claimants(spark, sf)))


@query("SELECT * FROM addresses", "addresses")
def address_dedup(spark, sf):
    return entities.addresses(entities.address_links(fx.contacts(spark, sf)))


@query("SELECT * FROM phones", "phones")
def phone_dedup(spark, sf):
    return entities.phones(entities.phone_links(fx.contacts(spark, sf)))


@query("""SELECT policy_id, quote_id, strftime(inception_date, '%Y-%m-%d') AS inception_date,
 strftime(expiration_date, '%Y-%m-%d') AS expiration_date, status, is_lapsed FROM policies""", "policies")
def policy_dates(spark, sf):
    return as_text(entities.policies(fx.quotes(spark, sf), F.lit(AS_OF)), "inception_date", "expiration_date")


@query(f"""SELECT count(*) AS claims_with_policy, count(*) FILTER (WHERE p.inception_date > {sql.AS_OF}) AS claims_before_inception
 FROM claims_raw c JOIN policies p ON p.quote_id = c.quote_id""", "claims_raw policies")
def policy_claim_check(spark, sf):
    policies = entities.policies(fx.quotes(spark, sf), F.lit(AS_OF))
    return entities.claims_before_inception(fx.claim_lines(spark, sf), policies, F.lit(AS_OF))


# Graph -------------------------------------------------------------------------------------------

def _graph_rows(spark, sf, quotes: DataFrame | None = None) -> DataFrame:
    # The fixture groups line items by claim, so claim ids are unique already.
    return graph.resolve_graph_input(fx.graph_claims(spark, sf, quotes, graph.resolve_contacts), unique_claims=True)


def _graph(spark, sf, quotes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables, written once as the graph build does, then read by every feature."""
    rows = materialise(_graph_rows(spark, sf, quotes), "rows")
    return graph.graph_nodes(rows), materialise(graph.graph_edges(rows), "edges")


def _enriched(spark, sf, quotes: DataFrame | None = None) -> DataFrame:
    """``quotes`` are written ones: the graph, the claims and who calls read them."""
    quotes = materialise(fx.quotes(spark, sf), "quotes") if quotes is None else quotes
    return _with_graph_features(spark, sf, quotes, *_graph(spark, sf, quotes))


def _with_graph_features(spark, sf, quotes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with their graph features, which are written first: the shuffles behind them are gone when the wide rows travel.

    They meet the bare claim lines; the context of the quote comes last, so the rows lie by quote for who joins quotes again.
    """
    found = materialise(graph.graph_features(nodes, edges, MAX_HOPS), "features")
    rows = fx.claims(spark, sf, quotes, graph.merge_graph_features(fx.claim_lines(spark, sf), found))
    keys, added = ["claim_id", "quote_id"], found.columns[1:]
    return rows.select(*keys, *[c for c in rows.columns if c not in (*keys, *added)], *added)


@query("SELECT * FROM nodes", "nodes")
def graph_nodes(spark, sf):
    return graph.graph_nodes(_graph_rows(spark, sf))


@query("SELECT * FROM edges", "edges")
def graph_edges(spark, sf):
    return graph.graph_edges(_graph_rows(spark, sf))


def _upserted(spark, sf) -> str:
    """The graph in two batches. The first brings half of the claims, a tenth of them in an older state; the second the rest and
    those again as they are now. Attorneys, vehicles and contact values come in both. One batch is delivered twice."""
    rows = materialise(_graph_rows(spark, sf), "rows")
    turn = F.pmod(F.crc32("claim_id"), F.lit(20))
    older = rows.where(turn < 10).withColumns({"is_fraud": F.when(turn == 0, ~F.col("is_fraud")).otherwise(F.col("is_fraud")), "state": F.when(turn == 0, "??").otherwise(F.col("state"))})
    path = scratch_path(spark, "graph-store")
    for batch_id, batch in ((0, older), (1, rows.where((turn >= 10) | (turn == 0))), (0, older)):
        graph_store.upsert(graph.graph_nodes(batch), graph.graph_edges(batch), path, batch_id)
    return path


@query("SELECT * FROM nodes", "nodes")
def graph_upsert_nodes(spark, sf):
    return graph_store.nodes(spark, _upserted(spark, sf))


@query("SELECT * FROM edges", "edges")
def graph_upsert_edges(spark, sf):
    """Read after compaction."""
    path, target = _upserted(spark, sf), scratch_path(spark, "graph-compact")
    graph_store.compact(spark, path, target)
    return graph_store.edges(spark, target)


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label", "nodes")
def node_counts(spark, sf):
    return graph.node_counts(graph.graph_nodes(_graph_rows(spark, sf)))


@query("SELECT label, count(*) AS n, count(DISTINCT node_id) AS n_ids FROM nodes GROUP BY label", "nodes")
def node_uniqueness(spark, sf):
    """Nodes and distinct node ids by label: equal, also where contacts are spelled in several ways."""
    return graph.graph_nodes(_graph_rows(spark, sf)).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("n_ids"))


@query("SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type", "edges")
def edge_counts(spark, sf):
    return graph.edge_counts(graph.graph_edges(_graph_rows(spark, sf)))


@query("""SELECT rel_type, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes)
 GROUP BY rel_type""", "edges nodes")
def edge_integrity(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.edge_counts(graph.edges_with_both_ends(edges, nodes))


@query("SELECT * FROM shared_entities", "shared_entities")
def shared_entities(spark, sf):
    return graph.shared_entities(graph.graph_edges(_graph_rows(spark, sf)))


@query("""SELECT (SELECT count(*) FROM graph_rows) AS claims, (SELECT count(*) FROM graph_rows WHERE vin IS NULL) AS claims_without_vehicle, (SELECT count(*) FROM nodes WHERE label = 'Entity') AS entities,
 (SELECT count(*) FROM edges WHERE rel_type = 'SHARES') AS share_edges, (SELECT count(*) FROM claim_entities) AS claim_share_edges,
 (SELECT count(*) FROM shared_entities) AS entities_shared""", "graph_rows nodes edges claim_entities shared_entities")
def graph_load_report(spark, sf):
    rows = materialise(_graph_rows(spark, sf), "rows")
    return graph.load_report(rows, graph.graph_nodes(rows), graph.graph_edges(rows))


@query("""SELECT (SELECT count(*) FROM nodes WHERE label = 'Claim' AND is_fraud) AS fraud_claims,
 (SELECT count(DISTINCT c.entity_id) FROM claim_entities c JOIN nodes n ON n.node_id = c.claim_id AND n.is_fraud) AS fraud_entities""",
       "nodes claim_entities")
def fraud_reach(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.fraud_reach(nodes, edges)


@query("""SELECT n.node_id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id OR e.dst = n.node_id
 WHERE n.label = 'Claim' GROUP BY n.node_id""".replace("LEFT JOIN edges e ON e.src = n.node_id OR e.dst = n.node_id",
    "LEFT JOIN (SELECT src FROM edges UNION ALL SELECT dst FROM edges) e ON e.src = n.node_id"), "nodes edges")
def claim_degrees(spark, sf):
    rows = materialise(_graph_rows(spark, sf), "rows")
    return graph.claim_degrees(graph.graph_nodes(rows), graph.graph_edges(rows))


@query("SELECT attorney_id, degree, round(centrality, 9) AS centrality FROM centrality", "centrality")
def attorney_degree_centrality(spark, sf):
    rows = materialise(_graph_rows(spark, sf), "rows")
    return rounded(graph.attorney_centrality(graph.graph_nodes(rows), graph.graph_edges(rows)), "centrality", places=9)


@query("SELECT claim_id, round(attorney_centrality_score, 9) AS attorney_centrality_score FROM claim_centrality", "claim_centrality")
def claim_attorney_centrality(spark, sf):
    rows = materialise(_graph_rows(spark, sf), "rows")
    found = graph.claim_attorney_centrality(graph.graph_nodes(rows), graph.graph_edges(rows))
    return rounded(found, "attorney_centrality_score", places=9)


@query("SELECT * FROM claim_shared", "claim_shared")
def shared_attribute_count(spark, sf):
    rows = materialise(_graph_rows(spark, sf), "rows")
    return graph.shared_attribute_counts(graph.graph_nodes(rows), graph.graph_edges(rows))


@query("SELECT * FROM claim_hops", "claim_hops")
def fraud_hop_distance(spark, sf):
    return graph.fraud_hop_distance(*_graph(spark, sf), MAX_HOPS)


@query("SELECT * FROM graph_features", "graph_features")
def graph_features(spark, sf):
    return graph.graph_features(*_graph(spark, sf), MAX_HOPS)


@query("SELECT * EXCLUDE (telematics_available) FROM claims_enriched", "claims_enriched")
def claims_enriched(spark, sf):
    return _enriched(spark, sf)


def _vote_sql(rounds: int) -> tuple[str, str]:
    """Unrolled rounds of label votes: the label most neighbours carry, the smallest on a tie."""
    sql.part("votes_0", "adjacent", "SELECT DISTINCT src AS node_id, src AS community FROM adjacent")
    for i in range(1, rounds + 1):
        sql.part(f"votes_{i}", f"votes_{i - 1} adjacent", f"""
SELECT node_id, community FROM (SELECT a.dst AS node_id, v.community, count(*) AS n FROM adjacent a JOIN votes_{i - 1} v ON v.node_id = a.src GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, community) = 1""")
    return f"SELECT * FROM votes_{rounds}", f"votes_{rounds}"


@query(*_vote_sql(3))
def label_votes(spark, sf):
    """Three rounds of votes over the whole graph."""
    return label_communities(_graph(spark, sf)[1], rounds=3)


def _ties(edges: DataFrame) -> DataFrame:
    """Edges that tie claims together: all but representation, as an attorney's clients are no ring."""
    return edges.where(F.col("rel_type") != "REPRESENTED_BY")


@query("SELECT node_id, community FROM communities", "communities")
def communities(spark, sf):
    """Claims, claimants, vehicles and contact values that hang together, to a fixed point."""
    return connected_components(_ties(_graph(spark, sf)[1]))


@query("""SELECT community, n_claims, n_fraud, n_entities, round(n_fraud / n_claims, 6) AS fraud_share FROM (
 SELECT c.community, count(*) FILTER (WHERE label = 'Claim') AS n_claims, count(*) FILTER (WHERE label = 'Claim' AND is_fraud) AS n_fraud,
 count(*) FILTER (WHERE label = 'Entity') AS n_entities FROM communities c JOIN nodes n ON n.node_id = c.node_id GROUP BY 1) WHERE n_claims >= 2""", "communities nodes")
def community_risk(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(components.community_risk(connected_components(_ties(edges)), nodes), "fraud_share")


# Profiles, spine and quality ---------------------------------------------------------------------

@query("""SELECT count(*) AS n, count(DISTINCT state) AS states, min(risk_score_at_issuance) AS risk_min, max(risk_score_at_issuance) AS risk_max,
 round(avg(CAST(claim_occurred AS INT)), 6) AS claim_rate FROM quotes""", "quotes")
def profile_quotes(spark, sf):
    return rounded(fx.quotes(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("state").alias("states"),
        F.min("risk_score_at_issuance").alias("risk_min"), F.max("risk_score_at_issuance").alias("risk_max"),
        F.avg(F.col("claim_occurred").cast("int")).alias("claim_rate"),
    ), "claim_rate")


@query("""SELECT count(*) AS n, round(avg(CAST(is_fraud AS INT)), 6) AS fraud_rate, round(avg(incurred_loss_usd), 4) AS loss_mean,
 round(quantile_cont(incurred_loss_usd, 0.5), 4) AS loss_p50, round(quantile_cont(incurred_loss_usd, 0.95), 4) AS loss_p95,
 round(avg(incurred_loss_usd) FILTER (WHERE is_fraud), 4) AS loss_fraud, round(avg(incurred_loss_usd) FILTER (WHERE NOT is_fraud), 4) AS loss_legit
 FROM claims_raw""", "claims_raw")
def profile_claims(spark, sf):
    claims, loss = fx.claim_lines(spark, sf), F.col("incurred_loss_usd")
    spread = ordered.exact_quantiles(claims, "incurred_loss_usd", {"loss_p50": 0.5, "loss_p95": 0.95})
    one = metrics.beside(claims.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"), F.avg(loss).alias("loss_mean"),
        F.avg(F.when(F.col("is_fraud"), loss)).alias("loss_fraud"), F.avg(F.when(~F.col("is_fraud"), loss)).alias("loss_legit"),
    ), spread)
    return rounded(rounded(one, "fraud_rate"), "loss_mean", "loss_p50", "loss_p95", "loss_fraud", "loss_legit", places=4)


@query("""SELECT count(DISTINCT c.quote_id) AS claim_quotes, count(DISTINCT c.quote_id) FILTER (WHERE q.quote_id IS NULL) AS orphans
 FROM claims_raw c LEFT JOIN quotes q ON q.quote_id = c.quote_id""", "claims_raw quotes")
def orphan_claims(spark, sf):
    claims, quotes = fx.claim_lines(spark, sf), fx.quotes(spark, sf)
    orphans = quality.orphan_claims(claims, quotes).agg(F.count(F.lit(1))).scalar()
    return claims.agg(F.count_distinct("quote_id").alias("claim_quotes")).withColumn("orphans", orphans)


@query("SELECT quote_id FROM quotes WHERE quote_id NOT IN (SELECT quote_id FROM claims_raw)", "quotes claims_raw")
def quotes_without_claims(spark, sf):
    return serving.without_keys(fx.quotes(spark, sf).select("quote_id"), fx.claim_lines(spark, sf), "quote_id")


@query("""SELECT count(*) AS pairs, count(*) FILTER (WHERE abs(c.risk_score_at_issuance - q.risk_score_at_issuance) > 1e-6) AS differing
 FROM claims c JOIN quotes q ON q.quote_id = c.quote_id""", "claims quotes")
def risk_agreement(spark, sf):
    quotes = fx.quotes(spark, sf)
    pairs = quality.risk_agreement(fx.claims(spark, sf, quotes), quotes)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("differs").alias("differing"))


def quality_query(name: str):
    rules, needs = sql.QUALITY[name]
    return query(" UNION ALL ".join(rules), needs)


@quality_query("quality_quotes")
def quality_quotes(spark, sf):
    return quality.check_quotes(fx.quotes(spark, sf))


@quality_query("quality_claims")
def quality_claims(spark, sf):
    return quality.check_claims(fx.claims(spark, sf))


@quality_query("quality_graph_features")
def quality_graph_features(spark, sf):
    return quality.check_graph_features(_enriched(spark, sf))


@quality_query("quality_graph_topology")
def quality_graph_topology(spark, sf):
    return quality.check_graph_topology(*_graph(spark, sf))


def _entity_checks(quotes: DataFrame, contacts: DataFrame, claimants: DataFrame) -> DataFrame:
    return quality.check_entities(
        entities.vehicles(quotes), entities.persons(entities.person_links(contacts, claimants)),
        entities.addresses(entities.address_links(contacts)), entities.phones(entities.phone_links(contacts)),
        entities.policies(quotes, F.lit(AS_OF)),
    )


@quality_query("quality_entities")
def quality_entities(spark, sf):
    return _entity_checks(fx.quotes(spark, sf), fx.contacts(spark, sf), fx.claimants(spark, sf))


@quality_query("quality_spine")
def quality_spine(spark, sf):
    quotes = fx.quotes(spark, sf)
    return quality.check_spine(fx.claims(spark, sf, quotes), quotes)


def _with_availability(claims: DataFrame) -> DataFrame:
    return claims.withColumn("telematics_available", features.telematics_trio(claims)["telematics_available"])


@quality_query("quality_fraud_signals")
def quality_fraud_signals(spark, sf):
    return quality.check_fraud_signals(_with_availability(_enriched(spark, sf)))


@quality_query("quality_trio")
def quality_trio(spark, sf):
    return _trio_checks(fx.quotes(spark, sf), fx.claims(spark, sf))


def _trio_checks(quotes: DataFrame, claims: DataFrame) -> DataFrame:
    on_quotes = quality.check_trio(features.quote_features(quotes), "quotes", "quote_id")
    return on_quotes.unionByName(quality.check_trio(features.claim_features(claims, quotes), "claims", "claim_id"))


@quality_query("quality_quote_snapshots")
def quality_quote_snapshots(spark, sf):
    return quality.check_snapshots(
        features.snapshots(features.quote_features(fx.quotes(spark, sf)), "quote", F.lit(STAMP)), "quote"
    )


@quality_query("quality_claim_snapshots")
def quality_claim_snapshots(spark, sf):
    quotes = materialise(fx.quotes(spark, sf), "quotes")
    vectors = features.claim_features(_enriched(spark, sf, quotes), quotes)
    return quality.check_snapshots(features.snapshots(vectors, "claim", F.lit(STAMP)), "claim")


@quality_query("quality_snapshot_spine")
def quality_snapshot_spine(spark, sf):
    quotes = fx.quotes(spark, sf)
    vectors = features.claim_features(fx.claims(spark, sf, quotes), quotes)
    return quality.check_snapshot_spine(
        features.snapshots(vectors, "claim", F.lit(STAMP)),
        features.snapshots(features.quote_features(quotes), "quote", F.lit(STAMP)),
    )


_CHECK_GROUPS = [
    "quality_quotes", "quality_claims", "quality_graph_features", "quality_fraud_signals", "quality_spine", "quality_graph_topology",
    "quality_entities", "quality_trio", "quality_quote_snapshots", "quality_claim_snapshots", "quality_snapshot_spine",
]


@query(
    " UNION ALL ".join(rule for name in _CHECK_GROUPS for rule in sql.QUALITY[name][0]),
    " ".join(sql.QUALITY[name][1] for name in _CHECK_GROUPS),
)
def quality_checks(spark, sf):
    """Every group of rules over tables that are written once: quotes, the graph, the enriched claims and both kinds of snapshots."""
    quotes = materialise(fx.quotes(spark, sf), "quotes")
    contacts = fx.contacts(spark, sf)
    rows = materialise(graph.resolve_graph_input(fx.graph_claims(spark, sf, quotes, graph.resolve_contacts), unique_claims=True), "rows")
    nodes, edges = materialise(graph.graph_nodes(rows), "nodes"), materialise(graph.graph_edges(rows), "edges")
    claims = materialise(_with_availability(_with_graph_features(spark, sf, quotes, nodes, edges)), "claims")
    quote_snapshots = materialise(features.snapshots(features.quote_features(quotes), "quote", F.lit(STAMP)), "snapshots")
    claim_snapshots = materialise(features.snapshots(features.claim_features(claims, quotes), "claim", F.lit(STAMP)), "snapshots")
    return reduce(DataFrame.unionByName, [
        quality.check_quotes(quotes), quality.check_claims(claims), quality.check_graph_features(claims),
        quality.check_fraud_signals(claims), quality.check_spine(claims, quotes), quality.check_graph_topology(nodes, edges),
        _entity_checks(quotes, contacts, fx.claimants(spark, sf)),
        quality.check_trio(quote_snapshots.select("quote_id", "features.*"), "quotes", "quote_id"),
        quality.check_trio(claim_snapshots.select(F.col("record_id").alias("claim_id"), "features.*"), "claims", "claim_id"),
        quality.check_snapshots(quote_snapshots, "quote"), quality.check_snapshots(claim_snapshots, "claim"),
        quality.check_snapshot_spine(claim_snapshots, quote_snapshots),
    ])


# Metrics -----------------------------------------------------------------------------------------

def _scored(spark, sf) -> DataFrame:
    """A fixed score stands in for a model's, so each metric itself can be checked exactly."""
    return fx.quotes(spark, sf).select(
        "quote_id", "claim_occurred", F.col("risk_score_at_issuance").alias("p"),
        F.col("prior_loss_severity_avg").alias("e_cost"), "policy_tier_at_issuance",
    )


def _costed(spark, sf) -> DataFrame:
    quotes = fx.quotes(spark, sf).select("quote_id", F.col("prior_loss_severity_avg").alias("predicted"))
    claims = fx.claim_lines(spark, sf).select("quote_id", F.col("incurred_loss_usd").alias("actual"))
    return claims.join(quotes, "quote_id").select("actual", "predicted")


_BINS = """(SELECT least(floor(p * 10), 9) AS b, avg(p) AS predicted, avg(CAST(claim_occurred AS INT)) AS actual, count(*) AS n FROM scored GROUP BY 1)"""


@query(f"""SELECT round(b / 10, 2) AS bin_lower, round((b + 1) / 10, 2) AS bin_upper, round(predicted, 4) AS predicted_freq,
 round(actual, 4) AS actual_freq, n AS "count" FROM {_BINS}""", "scored")
def reliability_bins(spark, sf):
    return metrics.reliability_bins(_scored(spark, sf), "claim_occurred", "p")


@query(f"SELECT round(sum(n * abs(actual - predicted)) / sum(n), 6) AS ece FROM {_BINS}", "scored")
def ece(spark, sf):
    return rounded(metrics.expected_calibration_error(_scored(spark, sf), "claim_occurred", "p"), "ece")


@query("SELECT round(avg(power(CAST(claim_occurred AS INT) - p, 2)), 6) AS brier FROM scored", "scored")
def brier(spark, sf):
    return rounded(metrics.brier(_scored(spark, sf), "claim_occurred", "p"), "brier")


@query("""SELECT round(avg(CASE WHEN claim_occurred THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss
 FROM (SELECT claim_occurred, least(1 - CAST(1e-15 AS DOUBLE), greatest(CAST(1e-15 AS DOUBLE), p)) AS q FROM scored)""", "scored")
def log_loss(spark, sf):
    return rounded(metrics.log_loss(_scored(spark, sf), "claim_occurred", "p"), "log_loss")


@query(f"SELECT round(a, 6) AS auc, round(2 * a - 1, 6) AS gini FROM (SELECT {sql.auc('scored', 'claim_occurred', 'p')} AS a)", "scored")
def auc_gini(spark, sf):
    scored = materialise(_scored(spark, sf).select("p", "claim_occurred"), "scored")
    return rounded(metrics.auc_gini(scored, "claim_occurred", "p"), "auc", "gini")


@query("""SELECT count(*) FILTER (WHERE claim_occurred) AS total_positives, count(*) FILTER (WHERE NOT claim_occurred) AS total_negatives,
 round(CAST(count(*) FILTER (WHERE NOT claim_occurred) AS DOUBLE) / count(*) FILTER (WHERE claim_occurred), 6) AS scale_pos_weight FROM scored""", "scored")
def class_balance(spark, sf):
    return rounded(metrics.class_balance(_scored(spark, sf), "claim_occurred"), "scale_pos_weight")


@query("""SELECT CASE WHEN ('0x' || substr(sha256(quote_id), 1, 8))::UBIGINT % 100 < 80 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n,
 count(*) FILTER (WHERE claim_occurred) AS positives FROM scored GROUP BY 1""", "scored")
def holdout_split(spark, sf):
    return models.split_report(_scored(spark, sf), "claim_occurred")


@query("""SELECT round(avg(abs(actual - predicted)), 4) AS mae_usd, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse_usd,
 round(avg(abs((actual - predicted) / nullif(actual, 0))), 6) AS mape FROM costed""", "costed")
def severity_errors(spark, sf):
    found = metrics.severity_errors(_costed(spark, sf), "actual", "predicted")
    return rounded(rounded(found, "mae_usd", "rmse_usd", places=4), "mape")


@query("SELECT round(avg(actual) / avg(predicted), 6) AS bias_correction FROM costed", "costed")
def bias_correction(spark, sf):
    return rounded(metrics.bias_correction(_costed(spark, sf), "actual", "predicted"), "bias_correction")


@query("""SELECT round(max(b), 6) AS bias_correction, round(avg(abs(actual - predicted)), 4) AS mae_before_usd,
 round(avg(abs(actual - predicted * b)), 4) AS mae_after_usd, round(sqrt(avg(power(actual - predicted, 2))), 4) AS rmse_before_usd,
 round(sqrt(avg(power(actual - predicted * b, 2))), 4) AS rmse_after_usd, round(avg(actual), 4) AS mean_actual_usd,
 round(avg(predicted), 4) AS mean_predicted_before_usd, round(avg(predicted * b), 4) AS mean_predicted_after_usd
 FROM costed, (SELECT avg(actual) / avg(predicted) AS b FROM costed)""", "costed")
def severity_calibration_report(spark, sf):
    found = metrics.severity_calibration_report(_costed(spark, sf), "actual", "predicted")
    return rounded(rounded(found, *[c for c in found.columns if c != "bias_correction"], places=4), "bias_correction")


def _hurdle(spark, sf) -> DataFrame:
    return models.apply_hurdle(_scored(spark, sf), GIVEN)


@query("SELECT quote_id, round(p_claim, 9) AS p_claim, round(e_cost_usd, 6) AS e_cost_usd, round(risk_score, 5) AS risk_score FROM hurdle", "hurdle")
def hurdle_score_given_params(spark, sf):
    scored = _hurdle(spark, sf).select("quote_id", "p_claim", "e_cost_usd", "risk_score")
    return rounded(rounded(rounded(scored, "p_claim", places=9), "e_cost_usd"), "risk_score", places=5)


@query("""SELECT round(avg(risk_score), 4) AS risk_score_mean, round(quantile_cont(risk_score, 0.5), 4) AS risk_score_p50,
 round(quantile_cont(risk_score, 0.95), 4) AS risk_score_p95, round(avg(p_claim), 6) AS p_claim_mean, round(avg(e_cost_usd), 4) AS e_cost_mean_usd FROM hurdle""", "hurdle")
def risk_distribution(spark, sf):
    found = metrics.score_distribution(materialise(_hurdle(spark, sf), "hurdle"))
    return rounded(rounded(found, *[c for c in found.columns if c != "p_claim_mean"], places=4), "p_claim_mean")


@query("""SELECT 'hurdle' AS model, metric, round(value, 4) AS value FROM (SELECT avg(risk_score) AS risk_score_mean, avg(p_claim) AS p_claim_mean,
 avg(e_cost_usd) AS e_cost_mean_usd FROM hurdle) UNPIVOT (value FOR metric IN (risk_score_mean, p_claim_mean, e_cost_mean_usd))""", "hurdle")
def metric_rows(spark, sf):
    one = _hurdle(spark, sf).agg(
        F.avg("risk_score").alias("risk_score_mean"), F.avg("p_claim").alias("p_claim_mean"), F.avg("e_cost_usd").alias("e_cost_mean_usd")
    )
    return rounded(metrics.to_metric_rows(one, "hurdle"), "value", places=4)


def _gains(rows: DataFrame, label: str) -> DataFrame:
    """A gain per feature from the data itself: the size of its correlation with the label."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in MODEL_FEATURES])
    long = rows.select(F.col(label).cast("double").alias("y"), F.inline(cells))
    return long.groupBy("feature").agg(
        F.coalesce(F.abs(correlation(F.col("value"), F.col("y"))), F.lit(0.0)).alias("gain")
    )


def _gains_sql(where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(abs(CASE WHEN isnan(r) THEN 0 ELSE r END), 0) AS gain FROM (SELECT corr({c}, CAST(CAST(claim_occurred AS INT) AS DOUBLE)) AS r FROM model_rows WHERE {where})"
        for c in MODEL_FEATURES
    )


def _frequency_rows(spark, sf) -> DataFrame:
    return features.model_features(fx.quotes(spark, sf), ("quote_id", F.col("claim_occurred").cast("int").alias("claim_occurred")))


@query(f"SELECT feature, round(gain / (sum(gain) OVER ()) * 100, 2) AS importance_pct FROM ({_gains_sql()})", "model_rows")
def importance_share_given_gains(spark, sf):
    return metrics.importance_share(_gains(_frequency_rows(spark, sf), "claim_occurred"))


# Weights and means handed to the reason-code query.
REASON_WEIGHTS = models.ReasonWeights(
    weights=dict(zip(MODEL_FEATURES, [-0.01, 0.8, 0.0001, 0.01, 0.3, 0.05, -0.02, -0.01, -0.001, -0.5, 0.03, 0.4, 0.00002, 0.9, 0.7, -0.4, 0.2, -0.1])),
    means=dict(zip(MODEL_FEATURES, [680, 0.4, 900, 60, 2.0, 3.0, 40, 20, 300, 0.5, 8, 0.3, 15000, 0.2, 0.2, 0.9, 0.6, 0.2])),
)
_PART = "coalesce(CAST({w!r} AS DOUBLE) * ({c} - CAST({m!r} AS DOUBLE)), CAST(0 AS DOUBLE))"
_PARTS = {c: _PART.format(w=REASON_WEIGHTS.weights[c], c=c, m=float(REASON_WEIGHTS.means[c])) for c in MODEL_FEATURES}
_TOTAL = " + ".join(f"abs({p})" for p in _PARTS.values())


@query(f"""SELECT quote_id, rank, feature, round(contribution, 9) AS contribution, pct FROM (
 SELECT quote_id, feature, contribution, round(contribution / total * 100, 1) AS pct,
 row_number() OVER (PARTITION BY quote_id ORDER BY abs(contribution) DESC, place) AS rank FROM (
 {" UNION ALL ".join(f"SELECT quote_id, '{c}' AS feature, {i} AS place, {p} AS contribution, {_TOTAL} AS total FROM model_rows" for i, (c, p) in enumerate(_PARTS.items()))}
 )) WHERE rank <= 5""", "model_rows")
def reason_codes_given_weights(spark, sf):
    coded = models.reason_codes(_frequency_rows(spark, sf), REASON_WEIGHTS, 5)
    exploded = coded.select("quote_id", F.posexplode("reason_codes").alias("pos", "code"))
    return exploded.select(
        "quote_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "code.feature",
        F.round("code.contribution", 9).alias("contribution"), "code.pct",
    )


# Models: fitted once for a session and a set of tables, then loaded by every query that needs them ----

_WORKSPACES: dict[tuple[str, str], pipeline.Workspace] = {}


def _workspace(spark, sf) -> pipeline.Workspace:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WORKSPACES:
        ws = pipeline.Workspace(scratch_path(spark, "models"))
        write(fx.quotes(spark, sf), ws.path("quotes"))
        write(fx.claim_lines(spark, sf), ws.path("claims"))
        _WORKSPACES[key] = ws
    return _WORKSPACES[key]


def _fitted(spark, sf, *names: str) -> pipeline.Workspace:
    """A workspace that holds the models named, each fitted with the library's own setting."""
    ws = _workspace(spark, sf)
    steps = {"frequency": pipeline.train_frequency, "severity": pipeline.train_severity, "calibration": pipeline.calibrate}
    for name in names:
        try:
            read(spark, ws.path("models/calibration" if name == "calibration" else f"models/{name}_importance"))
        except MissingUpstreamTable:
            steps[name](spark, ws)
    return ws


def _model_table(spark, sf, table: str, *needs: str) -> DataFrame:
    return read(spark, _fitted(spark, sf, *needs).path(f"models/{table}"))


@query()
def train_frequency(spark, sf):
    return _model_table(spark, sf, "frequency_metrics", "frequency")


_BUCKET = "('0x' || substr(sha256(quote_id), {}, 8))::UBIGINT % 100"


@query(f"""SELECT metric, round(value, 6) AS value FROM (SELECT
 CAST(count(*) FILTER (WHERE claim_occurred) AS DOUBLE) AS total_positives, CAST(count(*) FILTER (WHERE NOT claim_occurred) AS DOUBLE) AS total_negatives,
 CAST(count(*) FILTER (WHERE NOT claim_occurred) AS DOUBLE) / count(*) FILTER (WHERE claim_occurred) AS scale_pos_weight,
 CAST(count(*) FILTER (WHERE t) AS DOUBLE) AS train_rows, CAST(count(*) FILTER (WHERE t AND claim_occurred) AS DOUBLE) AS train_positives,
 CAST(count(*) FILTER (WHERE t AND v) AS DOUBLE) AS validation_rows
 FROM (SELECT claim_occurred, {_BUCKET.format(1)} < 80 AS t, {_BUCKET.format(9)} < 10 AS v FROM quotes))
 UNPIVOT (value FOR metric IN (total_positives, total_negatives, scale_pos_weight, train_rows, train_positives, validation_rows))""", "quotes")
def train_frequency_counts(spark, sf):
    """What the fit was made from: classes, their weight, and the rows of each part."""
    rows = _model_table(spark, sf, "frequency_metrics", "frequency")
    wanted = ["total_positives", "total_negatives", "scale_pos_weight", "train_rows", "train_positives", "validation_rows"]
    return rounded(rows.where(F.col("metric").isin(wanted)).select("metric", "value"), "value")


@query()
def frequency_importance(spark, sf):
    return _model_table(spark, sf, "frequency_importance", "frequency").orderBy(F.desc("importance_pct"), "feature")


@query()
def train_severity(spark, sf):
    return _model_table(spark, sf, "severity_metrics", "severity")


@query()
def calibrate_platt(spark, sf):
    return _model_table(spark, sf, "frequency_calibration_metrics", "frequency", "severity", "calibration")


@query()
def calibrate_severity(spark, sf):
    return _model_table(spark, sf, "severity_calibration_metrics", "frequency", "severity", "calibration")


@query(f"""SELECT (SELECT round(avg(CAST(claim_occurred AS INT)), 6) FROM quotes WHERE {_BUCKET.format(1)} >= 80) AS actual_claim_rate,
 (SELECT round(avg(incurred_loss_usd), 4) FROM claims_raw JOIN (SELECT quote_id FROM quotes) USING (quote_id) WHERE {_BUCKET.format(1)} >= 80) AS mean_actual_usd,
 true AS platt_keeps_the_rate, true AS bias_keeps_the_mean""", "quotes claims_raw")
def calibration_on_holdout(spark, sf):
    """Both calibrations are fitted on the held-out part: its claim rate and mean cost are what calibrated scores average to."""
    ws = _fitted(spark, sf, "frequency", "severity", "calibration")
    found = {r.metric: r.value for name in ("frequency", "severity") for r in read(spark, ws.path(f"models/{name}_calibration_metrics")).collect()}
    rate, cost = found["actual_claim_rate"], found["mean_actual_usd"]
    return spark.range(1).select(
        F.round(F.lit(rate), 6).alias("actual_claim_rate"), F.round(F.lit(cost), 4).alias("mean_actual_usd"),
        F.lit(abs(found["p_claim_mean_after"] - rate) < 1e-3).alias("platt_keeps_the_rate"),
        F.lit(abs(found["mean_predicted_after_usd"] / cost - 1) < 1e-6).alias("bias_keeps_the_mean"))


def _hurdle_model(spark, sf):
    ws = _fitted(spark, sf, "frequency", "severity", "calibration")
    return pipeline.load_model(spark, ws), read(spark, ws.path("quotes"))


@query()
def hurdle_eval(spark, sf):
    return models.evaluate(*_hurdle_model(spark, sf))


@query()
def hurdle_scores(spark, sf):
    """Calibrated probability, cost and their product for every quote."""
    model, quotes = _hurdle_model(spark, sf)
    return model.score(quotes)


@query("SELECT count(*) AS n, count(*) AS probabilities, count(*) AS costs, count(*) AS products FROM quotes", "quotes")
def hurdle_score_bounds(spark, sf):
    """How many scores keep to their bounds: all of them."""
    p, cost, risk = (F.col(c) for c in ("p_claim", "e_cost_usd", "risk_score"))
    return hurdle_scores(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((p >= 0) & (p <= 1)).alias("probabilities"),
        F.count_if((cost > 0) & (cost < float("inf"))).alias("costs"), F.count_if(F.abs(risk - p * cost) <= 1e-9 * risk).alias("products"))


@query()
def explain_quotes(spark, sf):
    """Reason codes of the logistic surrogate; ``surrogate_agreement`` tells how far it follows the trees."""
    quotes = read(spark, _workspace(spark, sf).path("quotes"))
    coded = models.reason_codes(models.frequency_rows(quotes), models.fit_reason_weights(quotes), 3)
    return coded.select("quote_id", F.to_json("reason_codes").alias("surrogate_reason_codes"))


@query()
def surrogate_agreement(spark, sf):
    ws = _fitted(spark, sf, "frequency")
    quotes = read(spark, ws.path("quotes"))
    frequency = PipelineModel.load(ws.path("models/frequency"))
    return models.surrogate_agreement(frequency, quotes, models.fit_reason_weights(quotes))


@query("""SELECT round(corr(a, b), 6) AS rank_agreement FROM (SELECT rank() OVER (ORDER BY risk_score_at_issuance) + (count(*) OVER (PARTITION BY risk_score_at_issuance) - 1) / 2.0 AS a,
 rank() OVER (ORDER BY violation_severity_index) + (count(*) OVER (PARTITION BY violation_severity_index) - 1) / 2.0 AS b FROM quotes)""", "quotes")
def rank_agreement(spark, sf):
    return rounded(metrics.rank_agreement(fx.quotes(spark, sf), "risk_score_at_issuance", "violation_severity_index"), "rank_agreement")


# Serving -----------------------------------------------------------------------------------------

def _online_rows(spark, sf) -> DataFrame:
    events = fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"),
        F.col("event_type").alias("features"), F.col("ts").cast("timestamp_ntz").alias("updated_at"),
    )
    return serving.with_expiry(events, ONLINE_TTL)


_LATEST = """(SELECT CAST(user_id AS VARCHAR) AS key, event_id AS version, event_type AS features, ts AS updated_at FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
_SHOWN = "key, version, features, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def _shown(rows: DataFrame) -> DataFrame:
    return as_text(rows.drop("expires_at"), "updated_at", pattern="yyyy-MM-dd HH:mm:ss")


@query(f"SELECT {_SHOWN} FROM {_LATEST}")
def latest_per_key(spark, sf):
    return _shown(serving.latest_per_key(_online_rows(spark, sf), "key", "updated_at", "version"))


@query(f"SELECT {_SHOWN} FROM {_LATEST} WHERE updated_at + INTERVAL 6 HOUR > TIMESTAMP '{ONLINE_AT}'")
def ttl_get(spark, sf):
    latest = serving.latest_per_key(_online_rows(spark, sf), "key", "updated_at", "version")
    return _shown(serving.unexpired(latest, F.lit(ONLINE_AT).cast("timestamp_ntz")))


@query(f"SELECT {_SHOWN} FROM {_LATEST} WHERE key NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 400)")
def online_delete(spark, sf):
    flagged = fx.table(spark, sf, "events").where((F.col("event_type") == "error") & (F.col("value") > 400))
    keys = flagged.select(F.col("user_id").cast("string").alias("key"))
    latest = serving.latest_per_key(_online_rows(spark, sf), "key", "updated_at", "version")
    return _shown(serving.without_keys(latest, keys))


def _stored_snapshots(spark, sf) -> str:
    """Quote snapshots in two batches, the first delivered twice."""
    path = scratch_path(spark, "snapshots")
    rows = materialise(features.snapshots(features.quote_features(fx.quotes(spark, sf)), "quote", F.lit(STAMP)), "snapshots")
    half = F.pmod(F.crc32("record_id"), F.lit(2))
    for batch_id in (0, 1, 0):
        feature_store.write_snapshots(rows.where(half == batch_id), path, "quote", batch_id)
    return path


@query(f"SELECT quote_id {_ENVELOPE.format('quote', 'true')}, {_VECTOR} FROM quote_vectors", "quote_vectors")
def snapshot_round_trip(spark, sf):
    return _flat_snapshot(feature_store.read_snapshots(spark, _stored_snapshots(spark, sf), "quote"))


@query(f"SELECT quote_id {_ENVELOPE.format('quote', 'true')}, {_VECTOR} FROM quote_vectors WHERE quote_id = (SELECT max(quote_id) FROM quotes)", "quote_vectors quotes")
def snapshot_point_read(spark, sf):
    """The snapshot of the last quote, found by id and type."""
    path = _stored_snapshots(spark, sf)
    last = fx.quotes(spark, sf).agg(F.max("quote_id")).first()[0]
    return _flat_snapshot(feature_store.read_snapshot(spark, path, last, "quote", "v1.0.0"))


_BROKEN = "CAST(substr(quote_id, 3) AS INT)"


@query(" UNION ALL ".join(f"SELECT '{rule}' AS check_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS n_bad FROM (SELECT count(*) AS n FROM quote_vectors WHERE {bad})" for rule, bad in (
    ("V30", f"{_BROKEN} % 50 IN (0, 1)"), ("V31", f"{_BROKEN} % 50 = 2"), ("V32", f"{_BROKEN} % 50 = 3"), ("V33", "false"), ("V34", "false"), ("V35", "false"), ("V36", "false"))), "quote_vectors")
def snapshot_tolerant_read(spark, sf):
    """Rules over JSON lines of which some are cut off, lack a key, have another version or lack a feature."""
    path = scratch_path(spark, "snapshots-json")
    rows = features.snapshots(features.quote_features(fx.quotes(spark, sf)), "quote", F.lit(STAMP)).drop("record_type")
    turn = F.substring("quote_id", 3, 9).cast("int") % 50
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    broken = (
        F.when(turn == 0, F.substring(line, 1, 60)).when(turn == 1, F.replace(line, F.lit('"timestamp":'), F.lit('"time":')))
        .when(turn == 2, F.replace(line, F.lit('"v1.0.0"'), F.lit('"v0.9.0"'))).when(turn == 3, F.replace(line, F.lit('"driver_age":'), F.lit('"age":'))).otherwise(line))
    rows.select(broken.alias("value")).write.text(f"{path}/record_type=quote/batch_id=0")
    return quality.check_snapshots(feature_store.read_snapshots_json(spark, path, "quote"), "quote").select("check_id", "status", "n_bad")


def _online_store(spark, sf) -> str:
    """Events as online rows in three batches, one of them replayed; keys with a costly error are then deleted."""
    path = scratch_path(spark, "online")
    # Of one moment's events for a key the greatest id stands, as its text comes first in the features.
    rows = _online_rows(spark, sf).select(
        "key", F.format_string("%012d:%s", "version", "features").alias("features"), F.col("updated_at").cast("timestamp").alias("updated_at"),
        F.col("expires_at").cast("timestamp").alias("expires_at"))
    turn = F.pmod(F.crc32("features"), F.lit(3))
    for batch_id in (0, 1, 2, 0):
        feature_store.upsert(rows.where(turn == batch_id), path, batch_id)
    flagged = fx.table(spark, sf, "events").where((F.col("event_type") == "error") & (F.col("value") > 400))
    feature_store.delete(flagged.select(F.col("user_id").cast("string").alias("key")), path, 3, F.lit("2030-01-01 00:00:00"))
    return path


_ONLINE_SQL = f"""SELECT key, printf('%012d:%s', version, features) AS features, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM {_LATEST} WHERE updated_at + INTERVAL 6 HOUR > TIMESTAMP '{ONLINE_AT}'
 AND key NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 400)"""


@query(_ONLINE_SQL)
def online_round_trip(spark, sf):
    return _shown(feature_store.online_view(spark, _online_store(spark, sf), F.lit(ONLINE_AT)))


@query(f"SELECT * FROM ({_ONLINE_SQL}) WHERE key = (SELECT min(key) FROM ({_ONLINE_SQL}))")
def online_point_get(spark, sf):
    """The first live key's row, found by key after compaction."""
    path, target = _online_store(spark, sf), scratch_path(spark, "online-compact")
    feature_store.compact(spark, path, target, F.lit(ONLINE_AT).cast("timestamp"))
    key = feature_store.online_view(spark, target, F.lit(ONLINE_AT)).agg(F.min("key")).first()[0]
    return _shown(feature_store.get(spark, target, key or "", F.lit(ONLINE_AT)))


@query("SELECT 'V15' AS check_id, dataset, CASE WHEN dataset = 'policies' THEN 'FAIL' ELSE 'PASS' END AS status FROM (VALUES ('vehicles'), ('persons'), ('addresses'), ('phones'), ('policies')) t(dataset)")
def quality_presence(spark, sf):
    """Entity tables written from the data, one of them not."""
    root, contacts = scratch_path(spark, "entities"), fx.contacts(spark, sf)
    tables = {
        "vehicles": entities.vehicles(fx.quotes(spark, sf)), "persons": entities.persons(entities.person_links(contacts, fx.claimants(spark, sf))),
        "addresses": entities.addresses(entities.address_links(contacts)), "phones": entities.phones(entities.phone_links(contacts)),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}")
    return quality.check_presence(spark, {name: f"{root}/{name}" for name in (*tables, "policies")}).select("check_id", "dataset", "status")


# Monitoring --------------------------------------------------------------------------------------

@query("""SELECT CASE WHEN risk_score_at_issuance < 0.25 THEN 'stp' WHEN risk_score_at_issuance < 0.6 THEN 'evidence'
 WHEN risk_score_at_issuance <= 0.85 THEN 'siu' ELSE 'hold' END AS tier, count(*) AS n FROM quotes GROUP BY 1""", "quotes")
def decision_tiers(spark, sf):
    tier = monitor.decision_tier(F.col("risk_score_at_issuance")).alias("tier")
    return fx.quotes(spark, sf).groupBy(tier).agg(F.count(F.lit(1)).alias("n"))


# Bin edges handed to the stability query.
PSI_CUTS = {
    "risk_score_at_issuance": [0.2, 0.4, 0.6, 0.8],
    "annual_mileage_estimate": [8000.0, 16000.0, 24000.0, 32000.0],
    "telematics_hard_brake_rate": [0.1, 0.2, 0.3],
    "violation_severity_index": [1.0, 2.0, 3.0, 4.0],
}


def _psi_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, claim_occurred, coalesce({' + '.join(f'CAST({c} >= CAST({e!r} AS DOUBLE) AS INT)' for e in edges)}, -1) AS bin FROM quotes"
        for c, edges in PSI_CUTS.items()
    )
    return f"""SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'warning' ELSE 'critical' END AS band FROM (
 SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (SELECT feature, bin,
  greatest(CAST(1e-6 AS DOUBLE), CAST(count(*) FILTER (WHERE claim_occurred) AS DOUBLE) / (sum(count(*) FILTER (WHERE claim_occurred)) OVER (PARTITION BY feature))) AS a,
  greatest(CAST(1e-6 AS DOUBLE), CAST(count(*) FILTER (WHERE NOT claim_occurred) AS DOUBLE) / (sum(count(*) FILTER (WHERE NOT claim_occurred)) OVER (PARTITION BY feature))) AS e
  FROM ({cells}) GROUP BY feature, bin) GROUP BY feature)"""


def _by_outcome(spark, sf) -> tuple[DataFrame, DataFrame]:
    quotes = fx.quotes(spark, sf)
    return quotes.where(~F.col("claim_occurred")), quotes.where(F.col("claim_occurred"))


@query(_psi_sql(), "quotes")
def psi_given_cuts(spark, sf):
    return rounded(monitor.psi(*_by_outcome(spark, sf), PSI_CUTS), "psi")


PSI_FEATURES = ["risk_score_at_issuance", "annual_mileage_estimate", "telematics_hard_brake_rate", "violation_severity_index", "vehicle_msrp", "driver_age"]
_PSI_EDGES = ", ".join(f"quantile_cont(value, {i / 10!r}::DOUBLE)" for i in range(1, 10))


@query(f"""SELECT * FROM (WITH cells AS (SELECT claim_occurred, feature, value FROM (SELECT claim_occurred, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PSI_FEATURES)} FROM quotes)
 UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(PSI_FEATURES)}))),
edges AS (SELECT feature, list_distinct([{_PSI_EDGES}]) AS cuts FROM cells WHERE NOT claim_occurred AND value IS NOT NULL GROUP BY feature),
binned AS (SELECT feature, claim_occurred, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(cuts, lambda e: value >= e)) END AS bin FROM cells JOIN edges USING (feature)),
counted AS (SELECT feature, bin, count(*) FILTER (WHERE claim_occurred) AS c, count(*) FILTER (WHERE NOT claim_occurred) AS b FROM binned GROUP BY ALL),
shares AS (SELECT feature, greatest(CAST(1e-6 AS DOUBLE), c / sum(c) OVER (PARTITION BY feature)) AS a, greatest(CAST(1e-6 AS DOUBLE), b / sum(b) OVER (PARTITION BY feature)) AS e FROM counted)
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'warning' ELSE 'critical' END AS band
FROM (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY feature))""", "quotes")
def psi(spark, sf):
    """Bins are deciles of the baseline, found exactly."""
    baseline, current = _by_outcome(spark, sf)
    baseline = materialise(baseline.select(*PSI_FEATURES), "baseline")
    return rounded(monitor.psi(baseline, current, monitor.baseline_cuts(baseline, PSI_FEATURES)), "psi")


@query(f"""SELECT feature, round(b, 6) AS baseline_rate, round(c, 6) AS current_rate, c - b > 0.05 AS spike FROM ({" UNION ALL ".join(
    f"SELECT '{s}' AS feature, avg(CAST({s} IS NULL AS INT)) FILTER (WHERE NOT claim_occurred) AS b, avg(CAST({s} IS NULL AS INT)) FILTER (WHERE claim_occurred) AS c FROM quotes"
    for s in ["credit_score", *TELEMATICS_SIGNALS])})""", "quotes")
def null_spikes(spark, sf):
    found = monitor.null_spikes(*_by_outcome(spark, sf), ["credit_score", *TELEMATICS_SIGNALS])
    return rounded(found, "baseline_rate", "current_rate")


@query("""SELECT count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS newest,
 count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS n_stale FROM orders""")
def freshness(spark, sf):
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    found = monitor.freshness(orders, "at", F.lit(datetime(2001, 8, 1)).cast("timestamp"), 212 * 86400)
    return as_text(found, "newest")


@query("""SELECT count(*) AS entities, count(*) FILTER (WHERE lo <> hi OR lz <> hz) AS collisions, round(avg(CAST(lo <> hi OR lz <> hz AS INT)), 6) AS collision_rate
 FROM (SELECT min(address_normalized) AS lo, max(address_normalized) AS hi, min(city_raw) AS lz, max(city_raw) AS hz FROM address_links GROUP BY address_id)""", "address_links")
def collision_rate(spark, sf):
    links = entities.address_links(fx.contacts(spark, sf))
    return rounded(monitor.collision_rate(links, "address_id", "address_normalized", "city_raw"), "collision_rate")


@query(f"""SELECT round(2 * a - 1, 6) AS champion_gini, round(2 * b - 1, 6) AS challenger_gini, (2 * b - 1) - (2 * a - 1) >= 0.02 AS promote
 FROM (SELECT {sql.auc('quotes', 'claim_occurred', 'risk_score_at_issuance')} AS a, {sql.auc('quotes', 'claim_occurred', 'violation_severity_index')} AS b)""", "quotes")
def champion_gate(spark, sf):
    quotes = fx.quotes(spark, sf).select("claim_occurred", "risk_score_at_issuance", "violation_severity_index")
    quotes = materialise(quotes, "scored")
    found = monitor.champion_gate(quotes, "claim_occurred", "risk_score_at_issuance", "violation_severity_index")
    return rounded(found, "champion_gini", "challenger_gini")


def _share_sql(where: str) -> str:
    return f"SELECT feature, round(gain / (sum(gain) OVER ()) * 100, 2) AS pct FROM ({_gains_sql(where)})"


@query(f"""SELECT b.feature, b.pct AS before_pct, a.pct AS after_pct, round(a.pct - b.pct, 2) AS change_pct
 FROM ({_share_sql('telematics_enrolled = 0')}) b JOIN ({_share_sql('telematics_enrolled = 1')}) a ON a.feature = b.feature""", "model_rows")
def importance_drift(spark, sf):
    rows = materialise(_frequency_rows(spark, sf), "model-rows")
    shares = [
        metrics.importance_share(_gains(rows.where(F.col("telematics_enrolled") == flag), "claim_occurred")) for flag in (0, 1)
    ]
    return monitor.importance_drift(*shares)


# Base rates and multipliers of the premium query, as a derived table by tier.
_RATES = {"platinum": 0.9, "gold": 1.0, "silver": 1.15, "bronze": 1.4}


@query(f"""SELECT quote_id, risk_score * (CASE tier {" ".join(f"WHEN '{t}' THEN CAST({r!r} AS DOUBLE)" for t, r in _RATES.items())} END)
 * CAST(1.05 AS DOUBLE) * CAST(1.2 AS DOUBLE) * CAST(0.98 AS DOUBLE) AS premium
 FROM (SELECT quote_id, policy_tier_at_issuance AS tier, risk_score_at_issuance * prior_loss_severity_avg AS risk_score FROM quotes)""", "quotes")
def premium(spark, sf):
    scores = fx.quotes(spark, sf).select(
        "quote_id", "policy_tier_at_issuance", (F.col("risk_score_at_issuance") * F.col("prior_loss_severity_avg")).alias("risk_score")
    )
    rates = spark.createDataFrame(
        [(tier, rate, 1.05, 1.2, 0.98) for tier, rate in _RATES.items()],
        "policy_tier_at_issuance string, base_rate double, profit_load double, expense_ratio double, competitive double",
    )
    return monitor.premium(scores, rates).select("quote_id", "premium")


@query("""SELECT CAST(d AS INT) AS days, count(*) AS n, count(*) FILTER (WHERE claim_occurred) AS positives FROM quotes, (VALUES (90), (180)) w(d)
 WHERE CAST(quoted_at AS DATE) > DATE '2001-07-01' - CAST(d AS INT) AND CAST(quoted_at AS DATE) <= DATE '2001-07-01' GROUP BY 1""", "quotes")
def confirmed_label_windows(spark, sf):
    quotes = fx.quotes(spark, sf)
    windows = [
        monitor.confirmed_labels(quotes, "quoted_at", F.lit(date(2001, 7, 1)), days).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("claim_occurred").alias("positives")
        ).withColumn("days", F.lit(days))
        for days in (90, 180)
    ]
    return windows[0].unionByName(windows[1])


@query("SELECT DISTINCT submission_channel FROM claims_raw WHERE submission_channel NOT IN (SELECT submission_channel FROM claims_raw WHERE prior_claims_count < 2 AND submission_channel IS NOT NULL)", "claims_raw")
def new_categories(spark, sf):
    claims = fx.claim_lines(spark, sf).where(F.col("submission_channel").isNotNull())
    return monitor.new_categories(claims.where(F.col("prior_claims_count") < 2), claims, "submission_channel")


# Streaming ---------------------------------------------------------------------------------------

def _order_stream(spark, sf) -> DataFrame:
    # A file source wants a folder or a pattern.
    return spark.readStream.schema(fx.SCHEMAS["orders"]).parquet(f"{sf}/orders*.parquet")


def _drain(spark, stream: DataFrame) -> DataFrame:
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    live.to_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"SELECT {_VECTOR} FROM quote_vectors", "quote_vectors")
def stream_quote_features(spark, sf):
    return _drain(spark, live.quote_feature_stream(fx.quotes(spark, sf, _order_stream(spark, sf))))


def _replayed(spark, source: str, files: int = 4, batches: int = 4) -> DataFrame:
    """A written table as a stream of ``files`` a micro-batch, more where ``batches`` of them would not hold all.

    Each micro-batch reads the whole of a static table that it is joined to, so their number must not grow with the stream.
    """
    written = spark.read.parquet(source)
    return spark.readStream.schema(written.schema).option("maxFilesPerTrigger", max(files, -(-len(written.inputFiles()) // batches))).parquet(source)


@query("SELECT * EXCLUDE (state) FROM claim_vectors", "claim_vectors")
def stream_claim_features(spark, sf):
    """Claims replayed as a stream against the static underwriting table."""
    source = scratch_path(spark, "claims")
    quotes = materialise(fx.quotes(spark, sf), "quotes")
    fx.claims(spark, sf, quotes).write.parquet(source)
    claims = _replayed(spark, source)
    return _drain(spark, live.claim_feature_stream(claims, quotes).drop("_state"))


def _in_turn(spark, rows: DataFrame, turn: Column, turns: int) -> DataFrame:
    """``rows`` as a stream of ``turns`` micro-batches: those of each turn in a file of their own, written in order."""
    source = scratch_path(spark, "source")
    rows = materialise(rows.withColumn("_turn", turn), "turns")
    for i in range(turns):
        rows.where(F.col("_turn") == i).drop("_turn").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(rows.drop("_turn").schema).option("maxFilesPerTrigger", 1).parquet(source)


@query(f"SELECT quote_id AS key, '2024-06-30 00:00:00' AS updated_at, '2024-06-30 01:00:00' AS expires_at, * EXCLUDE (quote_id, vin) FROM quote_vectors", "quote_vectors")
def stream_serving(spark, sf):
    """Every quote served through foreachBatch in three micro-batches, all of them delivered twice; stored features compared whole."""
    offline, online = scratch_path(spark, "offline"), scratch_path(spark, "online")
    orders = fx.table(spark, sf, "orders")
    quotes = fx.quotes(spark, sf, _in_turn(spark, orders, F.pmod(F.crc32(F.col("o_orderkey").cast("string")), F.lit(3)), 3))
    for _ in range(2):
        # A fresh checkpoint replays every batch under its old id.
        live.serve(quotes, "quote", offline, online, scratch_path(spark, "serving-state"), F.lit(STAMP), ttl_seconds=3600).awaitTermination()
    rows = feature_store.online_view(spark, online, F.lit(STAMP)).withColumn("features", F.from_json("features", schemas.QUOTE_FEATURES))
    return as_text(rows.select("key", "updated_at", "expires_at", "features.*").drop("vin"), "updated_at", "expires_at", pattern="yyyy-MM-dd HH:mm:ss")


@query("SELECT o_orderkey FROM orders")
def stream_dedup(spark, sf):
    """The orders delivered twice, copies in other micro-batches and dates in any order; each arrives once.

    The lateness allowed covers the seven years that the source spans, so no order is too late.
    """
    source = scratch_path(spark, "orders")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    orders.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).repartition(4, "copy", "o_orderkey").write.parquet(source)
    stream = spark.readStream.schema("o_orderkey bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    return _drain(spark, live.once_per_record(stream, "o_orderkey", "at", "4000 days").select("o_orderkey"))


_SECONDS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _window_text(windows: DataFrame) -> DataFrame:
    return as_text(windows, "window_start", "window_end", pattern="yyyy-MM-dd HH:mm:ss")


@query(f"""SELECT user_id, {_SECONDS.format('s')} AS window_start, {_SECONDS.format('s + INTERVAL 1 HOUR')} AS window_end, count(*) AS n
 FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) - CAST(k AS INT) * INTERVAL 15 MINUTE AS s FROM events, (VALUES (0), (1), (2), (3)) w(k))
 GROUP BY user_id, s""")
def burst_windows(spark, sf):
    return _window_text(bursts.burst_windows(fx.table(spark, sf, "events"), "user_id", "ts"))


@query(f"""SELECT user_id, {_SECONDS.format('s')} AS window_start, {_SECONDS.format('s + INTERVAL 1 HOUR')} AS window_end, n
 FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY ALL) WHERE n >= 2""")
def burst_tumbling(spark, sf):
    return _window_text(bursts.bursts(bursts.burst_windows(fx.table(spark, sf, "events"), "user_id", "ts", slide=None), 2))


@query("""SELECT user_id, min(m) AS first_micros, max(m) AS last_micros, count(*) AS n FROM (
 SELECT user_id, m, sum(starts) OVER (PARTITION BY user_id ORDER BY m, event_id) AS session FROM (
 SELECT user_id, event_id, epoch_us(ts) AS m, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS starts
 FROM events)) GROUP BY user_id, session""")
def burst_sessions(spark, sf):
    return bursts.burst_sessions(fx.table(spark, sf, "events"), "user_id", "ts", 7200).drop("session")


def _event_stream(spark, sf) -> DataFrame:
    """Events in four micro-batches by time, then a closing record far ahead that lets the watermark pass every window."""
    events = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    span = (last - first).total_seconds() or 1.0
    turn = F.least(F.floor((F.col("ts").cast("double") - F.lit(first).cast("timestamp").cast("double")) / span * 4), F.lit(3))
    closing = spark.createDataFrame([(None, last + timedelta(days=30))], events.schema)
    return _in_turn(spark, events.unionByName(closing), F.when(F.col("user_id").isNull(), 4).otherwise(turn), 5)


@query(f"""SELECT user_id, {_SECONDS.format('s')} AS window_start, {_SECONDS.format('s + INTERVAL 1 HOUR')} AS window_end, count(*) AS n
 FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) - CAST(k AS INT) * INTERVAL 15 MINUTE AS s FROM events, (VALUES (0), (1), (2), (3)) w(k))
 GROUP BY user_id, s""")
def stream_burst_windows(spark, sf):
    """Sliding windows appended as the watermark passes them."""
    found = _drain(spark, bursts.burst_windows(_event_stream(spark, sf), "user_id", "ts"))
    return _window_text(found.where(F.col("user_id").isNotNull()))


@query("""SELECT user_id, min(m) AS first_micros, max(m) AS last_micros, count(*) AS n FROM (
 SELECT user_id, m, sum(starts) OVER (PARTITION BY user_id ORDER BY m, event_id) AS session FROM (
 SELECT user_id, event_id, epoch_us(ts) AS m, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS starts
 FROM events)) GROUP BY user_id, session""")
def stream_burst_sessions(spark, sf):
    """Sessions appended as the watermark passes them."""
    found = _drain(spark, bursts.burst_sessions(_event_stream(spark, sf), "user_id", "ts", 7200))
    return found.where(F.col("user_id").isNotNull())


#: Days at which the late-row query cuts its deliveries.
_CUTS = ("1996-09-01", "1998-05-01", "2000-01-01")


@query(f"""SELECT o_orderkey, turn = 3 AND held AND o_orderdate < (SELECT max(o_orderdate) FROM dealt WHERE turn < 3) - INTERVAL 30 DAY AS late FROM dealt""".replace("FROM dealt", f"""FROM (
 SELECT o_orderkey, o_orderdate, o_orderkey % 100 = 7 AS held, CASE WHEN o_orderkey % 100 = 7 THEN 3 ELSE {" + ".join(f"CAST(o_orderdate >= TIMESTAMP '{d}' AS INT)" for d in _CUTS)} END AS turn FROM orders)"""))
def stream_late_split(spark, sf):
    """Orders by date in four deliveries; one in a hundred comes with the last one. Orders of the fortnight before a cut come twice."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    part = sum(((F.col("at") >= F.lit(d).cast("timestamp")).cast("int") for d in _CUTS), F.lit(0))
    held = F.col("o_orderkey") % 100 == 7
    again = ~held & (part < 3) & (sum(((F.col("at") + F.expr("INTERVAL 14 DAYS") >= F.lit(d).cast("timestamp")).cast("int") for d in _CUTS), F.lit(0)) > part)
    dealt = orders.withColumn("turn", F.when(held, F.array(F.lit(3))).when(again, F.array(part, part + 1)).otherwise(F.array(part)))
    stream = _in_turn(spark, dealt.withColumn("turn", F.explode("turn")), F.col("turn"), 4).drop("turn")
    path = scratch_path(spark, "late")
    late.split_late(stream, "o_orderkey", "at", timedelta(days=30), path, scratch_path(spark, "late-state"), "month").awaitTermination()
    return late.read_split(spark, path, "o_orderkey bigint, at timestamp").select("o_orderkey", "late")
