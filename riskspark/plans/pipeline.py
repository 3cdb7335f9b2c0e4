"""The engine's steps over a workspace of tables. Each step reads what earlier steps wrote."""

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.constants import MAX_HOPS
from riskspark.operators import entities, features, graph, metrics, models, quality
from riskspark.session import materialise
from riskspark.sources import feature_store, graph_store
from riskspark.sources.tables import MissingUpstreamTable, read, write

ENTITY_TABLES = ["vehicles", "persons", "addresses", "phones", "policies"]


@dataclass(frozen=True)
class Workspace:
    """Where each table lives under one root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def entity(self, name: str) -> str:
        return self.path(f"entities/{name}")


def resolve_entities(spark: SparkSession, ws: Workspace, as_of: date) -> None:
    """Write the five entity tables and the links from source rows to them.

    Needs ``quotes``, ``claims``, ``contacts`` (policyholder contact values by quote) and
    ``claimants`` (name and birth date by claim).
    """
    quotes = read(spark, ws.path("quotes"), upstream="the quote load")
    contacts = read(spark, ws.path("contacts"), upstream="the contact load")
    claimants = read(spark, ws.path("claimants"), upstream="the claimant load")
    write(entities.vehicles(quotes), ws.entity("vehicles"))
    links = {
        "persons": entities.person_links(contacts, claimants),
        "addresses": entities.address_links(contacts),
        "phones": entities.phone_links(contacts),
    }
    resolvers = {"persons": entities.persons, "addresses": entities.addresses, "phones": entities.phones}
    for name, rows in links.items():
        write(rows, ws.entity(f"{name}_links"))
        write(resolvers[name](read(spark, ws.entity(f"{name}_links"))), ws.entity(name))
    write(entities.policies(quotes, F.lit(as_of)), ws.entity("policies"))


def build_graph(spark: SparkSession, ws: Workspace, batch_id: int = 0, claims: DataFrame | None = None) -> DataFrame:
    """Upsert a batch of claims (``graph_claims`` by default) into the graph; returns the load report.

    Nodes and edges that earlier batches brought are met by key: a batch may repeat them or bring newer properties.
    The report counts the batch's claims and the whole graph's entities and edges.
    """
    if claims is None:
        claims = read(spark, ws.path("graph_claims"), upstream="the claim load")
    vehicles = read(spark, ws.entity("vehicles"), schemas.VEHICLES, "resolve_entities")
    batch = ws.path(f"graph_rows/batch_id={batch_id}")
    write(graph.resolve_graph_input(claims, vehicles), batch)
    rows = read(spark, batch)
    graph_store.upsert(graph.graph_nodes(rows), graph.graph_edges(rows), ws.path("graph"), batch_id)
    return graph.load_report(rows, *graph_tables(spark, ws))


def graph_tables(spark: SparkSession, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all batches, merged."""
    try:
        return graph_store.nodes(spark, ws.path("graph")), graph_store.edges(spark, ws.path("graph"))
    except MissingUpstreamTable as error:
        raise MissingUpstreamTable(f"{ws.path('graph')} not found: run build_graph first") from error


def compute_graph_features(spark: SparkSession, ws: Workspace, max_hops: int = MAX_HOPS) -> None:
    """Write ``claims_enriched``: the claims with fresh graph columns. The claims stay as they are."""
    # Merged once, then read by every feature.
    nodes, edges = (materialise(table, "graph") for table in graph_tables(spark, ws))
    # In the order of claims: files hold ranges of ids, so a point read skips most of them.
    write(graph.graph_features(nodes, edges, max_hops).orderBy("claim_id"), ws.path("graph_features"))
    claims = read(spark, ws.path("claims"), upstream="the claim load")
    found = read(spark, ws.path("graph_features"), schemas.GRAPH_FEATURES)
    write(graph.merge_graph_features(claims, found), ws.path("claims_enriched"))


def _claims(spark: SparkSession, ws: Workspace) -> DataFrame:
    try:
        return read(spark, ws.path("claims_enriched"))
    except MissingUpstreamTable:
        return read(spark, ws.path("claims"), upstream="the claim load")


def offline_features(spark: SparkSession, ws: Workspace, as_of, online: bool = False, batch_id: int = 0) -> tuple[int, int]:
    """Write quote and claim snapshots, optionally serve them; returns both row counts."""
    quotes = read(spark, ws.path("quotes"), upstream="the quote load")
    vehicles = read(spark, ws.entity("vehicles"), schemas.VEHICLES, "resolve_entities")
    stamp = F.lit(as_of)
    vectors = {
        "quote": features.quote_features(features.override_vehicle(quotes, vehicles)),
        "claim": features.claim_features(_claims(spark, ws), quotes),
    }
    counts = []
    for record_type, rows in vectors.items():
        counted = Observation()
        snapshots = features.snapshots(rows, record_type, stamp).observe(counted, F.count(F.lit(1)).alias("n"))
        feature_store.write_snapshots(snapshots, ws.path("snapshots"), record_type, batch_id)
        counts.append(counted.get["n"])
        if online:
            # This batch alone: older ones were served under their own ids.
            stored = feature_store.read_snapshots(spark, ws.path("snapshots"), record_type, batch_id)
            feature_store.upsert(feature_store.to_online_rows(stored), ws.path(f"online/{record_type}"), batch_id)
    return counts[0], counts[1]


def _save(fitted: models.Fitted, ws: Workspace, name: str) -> None:
    fitted.model.write().overwrite().save(ws.path(f"models/{name}"))
    write(metrics.to_metric_rows(fitted.report, name), ws.path(f"models/{name}_metrics"))
    write(fitted.importance, ws.path(f"models/{name}_importance"))


def train_frequency(spark: SparkSession, ws: Workspace, **boosting) -> None:
    """Fit and save the claim model with its metrics and importances."""
    _save(models.train_frequency(read(spark, ws.path("quotes")), **boosting), ws, "frequency")


def train_severity(spark: SparkSession, ws: Workspace, iterations: int = 25) -> None:
    """Fit and save the cost model with its metrics and importances."""
    _save(models.train_severity(read(spark, ws.path("quotes")), read(spark, ws.path("claims")), iterations), ws, "severity")


def train(spark: SparkSession, ws: Workspace, severity_iterations: int = 25, **boosting) -> DataFrame:
    """Fit and save both models, their metrics and importances; returns the hurdle evaluation."""
    train_frequency(spark, ws, **boosting)
    train_severity(spark, ws, severity_iterations)
    report = models.evaluate(load_model(spark, ws), read(spark, ws.path("quotes")))
    write(metrics.to_metric_rows(report, "hurdle"), ws.path("models/hurdle_metrics"))
    return report


def calibrate(spark: SparkSession, ws: Workspace) -> models.Calibration:
    """Fit and save both calibrations with their reports."""
    quotes, claims = read(spark, ws.path("quotes")), read(spark, ws.path("claims"))
    model = load_model(spark, ws)
    fitted, frequency_report = models.calibrate_frequency(model.frequency, quotes)
    fitted.bias, severity_report = models.calibrate_severity(model.severity, quotes, claims)
    write(metrics.to_metric_rows(frequency_report, "frequency"), ws.path("models/frequency_calibration_metrics"))
    write(metrics.to_metric_rows(severity_report, "severity"), ws.path("models/severity_calibration_metrics"))
    row = spark.createDataFrame([(fitted.a, fitted.b, fitted.bias)], "a double, b double, bias double")
    write(row, ws.path("models/calibration"))
    return fitted


def load_calibration(spark: SparkSession, ws: Workspace) -> models.Calibration:
    """The saved parameters, or none of them: scores then pass through unchanged."""
    try:
        row = read(spark, ws.path("models/calibration")).first()
    except MissingUpstreamTable:
        return models.Calibration()
    return models.Calibration(row["a"], row["b"], row["bias"])


def load_model(spark: SparkSession, ws: Workspace) -> models.HurdleModel:
    return models.HurdleModel(
        PipelineModel.load(ws.path("models/frequency")), PipelineModel.load(ws.path("models/severity")),
        load_calibration(spark, ws),
    )


def validate(spark: SparkSession, ws: Workspace) -> DataFrame:
    """Every rule over what the workspace holds; groups whose tables are missing are left out."""
    paths = {name: ws.entity(name) for name in ENTITY_TABLES}
    quotes, claims = read(spark, ws.path("quotes")), _claims(spark, ws)
    parts = [
        quality.check_quotes(quotes), quality.check_claims(claims), quality.check_fraud_signals(_signals(claims)),
        quality.check_spine(claims, quotes), quality.check_presence(spark, paths),
        quality.check_trio(features.quote_features(quotes), "quotes", "quote_id"),
        quality.check_trio(features.claim_features(claims, quotes), "claims", "claim_id"),
    ]
    snapshots = {}
    if "graph_hop_distance" in claims.columns:
        parts.append(quality.check_graph_features(claims))
    try:
        parts.append(quality.check_entities(*[read(spark, paths[name]) for name in ENTITY_TABLES]))
    except MissingUpstreamTable:
        pass  # The presence rows already say so.
    try:
        parts.append(quality.check_graph_topology(*graph_tables(spark, ws)))
    except MissingUpstreamTable:
        pass
    for record_type in ("quote", "claim"):
        try:
            read(spark, f"{ws.path('snapshots')}/record_type={record_type}")
        except MissingUpstreamTable:
            continue
        snapshots[record_type] = feature_store.read_snapshots(spark, ws.path("snapshots"), record_type)
        parts.append(quality.check_snapshots(snapshots[record_type], record_type))
    for record_type in ("quote", "claim"):
        # Snapshots that other systems delivered as JSON lines: broken ones become rows of the same rules.
        try:
            loaded = feature_store.read_snapshots_json(spark, ws.path("snapshots_json"), record_type)
        except MissingUpstreamTable:
            continue
        found = quality.check_snapshots(loaded, record_type)
        parts.append(found.withColumn("dataset", F.concat("dataset", F.lit("_json"))))
    if len(snapshots) == 2:
        parts.append(quality.check_snapshot_spine(snapshots["claim"], snapshots["quote"]))
    return reduce(DataFrame.unionByName, parts)


def _signals(claims: DataFrame) -> DataFrame:
    trio = features.telematics_trio(claims)
    return claims.withColumn("telematics_available", trio["telematics_available"])
