"""SQL twins of the registered queries, written on their own for another engine.

``WITH`` parts are kept by name and pulled in as needed, so each twin is one statement over the
test tables.
"""

from riskspark.constants import (
    FRAUD_CORRELATION_SIGNS, FRAUD_SIGNAL_DIRECTIONS, MODEL_FEATURES, STREET_SUFFIXES, TELEMATICS_SIGNALS, US_STATES,
    VIN_MAKES, VIN_MODELS, VIN_YEARS,
)

STATES = ",".join(US_STATES)
RESTRICTED = "('CA','MA','MI','HI')"
SIGNALS = ", ".join(TELEMATICS_SIGNALS)
ANY_SIGNAL = f"coalesce({SIGNALS}) IS NOT NULL"
AS_OF = "DATE '2024-06-30'"
STAMP = "TIMESTAMP '2024-06-30 00:00:00'"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    )


def decode(position: int, table: dict, default: str) -> str:
    names = ",".join(str(v) for v in table.values())
    return (
        f"coalesce(nullif(list_extract(string_split('{names}', ','), "
        f"strpos('{''.join(table)}', upper(substr(vin, {position}, 1)))), ''), '{default}')"
    )


def street(x: str) -> str:
    for short, long in STREET_SUFFIXES.items():
        x = f"replace({x}, '{short}.', '{long}')"
    for short, long in STREET_SUFFIXES.items():
        x = f"regexp_replace({x}, '\\b{short}$', '{long}')"
    return x


def address(line: str, city: str, state: str, zip_code: str) -> str:
    return (
        f"replace({street(f'trim({line})')} || ', ' || {title(f'trim({city})')} || ', ' || upper({state}) || ' ' || {zip_code},"
        " '  ', ' ')"
    )


def digits(x: str) -> str:
    only = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({only}) = 11 AND {only} LIKE '1%' THEN substr({only}, 2) ELSE {only} END"


def entity(kind: str, x: str) -> str:
    return f"'e_' || substr(sha256('{kind}:' || translate(lower(trim({x})), '()-. ', '')), 1, 16)"


PARTS: dict[str, tuple[str, str]] = {}
#: How recursive parts begin.
RECURSIVE: dict[str, str] = {}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


part("quotes_raw", "", f"""
SELECT 'Q-' || lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS quote_id, c.c_custkey AS customer_key,
 split_part('{STATES}', ',', CAST(c.c_nationkey + 1 AS INT)) AS state,
 CAST(500 + floor((c.c_acctbal + CAST(1000 AS DOUBLE)) * CAST(350 AS DOUBLE) / CAST(11000 AS DOUBLE)) AS INT) AS credit_score,
 CAST(h.n_f AS DOUBLE) / CAST(h.n AS DOUBLE) AS prior_loss_frequency,
 least(CAST(20000 AS DOUBLE), greatest(CAST(500 AS DOUBLE), h.min_price / CAST(20 AS DOUBLE))) AS prior_loss_severity_avg,
 CAST(o.o_orderkey % 181 AS INT) AS insurance_lapse_days,
 CAST(o.o_orderkey % 51 AS DOUBLE) / CAST(10 AS DOUBLE) AS violation_severity_index,
 CAST(0.5 AS DOUBLE) + CAST(c.c_custkey % 12 AS DOUBLE) / CAST(2 AS DOUBLE) AS household_driver_density,
 CAST(16 + (c.c_custkey * 7) % 65 AS INT) AS driver_age,
 CAST(least((c.c_custkey * 7) % 65, o.o_orderkey % 61) AS INT) AS years_licensed,
 CAST(12000 + CAST(floor(o.o_totalprice) AS BIGINT) % 138000 AS DOUBLE) AS vehicle_msrp,
 CAST(80 + o.o_orderkey % 421 AS DOUBLE) AS vehicle_power,
 CAST(o.o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS vehicle_adas_score,
 CAST(o.o_orderkey % 21 AS INT) AS vehicle_age_years,
 CAST(0.1 AS DOUBLE) + CAST(c.c_nationkey AS DOUBLE) / CAST(60 AS DOUBLE) AS geohash_risk_score,
 CAST(1000 + (o.o_orderkey * 37) % 39001 AS DOUBLE) AS annual_mileage_estimate,
 t.distraction AS telematics_distraction_score, t.hard_brake AS telematics_hard_brake_rate,
 t.crash AS telematics_crash_match, t.entropy AS telematics_commute_entropy,
 (c.c_custkey % 5 = 0) AS telematics_enrolled,
 (o.o_orderkey % 51 >= 38 AND o.o_orderstatus <> 'O') AS claim_occurred, o.o_orderdate AS quoted_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f, min(o_totalprice) AS min_price FROM orders GROUP BY o_custkey) h ON h.o_custkey = o.o_custkey
LEFT JOIN (SELECT user_id,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS distraction,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS hard_brake,
  max(value) / CAST(500 AS DOUBLE) AS crash, CAST(count(*) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS entropy
  FROM events GROUP BY user_id) t ON t.user_id = c.c_custkey""")

part("quotes_scored", "quotes_raw", """
SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE),
  greatest(CAST(0 AS DOUBLE), CAST(760 AS DOUBLE) - CAST(coalesce(nullif(credit_score, 0), 760) AS DOUBLE)) / CAST(300 AS DOUBLE)
  + least(CAST(1 AS DOUBLE), prior_loss_frequency * CAST(0.35 AS DOUBLE))
  + least(CAST(1 AS DOUBLE), prior_loss_severity_avg / CAST(20000 AS DOUBLE) * CAST(0.35 AS DOUBLE))
  + least(CAST(1 AS DOUBLE), CAST(insurance_lapse_days AS DOUBLE) / CAST(120 AS DOUBLE) * CAST(0.20 AS DOUBLE))
  + least(CAST(1 AS DOUBLE), violation_severity_index / CAST(5 AS DOUBLE) * CAST(0.18 AS DOUBLE))
  + CASE WHEN telematics_enrolled AND telematics_distraction_score IS NULL THEN CAST(0.12 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN vehicle_power > 220 THEN CAST(0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS risk_score_at_issuance
FROM quotes_raw""")

part("quotes", "quotes_scored", """
SELECT *, CASE WHEN risk_score_at_issuance < 0.25 THEN 'platinum' WHEN risk_score_at_issuance < 0.45 THEN 'gold'
 WHEN risk_score_at_issuance < 0.65 THEN 'silver' ELSE 'bronze' END AS policy_tier_at_issuance FROM quotes_scored""")

part("claims_raw", "", """
SELECT 'C-' || lpad(CAST(l.l_orderkey AS VARCHAR), 9, '0') || '-' || CAST(l.l_linenumber AS VARCHAR) AS claim_id,
 'Q-' || lpad(CAST(l.l_orderkey AS VARCHAR), 9, '0') AS quote_id,
 max(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 40 THEN 1 ELSE 0 END) = 1 AS is_fraud,
 max(l.l_discount) >= CAST(0.10 AS DOUBLE) AS attorney_present,
 min(l.l_suppkey) AS attorney_key,
 CAST(max(l.l_quantity) * CAST(3 AS DOUBLE) AS INT) AS policy_inception_days,
 CAST(count(*) AS INT) AS claimant_count,
 CAST(trunc(max(l.l_tax) * CAST(100 AS DOUBLE)) AS INT) AS reporting_delay_days,
 CAST(max(l.l_linenumber) * 3 AS INT) AS submission_hour,
 CAST(l.l_linenumber - 1 AS INT) AS prior_claims_count,
 CAST(min(l.l_suppkey) % 6 AS INT) AS reported_injury_count,
 CAST(max(l.l_partkey) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS narrative_inconsistency_score,
 CAST(min(l.l_partkey) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS narrative_complexity_score,
 CAST(min(l.l_suppkey) % 31 AS DOUBLE) AS ip_geolocation_delta_miles,
 CASE WHEN l.l_linenumber % 4 = 0 THEN CAST(NULL AS BOOLEAN) ELSE min(l.l_partkey) % 5 <> 0 END AS device_fingerprint_match,
 CASE l.l_linenumber % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'agent_portal' WHEN 2 THEN 'web' WHEN 3 THEN 'broker' END AS submission_channel,
 max(l.l_extendedprice) AS incurred_loss_usd
FROM lineitem l GROUP BY l.l_orderkey, l.l_linenumber""")

part("claims", "claims_raw quotes", f"""
SELECT c.*, q.customer_key, q.state, {", ".join(f"q.{s}" for s in TELEMATICS_SIGNALS)}, q.risk_score_at_issuance, q.policy_tier_at_issuance
FROM claims_raw c JOIN quotes q ON q.quote_id = c.quote_id""")

part("contacts", "", f"""
SELECT 'Q-' || lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS source_id, c.c_custkey AS customer_key,
 CASE WHEN o.o_orderkey % 2 = 0 THEN '  ' || upper(c.c_name) ELSE c.c_name END AS name_raw,
 CAST(1940 + c.c_custkey % 60 AS VARCHAR) || '-' || lpad(CAST(1 + c.c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c.c_custkey % 28 AS VARCHAR), 2, '0') AS dob,
 split_part('{STATES}', ',', CAST(c.c_nationkey + 1 AS INT)) AS state,
 CASE o.o_orderkey % 4
  WHEN 0 THEN '(' || CAST(200 + c.c_custkey % 700 AS VARCHAR) || ') 555-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0')
  WHEN 1 THEN '1-' || CAST(200 + c.c_custkey % 700 AS VARCHAR) || '-555-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0')
  WHEN 2 THEN CAST(200 + c.c_custkey % 700 AS VARCHAR) || '.555.' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0')
  ELSE '555' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone_raw,
 CAST(100 + c.c_custkey AS VARCHAR) || ' ' || CASE o.o_orderkey % 3 WHEN 0 THEN 'Main St' WHEN 1 THEN 'Main St.' ELSE 'Main Street' END AS address_line1_raw,
 CASE WHEN o.o_orderkey % 2 = 0 THEN lower(n.n_name) ELSE n.n_name END AS city_raw,
 lpad(CAST(10000 + c.c_custkey % 90000 AS VARCHAR), 5, '0') AS zip_raw
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""")

part("claimants", "claims_raw contacts", f"""
SELECT c.claim_id AS source_id,
 CASE WHEN c.submission_hour % 2 = 0 THEN h.name_raw ELSE s.s_name END AS name_raw,
 CASE WHEN c.submission_hour % 2 = 0 THEN h.dob ELSE CAST(1950 + s.s_suppkey % 40 AS VARCHAR) || '-' || lpad(CAST(1 + s.s_suppkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + s.s_suppkey % 28 AS VARCHAR), 2, '0') END AS dob,
 CASE WHEN c.submission_hour % 2 = 0 THEN h.state ELSE split_part('{STATES}', ',', CAST(s.s_nationkey + 1 AS INT)) END AS state
FROM claims_raw c JOIN contacts h ON h.source_id = c.quote_id JOIN supplier s ON s.s_suppkey = c.attorney_key""")

part("vins", "quotes", """
SELECT *, '1' || substr(d, 1, 2) || 'V' || substr(d, 3, 2) || 'D2' || substr(d, 5, 2) || '000001' AS vin
FROM (SELECT *, sha256(quote_id || ':' || CAST(CAST(vehicle_power AS BIGINT) AS VARCHAR) || '.0:' || CAST(CAST(vehicle_msrp AS BIGINT) AS VARCHAR) || '.0') AS d FROM quotes)""")

part("vehicles", "vins", f"""
SELECT vin, quote_id, 'v_' || substr(sha256(quote_id), 1, 32) AS vehicle_id,
 CAST({decode(10, VIN_YEARS, "2023")} AS INT) AS year, {decode(2, VIN_MAKES, "Toyota")} AS make, {decode(5, VIN_MODELS, "Civic")} AS model,
 'sedan' AS body_type, vehicle_msrp AS msrp, vehicle_power AS horsepower, vehicle_adas_score AS adas_score, vehicle_age_years
FROM vins""")

part("quote_vectors", "vins", f"""
SELECT quote_id, vin, CASE WHEN state NOT IN {RESTRICTED} THEN credit_score END AS credit_score, prior_loss_frequency, prior_loss_severity_avg,
 insurance_lapse_days, violation_severity_index, household_driver_density, driver_age, years_licensed,
 vehicle_msrp / greatest(CAST(1 AS DOUBLE), vehicle_power) AS vehicle_msrp_power_ratio, vehicle_adas_score, vehicle_age_years,
 geohash_risk_score, state, annual_mileage_estimate, risk_score_at_issuance, policy_tier_at_issuance, {SIGNALS},
 {ANY_SIGNAL} AS telematics_available, telematics_enrolled AND NOT ({ANY_SIGNAL}) AS telematics_enrolled_but_missing,
 state NOT IN {RESTRICTED} AS credit_eligible
FROM vins""")


def claim_vector(claims: str, hop: str, shared: str, centrality: str) -> str:
    return f"""
SELECT c.claim_id, c.quote_id, c.policy_inception_days, c.prior_claims_count, c.reported_injury_count, c.reporting_delay_days,
 c.attorney_present, c.submission_hour, coalesce(nullif(c.claimant_count, 0), 1) AS claimant_count, {hop} AS graph_hop_distance,
 {shared} AS shared_attribute_count, {centrality} AS attorney_centrality_score, c.narrative_inconsistency_score,
 c.narrative_complexity_score, coalesce(nullif(q.risk_score_at_issuance, 0), c.risk_score_at_issuance) AS risk_score_at_issuance,
 coalesce(q.policy_tier_at_issuance, c.policy_tier_at_issuance) AS policy_tier_at_issuance, c.ip_geolocation_delta_miles,
 coalesce(c.device_fingerprint_match, true) AS device_fingerprint_match, coalesce(c.submission_channel, 'unknown') AS submission_channel,
 {", ".join(f"c.{s}" for s in TELEMATICS_SIGNALS)},
 coalesce({", ".join(f"c.{s}" for s in TELEMATICS_SIGNALS)}) IS NOT NULL AS telematics_available,
 q.telematics_enrolled AND coalesce({", ".join(f"c.{s}" for s in TELEMATICS_SIGNALS)}) IS NULL AS telematics_enrolled_but_missing,
 c.state
FROM {claims} c LEFT JOIN quotes q ON q.quote_id = c.quote_id"""


part("claim_vectors", "claims quotes", claim_vector("claims", "CAST(NULL AS INT)", "0", "CAST(0 AS DOUBLE)"))

part("person_links", "contacts claimants", f"""
SELECT *, 'p_' || substr(sha256(lower(replace(name_normalized, ' ', '')) || ':' || dob || ':' || state), 1, 32) AS person_id FROM (
 SELECT source_id, {title("trim(name_raw)")} AS name_normalized, dob, state, 'policyholder' AS role, 0 AS role_rank FROM contacts
 UNION ALL SELECT source_id, {title("trim(name_raw)")}, dob, state, 'claimant', 1 FROM claimants)""")

part("persons", "person_links", """
SELECT person_id, name_normalized, dob, state, role FROM person_links
QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY role_rank, source_id) = 1""")

part("address_links", "contacts", f"""
SELECT *, 'a_' || substr(sha256(lower(address_normalized)), 1, 32) AS address_id FROM (
 SELECT source_id, {address("address_line1_raw", "city_raw", "state", "zip_raw")} AS address_normalized, city_raw, state, zip_raw FROM contacts)""")

part("addresses", "address_links", """
SELECT address_id, address_normalized, city_raw AS city, state, zip_raw AS zip, substr(sha256(address_normalized), 1, 16) AS address_hash
FROM address_links QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY source_id) = 1""")

part("phone_links", "contacts", f"""
SELECT source_id, phone_digits, 't_' || substr(sha256(phone_digits), 1, 32) AS phone_id, length(phone_digits) = 10 AS is_valid
FROM (SELECT source_id, {digits("phone_raw")} AS phone_digits FROM contacts)""")

part("phones", "phone_links", """
SELECT DISTINCT phone_id, CASE WHEN is_valid THEN phone_digits END AS phone_normalized,
 CASE WHEN is_valid THEN substr(sha256(phone_digits), 1, 16) END AS phone_hash, is_valid, 'mobile' AS phone_type FROM phone_links""")

part("policies", "quotes", f"""
SELECT *, CASE WHEN expiration_date > {AS_OF} THEN 'active' ELSE 'lapsed' END AS status, expiration_date < {AS_OF} AS is_lapsed FROM (
 SELECT 'pol_' || substr(sha256(quote_id), 1, 32) AS policy_id, quote_id, {AS_OF} - greatest(1, insurance_lapse_days) AS inception_date,
 {AS_OF} - greatest(1, insurance_lapse_days) + 365 AS expiration_date FROM quotes)""")

part("graph_rows", "claims vehicles contacts", f"""
SELECT c.claim_id, c.quote_id, c.is_fraud, c.state, v.vin, v.make, v.model, v.year,
 CASE WHEN c.attorney_present THEN 'attorney_' || CAST(c.attorney_key AS VARCHAR) END AS attorney_id,
 CASE WHEN length({digits("k.phone_raw")}) = 10 THEN {digits("k.phone_raw")} END AS phone,
 {address("k.address_line1_raw", "k.city_raw", "k.state", "k.zip_raw")} AS address
FROM claims c JOIN vehicles v ON v.quote_id = c.quote_id
LEFT JOIN contacts k ON k.source_id = c.quote_id""")


def node(label: str, node_id: str, where: str = "true", **values: str) -> str:
    columns = {"is_fraud": "CAST(NULL AS BOOLEAN)", "state": "NULL", "make": "NULL", "model": "NULL", "year": "CAST(NULL AS INT)", "attr_type": "NULL", "attr_value": "NULL", **values}
    return f"SELECT DISTINCT {node_id} AS node_id, '{label}' AS label, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM graph_rows WHERE {where}"


part("nodes", "graph_rows", " UNION ALL ".join([
    node("Claim", "claim_id", is_fraud="is_fraud", state="state"),
    node("Claimant", "'claimant_' || claim_id", is_fraud="is_fraud"),
    node("Attorney", "attorney_id", "attorney_id IS NOT NULL"),
    node("Vehicle", "vin", make="make", model="model", year="year"),
    *[node("Entity", entity(k, k), f"{k} IS NOT NULL GROUP BY ALL", attr_type=f"'{k}'", attr_value=f"min({k})") for k in ("phone", "address")],
]))

part("edges", "graph_rows", """
SELECT 'claimant_' || claim_id AS src, claim_id AS dst, 'FILED' AS rel_type, CAST(NULL AS VARCHAR) AS attr_type, 'Claimant' AS src_label FROM graph_rows
UNION ALL SELECT 'claimant_' || claim_id, attorney_id, 'REPRESENTED_BY', NULL, 'Claimant' FROM graph_rows WHERE attorney_id IS NOT NULL
UNION ALL SELECT claim_id, vin, 'INVOLVES', NULL, 'Claim' FROM graph_rows
""" + " ".join(
    f"UNION ALL SELECT {src}, {entity(k, k)}, 'SHARES', '{k}', '{label}' FROM graph_rows WHERE {k} IS NOT NULL"
    for k in ("phone", "address") for src, label in (("'claimant_' || claim_id", "Claimant"), ("claim_id", "Claim"))
))

part("claim_entities", "edges", "SELECT src AS claim_id, dst AS entity_id FROM edges WHERE rel_type = 'SHARES' AND src_label = 'Claim'")
part("shared_entities", "claim_entities", """
SELECT entity_id, count(DISTINCT claim_id) AS n_claims FROM claim_entities GROUP BY entity_id HAVING count(DISTINCT claim_id) > 1""")
part("centrality", "edges", """
SELECT attorney_id, degree, CAST(degree AS DOUBLE) / CAST((max(degree) OVER ()) AS DOUBLE) AS centrality
FROM (SELECT dst AS attorney_id, count(*) AS degree FROM edges WHERE rel_type = 'REPRESENTED_BY' GROUP BY dst)""")
part("claim_centrality", "edges centrality nodes", """
SELECT n.node_id AS claim_id, coalesce(max(t.centrality), CAST(0 AS DOUBLE)) AS attorney_centrality_score FROM nodes n
LEFT JOIN edges f ON f.dst = n.node_id AND f.rel_type = 'FILED'
LEFT JOIN edges r ON r.src = f.src AND r.rel_type = 'REPRESENTED_BY'
LEFT JOIN centrality t ON t.attorney_id = r.dst WHERE n.label = 'Claim' GROUP BY n.node_id""")
part("claim_shared", "claim_entities nodes", """
SELECT n.node_id AS claim_id, CAST(coalesce(s.cnt, 0) AS INT) AS shared_attribute_count FROM nodes n LEFT JOIN (
 SELECT a.claim_id, count(DISTINCT a.entity_id) AS cnt FROM claim_entities a JOIN claim_entities b ON a.entity_id = b.entity_id AND a.claim_id <> b.claim_id
 GROUP BY a.claim_id) s ON s.claim_id = n.node_id WHERE n.label = 'Claim'""")
part("adjacent", "edges", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
part("ties", "edges", """SELECT src, dst FROM edges WHERE rel_type <> 'REPRESENTED_BY' UNION SELECT dst, src FROM edges WHERE rel_type <> 'REPRESENTED_BY'""")
RECURSIVE["communities"] = "communities(node_id, community) USING KEY (node_id) AS"
part("communities", "ties", """
SELECT src, min(least(src, dst)) FROM ties GROUP BY src
UNION SELECT t.dst, min(c.community) FROM communities c JOIN ties t ON t.src = c.node_id JOIN recurring.communities k ON k.node_id = t.dst
 WHERE c.community < k.community GROUP BY t.dst""")
part("reached_0", "nodes", "SELECT node_id, 0 AS hop FROM nodes WHERE label = 'Claim' AND is_fraud")
for _hop in range(1, 7):
    part(f"reached_{_hop}", f"reached_{_hop - 1} adjacent", f"""
SELECT * FROM reached_{_hop - 1} UNION ALL SELECT DISTINCT a.dst, {_hop} FROM adjacent a JOIN reached_{_hop - 1} r ON r.node_id = a.src AND r.hop = {_hop - 1}
WHERE NOT EXISTS (SELECT 1 FROM reached_{_hop - 1} k WHERE k.node_id = a.dst)""")
part("claim_hops", "reached_6 nodes", """
SELECT n.node_id AS claim_id, coalesce(r.hop, 999) AS graph_hop_distance FROM nodes n LEFT JOIN reached_6 r ON r.node_id = n.node_id WHERE n.label = 'Claim'""")
part("graph_features", "claim_hops claim_shared claim_centrality", """
SELECT h.claim_id, s.shared_attribute_count, h.graph_hop_distance, t.attorney_centrality_score
FROM claim_hops h JOIN claim_shared s ON s.claim_id = h.claim_id JOIN claim_centrality t ON t.claim_id = h.claim_id""")
part("claims_enriched", "claims graph_features", f"""
SELECT c.*, f.shared_attribute_count, f.graph_hop_distance, f.attorney_centrality_score, {ANY_SIGNAL} AS telematics_available
FROM claims c LEFT JOIN graph_features f ON f.claim_id = c.claim_id""")
part("claim_vectors_enriched", "claims_enriched quotes", claim_vector(
    "claims_enriched", "nullif(c.graph_hop_distance, 999)", "coalesce(c.shared_attribute_count, 0)", "coalesce(c.attorney_centrality_score, 0)"
))
part("scored", "quotes", """
SELECT quote_id, claim_occurred, risk_score_at_issuance AS p, prior_loss_severity_avg AS e_cost, policy_tier_at_issuance FROM quotes""")
part("costed", "claims quotes", """
SELECT c.incurred_loss_usd AS actual, q.prior_loss_severity_avg AS predicted FROM claims c JOIN quotes q ON q.quote_id = c.quote_id""")
part("hurdle", "scored", """
SELECT quote_id, claim_occurred, p_claim, e_cost_usd, p_claim * e_cost_usd AS risk_score FROM (
 SELECT quote_id, claim_occurred, e_cost * CAST(1.2 AS DOUBLE) AS e_cost_usd,
 1 / (1 + exp(-(CAST(1.1 AS DOUBLE) * ln(q / (1 - q)) + CAST(-0.3 AS DOUBLE)))) AS p_claim
 FROM (SELECT *, least(CAST(0.999999999 AS DOUBLE), greatest(CAST(1e-9 AS DOUBLE), p)) AS q FROM scored))""")
part("model_rows", "quotes", f"""
SELECT quote_id, claim_occurred, CASE WHEN state NOT IN {RESTRICTED} THEN CAST(credit_score AS DOUBLE) END AS credit_score,
 vehicle_msrp / greatest(CAST(1 AS DOUBLE), vehicle_power) AS vehicle_msrp_power_ratio, CAST(CAST(telematics_enrolled AS INT) AS DOUBLE) AS telematics_enrolled,
 {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_FEATURES if c not in ("credit_score", "vehicle_msrp_power_ratio", "telematics_enrolled"))}
FROM quotes""")


def assemble(body: str, needs: str) -> str:
    """One statement with exactly the parts ``body`` needs, each before its users."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][0].split():
            visit(other)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    start = "WITH RECURSIVE " if RECURSIVE.keys() & set(order) else "WITH "
    return start + ",\n".join(f"{RECURSIVE.get(name, f'{name} AS MATERIALIZED')} ({PARTS[name][1]})" for name in order) + "\n" + body


def auc(table: str, label: str, score: str) -> str:
    """Rank-sum AUC with middle ranks for ties."""
    return f"""(SELECT (sum(CASE WHEN {label} THEN r ELSE 0 END) - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)) FROM (
 SELECT {label}, CAST(rank() OVER (ORDER BY {score}) AS DOUBLE) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r,
 CAST(count(*) OVER () AS DOUBLE) AS n, CAST(sum(CASE WHEN {label} THEN 1 ELSE 0 END) OVER () AS DOUBLE) AS n_pos FROM {table}) GROUP BY n, n_pos)"""


def row_rule(check: str, dataset: str, table: str, key: str, bad: str, threshold: str, status: str = "FAIL") -> str:
    return f"""
SELECT '{check}' AS check_id, '{dataset}' AS dataset, CASE WHEN n > 0 THEN '{status}' ELSE 'PASS' END AS status, CAST(n AS DOUBLE) AS observed,
 '{threshold}' AS threshold, n AS n_bad, examples FROM (SELECT count(*) AS n, array_to_string(list_sort(list(k) FILTER (WHERE rn <= 5)), ',') AS examples
 FROM (SELECT CAST({key} AS VARCHAR) AS k, row_number() OVER (ORDER BY CAST({key} AS VARCHAR)) AS rn FROM {table} WHERE {bad}))"""


def value_rule(check: str, dataset: str, table: str, observed: str, threshold: str, status: str) -> str:
    """``status`` is a CASE body over the unrounded value ``o``."""
    return f"""
SELECT '{check}' AS check_id, '{dataset}' AS dataset, CASE WHEN o IS NULL THEN 'SKIP' {status} END AS status, round(CAST(o AS DOUBLE), 6) AS observed,
 '{threshold}' AS threshold, CAST(NULL AS BIGINT) AS n_bad, CAST(NULL AS VARCHAR) AS examples FROM (SELECT {observed} AS o FROM {table})"""


_MIXED = "NOT ((" + " + ".join(f"CAST({s} IS NULL AS INT)" for s in TELEMATICS_SIGNALS) + ") IN (0, 4))"
_STATE_LIST = "(" + ",".join(f"'{s}'" for s in US_STATES) + ")"


def share(condition: str, of: str = "true") -> str:
    return f"avg(CASE WHEN {of} THEN CASE WHEN {condition} THEN 1.0 ELSE 0.0 END END)"


QUALITY: dict[str, tuple[list[str], str]] = {
    "quality_quotes": ([
        row_rule("V1", "quotes", "quotes", "quote_id", f"state NOT IN {_STATE_LIST}", "state in list"),
        row_rule("V2", "quotes", "quotes", "quote_id", "credit_score < 500 OR credit_score > 850", "[500,850]"),
        row_rule("V22", "quotes", "quotes", "quote_id", _MIXED, "all or none"),
        row_rule("V23", "quotes", "quotes", "quote_id", f"state NOT IN {RESTRICTED} AND credit_score IS NULL", "present"),
        value_rule("V23_restricted", "quotes", "quotes", f"count(*) FILTER (WHERE state IN {RESTRICTED})", "info", "ELSE 'INFO'"),
        value_rule("V3", "quotes", "quotes", "avg(CAST(claim_occurred AS INT))", "[0.02,0.25]", "WHEN o < 0.02 OR o > 0.25 THEN 'WARN' ELSE 'PASS'"),
    ], "quotes"),
    "quality_claims": ([
        value_rule("V4", "claims", "claims", "avg(CAST(is_fraud AS INT))", "[0.15,0.45]", "WHEN o < 0.15 OR o > 0.45 THEN 'WARN' ELSE 'PASS'"),
        row_rule("V5", "claims", "claims", "claim_id", "policy_inception_days < 0", ">=0"),
        row_rule("V6", "claims", "claims", "claim_id", "reporting_delay_days < 0", ">=0"),
        row_rule("V22", "claims", "claims", "claim_id", _MIXED, "all or none"),
        row_rule("V7", "claims", "claims", "claim_id", "incurred_loss_usd IS NULL", "not null"),
        row_rule("V7b", "claims", "claims", "claim_id", "incurred_loss_usd <= 0", ">0"),
        value_rule("V8", "claims", "claims", "avg(incurred_loss_usd) FILTER (WHERE is_fraud) - avg(incurred_loss_usd) FILTER (WHERE NOT is_fraud)", "fraud mean above", "WHEN o <= 0 THEN 'WARN' ELSE 'PASS'"),
    ], "claims"),
    "quality_graph_features": ([
        value_rule("V9", "graph_features", "claims_enriched", share("graph_hop_distance = 999"), "0.2/0.5", "WHEN o > 0.5 THEN 'FAIL' WHEN o > 0.2 THEN 'WARN' ELSE 'PASS'"),
        value_rule("V9_min", "graph_features", "claims_enriched", "min(graph_hop_distance) FILTER (WHERE graph_hop_distance <> 999)", "info", "ELSE 'INFO'"),
        value_rule("V9_median", "graph_features", "claims_enriched", "median(graph_hop_distance) FILTER (WHERE graph_hop_distance <> 999)", "info", "ELSE 'INFO'"),
        value_rule("V9_max", "graph_features", "claims_enriched", "max(graph_hop_distance) FILTER (WHERE graph_hop_distance <> 999)", "info", "ELSE 'INFO'"),
        row_rule("V10", "graph_features", "claims_enriched", "claim_id", "attorney_centrality_score < 0 OR attorney_centrality_score > 1", "[0,1]"),
        row_rule("V11", "graph_features", "claims_enriched", "claim_id", "shared_attribute_count < 0", ">=0"),
        value_rule("V39", "graph_features", "claims_enriched", share("graph_hop_distance = 999"), "<1", "WHEN o >= 1 THEN 'WARN' ELSE 'PASS'"),
    ], "claims_enriched"),
    "quality_graph_topology": ([
        value_rule("V12_nodes", "graph", "nodes", "count(DISTINCT node_id)", ">0", "WHEN o = 0 THEN 'FAIL' ELSE 'PASS'"),
        *(value_rule(f"V12_nodes_{label}", "graph", "nodes", f"count(*) FILTER (WHERE label = '{label}')", "info", "ELSE 'INFO'") for label in ("Claimant", "Claim", "Attorney", "Vehicle", "Entity")),
        *(value_rule(f"V12_edges_{kind}", "graph", "edges", f"count(*) FILTER (WHERE rel_type = '{kind}')", "info", "ELSE 'INFO'") for kind in ("FILED", "REPRESENTED_BY", "INVOLVES", "SHARES")),
        value_rule("V12_edge_ends", "graph", "edges", "count(*) * 2", ">0", "WHEN o = 0 THEN 'FAIL' ELSE 'PASS'"),
        value_rule("V13", "graph", "nodes", "count(*) FILTER (WHERE label = 'Claimant' AND is_fraud)", "5", "WHEN o = 0 THEN 'FAIL' WHEN o < 5 THEN 'WARN' ELSE 'PASS'"),
        row_rule("V14", "graph", "nodes", "node_id", "label = 'Claimant' AND node_id NOT IN (SELECT src FROM edges) AND node_id NOT IN (SELECT dst FROM edges)", "0", "WARN"),
    ], "nodes edges"),
    "quality_entities": ([
        row_rule("V16", "vehicles", "vehicles", "quote_id", "vin IS NULL", "not null"),
        value_rule("V17", "persons", "persons", "count(person_id) - count(DISTINCT person_id)", "0", "WHEN o > 0 THEN 'FAIL' ELSE 'PASS'"),
        row_rule("V18", "addresses", "addresses", "address_id", "address_hash IS NULL", "not null"),
        value_rule("V19", "phones", "phones", "avg(CAST(is_valid AS INT))", "info", "ELSE 'INFO'"),
        row_rule("V20", "policies", "policies", "policy_id", "inception_date > expiration_date", "inception<=expiration"),
    ], "vehicles persons addresses phones policies"),
    "quality_spine": ([
        row_rule("V26", "claims", "(SELECT DISTINCT quote_id FROM claims)", "quote_id", "quote_id NOT IN (SELECT quote_id FROM quotes)", "0"),
        row_rule("V27", "claims", "claims c JOIN quotes q ON q.quote_id = c.quote_id", "claim_id", "abs(c.risk_score_at_issuance - q.risk_score_at_issuance) > 1e-6", "1e-6"),
    ], "claims quotes"),
}


def _as_number(name: str) -> str:
    boolean = name in ("attorney_present", "device_fingerprint_match", "telematics_available")
    return f"CAST({f'CAST({name} AS INT)' if boolean else name} AS DOUBLE)"


_SIGNAL_RULES = [
    value_rule(
        f"V24_{name}", "claims", "claims_enriched",
        f"avg({_as_number(name)}) FILTER (WHERE is_fraud) - avg({_as_number(name)}) FILTER (WHERE NOT is_fraud)", direction,
        f"WHEN o {'<=' if direction == 'greater' else '>='} 0 THEN 'FAIL' ELSE 'PASS'",
    )
    for name, direction in FRAUD_SIGNAL_DIRECTIONS.items()
] + [
    value_rule(
        f"V25_{name}", "claims", "claims_enriched",
        f"CASE WHEN count({_as_number(name)}) >= 10 AND NOT isnan(corr({_as_number(name)}, CAST(is_fraud AS INT))) THEN corr({_as_number(name)}, CAST(is_fraud AS INT)) END",
        "positive" if sign > 0 else "negative",
        f"WHEN abs(o) < 0.01 THEN 'WARN' WHEN o * ({sign}) < 0 THEN 'FAIL' ELSE 'PASS'",
    )
    for name, sign in FRAUD_CORRELATION_SIGNS.items()
]
QUALITY["quality_fraud_signals"] = (_SIGNAL_RULES + [
    value_rule("V28_zero", "claims", "claims_enriched", share("attorney_centrality_score = 0", "attorney_present"), "0.2", "WHEN o > 0.2 THEN 'WARN' ELSE 'PASS'"),
    value_rule("V28_high", "claims", "claims_enriched", share("attorney_centrality_score > 0.3", "NOT attorney_present"), "0.1", "WHEN o > 0.1 THEN 'WARN' ELSE 'PASS'"),
    value_rule("V29_fraud", "claims", "claims_enriched", share("graph_hop_distance = 999", "is_fraud"), "0.3", "WHEN o > 0.3 THEN 'FAIL' ELSE 'PASS'"),
    value_rule("V29_gap", "claims", "claims_enriched", share("graph_hop_distance = 999", "NOT is_fraud") + " - " + share("graph_hop_distance = 999", "is_fraud"), "legit above fraud", "WHEN o < 0 THEN 'WARN' ELSE 'PASS'"),
], "claims_enriched")

_TRIO_BAD = {
    "available": f"telematics_available AND NOT ({ANY_SIGNAL})",
    "missing": "telematics_enrolled_but_missing AND telematics_available",
    "neither": f"NOT telematics_available AND NOT telematics_enrolled_but_missing AND ({ANY_SIGNAL})",
}
_ANY_TRIO = " OR ".join(f"({v})" for v in _TRIO_BAD.values())
QUALITY["quality_trio"] = (
    [row_rule(f"V21_{k}", "quotes", "quote_vectors", "quote_id", v, "0") for k, v in _TRIO_BAD.items()]
    + [row_rule(f"V21_{k}", "claims", "claim_vectors", "claim_id", v, "0") for k, v in _TRIO_BAD.items()], "quote_vectors claim_vectors",
)
QUALITY["quality_quote_snapshots"] = ([
    row_rule("V30", "quote_snapshots", "quote_vectors", "quote_id", "quote_id IS NULL", "complete"),
    row_rule("V31", "quote_snapshots", "quote_vectors", "quote_id", "false", "v1.0.0"),
    row_rule("V32", "quote_snapshots", "quote_vectors", "quote_id", "false", "all keys"),
    row_rule("V34", "quote_snapshots", "quote_vectors", "quote_id", _ANY_TRIO, "0"),
    row_rule("V35", "quote_snapshots", "quote_vectors", "quote_id", "risk_score_at_issuance < 0 OR risk_score_at_issuance > 1 OR (driver_age > 0 AND driver_age < 15) OR vehicle_msrp_power_ratio < 0", "in range"),
    row_rule("V36", "quote_snapshots", "quote_vectors", "quote_id", "isnan(vehicle_msrp_power_ratio)", "no NaN"),
    row_rule("V33", "quote_snapshots", "quote_vectors", "quote_id", f"(state IN {RESTRICTED} AND (credit_score IS NOT NULL OR credit_eligible)) OR (state NOT IN {RESTRICTED} AND NOT credit_eligible)", "masked"),
], "quote_vectors")
QUALITY["quality_claim_snapshots"] = ([
    row_rule("V30", "claim_snapshots", "claim_vectors_enriched", "claim_id", "claim_id IS NULL", "complete"),
    row_rule("V31", "claim_snapshots", "claim_vectors_enriched", "claim_id", "false", "v1.0.0"),
    row_rule("V32", "claim_snapshots", "claim_vectors_enriched", "claim_id", "false", "all keys"),
    row_rule("V34", "claim_snapshots", "claim_vectors_enriched", "claim_id", _ANY_TRIO, "0"),
    row_rule("V35", "claim_snapshots", "claim_vectors_enriched", "claim_id", "policy_inception_days < 0 OR reporting_delay_days < 0 OR shared_attribute_count < 0 OR attorney_centrality_score < 0 OR attorney_centrality_score > 1 OR graph_hop_distance < 0 OR graph_hop_distance = 999", "in range"),
    row_rule("V36", "claim_snapshots", "claim_vectors_enriched", "claim_id", "isnan(attorney_centrality_score)", "no NaN"),
    row_rule("V37", "claim_snapshots", "claim_vectors_enriched", "claim_id", "risk_score_at_issuance IS NULL", "0", "WARN"),
    value_rule("V38", "claim_snapshots", "claim_vectors_enriched", "count(*) FILTER (WHERE telematics_enrolled_but_missing)", ">0", "WHEN o = 0 THEN 'FAIL' ELSE 'PASS'"),
], "claim_vectors_enriched")
QUALITY["quality_snapshot_spine"] = ([
    row_rule("V26_snapshots", "claims", "(SELECT DISTINCT quote_id FROM claim_vectors)", "quote_id", "quote_id NOT IN (SELECT quote_id FROM quote_vectors)", "0"),
    row_rule("V27_snapshots", "claims", "claim_vectors c JOIN quote_vectors q ON q.quote_id = c.quote_id", "claim_id", "abs(c.risk_score_at_issuance - q.risk_score_at_issuance) > 1e-6", "1e-6"),
], "claim_vectors quote_vectors")
