"""Fixed domain values shared by every operator."""

# US states and DC, in the order the fixture indexes them.
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID",
    "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

# States that forbid credit-based underwriting.
CREDIT_RESTRICTED_STATES = ["CA", "MA", "MI", "HI"]

# Feature store version, hop sentinel and hop limit.
FEATURE_STORE_VERSION = "v1.0.0"
HOP_SENTINEL = 999
MAX_HOPS = 6

# The telematics signals of a quote.
TELEMATICS_SIGNALS = [
    "telematics_distraction_score",
    "telematics_hard_brake_rate",
    "telematics_crash_match",
    "telematics_commute_entropy",
]

# Policy tier upper bounds on the issuance risk score.
POLICY_TIERS = [(0.25, "platinum"), (0.45, "gold"), (0.65, "silver")]
LOWEST_TIER = "bronze"

# VIN decoding tables (model year, make, model).
VIN_YEARS = {
    "0": 2020, "1": 2021, "2": 2022, "3": 2023, "4": 2024, "5": 2025, "6": 2026,
    "7": 2019, "8": 2018, "9": 2017, "A": 2010, "B": 2011, "C": 2012, "D": 2013,
    "E": 2014, "F": 2015, "G": 2016, "H": 2017, "J": 2018, "K": 2019, "L": 2020,
    "M": 2021, "N": 2022, "P": 2023, "R": 2024, "S": 2025, "T": 2026, "V": 2027,
    "W": 2028, "X": 2029, "Y": 2030, "Z": 2031,
}
DEFAULT_VIN_YEAR = 2023
VIN_MAKES = {
    "0": "Toyota", "1": "Honda", "2": "Ford", "3": "BMW", "4": "Audi",
    "5": "Mercedes", "6": "Volkswagen", "7": "Nissan", "8": "Hyundai", "9": "Kia",
    "A": "Mazda", "B": "Subaru", "C": "Volvo", "D": "Jaguar", "E": "Lexus",
    "F": "Tesla", "G": "Chevrolet", "H": "GMC", "I": "Cadillac", "J": "Buick",
}
DEFAULT_VIN_MAKE = "Toyota"
VIN_MODELS = {
    "0": "Civic", "1": "Accord", "2": "Corolla", "3": "Camry", "4": "Model 3",
    "5": "Model Y", "6": "Mustang", "7": "Escape", "8": "F-150", "9": "Ram 1500",
    "A": "A4", "B": "3 Series", "C": "C-Class", "D": "Q5", "E": "Q7",
}
DEFAULT_VIN_MODEL = "Civic"

# Street suffix abbreviations and their long forms.
STREET_SUFFIXES = {
    "St": "Street", "Ave": "Avenue", "Blvd": "Boulevard",
    "Dr": "Drive", "Rd": "Road", "Ln": "Lane",
}

# The model inputs, in model order.
MODEL_FEATURES = [
    "credit_score",
    "prior_loss_frequency",
    "prior_loss_severity_avg",
    "insurance_lapse_days",
    "violation_severity_index",
    "household_driver_density",
    "driver_age",
    "years_licensed",
    "vehicle_msrp_power_ratio",
    "vehicle_adas_score",
    "vehicle_age_years",
    "geohash_risk_score",
    "annual_mileage_estimate",
    "telematics_distraction_score",
    "telematics_hard_brake_rate",
    "telematics_crash_match",
    "telematics_commute_entropy",
    "telematics_enrolled",
]

# Expected direction of each claim signal, fraud mean against legitimate mean.
FRAUD_SIGNAL_DIRECTIONS = {
    "attorney_present": "greater",
    "reporting_delay_days": "greater",
    "claimant_count": "greater",
    "shared_attribute_count": "greater",
    "attorney_centrality_score": "greater",
    "narrative_inconsistency_score": "greater",
    "narrative_complexity_score": "greater",
    "ip_geolocation_delta_miles": "greater",
    "prior_claims_count": "greater",
    "incurred_loss_usd": "greater",
    "device_fingerprint_match": "less",
    "policy_inception_days": "less",
    "telematics_available": "less",
}

# Expected sign of each claim signal's correlation with the fraud label.
FRAUD_CORRELATION_SIGNS = {
    "attorney_present": 1,
    "reporting_delay_days": 1,
    "claimant_count": 1,
    "shared_attribute_count": 1,
    "attorney_centrality_score": 1,
    "narrative_inconsistency_score": 1,
    "ip_geolocation_delta_miles": 1,
    "prior_claims_count": 1,
    "incurred_loss_usd": 1,
    "device_fingerprint_match": -1,
    "policy_inception_days": -1,
    "telematics_available": -1,
}
