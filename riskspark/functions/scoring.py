"""Rule score, policy tier, hurdle product and probability calibration."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.constants import LOWEST_TIER, POLICY_TIERS
from riskspark.functions.values import clip, truthy


RULE_SCORE = """
least(1.0D, greatest(0.0D,
    greatest(0.0D, 760.0D - coalesce(nullif(cast(credit_score AS double), 0.0D), 760.0D)) / 300.0D
    + least(1.0D, coalesce(prior_loss_frequency, 0.0D) * 0.35D)
    + least(1.0D, coalesce(prior_loss_severity_avg, 0.0D) / 20000.0D * 0.35D)
    + least(1.0D, coalesce(cast(insurance_lapse_days AS double), 0.0D) / 120.0D * 0.20D)
    + least(1.0D, coalesce(violation_severity_index, 0.0D) / 5.0D * 0.18D)
    + if(telematics_enrolled AND telematics_distraction_score IS NULL, 0.12D, 0.0D)
    + if(vehicle_power > 220.0D, 0.08D, 0.0D)))
"""


def rule_risk_score() -> Column:
    """Issuance risk from the quote columns. A missing or zero credit score counts as 760."""
    return F.expr(RULE_SCORE)


def policy_tier(score: Column) -> Column:
    bounds = iter(POLICY_TIERS)
    limit, tier = next(bounds)
    chain = F.when(score < limit, tier)
    for limit, tier in bounds:
        chain = chain.when(score < limit, tier)
    return F.when(score.isNotNull(), chain.otherwise(LOWEST_TIER))


def logit(p: Column, margin: float = 1e-9) -> Column:
    bounded = clip(p, margin, 1.0 - margin)
    return F.ln(bounded / (1.0 - bounded))


def platt(p: Column, a: Column, b: Column) -> Column:
    """Platt scaling, or ``p`` itself where no slope was fitted."""
    scaled = 1.0 / (1.0 + F.exp(-(a * logit(p) + b)))
    return F.when(a.isNull(), p).otherwise(scaled)


def debias(cost: Column, bias: Column) -> Column:
    return cost * F.coalesce(bias, F.lit(1.0))


def hurdle(p_claim: Column, e_cost: Column) -> Column:
    return p_claim * e_cost


def agreed_score(underwriting: Column, claim: Column) -> Column:
    """Underwriting value when it is present and not zero, else the claim's own."""
    return F.coalesce(truthy(underwriting, 0.0), claim)
