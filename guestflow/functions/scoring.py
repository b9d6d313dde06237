"""Confidence score, routing and bands as column expressions.

Scores are kept as integer hundredths while computing, which is exact and
equals rounding the float result to two places; the public score is
``cents / 100`` as a double.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import _col, all_contain, any_contains, lowered, memo_per_context
from .rules import (AGENT_REVIEW_CENTS, AMBIGUITY_PENALTY_CENTS, AMBIGUITY_PHRASES,
                    AUTO_SEND_CENTS, BAND_BELOW, BAND_COMPLAINT, BASE_SCORE_CENTS,
                    CONFIDENCE_BANDS, DEFAULT_SCORE_CENTS, MULTI_INTENT_PAIRS,
                    MULTI_INTENT_PENALTY_CENTS, SCORE_CEIL_CENTS, SCORE_FLOOR_CENTS)


def base_score_cents(query_type) -> Column:
    """Base score of a class; unknown classes get the default."""
    qt = _col(query_type)
    expr = None
    for name, cents in BASE_SCORE_CENTS.items():
        expr = (F.when(qt == name, F.lit(cents)) if expr is None
                else expr.when(qt == name, F.lit(cents)))
    return expr.otherwise(F.lit(DEFAULT_SCORE_CENTS))


def multi_intent(low: Column) -> Column:
    """C11: true if any pair has all its terms present."""
    return reduce(lambda a, b: a | b, [all_contain(low, pair) for pair in MULTI_INTENT_PAIRS])


def ambiguous(low: Column) -> Column:
    """True if any ambiguity phrase is present."""
    return any_contains(low, AMBIGUITY_PHRASES)


@memo_per_context
def score_cents_lowered(query_type, low) -> Column:
    """C13 in hundredths: complaint is fixed; otherwise base minus each
    penalty at most once, clamped."""
    qt, low = _col(query_type), _col(low)
    raw = (base_score_cents(qt)
           - F.when(multi_intent(low), F.lit(MULTI_INTENT_PENALTY_CENTS)).otherwise(F.lit(0))
           - F.when(ambiguous(low), F.lit(AMBIGUITY_PENALTY_CENTS)).otherwise(F.lit(0)))
    clamped = F.least(F.greatest(raw, F.lit(SCORE_FLOOR_CENTS)), F.lit(SCORE_CEIL_CENTS))
    return (F.when(qt == "complaint", F.lit(BASE_SCORE_CENTS["complaint"]))
            .otherwise(clamped))


def score_cents(query_type, text) -> Column:
    return score_cents_lowered(query_type, lowered(text))


def confidence(query_type, text) -> Column:
    """The confidence score as a double in [0, 1]."""
    return score_cents(query_type, text).cast("double") / F.lit(100.0)


def route_action(cents, query_type) -> Column:
    """C14: complaint → escalate; ≥ 0.85 auto_send; ≥ 0.60 agent_review; else escalate.

    Compares the rounded score (hundredths)."""
    c, qt = _col(cents), _col(query_type)
    return (F.when(qt == "complaint", F.lit("escalate"))
            .when(c >= AUTO_SEND_CENTS, F.lit("auto_send"))
            .when(c >= AGENT_REVIEW_CENTS, F.lit("agent_review"))
            .otherwise(F.lit("escalate")))


def confidence_band(cents, query_type) -> Column:
    """Named band; lower bound inclusive; complaints have their own band."""
    c, qt = _col(cents), _col(query_type)
    expr = F.when(qt == "complaint", F.lit(BAND_COMPLAINT))
    for lower, name in CONFIDENCE_BANDS:
        expr = expr.when(c >= lower, F.lit(name))
    return expr.otherwise(F.lit(BAND_BELOW))


def context_penalty_cents(query_type, low: Column, wifi_password, property_known,
                          penalty_cents: int = 25) -> Column:
    """C20: lower the score when the property lacks the asked-for fact.

    Our rule: a check-in question that mentions wifi (or wi-fi/password) while
    the property has no WiFi password on file, or any non-complaint question
    about an unknown property, loses ``penalty_cents``.
    """
    asks_wifi = any_contains(low, ["wifi", "wi-fi", "password"])
    qt = _col(query_type)
    missing = ((qt == "post_sales_checkin") & asks_wifi & _col(wifi_password).isNull()) | \
              (~_col(property_known) & (qt != "complaint"))
    return F.when(missing, F.lit(penalty_cents)).otherwise(F.lit(0))
