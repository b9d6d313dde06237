"""guestflow: guest-message processing and reporting as Spark DataFrame jobs.

Main entry points::

    from guestflow import build_session, process_messages, classify, confidence, route_action
    spark = build_session()
    responses = process_messages(spark, "/path/to/sf_dir")

Column functions live in ``guestflow.functions``; table operators in
``guestflow.operators``; the composed flow and the registered queries in
``guestflow.plans``; stream jobs in ``guestflow.streaming``.
"""
from .functions.classify import classify, classify_by_lang, explain_match
from .functions.scoring import confidence, route_action, score_cents
from .plans.process import draft_replies, process_messages, processed, with_decision
from .session import build_session

__all__ = ["build_session", "classify", "classify_by_lang", "explain_match", "confidence", "route_action",
           "score_cents", "process_messages", "processed", "with_decision", "draft_replies"]
