"""Intent classification as column expressions.

Matching is plain substring search on the lower-cased text, no word
boundaries, exactly like the message service: "coffee" hits "fee".
Everything stays inside Catalyst/codegen; no Python runs per row.
"""
from __future__ import annotations

from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CLASS_RULES, FALLBACK_CLASS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _frozen(a):
    """A hashable copy of an argument by content; raises TypeError for others."""
    if isinstance(a, (list, tuple)):
        return tuple(map(_frozen, a))
    if isinstance(a, dict):
        return tuple((_frozen(k), _frozen(v)) for k, v in a.items())
    if a is None or isinstance(a, (str, int, float, bool)):
        return a
    raise TypeError("not a plain value")


def memo_per_context(fn):
    """Reuse a rule expression built from column *names* and rule tables: the
    Column is unresolved, so one object serves every DataFrame of the same
    application, and the hundreds of py4j calls that build it run once.

    The key holds the tables' contents, not their identity: equal tables share
    an expression, and a table changed in place or a new list that happens to
    take an old one's address gets its own. Calls with Columns are not kept."""
    cache: dict = {}

    @wraps(fn)
    def run(*args, **kwargs):
        try:
            key = (SparkContext._active_spark_context.applicationId, _frozen(args), _frozen(kwargs))
        except (TypeError, AttributeError):
            return fn(*args, **kwargs)
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]
    return run


def lowered(text) -> Column:
    return F.lower(_col(text))


def any_contains(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def all_contain(low: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [low.contains(w) for w in words])


@memo_per_context
def classify_lowered(low, rules=CLASS_RULES, fallback=FALLBACK_CLASS) -> Column:
    """First class with any keyword as a substring of ``low``; else ``fallback``.

    A trailing class equal to the fallback cannot change the answer, so it is
    not tested.
    """
    low = _col(low)
    active = list(rules)
    while active and active[-1][0] == fallback:
        active.pop()
    if not active:
        return F.lit(fallback)
    expr = None
    for name, words in active:
        cond = any_contains(low, words)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(fallback))


def classify(text, rules=CLASS_RULES, fallback=FALLBACK_CLASS) -> Column:
    """The query type of ``text``."""
    return classify_lowered(lowered(text), rules, fallback)


@memo_per_context
def keyword_hits(text, rules=CLASS_RULES) -> Column:
    """Every matching 'class:keyword' in rule order, comma-joined ('' if none).

    One codegen'd ``concat_ws`` (nulls skipped) over all keywords."""
    low = lowered(text)
    return F.concat_ws(",", *[F.when(low.contains(w), F.lit(f"{name}:{w}"))
                              for name, words in rules for w in words])


def explain_from_hits(hits, fallback=FALLBACK_CLASS) -> Column:
    """C2 trace from a ``keyword_hits`` column.

    struct(query_type, matched_by 'keyword'|'fallback', keyword,
           matched_classes array<string>, matched_keywords array<'class:kw'>).
    ``keyword`` is the first keyword (rule order) of the winning class.
    """
    h = _col(hits)
    first = F.substring_index(h, ",", 1)
    hit_list = F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ","))
    classes = F.array_distinct(F.transform(hit_list, lambda x: F.substring_index(x, ":", 1)))
    return F.struct(
        F.coalesce(F.nullif(F.substring_index(first, ":", 1), F.lit("")), F.lit(fallback)).alias("query_type"),
        F.when(h == "", F.lit("fallback")).otherwise(F.lit("keyword")).alias("matched_by"),
        F.nullif(F.substring_index(first, ":", -1), F.lit("")).alias("keyword"),
        classes.alias("matched_classes"),
        hit_list.alias("matched_keywords"),
    )


def explain_match(text, rules=CLASS_RULES, fallback=FALLBACK_CLASS) -> Column:
    """C2 as one column (for a DataFrame with many rows, add ``keyword_hits``
    as its own column first and call ``explain_from_hits`` on it, so the
    keyword scan stays in generated code)."""
    return explain_from_hits(keyword_hits(text, rules), fallback)


def classify_by_lang(text, lang, rules_by_lang=None, fallback=FALLBACK_CLASS) -> Column:
    """Pick the keyword table by language, then classify.

    ``rules_by_lang`` maps a language code to an ordered rule list; a language
    without a table gets the fallback class. The choice is one CASE over the
    language column, so it stays a per-row expression: no join, no shuffle.
    """
    rules_by_lang = rules_by_lang or {"en": CLASS_RULES}
    low = lowered(text)
    expr = None
    for code, rules in rules_by_lang.items():
        branch = classify_lowered(low, rules, fallback)
        cond = _col(lang) == F.lit(code)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return expr.otherwise(F.lit(fallback))
