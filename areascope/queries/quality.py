"""Data-quality checks: the 35 declared not_null / unique / accepted_values tests (Q-01..Q-03)."""

from __future__ import annotations


from areascope import oracle as O
from areascope.operators import quality as Q
from areascope.plans.checks import CHECKS, RAW_CHECKS, declared, stored_checks
from areascope.plans.layers import Layers
from areascope.queries.base import layers, register



_MODEL_ATTR = {"stg_home_values": "stg_home_values", "stg_rental_prices": "stg_rental_prices", "stg_amenities": "stg_amenities",
               "stg_schools": "stg_schools", "int_price_trends": "price_trends", "int_rental_yield": "rental_yield",
               "int_neighborhood_score": "neighborhood_score", "int_school_score": "school_score",
               "market_intelligence": "market_intelligence", "investment_hotspots": "investment_hotspots",
               "area_comparison": "area_comparison"}


def _dq(spark, sf_dir, test):
    p = layers(spark, sf_dir)
    parts = []
    for model, specs in CHECKS.items():
        checks = declared(s for s in specs if s[1] == test)
        if checks:
            parts.append(Q.run_checks(model, getattr(p, _MODEL_ATTR[model]), checks))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _check_sql(model, spec):
    col, test = spec[0], spec[1]
    if test == "not_null":
        cond = f"SELECT count(*) FROM {model} WHERE {col} IS NULL"
    elif test == "unique":
        cond = f"SELECT count(*) FROM (SELECT {col} FROM {model} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1)"
    else:
        vals = ", ".join(repr(v) if isinstance(v, str) else str(v) for v in spec[2])
        cond = f"SELECT count(*) FROM {model} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})"
    return f"SELECT '{model}' AS model, '{col}' AS column_name, '{test}' AS test, ({cond}) AS violations"


def _dq_sql(test):
    return O.with_models("\nUNION ALL\n".join(_check_sql(m, s) for m, specs in CHECKS.items() for s in specs if s[1] == test))


for _t in ("not_null", "unique", "accepted_values"):
    def _make(test):
        def q(spark, sf_dir):
            return _dq(spark, sf_dir, test)
        q.__name__ = f"q_dq_{test}"
        return q
    register(f"dq_{_t}", _dq_sql(_t))(_make(_t))


@register("dq_raw", O.with_models("\nUNION ALL\n".join(_check_sql(m, s) for m, specs in RAW_CHECKS.items() for s in specs)))
def q_dq_raw(spark, sf_dir):
    """The declared kinds of checks on the raw tables, where they find something."""
    p = layers(spark, sf_dir)
    parts = [Q.run_checks(m, getattr(p, m), declared(specs)) for m, specs in RAW_CHECKS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STORED = {**{m: CHECKS[m] for m in CHECKS if not m.startswith("stg_")}, **RAW_CHECKS}


@register("dq_build", O.with_models("\nUNION ALL\n".join(_check_sql(m, s) for m, specs in _STORED.items() for s in specs)))
def q_dq_build(spark, sf_dir):
    """A build whose checks are counted while its tables are written: one row for each check of each stored model."""
    p = Layers.from_benchmark(spark, sf_dir, checks=stored_checks())
    for name in _STORED:
        getattr(p, _MODEL_ATTR.get(name, name))
    return spark.createDataFrame([f for m in _STORED for f in p.violations[m]], "model string, column_name string, test string, violations bigint")
