"""Imports every query module so that all queries are registered."""

from concordat.plans import (  # noqa: F401
    fixtures,
    q_contract,
    q_coverage,
    q_evidence,
    q_expressions,
    q_extraction,
    q_findings,
    q_portfolio,
    q_scan,
    q_sources,
    q_specs,
    q_streaming,
)
