"""All reports in one place."""

from . import reports_core, reports_jobs, reports_metrics  # noqa: F401
from .registry import REPORTS, oracle_sql, queries  # noqa: F401
