"""Workforce, staffing and billing analytics as PySpark DataFrame operators."""

from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables

__all__ = ["Periods", "Tables"]
