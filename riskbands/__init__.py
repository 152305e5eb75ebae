"""riskbands: transaction fraud-risk analytics on Spark DataFrames.

Profiles, risk bands (high / mid / low), threshold evidence and a current-vs-banded
decision-flow comparison, all as lazy DataFrame plans.
"""

from .policy import DEFAULT, Policy

__all__ = ["Policy", "DEFAULT"]
