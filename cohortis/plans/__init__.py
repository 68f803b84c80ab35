"""All registered queries."""

from cohortis.plans import cleaning, evaluation, interaction, modelling, sampling
from cohortis.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "evaluation", "interaction", "modelling", "sampling"]
