"""All registered queries of the investigation operators."""

from caseloom.plans import behaviour, build, codes, files, graph, landing, loads, relational, rules, searching, text  # noqa: F401
from caseloom.plans.registry import ORACLES, QUERIES  # noqa: F401
