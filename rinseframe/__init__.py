"""Table cleaning, validation and profiling on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from rinseframe.frames import nan_to_null
from rinseframe.model import ALL_TEXT, ROW_ID, Proposal, Recipe, Rulebook
from rinseframe.operators import columns, fill, rows, rules, values  # noqa: F401  (registers the steps)
from rinseframe.operators.rules import (
    check_expression, range_defaults, resolution, total_violations, validate, violating_rows, violation_cells,
    violation_report,
)
from rinseframe.operators.scout import accept, find_problems, scout
from rinseframe.plans.compile import Context, apply_prefix, apply_recipe
from rinseframe.plans.report import audit_trail, cleaning_impact, rule_summary, violation_details
from rinseframe.plans.saved import CleaningPlan
from rinseframe.sources.tables import read_csv, read_parquet, with_row_id, write_csv, write_parquet

# The few functions that run inside Python tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ALL_TEXT", "ROW_ID", "CleaningPlan", "Context", "Proposal", "Recipe", "Rulebook", "accept", "apply_prefix",
    "apply_recipe", "audit_trail", "check_expression", "cleaning_impact", "find_problems", "nan_to_null",
    "range_defaults", "read_csv", "read_parquet", "resolution", "rule_summary", "scout", "total_violations",
    "validate", "violating_rows", "violation_cells", "violation_details", "violation_report", "with_row_id",
    "write_csv", "write_parquet",
]
