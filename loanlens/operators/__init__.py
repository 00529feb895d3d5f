"""Reusable DataFrame -> DataFrame operators behind the analyses."""

from loanlens.operators.output import sorted_by, sorted_result
from loanlens.operators.profile import (calibration, profile_with_total, segment_profile,
                                        share_of_groups)
from loanlens.operators.ranking import concentration_curve, multi_rank, row_number_by
from loanlens.operators.rollup import cohort_columns, cohort_trend, entity_rollup, windowed_baseline
from loanlens.operators.scoring import additive_score, rule_label, scenario_grid

__all__ = ["sorted_by", "sorted_result", "calibration", "profile_with_total", "segment_profile",
           "share_of_groups", "concentration_curve", "multi_rank", "row_number_by",
           "cohort_columns", "cohort_trend", "entity_rollup", "windowed_baseline",
           "additive_score", "rule_label", "scenario_grid"]
