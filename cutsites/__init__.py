"""Reproducible 5'-end sites from strand-aware interval data, on Spark.

Every public function takes DataFrames and plain parameters and returns a
lazy DataFrame; nothing here collects data to the driver.
"""

from cutsites.profile import PROFILE_CONTROL, PROFILE_HUMAN, PROFILE_MULTI, Profile
from cutsites.plans.find_candidates import find_candidates

__all__ = [
    "PROFILE_CONTROL",
    "PROFILE_HUMAN",
    "PROFILE_MULTI",
    "Profile",
    "find_candidates",
]
