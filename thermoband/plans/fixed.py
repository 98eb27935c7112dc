"""Fixed values shared by the query catalogue and the study."""

from __future__ import annotations

# Axis limits of the smoothed panels.
LIMITS = {"tb": (10, 35), "te": (-10, 70), "db": (-20, 2), "de": (-32, 40)}
# Number of joint limits in the two predicted bands.
JOINT_LIMITS = {"tb": 1344, "te": 8064}
# Widths of the error bars of the day-part summaries.
PART_WIDTH = {"tb": 8, "te": 8, "db": 8, "de": 5}
# Points of the prediction grids: hours, and days where not every occurring day is taken.
GRID_HOURS = 100
GROUP_DAYS = {"tb": None, "te": 30}
SERIES_DAYS = {"tb": None, "te": 40}
# Variance parameters (correlation of neighbours, relative deviations of the slopes) that the models are also
# evaluated at without a search.
STATED = {
    "tb": ((0.8, (0.5, 0.3)), (0.4, (1.2, 0.1))),
    "te": ((0.8, (0.5, 0.3, 0.2, 0.6)), (0.4, (1.2, 0.1, 0.4, 0.9))),
}
