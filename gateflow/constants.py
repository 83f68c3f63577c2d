"""Values shared by the operators.

Everything below is a fixed value: results only match when these numbers are kept.
"""

SLOT_MINUTES = 10
SLOTS_PER_DAY = 144

# Service-period code -> closed hour ranges; hours in no range get DEFAULT_BAND.
BANDS_X = {1: [(0, 6), (22, 23)], 2: [(10, 15)], 3: [(7, 7), (19, 21)], 4: [(16, 18)]}
BANDS_Y = {1: [(0, 6), (23, 23)], 2: [(10, 13)], 3: [(18, 22)], 4: [(14, 17)]}
DEFAULT_BAND = 5

# First minute-of-day of service; slots before it are left out.
SERVICE_START_MINUTE = 320

# Night band of the override, in minutes of the day.
NIGHT_IN_FROM = 1420
NIGHT_IN_UNTIL = 320
NIGHT_OUT_UNTIL = 350

# Upper bounds of station tiers 0, 1 and 2 (above the last one: tier 3).
TIER_BOUNDS_IN = (150, 500, 1000)
TIER_BOUNDS_OUT = (150, 500, 1100)
# Stations whose tier is set by hand.
TIER_OVERRIDES = {9: 4, 15: 5}

# Trailing window lengths in business days, and per label span.
TRAILING_WINDOWS = (1, 3, 5, 10, 15)
TRAILING_WINDOWS_BY_SPAN = {1: (1, 5, 7), 2: (2, 6), 3: (3, 9), 5: (5, 8)}
# Most recent anchors kept per label span in the capped training set.
ANCHOR_CAP_BY_SPAN = {1: 10, 2: 5, 3: 3, 5: 2}

# Line letter -> code.
LINE_CODES = {"A": 1, "B": 2, "C": 3}

# Domain of the ticket type.
PAY_TYPES = (0, 1, 2, 3)

QUASI_CONSTANT_SHARE = 0.90
REGULAR_RIDER_SWIPES = 50
EARLY_HOURS_END = 6
EARLY_HOURS_CAP = 2
PROFILE_DAMPING = 0.95
