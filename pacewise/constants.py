"""Values that are part of the semantics."""

# Fixed values of the analysis.
SPEED = 80.0  # metres a minute
SNAP = 300.0
END_EPS = 1e-3
UNREACHABLE = 9999.0
CLOSED_FROM = 0.20
SHELTER_LIMIT = 2
BUFFER = 50.0
DEFAULT_T_MAX = 60.0
LEVELS = [("baseline", 0, 0.0, []), ("rendah", 1, 0.25, [3]), ("sedang", 2, 0.5, [2, 3]), ("tinggi", 3, 0.75, [1, 2, 3])]
NORMALISED = {0: 0.0, 1: 0.33, 2: 0.67, 3: 1.0}
EVACUATION = 30.0
FUZZINESS, ALPHA, NEIGHBOURS = 1.7, 0.5, 8
EXPONENT = 1.0 / (FUZZINESS - 1.0)
CATEGORIES = 5
