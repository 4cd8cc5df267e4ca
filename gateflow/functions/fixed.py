"""They must equal the ones users already have in their reports."""

# Gates kept when the caller names none.
DEFAULT_GATES = [
    "TK54RT54",
    "TK55RT55",
    "TK56RT56",
    "TK57RT57",
    "TK58RT58",
    "TK60RT60",
    "TK72RT72",
    "TK76RT76",
    "TK77RT77",
    "TK78RT78",
]

# Band label, first hour, last hour (both included), in the order of the day.
TIME_BANDS = [
    ("Madrugada", 0, 5),
    ("Maniana", 6, 12),
    ("Tarde", 13, 18),
    ("Noche", 19, 23),
]
BAND_LABELS = [label for label, _, _ in TIME_BANDS]

# Day-type label, first weekday, last weekday (Monday is 1).
DAY_TYPES = [("L-V", 1, 5), ("Sab", 6, 6), ("Dom", 7, 7)]
WORKING_DAYS = "L-V"

# Weekday labels, Monday first.
WEEKDAY_LABELS = ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"]

HOURS = list(range(24))

ENTRY = "Entry"
EXIT = "Exit"

# Width of the outlier band, in standard deviations.
SIGMAS = 2.0

# Boxplot whiskers reach at most this many interquartile ranges.
WHISKER = 1.5

# Hour whose first-day level seeds the day-to-day carry-over.
SEED_HOUR = 22
