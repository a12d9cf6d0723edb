"""Built-in defaults that decide generated values."""

# Mean and standard deviation of salary by role.
ROLE_SALARY = {
    "engineer": (70000.0, 10000.0),
    "manager": (90000.0, 15000.0),
    "hr": (60000.0, 8000.0),
    "finance": (80000.0, 12000.0),
    "contractor": (40000.0, 10000.0),
}
DEFAULT_ROLE = "engineer"

# Mean and standard deviation of an amount by product category.
CATEGORY_AMOUNT = {
    "electronics": (800.0, 400.0),
    "clothing": (150.0, 100.0),
    "food": (50.0, 30.0),
    "books": (25.0, 15.0),
    "toys": (100.0, 60.0),
}
# The name rule that links a category column to an amount column.
PARENT_WORDS = ("category", "product")
CHILD_WORDS = ("amount", "price", "cost")

# Default date range.
DATE_LOW, DATE_HIGH = "2020-01-01 00:00:00", "2021-01-01 00:00:00"

# Fragments of validation messages that readers look for.
UNIQUENESS = "uniqueness"
OUT_OF_BOUNDS = "values {side} {bound}"
IN_THE_FUTURE = "timestamps are in the future"

# What marks an anomaly row.
LARGE_BYTES, LARGE_STEP = 1e9, 0.1
NIGHT = "2020-01-01 03:00:00"
PRIVATE_NETWORK = "10.0"
RARE_EXTENSION = ".key"
BYTE_FIELDS = ("bytes_out", "bytes")
EXTENSION_FIELDS = ("file_ext", "extension")
# What the other fields of an anomaly row hold.
ANOMALY_INTS, ANOMALY_TRUE, ANOMALY_TEXT, ANOMALY_IP, ANOMALY_CATEGORIES = 1000.0, 0.1, "anom_", "10.0.0.1", ("A", "B")

# Own short word lists for text fields.
WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "harbor",
         "island", "jasper", "kettle", "lagoon", "meadow", "nectar", "orchid", "pebble",
         "quartz", "river", "saddle", "timber", "umber", "valley", "willow", "yarrow"]
FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gwen", "Hugo",
               "Iris", "Jon", "Kira", "Leo", "Mina", "Nils", "Olga", "Paul"]
LAST_NAMES = ["Archer", "Baker", "Carver", "Dyer", "Ellis", "Fisher", "Glover", "Hunter",
              "Ives", "Joyner", "Knight", "Lister", "Mason", "Norris", "Potter", "Quinn"]
MAIL_DOMAINS = ["example.com", "example.org", "example.net"]

# Drivers that are looked for by name.
CONDITIONAL_DRIVERS = ("role", "category", "country")


def linked_by_name(parent: str, child: str) -> bool:
    p, c = parent.lower(), child.lower()
    return any(w in p for w in PARENT_WORDS) and any(w in c for w in CHILD_WORDS)
