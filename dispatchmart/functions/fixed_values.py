"""Literals the results depend on, stated as they are."""

# Source tags written to the pickup table.
LOCATION_SUFFIX_SOURCE = "SKYLINE"
FREE_TEXT_SOURCE = "FIRSTCLASS"
SPLIT_FIELD_SOURCE = "DIAL7"

# Street types shortened when they end an address.
STREET_TYPES = {
    "BL": "BLVD",
    "AV": "AVE",
    "AVENUE": "AVE",
    "COURT": "CT",
    "STREET": "ST",
    "LANE": "LN",
    "ROAD": "RD",
    "DRIVE": "DR",
    "HY": "HWY",
    "PZ": "PLZ",
    "TP": "TPKE",
}

# Street types after which a free-text address is cut.
CUTTING_STREET_TYPES = (
    "AVE", "ST", "BLVD", "LANE", "LN", "HWY", "TPKE", "TURNPIKE", "PL", "PLAZA", "DR",
)

# Number words rewritten as ordinals ...
ORDINAL_WORDS = {
    "FIRST": "1ST",
    "SECOND": "2ND",
    "THIRD": "3RD",
    "FIFTH": "5TH",
    "SIXTH": "6TH",
    "SEVENTH": "7TH",
    "EIGHTH": "8TH",
    "NINTH": "9TH",
    "TENTH": "10TH",
    "ELEVENTH": "11TH",
    "TWELFTH": "12TH",
}
# ... and the one that only the corrected rule set knows.
ADDED_ORDINAL_WORDS = {"FOURTH": "4TH"}

# Ordinal suffix by last digit; all other digits take OTHER_ORDINAL.
ORDINAL_SUFFIXES = {"1": "ST", "2": "ND", "3": "RD"}
OTHER_ORDINAL = "TH"
COMPASS_LETTERS = ("W", "E", "S", "N")

# Two-letter endings of a location that name a suburb.
SUBURB_CODES = ("NJ", "CT", "LI", "PA")

# Location code to state.
LOCATION_STATES = {
    "M": "NEW YORK",
    "QU": "NEW YORK",
    "BX": "NEW YORK",
    "CA": "NEW YORK",
    "ST": "NEW YORK",
    "WE": "NEW YORK",
    "BK": "NEW YORK",
    "FK": "NEW YORK",
    "AG": "NEW YORK",
    "PA": "PENNSYLVANIA",
    "CT": "CONNECTICUT",
    "LI": "LONG ISLAND",
    "NJ": "NEW JERSEY",
    "WK": "NEW JERSEY",
}

# Location codes that name no city, and those that do.
CITYLESS_CODES = ("NJ", "LI", "PA", "CT", "WE")
BOROUGHS = {"M": "MANHATTAN", "BK": "BROOKLYN", "BX": "BRONX", "QU": "QUEENS"}
AIRPORT_CITIES = {"FK": "JAMAICA", "WK": "NEWARK", "AG": "EAST ELMHURST"}

# States whose pickups carry no city.
CITYLESS_STATES = ("NEW JERSEY", "CONNECTICUT", "PENNSYLVANIA", "LONG ISLAND")

# Airport addresses by whole location text.
AIRPORT_BY_LOCATION = {
    "NWK": "3 BREWSTER",
    "JFK": "148-18 134TH ST",
    "LAG": "102-05 DITMARS BLVD",
}

# Airport addresses by text found in the first word.
AIRPORT_BY_WORD = {
    "JFK": "148-18 134TH ST",
    "EWR": "3 BREWSTER RD",
    "LGA": "102-05 DITMARS BLVD",
}

# Airport code to street, house number, state and city.
AIRPORT_BY_CODE = {
    "EW": ("BREWSTER RD", "3", "NEW JERSEY", "NEWARK"),
    "JF": ("134TH ST", "148-18", "NEW YORK", "JAMAICA"),
    "LG": ("DITMARS BLVD", "102-05", "NEW YORK", "EAST ELMHURST"),
    "LA": ("DITMARS BLVD", "102-05", "NEW YORK", "EAST ELMHURST"),
    "NW": ("BREWSTER RD", "3", "NEW JERSEY", "NEWARK"),
    "IS": ("ARRIVAL AVE", "100", "NEW YORK", "RONKONKOMA"),
    "TE": ("INDUSTRIAL AVE", "111", "NEW JERSEY", "TETERBORO"),
    "HP": ("AIRPORT RD", "240", "NEW YORK", "WHITE PLAINS"),
}

# Three-letter end of a free-text address to city.
FRAGMENT_CITIES = {
    "ONX": "BRONX",
    "BX": "BRONX",
    "NYC": "NEW YORK CITY",
    "NY": "NEW YORK CITY",
    "ORK": "NEW YORK CITY",
    "QU": "QUEENS",
    "NY.": "YONKERS",
    "LYN": "BROOKLYN",
}

# State code to state name.
STATE_NAMES = {
    "NY": "NEW YORK",
    "NJ": "NEW JERSEY",
    "PA": "PENNSYLVANIA",
    "CT": "CONNECTICUT",
    "VA": "VIRGINIA",
    "RI": "RHODE ISLAND",
    "M": "MANHATTAN",
    "MA": "MASSACHUSETTS",
}

# Coverage and company keys of the pickup fact.
COVERAGE_KEYS = {
    "BRONX": 1,
    "BROOKLYN": 2,
    "JAMAICA": 3,
    "EAST ELMHURST": 4,
    "MANHATTAN": 5,
    "NEW YORK CITY": 6,
    "NEWARK": 7,
    "Other": 8,
}
COMPANY_KEYS = {"DIAL7": 1, "FIRSTCLASS": 2, "LYFT": 3, "SKYLINE": 4}
UNKNOWN_KEY = -1

# Shift number to first and last minute.
SHIFTS = {1: ("00:00", "07:59"), 2: ("08:00", "15:59"), 3: ("16:00", "23:59")}

# End date of a version that is still open, as text and as ISO text.
OPEN_END_TEXT = "12/31/9999"
OPEN_END_ISO = "9999-12-31"

# Words and language that select a message, and the capture limit.
CAPTURE_WORDS = ("taxi",)
CAPTURE_LANGUAGES = ("en",)
CAPTURE_LIMIT = 120

# How many leading terms make the tag, and how many must be exceeded.
TAG_TERMS = 5
TAG_THRESHOLD = 2
LISTED_TERMS = 10

# Spark ML's English stop words, in the order Spark lists them.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
    you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
    let's ought that's there's what's when's where's who's why's would
    """.split()
)

# Fixed value: rows a pickup feed may spend on coordinates.
GEOCODE_BUDGET = 100

# Fixed value: bad rows at which a load fails.
MAX_LOAD_ERRORS = 2

# Text formats of dates and audit times.
DATE_TEXT = "MM/dd/yyyy"
DATE_TEXT_IN = "M/d/yyyy"
AUDIT_TIME_TEXT = "dd/MM/yyyy HH:mm:ss"

# How the time of a pickup may be written.
PICKUP_TIMES = ("M-d-yyyy h:mm:ss a", "M-d-yyyy h:mm a", "M-d-yyyy H:mm:ss", "M-d-yyyy H:mm")
