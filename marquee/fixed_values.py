"""They must equal the published ones for results to match."""

# The category names in canonical order.
CATEGORIES = [
    "Music", "Art", "Food & Drink", "Sports", "Family", "Theater", "Comedy", "Film",
    "Nightlife", "Wellness", "Community", "Education", "Tech", "Other",
]
RETIRED_CATEGORIES = ["Date Night"]

# Weight of each category in the classifier.
CATEGORY_PRIORITY = {
    "Family": 2.5,
    "Theater": 2.0, "Comedy": 2.0, "Film": 2.0,
    "Tech": 1.5, "Music": 1.5, "Art": 1.5, "Sports": 1.5, "Wellness": 1.5, "Education": 1.5,
    "Food & Drink": 1.0, "Nightlife": 1.0, "Community": 1.0,
    "Other": 0.5,
}

# Venues that imply a category.
CATEGORY_VENUES = {
    "Music": [
        "kia forum", "forum", "hollywood bowl", "greek theatre", "troubadour", "roxy",
        "whisky a go go", "el rey", "teragram ballroom", "echoplex", "echo", "bootleg theater",
        "lodge room", "resident", "concert hall", "music center", "walt disney concert hall",
        "shrine auditorium", "hollywood palladium", "fonda theatre", "wiltern", "novo",
        "microsoft theater", "youtube theater", "staples center", "crypto.com arena",
        "dodger stadium", "rose bowl", "banc of california stadium", "sofi stadium",
        "hollywood forever cemetery",
    ],
    "Sports": [
        "staples center", "crypto.com arena", "dodger stadium", "rose bowl",
        "banc of california stadium", "sofi stadium", "dignity health sports park",
        "ucla pauley pavilion", "galen center", "coliseum",
    ],
    "Theater": [
        "pantages", "ahmanson", "mark taper forum", "geffen playhouse",
        "kirk douglas theatre", "pasadena playhouse", "actors gang",
    ],
    "Film": [
        "chinese theatre", "egyptian theatre", "vista theatre", "aero theatre",
        "nuart theatre", "new beverly cinema", "arclight", "vintage cinemas",
    ],
}

# Substrings counted for each category, in tie-break order.
CATEGORY_KEYWORDS = {
    "Music": [
        "concert", "music", "band", "orchestra", "symphony", "jazz", "rock", "pop",
        "classical", "opera", "dj", "performance", "festival", "live music", "singing",
        "choir", "recital", "live nation", "ticketmaster", "axs",
    ],
    "Art": [
        "art", "gallery", "exhibition", "museum", "painting", "sculpture", "installation",
        "artist", "contemporary art", "modern art", "photography", "drawing", "print",
        "multimedia", "visual",
    ],
    "Food & Drink": [
        "food", "restaurant", "dining", "wine", "beer", "cocktail", "tasting", "taste",
        "culinary", "cuisine", "chef", "cooking", "brunch", "dinner", "lunch", "breakfast",
        "cafe", "bar", "happy hour", "foodie", "food festival",
    ],
    "Sports": [
        "sports", "game", "match", "tournament", "athletic", "football", "basketball",
        "baseball", "soccer", "tennis", "golf", "running", "race", "marathon", "cycling",
        "swim", "fitness", "workout", " vs ", " vs. ", " v. ", "lakers", "clippers",
        "dodgers", "rams", "chargers", "kings", "galaxy", "lafc", "sparks", "angels",
        "ducks", "bruins", "trojans", "warriors", "celtics", "heat", "bulls", "knicks",
        "nets", "bucks", "mavericks", "nuggets", "suns", "trail blazers", "grizzlies",
    ],
    "Family": [
        "family", "kids", "children", "child", "youth", "playground", "storytime",
        "educational", "learning", "workshop for kids", "family-friendly", "all ages",
        "parents",
    ],
    "Theater": [
        "theater", "theatre", "play", "drama", "musical", "performance", "stage", "acting",
        "actor", "production", "broadway", "show",
    ],
    "Comedy": [
        "comedy", "stand-up", "comedian", " improv ", "improv show", "improv comedy",
        "funny", "laugh", "humor", "comic",
    ],
    "Film": [
        "film", "movie", "cinema", "screening", "documentary", "short film", "feature",
        "director", "filmmaker",
    ],
    "Nightlife": [
        "nightlife", "nightclub", "dance party", "night out", "late night", "after dark",
        "lounge", "beach club", "dj set", "guest dj", "resident dj", "dj night",
        "special guest dj",
    ],
    "Wellness": [
        "wellness", "yoga", "meditation", "health", "fitness", "mindfulness", "spa",
        "healing", "therapy", "massage", "relaxation", "exercise",
    ],
    "Community": [
        "community", "meeting", "gathering", "volunteer", "charity", "fundraiser",
        "nonprofit", "social", "neighborhood", "local", "civic", "public",
    ],
    "Education": [
        "lecture", "talk", "seminar", "workshop", "class", "course", "training",
        "educational", "learning", "discussion", "panel", "conference", "symposium",
        "presentation",
    ],
    "Tech": [
        "tech ", " tech", "technology", "startup", "artificial intelligence",
        "machine learning", "software", "developer", "programming", "coding", "hackathon",
        "blockchain", "crypto", "web3", "saas", "venture capital", "founder",
        "entrepreneur", "data science", "cybersecurity", "tech meetup", "pitch",
        "demo day", "techstars", "y combinator", "accelerator", "incubator",
        "silicon beach", "tech industry", "product management", "devops", "open source",
    ],
}

# Boxes as (south, north, west, east), the radius test and its point.
CORE_BOX = (33.9400, 34.0900, -118.5500, -118.3300)
COAST_BOX = (34.0000, 34.1100, -118.9500, -118.5500)
COUNTY_BOX = (33.6900, 34.8233, -118.9520, -117.6460)
SEARCH_BOX = (33.90, 34.15, -118.75, -118.33)
REFERENCE_POINT = (34.0095, -118.4977)
RADIUS_MILES = 12.0

# Names that mark a place as inside the coverage area.
AREA_CITIES = [
    "santa monica", "venice", "culver city", "beverly hills", "west hollywood",
    "inglewood", "el segundo", "malibu",
]
AREA_NEIGHBORHOODS = [
    "santa monica", "venice", "marina del rey", "playa vista", "playa del rey",
    "westchester", "brentwood", "west la", "west los angeles", "palms", "mar vista",
    "culver city", "westwood", "sawtelle", "pacific palisades", "beverly hills",
    "century city", "inglewood", "el segundo", "malibu", "topanga", "topanga beach",
    "el matador", "zuma beach", "point dume", "carbon beach", "surfrider beach", "ucla",
    "ucla campus",
]
AREA_ZIPS = [
    "90401", "90402", "90403", "90404", "90405", "90291", "90292", "90293", "90294",
    "90066", "90034", "90025", "90064", "90024", "90049", "90045", "90245", "90230",
    "90232", "90301", "90302", "90303", "90304", "90305", "90067", "90035", "90210",
    "90211", "90212", "90263", "90264", "90265",
]
VENUE_DENYLIST = [
    "miracle mile certified farmers market", "melrose place certified farmers market",
    "la cienega farmers market", "farm habit certified farmers market",
    "wellington square certified farmers",
]
VENUE_ALLOWLIST = ["io music academy"]

# Locality hints in match order, ordinal words, street types.
CITY_HINTS = [
    "Santa Monica", "Venice", "Culver City", "Marina del Rey", "Pacific Palisades",
    "Malibu", "Beverly Hills", "West Los Angeles", "Westwood", "Mar Vista", "Playa Vista",
    "Playa del Rey", "Brentwood", "Inglewood", "El Segundo",
]
ORDINAL_WORDS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
    "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
    "eleventh": "11th", "twelfth": "12th",
}
STREET_TYPES = (
    "st|street|ave|avenue|blvd|boulevard|dr|drive|pl|place|ct|court|rd|road|way|ln|lane"
)

# Venue name suffixes, stripped in this order.
VENUE_SUFFIXES = [
    " - los angeles", " los angeles", " la", " theater", " theatre", " museum",
    " gallery", " center", " centre",
]

# Venue part -> street address, used when a listing is built.
KNOWN_VENUE_ADDRESSES = {
    "santa monica college theatre arts": "1900 Pico Blvd, Santa Monica, CA 90405",
}

# Exact venue name -> street address, used when coordinates are looked up.
VENUE_ADDRESSES = {
    "william turner gallery": "2525 Michigan Ave, Santa Monica, CA 90404",
    "largo at the coronet": "366 N La Cienega Blvd, Los Angeles, CA 90048",
    "getty center": "1200 Getty Center Dr, Los Angeles, CA 90049",
    "loulou rooftop restaurant & lounge": "395 Santa Monica Place, Santa Monica, CA 90401",
    "loulou santa monica": "395 Santa Monica Place, Santa Monica, CA 90401",
    "theatre 40": "241 Moreno Drive, Beverly Hills, CA 90212",
    "skirball cultural center": "2701 N Sepulveda Blvd, Los Angeles, CA 90049",
    "lmu farmers market": "Loyola Marymount University, Los Angeles, CA 90045",
    "will rogers shp": "1501 Will Rogers State Park Rd, Pacific Palisades, CA 90272",
    "palisades park rose garden": "1249 Ocean Avenue, Santa Monica, CA 90401",
    "santa monica college theatre arts complex main stage":
        "1900 Pico Blvd, Santa Monica, CA 90405",
    "the washington (mar vista)": "12400 Washington Blvd, Los Angeles, CA 90066",
    "casa del mar hotel & resort": "1910 Ocean Way, Santa Monica, CA 90405",
    "along main street": "Main Street, Santa Monica, CA 90405",
    "thrive health & wellness collective": "2905 Stanford Ave, Venice, CA 90292",
    "will geer's theatricum botanicum": "1419 N Topanga Canyon Blvd, Topanga, CA 90290",
    "the braid theatre": "3435 Ocean Park Blvd, Santa Monica, CA 90405",
    "inman cultural center": "3376 Motor Ave, Los Angeles, CA 90034",
    "poj studio pop-up": "8542 Washington Blvd, Culver City, CA 90232",
    "the kinney venice beach hotel": "737 W Washington Blvd, Venice, CA 90292",
    "hollywood park retail district": "1001 S Stadium Dr, Inglewood, CA 90301",
    "l.a. louver": "45 N Venice Blvd, Venice, CA 90291",
    "hotel bel-air": "701 Stone Canyon Rd, Los Angeles, CA 90077",
    "ucla glorya kaufman hall": "120 Westwood Plaza, Los Angeles, CA 90095",
    "7053 trolleyway s": "7053 Trolleyway, Los Angeles, CA 90293",
    "topanga community club": "1440 N Topanga Canyon Blvd, Topanga, CA 90290",
    "the troubdadour": "9081 Santa Monica Blvd, West Hollywood, CA 90069",
}

# Sources whose stored row gives way to the incoming one.
LOW_PRIORITY_SOURCES = ["Shore Hotel"]

# Start hours of each time-of-day bucket.
TIME_OF_DAY_HOURS = {
    "morning": [5, 6, 7, 8, 9, 10, 11],
    "afternoon": [12, 13, 14, 15, 16],
    "evening": [17, 18, 19, 20],
    "night": [21, 22, 23],
}

# Filters behind each named preset.
PRESETS = {
    "weekend": {"date_filter": "this_weekend"},
    "free": {"is_free": True},
    "family": {"categories": ["Family"]},
    "date-night": {
        "times_of_day": ["evening", "night"],
        "categories": ["Music", "Theater", "Film", "Food & Drink", "Comedy"],
    },
}

# Words in a price note that mean free, and words that forbid it.
FREE_NOTE_WORDS = ["free", "no charge", "no cost", "gratis", "complimentary"]
FREE_NOTE_BLOCKERS = ["$", "otherwise", "after", "except", "member"]

# Image theme of each lower-cased category.
CATEGORY_THEME = {
    "music": "music", "entertainment": "music", "nightlife": "nightlife",
    "art": "art", "arts": "art", "art & museums": "art", "art shows & galleries": "art",
    "museums": "art", "culture": "art", "cultural": "art",
    "theater": "theater", "theatre": "theater", "performing arts": "theater",
    "arts & theatre": "theater", "dance": "theater",
    "food & drink": "food", "food": "food", "comedy": "comedy",
    "sports": "sports", "world cup matches": "sports", "wellness": "wellness",
    "family": "family", "community": "learning", "education": "learning",
    "educational": "learning", "education & learning": "learning",
    "bookstore events": "learning", "black history month": "learning",
    "film": "film", "film & screenings": "film", "tech": "tech", "other": "other",
    "miscellaneous": "other", "tours": "other", "festival": "other", "festivals": "other",
}

# Weekday numbers, Monday first.
WEEKDAYS = {
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5,
    "sunday": 6,
}
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# Weekly markets (weekday, opening hours, place).
MARKETS = [
    {"name": "Wednesday Downtown Farmers Market", "weekday": 2, "hours": "8:30am-1:30pm",
     "location": "Arizona Avenue & 2nd Street",
     "address": "1299 Arizona Ave, Santa Monica, CA 90401"},
    {"name": "Saturday Downtown Farmers Market", "weekday": 5, "hours": "8:30am-1pm",
     "location": "Arizona Avenue & 2nd Street",
     "address": "1299 Arizona Ave, Santa Monica, CA 90401"},
    {"name": "Sunday Main Street Farmers Market", "weekday": 6, "hours": "8:30am-1pm",
     "location": "Main Street between Ocean Park & Ashland",
     "address": "2640 Main St, Santa Monica, CA 90405"},
    {"name": "Sunday Pico Farmers Market", "weekday": 6, "hours": "8am-1pm",
     "location": "Pico Boulevard & Cloverfield",
     "address": "2400 Pico Blvd, Santa Monica, CA 90405"},
]

# Source category tag -> category (C7) and ordered rules.
CATEGORY_TAGS = {
    "arts & theatre": "Theater", "theatre": "Theater", "art": "Art", "museums": "Art",
    "art & museums": "Art",
    "music": "Music", "food & drink": "Food & Drink", "food": "Food & Drink",
    "sports & active": "Sports", "sports": "Sports", "outdoors & adventure": "Wellness",
    "outdoors": "Wellness", "film": "Film", "nightlife": "Nightlife",
    "family & kids": "Family", "family": "Family", "kids": "Family",
    "educational": "Education", "education": "Education", "community": "Community",
    "tech": "Tech", "wellness": "Wellness", "comedy": "Comedy",
}
BAR_NIGHT_RULES = [
    ("trivia", "Community"), ("quiz", "Community"), ("open mic", "Music"),
    ("music", "Music"), ("jam", "Music"), ("dj", "Nightlife"), ("comedy", "Comedy"),
    ("art", "Art"),
]

# Words that rule out a mined venue name.
VENUE_STOP_PHRASES = [
    "the event", "the end", "the same", "a time", "least", "most", "first", "last",
]
VENUE_STOP_VERBS = (
    "has|have|had|is|are|was|were|will|would|could|should|created|held|said|told"
)

# How an article writes a date (S10), tried in this order.
ARTICLE_DATE_PATTERNS = [
    r"(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+([A-Z][a-z]+ \d{1,2}(?:,?\s+\d{4})?)",
    r"([A-Z][a-z]+ \d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})",
    r"([A-Z][a-z]+ \d{1,2}(?:st|nd|rd|th)?)",
]
ARTICLE_CLOCK_PATTERN = r"(?i)(\d{1,2}(?::\d{2})?\s*[AP]M)"

# What leaves an address (X3), as (pattern, replacement) in this order.
ADDRESS_CUTS = [
    (r"\s*\([^)]*\)", ""),
    (r"(\b\d{5}\b).*$", "$1"),
    (r"^(\s*\d+)\s*[-–]\s*\d+", "$1"),
    (r"\s*#\s*\w+", ""),
    (r"(?i)\s*\b(?:suite|ste|unit|apt|apartment|fl|floor)\b\.?\s*#?\s*\w+", ""),
]

# A street address and a venue in prose.
PROSE_ADDRESS_PATTERN = (
    r"\b(\d{3,5}\s+(?:[A-Z][a-zA-Z]+\s+){1,4}(?:Blvd|Ave|St|Dr|Rd|Way|Lane|Ln|Place|Pl)\.?"
    r"(?:,\s*[A-Za-z\s]+,\s*CA(?:\s*\d{5})?)?)"
)
PROSE_VENUE_PATTERN = r"(?m)\bat\s+([A-Z][^\.,\n]{3,50})(?:[,.]|\s+in\s+|\s+on\s+|$)"

# A weekday that binds a listing (X24), and clock text.
BINDING_WEEKDAY_PATTERN = (
    rf"(?i)(?:\bthis\s+|\bevery\s+|\bon\s+)?\b({'|'.join(WEEKDAYS)})s?\b"
    r"(?=\s*(?:,|:|\s+night|\s+\d|\s*\||\z))"
)
CLOCK_DASH = r"\s*(?:-|–|—|to)\s*"
CLOCK_HALF = r"\s*([ap])\.?m\.?"
CLOCK_BOTH_PATTERN = rf"(?i)\b(\d{{1,2}})(?::(\d{{2}}))?{CLOCK_HALF}{CLOCK_DASH}(\d{{1,2}})(?::(\d{{2}}))?{CLOCK_HALF}"
CLOCK_TAIL_PATTERN = rf"(?i)\b(\d{{1,2}})(?::(\d{{2}}))?{CLOCK_DASH}(\d{{1,2}})(?::(\d{{2}}))?{CLOCK_HALF}"
CLOCK_ONE_PATTERN = rf"(?i)\b(\d{{1,2}})(?::(\d{{2}}))?{CLOCK_HALF}"
START_CLOCK_PATTERN = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(?:(?:-|–|to)\s*(\d{1,2})(?::\d{2})?)?\s*(am|pm)\b"

# A weekly series stated in a title.
WEEKDAY_STEMS = "mon|tues|wednes|thurs|fri|satur|sun"
STATED_WEEKDAY_PATTERN = rf"(?i)\bevery\s+({WEEKDAY_STEMS})day\b|\b({WEEKDAY_STEMS})days\b"
