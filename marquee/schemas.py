"""Table schemas."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    fields = []
    for item in text.replace("\n", " ").split(","):
        name, kind = item.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not required))
    return T.StructType(fields)


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "ntz": T.TimestampNTZType(),
    "date": T.DateType(),
    "strings": T.ArrayType(T.StringType()),
}

LISTINGS = _struct(
    """id long, title string!, description string, venue_name string, address string,
    latitude double, longitude double, event_date ntz, end_date ntz, category string,
    source string!, url string, image_url string, source_logo_url string, price double,
    is_free boolean, price_note string, region string, created_at ntz, updated_at ntz"""
)
PAGE_VIEWS = _struct(
    """id long, session_id string!, user_id string, path string!, referrer string,
    user_agent string, ip_hash string, created_at ntz"""
)
INTERACTIONS = _struct(
    """id long, session_id string!, event_id long!, interaction_type string!,
    source string, category string, created_at ntz"""
)
SEARCH_QUERIES = _struct(
    """id long, session_id string!, query string, date_filter string, categories strings,
    sources strings, free_only boolean, results_count int, created_at ntz"""
)
SESSIONS = _struct(
    """session_id string!, first_seen ntz, last_seen ntz, page_views long,
    events_viewed long, events_clicked long, searches long"""
)
DAILY_METRICS = _struct(
    """date date, unique_visitors long, page_views long, events_viewed long,
    events_clicked long, searches long, favorites_added long"""
)
GEOCODES = _struct("address_key string, lat double, lng double, cached_at double")
INGEST_RUNS = _struct(
    "source string, ok boolean, error string, duration_s double, scraped long"
)

# Extracted feed rows carry these columns before Q4 turns them into listings.
FEED_COLUMNS = [f.name for f in LISTINGS.fields if f.name not in ("id", "created_at", "updated_at")]
