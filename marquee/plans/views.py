"""Domain tables derived from the given Parquet tables.

The same SQL text feeds Spark and the oracle, so operators can be checked
against an independent engine on identical input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-17 10:30:00"
LOG_AS_OF = "2024-01-25 12:00:00"

VIEW_SQL = {
    "listings": """
SELECT o.o_orderkey AS id,
  p.p_name || CASE o.o_orderkey % 5 WHEN 0 THEN ' at ' || c.c_name WHEN 1 THEN ' "live"'
              WHEN 2 THEN ' (' || p.p_brand || ')' ELSE ' ' || lower(p.p_type) END AS title,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL
       ELSE o.o_orderpriority || ' ' || lower(c.c_mktsegment) || ' concert, ' || lower(p.p_type) || ' wine tasting' END AS description,
  CASE WHEN o.o_custkey % 13 = 0 THEN ''
       ELSE 'Venue ' || CAST(o.o_custkey % 40 AS VARCHAR(20)) ||
            CASE o.o_custkey % 4 WHEN 0 THEN ' Theater' WHEN 1 THEN ' Gallery' ELSE '' END END AS venue_name,
  CAST(100 + o.o_custkey % 900 AS VARCHAR(20)) || ' Pico Blvd #' || CAST(o.o_custkey % 30 AS VARCHAR(20)) || ', ' ||
    CASE o.o_custkey % 6 WHEN 0 THEN 'Santa Monica, CA 90405' WHEN 1 THEN 'Venice, CA 90291'
      WHEN 2 THEN 'Culver City, CA 90232' WHEN 3 THEN 'Malibu, CA 90265'
      WHEN 4 THEN 'Los Angeles, CA 90012' ELSE 'Pasadena, CA 91101' END AS address,
  CASE WHEN o.o_custkey % 11 = 0 THEN NULL
       ELSE CAST(33.80 AS DOUBLE) + CAST(o.o_custkey % 40 AS DOUBLE) * CAST(0.0125 AS DOUBLE) END AS latitude,
  CASE WHEN o.o_custkey % 11 = 0 THEN NULL
       ELSE CAST(-118.90 AS DOUBLE) + CAST(o.o_custkey % 29 AS DOUBLE) * CAST(0.025 AS DOUBLE) END AS longitude,
  o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 24 AS INT) AS event_date,
  CASE WHEN o.o_orderkey % 6 = 0 THEN o.o_orderdate + INTERVAL '1' DAY * CAST(2 + o.o_orderkey % 120 AS INT)
       WHEN o.o_orderkey % 2 = 0 THEN o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 24 + 2 AS INT)
       ELSE NULL END AS end_date,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
       ELSE CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Tech' WHEN 'BUILDING' THEN 'Art'
            WHEN 'AUTOMOBILE' THEN 'Music' WHEN 'FURNITURE' THEN 'Family' ELSE 'Food & Drink' END END AS category,
  n.n_name AS source,
  CASE WHEN o.o_orderkey % 19 = 0 THEN ''
       ELSE 'https://' || lower(n.n_name) || '.example.com/e/' || CAST(o.o_orderkey AS VARCHAR(20)) END AS url,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE '/img/' || CAST(o.o_orderkey % 50 AS VARCHAR(20)) || '.jpg' END AS image_url,
  '/static/logos/' || lower(n.n_name) || '.png' AS source_logo_url,
  CASE WHEN o.o_orderstatus = 'F' OR o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_totalprice END AS price,
  o.o_orderstatus = 'F' AS is_free,
  CASE o.o_orderkey % 7 WHEN 0 THEN 'Free admission' WHEN 1 THEN 'Sold out' WHEN 2 THEN 'TBD'
       WHEN 3 THEN '$25 at the door' WHEN 4 THEN 'Free for members, $20 otherwise' ELSE '' END AS price_note,
  CASE r.r_name WHEN 'AMERICA' THEN 'beyond' WHEN 'ASIA' THEN NULL ELSE 'westside' END AS region,
  o.o_orderdate - INTERVAL '1' DAY * CAST(o.o_orderkey % 60 AS INT) AS created_at,
  o.o_orderdate - INTERVAL '1' DAY * CAST(o.o_orderkey % 30 AS INT) AS updated_at
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON p.p_partkey = o.o_orderkey % 200
""",
    "listings_incoming": """
SELECT id + 100000000 AS id,
  CASE id % 4 WHEN 0 THEN upper(title) WHEN 1 THEN title || ' party' WHEN 2 THEN title ELSE 'Special: ' || title END AS title,
  description || ' updated listing' AS description,
  CASE WHEN id % 8 = 0 THEN '' ELSE venue_name END AS venue_name,
  address, latitude, longitude,
  event_date + INTERVAL '1' HOUR * CAST(CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE 0 END AS INT) AS event_date,
  end_date, category,
  CASE WHEN id % 7 = 0 THEN source ELSE 'FEED_' || CAST(id % 5 AS VARCHAR(20)) END AS source,
  CASE WHEN id % 2 = 0 THEN url ELSE url || '#re' END AS url,
  image_url, source_logo_url, price, is_free, price_note, region, created_at, updated_at
FROM listings WHERE id % 3 = 0
""",
    # Listings three days apart, so only a row's own counterpart can match it; the title of one
    # contains that of the other, which makes their similarity 2 * min / (a + b).
    "spaced": """
SELECT id, title, description, venue_name, address, latitude, longitude,
  TIMESTAMP '1000-01-01 00:00:00' + INTERVAL '3' DAY * CAST(id % 900000 AS INT) + INTERVAL '1' HOUR * CAST(id % 20 AS INT) AS event_date,
  CASE WHEN id % 12 = 9 THEN TIMESTAMP '1000-01-01 00:00:00' + INTERVAL '3' DAY * CAST(id % 900000 + 4 AS INT) ELSE NULL END AS end_date,
  category, source, url, image_url, source_logo_url, price, is_free, price_note, region, created_at, updated_at
FROM listings
""",
    "spaced_incoming": """
SELECT id + 100000000 AS id,
  CASE id % 12 WHEN 1 THEN title || ' party' WHEN 2 THEN substring(title, 1, 3) WHEN 4 THEN title || ' go'
    WHEN 5 THEN title || ' encore party' WHEN 6 THEN title || ' at ' || venue_name || ' with friends and family'
    WHEN 7 THEN title || ' with a great many friends' WHEN 8 THEN title || ' with a great many friends' ELSE title END AS title,
  description, CASE WHEN id % 12 IN (8, 11) THEN '' ELSE venue_name END AS venue_name, address,
  CASE WHEN id % 12 = 11 THEN latitude + CAST(1 AS DOUBLE) ELSE latitude END AS latitude, longitude,
  event_date + INTERVAL '30' MINUTE * CAST(CASE id % 12 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 1 WHEN 4 THEN 20
    WHEN 5 THEN 20 WHEN 6 THEN 20 WHEN 7 THEN 4 WHEN 8 THEN 4 WHEN 9 THEN 72 WHEN 10 THEN 60 ELSE 3 END AS INT) AS event_date,
  CASE WHEN id % 12 = 9 THEN end_date + INTERVAL '5' DAY ELSE NULL END AS end_date, category,
  CASE WHEN id % 12 IN (3, 9) THEN source ELSE 'FEED_' || CAST(id % 5 AS VARCHAR(20)) END AS source,
  CASE WHEN id % 12 < 3 THEN url ELSE '' END AS url,
  image_url, source_logo_url, price, is_free, price_note, region, created_at, updated_at
FROM spaced
""",
    "interactions": """
SELECT event_id AS id, 's' || CAST(user_id AS VARCHAR(20)) AS session_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS event_id,
  CASE event_type WHEN 'purchase' THEN 'favorite' WHEN 'error' THEN 'unfavorite'
       WHEN 'signup' THEN 'calendar_download' ELSE event_type END AS interaction_type,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'NATION_' || CAST(user_id % 25 AS VARCHAR(20)) END AS source,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 WHEN 0 THEN 'Music' WHEN 1 THEN 'Art'
       WHEN 2 THEN 'Family' WHEN 3 THEN 'Tech' ELSE NULL END AS category,
  ts AS created_at
FROM events
""",
    "page_views": """
SELECT event_id AS id, 's' || CAST(user_id AS VARCHAR(20)) AS session_id, CAST(NULL AS VARCHAR(20)) AS user_id,
  CASE WHEN event_id % 4 = 0 THEN '/' ELSE '/event/' || regexp_extract(props, '([0-9]+)', 1) END AS path,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://ref' || CAST(event_id % 6 AS VARCHAR(20)) || '.example.com' END AS referrer,
  'agent' AS user_agent, '10.0.0.' || CAST(user_id % 256 AS VARCHAR(20)) AS ip_address, ts AS created_at
FROM events WHERE event_type IN ('view', 'signup')
""",
    "search_queries": """
SELECT event_id AS id, 's' || CAST(user_id AS VARCHAR(20)) AS session_id,
  CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'q' || CAST(event_id % 23 AS VARCHAR(20)) END AS query,
  CASE event_id % 3 WHEN 0 THEN 'today' WHEN 1 THEN 'this_week' ELSE 'upcoming' END AS date_filter,
  CASE event_id % 4 WHEN 0 THEN 'Music' WHEN 1 THEN 'Music,Art' ELSE NULL END AS categories,
  CASE WHEN event_id % 5 = 0 THEN 'NATION_1,NATION_2' ELSE NULL END AS sources,
  event_id % 6 = 0 AS free_only,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS results_count, ts AS created_at
FROM events WHERE event_type = 'error'
""",
}

_VIEW_INPUTS = {
    "listings": ["orders", "customer", "nation", "region", "part"],
    "listings_incoming": ["listings"],
    "spaced": ["listings"],
    "spaced_incoming": ["spaced"],
    "interactions": ["events"],
    "page_views": ["events"],
    "search_queries": ["events"],
}


class Tables:
    """The given tables of one folder and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        text, inputs = VIEW_SQL[name], {}
        for table in _VIEW_INPUTS[name]:
            inputs[table] = getattr(self, table) if table in VIEW_SQL else self.raw(table)
            for clause in ("FROM", "JOIN"):
                for end in (" ", "\n"):
                    text = text.replace(f"{clause} {table}{end}", f"{clause} {{{table}}}{end}")
        return self.spark.sql(text, **inputs)

    @cached_property
    def listings(self) -> DataFrame:
        return self._derived("listings")

    @cached_property
    def listings_incoming(self) -> DataFrame:
        return self._derived("listings_incoming")

    @cached_property
    def spaced(self) -> DataFrame:
        return self._derived("spaced")

    @cached_property
    def spaced_incoming(self) -> DataFrame:
        return self._derived("spaced_incoming")

    @property
    def incoming(self) -> DataFrame:
        return self.listings_incoming

    @cached_property
    def interactions(self) -> DataFrame:
        return self._derived("interactions")

    @cached_property
    def page_views(self) -> DataFrame:
        return self._derived("page_views")

    @cached_property
    def search_queries(self) -> DataFrame:
        return self._derived("search_queries")


def with_views(*names: str) -> str:
    """WITH clause that defines the named views for the oracle."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEW_SQL:
            for needed in _VIEW_INPUTS[name]:
                add(needed)
            if name not in wanted:
                wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in wanted)
