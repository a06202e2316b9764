"""Registry of checked queries: a Spark plan and, where it can be said, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.plans.views import Tables, with_views

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a plan; ``views`` names the derived tables the SQL reads."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = build
        if sql is not None:
            text = sql.strip()
            if views:
                head = with_views(*views.split())
                text = f"{head},\n{text[5:]}" if text[:5].upper() == "WITH " else f"{head}\n{text}"
            ORACLES[name] = text
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types both engines hash alike: text, bigint, double, boolean."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(field.name))
    return df.select(*out)
