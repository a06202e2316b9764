import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marquee import schemas  # noqa: E402
from marquee.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", spark__ui__showConsoleProgress="false")


@pytest.fixture(scope="session")
def make_listings(spark):
    """Listings from dicts; absent columns are NULL."""

    def make(rows):
        names = schemas.LISTINGS.fieldNames()
        full = [tuple({"title": "", "source": "src", **r}.get(n) for n in names) for r in rows]
        return spark.createDataFrame(full, schemas.LISTINGS)

    return make


def at(text):
    return datetime.fromisoformat(text)
