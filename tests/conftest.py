import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from loanlens.session import get_session
    s = get_session("local[4]", 4, app_name="loanlens-tests")
    yield s
    s.stop()


@pytest.fixture(autouse=True, scope="module")
def small_loans_not_cached(spark):
    """A module that caches the loans of SF_SMALL leaves no cached plan to the next one (test_plans reads plans)."""
    yield
    from loanlens.sources.loans import derive_loans
    derive_loans(spark, SF_SMALL).unpersist()


@pytest.fixture(scope="session")
def duck_small():
    from verify import duck_connection
    return duck_connection(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from verify import duck_connection
    return duck_connection(SF_MID)


@pytest.fixture(scope="session")
def loans_mid(spark):
    """Loan table at sf0.01, cached once for the session (tests only)."""
    from loanlens.sources.loans import derive_loans
    df = derive_loans(spark, SF_MID).cache()
    df.count()
    return df
