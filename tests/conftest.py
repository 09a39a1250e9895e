import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from lotwise.session import local_session, via_table  # noqa: E402
from lotwise.sources.listing import listing  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def houses(spark):
    return via_table(listing(spark, SF), "houses")


@pytest.fixture(scope="session")
def cleaned(houses):
    from lotwise.operators.cleaning import HouseCleaner

    return via_table(HouseCleaner().fit(houses).transform(houses), "cleaned")


@pytest.fixture(scope="session")
def engineered(cleaned):
    from lotwise.operators.features import engineer_features

    return via_table(engineer_features(cleaned), "engineered")


@pytest.fixture(scope="session")
def prepared(houses):
    from lotwise.plans.training import prepare

    return prepare(houses)


@pytest.fixture()
def request_row():
    """One valid request."""
    return dict(
        MSSubClass="60", MSZoning="RL", LotFrontage=70.0, LotArea=9000, Neighborhood="NATION_3", HouseStyle="2Story",
        OverallQual=7, OverallCond=5, YearBuilt=1999, YearRemodAdd=2001, ExterQual="Gd", BsmtQual="Gd", TotalBsmtSF=900.0,
        HeatingQC="Ex", FirstFlrSF=900.0, SecondFlrSF=800.0, GrLivArea=1700.0, FullBath=2, HalfBath=1, BedroomAbvGr=3,
        KitchenQual="Gd", TotRmsAbvGrd=8, Fireplaces=1, GarageType="Attchd", GarageYrBlt=1999.0, GarageCars=2,
        GarageArea=500.0, GarageQual="TA", OpenPorchSF=60.0, MoSold=5, YrSold=2008,
    )
