from lotwise.plans.catalog import (  # noqa: F401
    cleaning,
    comparing,
    deriving,
    explaining,
    growing,
    profiling,
    scoring,
    storing,
)
from lotwise.plans.catalog.registry import QUERIES, SQL  # noqa: F401
