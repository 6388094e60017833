"""All registered queries: importing this module registers them."""

from docquarry.plans import answers, assembly, indexes, knowledge, monitoring, queries, storage, strategies  # noqa: F401
from docquarry.plans.registry import QUERIES, SQL  # noqa: F401
