"""Queries over the driver's tables; importing this package registers them."""

from rankfield.plans import analysis, audits, checks, cleaning, documents, feature_rows, features, inference, manifests, models, prediction, records, research, tables, vocabulary, walkforward  # noqa: F401
from rankfield.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
