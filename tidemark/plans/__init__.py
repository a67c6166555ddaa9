"""The registered queries of the analytics and their SQL."""

from __future__ import annotations

from tidemark.plans.accounts import ORACLE_SQL as _ACCOUNT_SQL
from tidemark.plans.accounts import QUERIES as _ACCOUNT
from tidemark.plans.features import ORACLE_SQL as _FEATURE_SQL
from tidemark.plans.features import QUERIES as _FEATURE
from tidemark.plans.filings import ORACLE_SQL as _FILING_SQL
from tidemark.plans.filings import QUERIES as _FILING
from tidemark.plans.models import ORACLE_SQL as _MODEL_SQL
from tidemark.plans.models import QUERIES as _MODEL

QUERIES = {**_MODEL, **_ACCOUNT, **_FILING, **_FEATURE}
ORACLE_SQL = {**_MODEL_SQL, **_ACCOUNT_SQL, **_FILING_SQL, **_FEATURE_SQL}
