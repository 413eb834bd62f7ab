"""All registered queries of the conversation operators."""

from turnwise.plans import calls, checks, evaluation, merging, people, records, report, scores, segments, signals, statistics, texts, verification  # noqa: F401  they register their queries
from turnwise.registry import ORACLE_SQL, QUERIES  # noqa: F401
