"""All registered queries."""

from queries import (  # noqa: F401
    answers,
    conversations,
    evidence,
    exchanges,
    request_texts,
    texts_and_samples,
    training,
    trees,
)
from queries.registry import ORACLES, QUERIES  # noqa: F401
