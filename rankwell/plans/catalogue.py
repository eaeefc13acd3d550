"""All registered queries; importing the modules registers them."""

from rankwell.plans import (  # noqa: F401
    queries_ingest,
    queries_match,
    queries_report,
    queries_state,
    queries_stream,
    queries_text,
    queries_track,
)
from rankwell.plans.registry import ORACLES, QUERIES  # noqa: F401
