"""Named queries; importing this package registers them."""

from tessera.plans import corpus, evals, events, retrieval, sessions, streams  # noqa: F401
from tessera.plans import sources  # noqa: F401  (names queries of the others again)
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
