"""All runnable queries; importing this package fills the registry."""

from lotlens.catalog import carriers  # noqa: F401
from lotlens.catalog import audits, evaluation, events, grading, measures, stores  # noqa: F401
from lotlens.catalog.core import QUERIES, Tables, oracle_text  # noqa: F401
