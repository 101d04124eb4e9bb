"""The queries of the engine's own operators, by name, and the SQL that each is compared with."""

from __future__ import annotations

from lakefold.plans import decisions, evaluation, labels, models, outcomes, people, retrieval

FLAGSHIP = "search_evidence"
QUERIES = retrieval.BOOK.queries | evaluation.BOOK.queries | people.BOOK.queries | decisions.BOOK.queries | labels.BOOK.queries | outcomes.BOOK.queries | models.BOOK.queries
ORACLES = retrieval.BOOK.oracles | evaluation.BOOK.oracles | people.BOOK.oracles | decisions.BOOK.oracles | labels.BOOK.oracles | outcomes.BOOK.oracles | models.BOOK.oracles
#: The same rows by another name.
ORACLES["replayed_jobs"] = ORACLES["job_states"]
