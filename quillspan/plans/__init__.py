"""Named queries over the test tables: importing this package fills the registry."""

from quillspan.plans import intake, keeping, ordered, payloads, ranking, relational, reporting, scalars, storage, streams  # noqa: F401
