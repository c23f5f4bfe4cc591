"""Named queries over the given tables."""

from . import batches, detection, edges, enrich, events, extras, harvest, identity, quality, records, regions, validation  # noqa: F401
