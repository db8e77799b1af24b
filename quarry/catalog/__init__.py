"""All queries of the library outside the llm folder."""

from quarry.catalog import answers, binding, chunking, drafts, evaluation, evidence, figures, layout, planning, quality, retrieval, scoped, streams, structure, texts  # noqa: F401
from quarry.catalog.registry import ORACLES, QUERIES  # noqa: F401
