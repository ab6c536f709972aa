"""Job parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalOptions:
    """Sizes and thresholds of retrieval.

    ``max_broadcast_rows`` and ``max_broadcast_values`` bound the query-side
    rows and vector components shipped to every executor at a time; bigger
    batches go in blocks of queries. Up to ``max_pushed_terms`` query terms are
    named in the filter of the postings, which are sorted by term. The ``first_blocks`` most promising blocks of documents
    per query are scored before the others, or one in ``first_share`` where those would be more; beyond ``max_bounded_terms`` query
    terms, bounds of every query and block would be more work than they save, and all are scored. Up to ``max_pruned_documents`` documents, a lookup
    names the documents so that the other buckets are not read.
    """

    # Defaults of ranking, fusion and the evidence gate.
    top_k: int = 6
    candidate_pool: int = 20
    rrf_k: int = 60
    min_dense_score: float = 0.55
    min_lexical_coverage: float = 0.5
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    max_query_chars: int = 500
    max_top_k: int = 20
    substitute_sections: int = 2

    # Spark-side sizing.
    max_broadcast_rows: int = 500_000
    max_broadcast_values: int = 16_000_000
    max_pruned_documents: int = 1_000
    max_pushed_terms: int = 64
    first_blocks: int = 2
    first_share: int = 8
    max_bounded_terms: int = 50_000


@dataclass(frozen=True)
class EmbeddingOptions:
    """How texts are handed to the caller's embedder."""

    model: str
    query_prefix: str = ""
    document_prefix: str = ""
    batch_size: int = 16


DEFAULTS = RetrievalOptions()

# Fixed value: longest chunk, in UTF-16 units, before a section is split at paragraphs.
MAX_CHUNK_CHARS = 1200
