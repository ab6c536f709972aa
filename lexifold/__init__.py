"""Building, searching and auditing a versioned document knowledge base with Spark DataFrames."""

from lexifold.operators.cells import CellOptions, VectorCells, build_cells, load_cells
from lexifold.operators.replies import ReplyLedger
from lexifold.options import DEFAULTS, EmbeddingOptions, RetrievalOptions
from lexifold.plans.ask import answer_questions, build_context, validate_answers, version_report
from lexifold.plans.catalog import document_detail, document_versions, list_documents, status
from lexifold.plans.index import KnowledgeIndex, build_index, load_index
from lexifold.plans.ingest import IngestRejected, ingest
from lexifold.plans.search import prepare, search, with_chunks
from lexifold.plans.segments import merge_segments, refresh_index, update_index
from lexifold.sources.audit_log import append_audit_log, compact_audit_log, read_audit_log
from lexifold.sources.markdown import folder_manifest, read_changed_markdown, read_markdown_folder, write_markdown_folder
from lexifold.sources.store import Store, StoreChanges, StoreMoved, empty_store, read_store, write_changes, write_store

__all__ = [
    "CellOptions", "DEFAULTS", "EmbeddingOptions", "IngestRejected", "KnowledgeIndex", "ReplyLedger", "RetrievalOptions", "Store",
    "StoreChanges", "StoreMoved", "VectorCells",
    "answer_questions", "append_audit_log", "build_cells", "build_context", "build_index", "compact_audit_log", "document_detail",
    "document_versions", "empty_store", "folder_manifest", "ingest", "list_documents", "load_cells", "load_index", "merge_segments",
    "prepare", "read_audit_log", "read_changed_markdown", "read_markdown_folder", "read_store", "refresh_index", "search",
    "status", "update_index", "validate_answers", "version_report", "with_chunks", "write_changes", "write_markdown_folder",
    "write_store",
]
