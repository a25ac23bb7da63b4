"""Types, ordered stages and defaults of a research library."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Stages in order; the first of each is the default for unknown text.
PAPER_STATUS = ("discovered", "abstract_read", "skimmed", "read", "deep_read")
READING_STATUS = ("unread", "queued", "in_progress", "completed", "abandoned")
GAP_TYPE = ("missing_literature", "unanswered_question", "methodology_gap", "connection_gap")
#: Names by which a language model's reply calls the gap types.
GAP_NAMES = ("MissingLiterature", "UnansweredQuestion", "MethodologyGap", "ConnectionGap")

MAX_BODY, MAX_TOOL_BODY, MAX_KEYWORDS, HISTORY = 500_000, 40_000, 512, 500
REPORT_TOKENS, KEYWORD_TOKENS, GAP_TOKENS, GAP_CHARS, CHARS_PER_TOKEN = 4000, 3000, 6000, 24_000, 4
PAGE_MARK = "<!-- page "

_text = lambda *names: [StructField(x, StringType()) for x in names]

PAPERS = StructType(
    [*_text("id"), StructField("title", StringType(), False), StructField("authors", ArrayType(StringType())), *_text("abstract_text"), StructField("year", IntegerType())]
    + _text("venue", "doi", "arxiv_id", "s2_id", "openalex_id", "url", "pdf_path", "status", "reading_status", "notes")
    + [StructField("tags", ArrayType(StringType())), StructField("relevance_score", DoubleType()), StructField("rating", IntegerType()), *_text("keywords", "created_at", "updated_at")]
)
BODIES = StructType(_text("paper_id", "body"))
TOPICS = StructType([*_text("id", "name", "description", "parent_topic_id"), StructField("depth", IntegerType()), StructField("priority", DoubleType()), *_text("created_at")])
TOPIC_PAPERS = StructType([*_text("topic_id", "paper_id"), StructField("relevance", DoubleType())])
GAPS = StructType([*_text("id", "description", "topic_id", "gap_type"), StructField("priority", DoubleType()), *_text("discovered_at")])
STATE = StructType([*_text("topic_id"), *[StructField(x, IntegerType()) for x in ("papers_read", "papers_queued", "gaps_identified")], StructField("coverage_score", DoubleType()), *_text("last_updated")])
REPORTS = StructType([*_text("id", "title"), StructField("topic_ids", ArrayType(StringType())), *_text("content", "generated_at")])
CITATIONS = StructType([*_text("citing", "cited", "context"), StructField("seq", LongType())])

#: Tables of a library with the columns that identify a row.
TABLES = {"papers": (PAPERS, ["id"]), "bodies": (BODIES, ["paper_id"]), "topics": (TOPICS, ["id"]), "topic_papers": (TOPIC_PAPERS, ["topic_id", "paper_id"]), "gaps": (GAPS, ["id"]), "state": (STATE, ["topic_id"]), "reports": (REPORTS, ["id"]), "citations": (CITATIONS, ["citing", "cited"])}
#: Values for columns that an older table lacks.
DEFAULTS = {"status": "discovered", "reading_status": "unread", "keywords": "", "notes": "", "relevance_score": 0.5, "context": "", "priority": 0.5, "depth": 0}
