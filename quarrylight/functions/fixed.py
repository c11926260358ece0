"""Word lists, patterns and constants that decide results.

Everything in this module is data. Changing an entry changes query results, so
the values are kept together and in plain text.
"""

from __future__ import annotations

# --- tokens -----------------------------------------------------------------
# Words of keywords and probes.
WORD_PATTERN = r"[A-Za-z][A-Za-z0-9\-]{2,}"
# Words of the full-text index, the vectors and their queries: all letters, marks and digits.
SEARCH_PATTERN = r"[\p{L}\p{M}\p{N}]+"

# Function words ignored by keyword extraction.
KEYWORD_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by",
    "is", "are", "was", "were", "be", "been", "that", "this", "these", "those",
    "as", "at", "from", "we", "our", "using", "used", "use", "can", "may", "also",
    "which", "than", "then", "between", "their", "its", "it", "not", "but", "each",
    "per", "via", "into", "over", "under", "both", "all", "more", "most", "such",
    "when", "while", "after", "before", "during", "results", "methods", "study",
)

# Function words ignored when a query is split into sub-queries.
SUBQUERY_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by",
    "is", "are", "was", "were", "be", "that", "this", "these", "those", "as", "at",
    "from", "we", "our", "its", "it", "not", "but", "which", "than", "then", "their",
)

# Synthesis phrasing that carries no topic of its own.
SCAFFOLD = (
    "compare", "summarize", "summary", "across", "studies", "study", "overall",
    "synthesize", "synthesis", "between", "differ", "differences", "consensus",
)

# Single words too general to be a concept.
GENERIC_CONCEPTS = (
    "model", "method", "result", "study", "approach", "figure", "table", "paper",
    "value", "data", "analysis",
)

# --- router -----------------------------------------------------------------
# Substrings that mark a query as global or local. The blanks
# around "vs" are part of the marker.
GLOBAL_MARKERS = (
    "compare", "across", "overall", "summary", "summarize", "synthesize", "trend",
    "differ", "differences", "versus", " vs ", "relationship", "consensus",
    "in general", "all studies", "between",
)
LOCAL_MARKERS = (
    "define", "definition", "what is", "value of", "equation", "formula",
    "table", "figure",
)

# Example questions of each scope.
LOCAL_EXEMPLARS = (
    "what is the value of the .632 estimator",
    "definition of the hazard ratio",
    "what sample size does Riley 2020 recommend",
    "the equation for the c-statistic",
    "what does table 2 report",
    "which optimism-correction did Harrell use",
    "the formula for net benefit",
    "what is the bootstrap .632+ rule",
)
GLOBAL_EXEMPLARS = (
    "compare bootstrap and cross-validation across studies",
    "summarize the methods for sample size in prediction models",
    "how do calibration approaches differ overall",
    "what is the consensus on optimism correction",
    "synthesize the recommendations across these papers",
    "trends in prediction-model validation over time",
    "relationship between shrinkage and overfitting across methods",
    "overall, how should model performance be assessed",
)

# Fixed value: phrasing of a generated multi-source question.
GLOBAL_QUESTION_PREFIX = "compare and summarize across the studies: "

# --- document classes -------------------------------------------------------
# Fingerprints of scanning software in producer/creator fields.
SCANNER_SIGNATURES = (
    "abbyy", "finereader", "paper capture", "acrobat capture", "scansnap",
    "tesseract", "omnipage", "nuance", "kofax", "readiris", "scanned by",
    "capture plug-in",
)

# Thresholds of the page classifier.
SCAN_COVERAGE = 0.80
AMBIGUOUS_COVERAGE = 0.55
TEXT_PRESENT_CHARS = 40
TEXT_USABLE_CHARS = 200
NOISE_LIMIT = 0.06
MAX_SAMPLED_PAGES = 8

# Characters counted as OCR noise, as a regular-expression class.
NOISE_CLASS = r"\x00-\x1F\x7F-\x9F\x{FFFD}\x{E000}-\x{F8FF}\x{FB00}-\x{FB04}"

# --- artifacts --------------------------------------------------------------
# Caption openings and search windows in points.
TABLE_CAPTION_PATTERN = r"(?i)^\s*(table|tab\.?)\s*\d+"
FIGURE_CAPTION_PATTERN = r"(?i)^\s*(figure|fig\.?)\s*\d+"
TABLE_CAPTION_WINDOW = 60.0
FIGURE_CAPTION_WINDOW = 80.0
FIGURE_ABOVE_PENALTY = 1000.0
MIN_FIGURE_AREA = 2500.0

# Symbols, patterns and limits of the formula test.
MATH_CLASS = r"=+\-*/^<>∑∏∫∂√≈≠≤≥±×÷∇∞αβγδθλμπσφω→∈"
EQUATION_NUMBER_PATTERN = r"\(\s*\d+[a-z]?\s*\)\s*$"
RELATION_PATTERN = r"[A-Za-z0-9\)\]]\s*[=<>≈≠≤≥]\s*[A-Za-z0-9\(\[\-]"
FORMULA_MIN_CHARS = 3
FORMULA_DENSITY = 0.18

ARTIFACT_ID_PATTERN = r"^(.+)-([tfe])(\d+)$"
YEAR_PATTERN = r"((?:19|20)\d{2})"
DOI_PATTERN = r"^(?i)(10\.\d{4,9}/\S+)"

CHUNK_KINDS = ("text", "table", "figure", "formula")

DECISIONS = (
    "HYBRID_SUFFICIENT",
    "CONSIDER_GRAPH_OR_ROUTING",
    "TUNE_RETRIEVAL_FIRST",
    "MONITOR",
    "INSUFFICIENT_DATA",
)
