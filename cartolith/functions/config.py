"""Fixed values that drive the operators' defaults; each is a parameter where it is used."""

#: Folders that are never analysed.
IGNORE_FOLDERS = (
    "test", "tests", "docs", "examples", ".git", ".hg", ".svn", "node_modules", "dist", "build", "target", ".venv", "venv", "__pycache__", ".tox", ".eggs", "site-packages",
)
#: Language of each file suffix.
LANGUAGES = {".py": "python", ".java": "java", ".scala": "scala", ".rs": "rust"}
#: Suffixes each language's analyser takes.
ANALYZER_SUFFIXES = {"scala": (".scala", ".sbt", ".sc"), "python": (".py",), "java": (".java",), "rust": (".rs",)}
#: Suffixes of store files that are no source.
STORE_SUFFIXES = (".sqlite", ".sqlite-shm", ".sqlite-wal")
#: Least share of supported tokens, per cent from which one language dominates, label of files in no language.
MIN_SUPPORTED_RATIO = 0.5
DOMINANT_PCT = 70.0
UNSUPPORTED = "unsupported/unknown"
#: Metric names shown with a job's precheck stage.
PRECHECK_METRICS = (
    "total_tokens", "supported_tokens", "supported_ratio", "primary_language", "language_distribution_pct", "supported_file_count", "unsupported_file_count", "excluded_file_count",
)
#: Kinds of document.
BRIEF, IGNORED, ENTRY_POINTS, CONTEXT, SUMMARY = "BRIEF_FILE_OVERVIEW", "IGNORED_FILE", "POTENTIAL_ENTRY_POINTS", "REPO_CONTEXT", "REPO_SUMMARY"
#: Words that come right before the name they define, by language.
DEFINING_WORDS = {
    "python": ("def", "class"),
    "java": ("class", "interface", "enum", "record"),
    "scala": ("def", "class", "object", "trait", "val", "var"),
    "rust": ("fn", "struct", "enum", "trait", "mod", "impl"),
}
TOKEN = r"[A-Za-z_]+|[0-9]+|[^ \t\n\r\x0B\fA-Za-z_0-9]"
SYMBOL = "^[A-Z][A-Za-z_]{7,}$"
