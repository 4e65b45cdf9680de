"""Word lists, patterns, limits and names that decide results.

Fixed values: every list below is part of the defined behaviour and must stay
exactly as it is for results to match.
"""

# --- messages -------------------------------------------------------------

LABEL_KEYWORDS = [
    "fix", "fixed", "bug", "issue", "error", "crash", "regression",
    "incorrect", "wrong", "fail", "failure", "broken", "patch",
]

HISTORY_SUBSTRINGS = [
    "fix", "fixed", "bug", "bugfix", "bug fix", "error", "crash",
    "regression", "failure", "broken", "incorrect",
]

STRONG_KEYWORDS = [
    "fix", "fixed", "fixes", "bug", "bugfix", "bug fix", "defect", "error",
    "exception", "crash", "failure", "fail", "regression", "incorrect",
    "wrong", "broken", "break", "issue", "patch", "resolve", "resolves",
    "resolved", "repair", "hotfix", "workaround", "prevent",
]

NEGATIVE_SUBSTRINGS = [
    "merge branch", "merge pull request", "release", "version bump",
    "bump version", "changelog", "readme", "documentation", "docs:", "typo",
    "formatting", "lint", "style only", "refactor only", "rename only",
]

TEST_EVIDENCE_SUBSTRINGS = ["fix", "bug", "regression", "failure", "error"]

REFERENCE_PATTERN = r"(#\d+|\bissue\s+\d+|\bpr\s+\d+)"

TEST_WORD_PATTERN = r"\btest\b|\btests\b|\btesting\b"

ROUTINE_KEYWORDS = [
    "add", "implement", "feature", "new", "update", "upgrade", "refactor",
    "cleanup", "rename", "remove", "delete", "deprecate", "support",
    "improve", "optimize", "performance", "typing", "type hints", "test",
    "tests", "testing", "documentation", "docs", "readme", "example",
    "examples",
]

EXPLICIT_INTENT_PATTERNS = [
    r"\bfix(?:ed|es)?\s+(?:the\s+)?(?:bug|issue|defect|regression|crash)\b",
    r"\bfix(?:ed|es)?\s+.*\b(?:crash|regression|incorrect|broken|wrong)\b",
    r"\bresolve[ds]?\s+(?:the\s+)?(?:bug|issue|defect|regression)\b",
    r"\brepair(?:ed|s)?\s+(?:the\s+)?(?:bug|issue|defect|regression)\b",
    r"\b(?:bug|issue|defect)\s+(?:fix|fixed|fixes)\b",
    r"\bfix(?:ed|es)?\s+.*\bcaus(?:e|es|ed|ing)\b",
    r"\bfix(?:ed|es)?\s+.*\bincorrect\b",
    r"\bfix(?:ed|es)?\s+.*\bwrong\b",
    r"\bfix(?:ed|es)?\s+.*\bbroken\b",
    r"\bfix(?:ed|es)?\s+.*\bfail(?:ure|ed|ing)?\b",
    r"\bfix(?:ed|es)?\s+.*\bexception\b",
    r"\bfix(?:ed|es)?\s+.*\bcrash(?:es|ed|ing)?\b",
    r"\bfix(?:ed|es)?\s+.*\bregression\b",
    r"\bhotfix\b",
]

REJECT_PATTERNS = [
    r"^\s*merge\b",
    r"^\s*merged\b",
    r"\bmerge pull request\b",
    r"\bmerge branch\b",
    r"\bsvnmerge\b",
    r"\bcherry[- ]pick\b",
    r"\bcherry picked\b",
    r"\brelease\b",
    r"\bversion bump\b",
    r"\bbump version\b",
    r"^\s*bump\b",
    r"\bupdate changelog\b",
    r"^\s*changelog\b",
    r"^\s*docs?\b",
    r"\bdocumentation\b",
    r"^\s*readme\b",
    r"\bformatting\b",
    r"^\s*lint\b",
    r"\btypo\b",
]

STRONG_EVIDENCE_PATTERNS = [
    r"\bfix\b",
    r"\bfixed\b",
    r"\bfixes\b",
    r"\bbug\b",
    r"\bbugfix\b",
    r"\bbug fix\b",
    r"\bregression\b",
    r"\bcrash\b",
    r"\bexception\b",
    r"\bfailure\b",
    r"\bincorrect\b",
    r"\bwrong\b",
    r"\bbroken\b",
    r"\bdefect\b",
    r"\bresolve\b",
    r"\bresolved\b",
    r"\bresolves\b",
    r"\bprevent\b",
    r"\brepair\b",
    r"\bhotfix\b",
    r"\bworkaround\b",
]

SUPPORTING_PATTERNS = [
    r"#\d+",
    r"\bissue\s+#?\d+\b",
    r"\bpr\s+#?\d+\b",
    r"\bpull request\b",
    r"\btest\b",
    r"\btest case\b",
    r"\bregression test\b",
]

# --- paths ----------------------------------------------------------------

IGNORED_PATH_PATTERNS = [
    r"(^|/)__pycache__(/|$)",
    r"(^|/)node_modules(/|$)",
    r"(^|/)vendor(/|$)",
    r"(^|/)dist(/|$)",
    r"(^|/)build(/|$)",
    r"(^|/)target(/|$)",
    r"(^|/)coverage(/|$)",
    r"(^|/)htmlcov(/|$)",
    r"(^|/)site-packages(/|$)",
    r"(^|/)package-lock\.json$",
    r"(^|/)yarn\.lock$",
    r"(^|/)pnpm-lock\.yaml$",
    r"(^|/)poetry\.lock$",
    r"(^|/)Pipfile\.lock$",
    r"(^|/)Cargo\.lock$",
    r"(^|/)go\.sum$",
]

SOURCE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".cc",
    ".cxx", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".kts",
    ".scala", ".m", ".mm",
]

PYTHON_EXTENSIONS = [".py"]

LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".go": "go",
    ".rs": "rust",
}

IGNORED_DIRECTORIES = [
    ".git", ".venv", "venv", "node_modules", "vendor", "build", "dist",
    "__pycache__",
]

# --- limits ---------------------------------------------------------------

SEED = 42

DIFF_LIMITS = {
    "max_files": 30,
    "max_added": 1500,
    "max_deleted": 1500,
    "max_patch_chars": 80000,
}
STORED_PATCH_CHARS = 20000
MIN_SIGNAL_SCORE = 2
MAX_NEGATIVES_PER_REPO = 1200
TARGET_NEGATIVES = 12000

QUALITY_LIMITS = {
    "max_files": 20,
    "max_lines": 1000,
    "min_lines": 1,
    "min_score": 4,
}
MIN_RECORDS_PER_REPO = 100
MAX_RECORDS_PER_REPO = 3000
MAX_PER_CLASS = 12000

MIN_COMMITS = 100
MIN_PYTHON_FILES = 20
APPROVED_LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"]

SPLIT_RATIOS = (0.80, 0.10, 0.10)
TEMPORAL_RATIOS = (0.70, 0.15, 0.15)
DECISION_THRESHOLD = 0.51
EXTERNAL_THRESHOLD = 0.31

# --- features -------------------------------------------------------------

HISTORY_FEATURES = [
    "prior_commit_count",
    "prior_bug_fix_count",
    "prior_total_insertions",
    "prior_total_deletions",
    "prior_total_churn",
    "prior_unique_authors",
    "days_since_last_change",
    "historical_bug_fix_ratio",
    "average_prior_churn",
]

MAX_TERMS = 30000
MIN_DOC_COUNT = 2
MAX_DOC_SHARE = 0.95

VOCABULARY_SIZE = 16000
MIN_PAIR_COUNT = 2
SPECIAL_TOKENS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "<MASK>"]
PRE_TOKEN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
