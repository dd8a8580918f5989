"""Fixed values and tunable defaults.

Everything in the first part of this module must keep its exact value for results to be
right; the second part holds defaults a caller may override.
"""

# ---------------------------------------------------------------------------------------
# Names, messages, patterns and lookup tables.
# ---------------------------------------------------------------------------------------

# Languages in tie-breaking order, and the file extension that decides each of them.
LANGUAGE_EXTENSIONS = {
    "python": ".py",
    "javascript": ".js",
    "java": ".java",
    "ruby": ".rb",
    "go": ".go",
    "rust": ".rs",
}
UNKNOWN_LANGUAGE = "unknown"

# Opening constructs that vote for a language. {W} is a word character, {S} white space,
# {BOL} / {EOL} the line anchors; see functions/language.py for how they are filled in.
LANGUAGE_PATTERNS = {
    "python": r"\.py{EOL}|{BOL}import{S}+{W}+|{BOL}from{S}+{W}+{S}+import|{BOL}def{S}+{W}+{S}*\(|{BOL}class{S}+{W}+:",
    "javascript": r"\.js{EOL}|{BOL}function{S}+{W}+{S}*\(|{BOL}const{S}+{W}+{S}*=|{BOL}let{S}+{W}+{S}*=|{BOL}var{S}+{W}+{S}*=",
    "java": r"\.java{EOL}|{BOL}public{S}+class{S}+{W}+|{BOL}private{S}+{W}+{S}+{W}+{S}*\(|{BOL}protected{S}+{W}+{S}+{W}+{S}*\(",
    "ruby": r"\.rb{EOL}|{BOL}require{S}+|{BOL}def{S}+{W}+{S}*(?:\(|{EOL})|{BOL}class{S}+{W}+{S}*(?:<|\n)",
    "go": r"\.go{EOL}|{BOL}package{S}+{W}+|{BOL}func{S}+{W}+{S}*\(|{BOL}type{S}+{W}+{S}+struct",
    "rust": r"\.rs{EOL}|{BOL}fn{S}+{W}+{S}*\(|{BOL}let{S}+mut{S}+{W}+|{BOL}impl{S}+{W}+{S}+for",
}

COMMENT_PATTERN = r"#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/"
STRING_PATTERN = r"\"[^\n]*?\"|'[^\n]*?'"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]+"
WORD_CLASS = r"[\p{L}\p{N}_]"
SPACE_CLASS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
DANGEROUS_TEXT = ["eval(", "exec(", "__import__"]

ISSUE_CATEGORIES = ["errors", "warnings", "style_issues", "security_issues"]

UNSAFE_FUNCTIONS = {
    "eval": "Evaluates a string as Python code",
    "exec": "Executes Python code dynamically",
}
UNSAFE_MODULES = {"pickle": "Potentially unsafe serialization"}
UNSAFE_CALL_ISSUE = "Unsafe Function Call"
UNSAFE_CALL_TEXT = "Potentially unsafe use of '%s': %s"
UNSAFE_IMPORT_ISSUE = "Unsafe Module Import"
UNSAFE_IMPORT_TEXT = "Importing potentially unsafe module '%s': %s"
LARGE_STRING_ISSUE = "Large String Assignment"
LARGE_STRING_TEXT = (
    "Assignment of a large string literal. Could potentially contain encoded malicious code."
)
LARGE_STRING_LENGTH = 100

EMPTY_EXCEPT = "Empty except clause"
BARE_EXCEPT = "Bare except clause"
EMPTY_TRY = "Empty try block"
CATCH_WITHOUT_PARAMETER = "Catch block without parameter"
CATCH_WITHOUT_TYPE = "Catch block without exception type"
UNINITIALISED_VARIABLE = "Variable '%s' declared but not initialized"

# (fragments that must all occur in the error, fix text); the first rule that fits wins.
# The two rows after the first carry the wording of newer Python versions.
UNCLOSED_FIX = "Check for unclosed parentheses, brackets, or quotes"
FIX_RULES = [
    (["SyntaxError", "EOF while scanning"], UNCLOSED_FIX),
    (["SyntaxError", "unterminated"], UNCLOSED_FIX),
    (["SyntaxError", "was never closed"], UNCLOSED_FIX),
    (["SyntaxError", "invalid syntax"], "Review the line for typos or missing colons"),
    (["Empty except clause"], "Add a specific exception to catch on line {line}"),
    (
        ["Bare except clause"],
        "Specify an exception to catch on line {line}, e.g., 'except Exception:'",
    ),
]

REPORT_EMPTY = "No security issues found."
REPORT_HEADER = "Security Analysis Report:\n\n"
REPORT_ENTRY = "%d. %s (Line %d, Column %d):\n   %s\n\n"
REPORT_TOTAL = "Total issues found: %d"

BANDIT_ISSUE = "Bandit Issue"
BANDIT_PARSING_ERROR = "Bandit Parsing Error"
BANDIT_PARSING_TEXT = "Error parsing Bandit output"
BANDIT_ERROR = "Bandit Error"
BANDIT_ERROR_TEXT = "Error running Bandit: "

SNIPPET_KIND = 15
FIX_LABEL_PREFIX, COMPLETION_LABEL_PREFIX = "\U0001F527 ", "\U0001F4A1 "
ANONYMOUS = "anonymous"
SECURITY_EVENT_PREFIX = "Security Event: "
ACCEPTED_KEY, REJECTED_KEY = "accepted_pattern", "rejected_pattern"

# ---------------------------------------------------------------------------------------
# Defaults.
# ---------------------------------------------------------------------------------------

DETAIL_PREFIX = "Code suggestion"  # label shown with a suggestion: "<prefix> (<language>)"
CONTEXT_LINES = 2
INLINE_SUGGESTIONS = 3
STREAM_SUGGESTIONS = 5
OVERSAMPLING = 2
TOP_K, TOP_P = 50, 0.95
RETRIEVAL_K = 5
EMBEDDING_DIM = 64
THROTTLE_LIMIT, THROTTLE_WINDOW_S = 5, 60
RATE_LIMIT, RATE_PERIOD_S = 60, 60
DEBOUNCE_MS = 300
CACHE_SIZE = 100
TOKEN_LIFETIME_S = 3600

SESSION_IDLE_S = 90 * 86400  # a user without any event for so long is signed out
