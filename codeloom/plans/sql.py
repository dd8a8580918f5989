"""Pieces of checking SQL used by several queries."""

from codeloom import params
from codeloom.functions.language import patterns
from codeloom.plans.registry import list_literal, text_literal
from codeloom.sources.corpus import COMMENTS, EXTENSIONS, TEMPLATES

# code(doc_id, source, path, text, t): the code corpus with its template number.
CODE = f"""
code AS (
  SELECT doc_id, source, doc_id % {len(TEMPLATES)} AS t, length(doc_id::varchar) AS l,
         source || '/file_' || doc_id || {list_literal(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS path,
         replace({list_literal(TEMPLATES)}[doc_id % {len(TEMPLATES)} + 1], '{{id}}', doc_id::varchar)
           || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
                lambda x: {list_literal(COMMENTS)}[doc_id % {len(COMMENTS)} + 1] || x), chr(10)) || chr(10) AS text
  FROM documents)
"""

# Templates a Python reader accepts, and those whose language is detected as Python.
PARSED = "(0,1,2,3,4,5,6,7,8,11,12,13,14,20,22,23,24,25)"
PYTHON = "(0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,22,24,25,26)"
PYTHON_PARSED = "(0,1,2,3,4,5,6,7,8,11,12,13,14,22,24,25)"



def _security(template, source, kind, line, col, message, place=0):
    return (
        f"SELECT doc_id, {place}, 'security_issues', {text_literal(source)}, {text_literal(kind)}, "
        f"{line}, {col}, {text_literal(message)} FROM code WHERE t = {template}"
    )


def _error(template, place, source, line, col, message):
    return (
        f"SELECT doc_id, {place}, 'errors', {text_literal(source)}, NULL, {line}, {col}, "
        f"{text_literal(message)} FROM code WHERE t = {template}"
    )


_EVAL = params.UNSAFE_CALL_TEXT % ("eval", params.UNSAFE_FUNCTIONS["eval"])
_EXEC = params.UNSAFE_CALL_TEXT % ("exec", params.UNSAFE_FUNCTIONS["exec"])
_PICKLE = params.UNSAFE_IMPORT_TEXT % ("pickle", params.UNSAFE_MODULES["pickle"])

# issues(doc_id, place, category, source, issue_type, line, col, message): stated by template;
# the text of a syntax error depends on the Python version and is left out.
ISSUES = (
    "issues(doc_id, place, category, source, issue_type, line, col, message) AS (\n"
    + "\nUNION ALL ".join(
        [
            "SELECT doc_id, 0, 'errors', 'syntax', 'SyntaxError', "
            "CASE t WHEN 9 THEN 1 ELSE 2 END, CASE t WHEN 9 THEN 8 + l ELSE 6 + l END, "
            "NULL::varchar FROM code WHERE t IN (9, 10)",
            "SELECT doc_id, 0, 'errors', 'syntax', 'MemoryError', NULL, NULL, NULL FROM code WHERE t = 26",
            _error(4, 0, "except", 4, 4, params.BARE_EXCEPT),
            _error(5, 0, "except", 2, 0, params.EMPTY_EXCEPT),
            _error(25, 0, "except", 4, 0, params.BARE_EXCEPT),
            _error(25, 1, "except", 5, 4, params.EMPTY_EXCEPT),
            _error(15, 0, "var", 2, 6, params.UNINITIALISED_VARIABLE % "x"),
            _error(15, 1, "catch", 3, 15, params.CATCH_WITHOUT_PARAMETER),
            _error(16, 0, "try", 2, 13, params.EMPTY_TRY),
            _security(3, "import", params.UNSAFE_IMPORT_ISSUE, 1, 0, _PICKLE),
            _security(6, "call", params.UNSAFE_CALL_ISSUE, 2, "5 + l", _EVAL),
            _security(7, "call", params.UNSAFE_CALL_ISSUE, 3, 0, _EXEC),
            _security(8, "string", params.LARGE_STRING_ISSUE, 2, 0, params.LARGE_STRING_TEXT),
            _security(24, "import", params.UNSAFE_IMPORT_ISSUE, 1, 0, _PICKLE),
            _security(24, "string", params.LARGE_STRING_ISSUE, 2, 0, params.LARGE_STRING_TEXT, 1),
            _security(24, "call", params.UNSAFE_CALL_ISSUE, 3, "5 + l", _EVAL, 2),
        ]
    )
    + ")"
)

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def words_sql(text):
    return WORDS.format(text)


def clean_sql(text):
    comments = text_literal(params.COMMENT_PATTERN)
    strings = text_literal(params.STRING_PATTERN)
    return f"regexp_replace(regexp_replace({text}, {comments}, '', 'g'), {strings}, '', 'g')"


def scores_sql(clean):
    return ", ".join(
        f"len(regexp_extract_all({clean}, {text_literal(p)})) AS s_{lang}"
        for lang, p in patterns().items()
    )


BEST_SQL = (
    "CASE WHEN greatest("
    + ", ".join(f"s_{n}" for n in params.LANGUAGE_PATTERNS)
    + ") = 0 THEN 'unknown' "
    + " ".join(
        f"WHEN s_{n} = greatest({', '.join('s_' + m for m in params.LANGUAGE_PATTERNS)}) THEN '{n}'"
        for n in params.LANGUAGE_PATTERNS
    )
    + " END"
)

EXTENSION_SQL = (
    "CASE regexp_extract(path, '\\.[^./]+$') "
    + " ".join(f"WHEN '{e}' THEN '{n}'" for n, e in params.LANGUAGE_EXTENSIONS.items())
    + " END"
)

# pairs(conv_id, turn, prompt, completion): a user turn and the assistant turn after it.
PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""
