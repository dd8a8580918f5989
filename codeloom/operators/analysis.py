"""Issue rules, fixes and reports. Issues stay an array in the row of their file."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.language import with_language
from codeloom.functions.text import lines
from codeloom.operators.features import of_kind, python_features

ISSUE = "struct<ord:int,category:string,source:string,issue_type:string,line:int,col:int,message:string>"

# Line rules for languages without a parser here: (source, language, text before the reported
# position, reported text, message); a message with %s names the reported identifier. Without a
# text before, the rule reports blocks of that keyword that no catch or finally follows. Rules read
# the code with comments, strings and template strings blanked out.
TEXT_RULES = [
    ("var", "javascript", r"(\b(?:var|let)\s+)", r"([A-Za-z_$][\w$]*\s*;)", params.UNINITIALISED_VARIABLE),
    ("catch", "javascript", r"()", r"(\bcatch\s*\{)", params.CATCH_WITHOUT_PARAMETER),
    ("try", "javascript", None, "try", params.EMPTY_TRY),
    ("try", "java", None, "try", params.EMPTY_TRY),
    ("catch", "java", r"()", r"(\bcatch\s*(?:\(\s*\))?\s*\{)", params.CATCH_WITHOUT_TYPE),
]
MARK = "\x01"
BLANKED = (
    r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
)


def issue(ord, category, source, issue_type, line, col, message):
    """One issue struct; plain values become literals. ``ord`` is the place in the syntax walk."""
    def column(value):
        return F.lit(value) if value is None or isinstance(value, (str, int)) else value

    values = dict(
        ord=ord, category=category, source=source, issue_type=issue_type,
        line=line, col=col, message=message,
    )
    return F.struct(*[column(v).alias(n) for n, v in values.items()]).cast(ISSUE)


def syntax_issues():
    text = F.concat_ws(": ", "error_class", "error_message")
    found = issue(
        0, "errors", "syntax", F.col("error_class"), F.col("error_line"), F.col("error_col"), text
    )
    return F.when(~F.col("valid"), F.array(found)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def except_issues():
    """``try`` without handlers and bare handlers, in the order of the syntax walk."""
    hits = F.filter("facts", lambda f: f["kind"].isin("try", "handler") & (f["size"] == 0))
    return F.transform(
        hits,
        lambda f: issue(
            f["ord"],
            "errors",
            "except",
            None,
            f["line"],
            f["col"],
            F.when(f["kind"] == "try", params.EMPTY_EXCEPT).otherwise(params.BARE_EXCEPT),
        ),
    )


def lookup(table):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def unsafe_calls(table=None):
    table = table or params.UNSAFE_FUNCTIONS
    hits = F.filter(of_kind("call"), lambda f: f["name"].isin(*table))
    return F.transform(
        hits,
        lambda f: issue(
            f["ord"], "security_issues", "call", params.UNSAFE_CALL_ISSUE, f["line"], f["col"],
            F.format_string(params.UNSAFE_CALL_TEXT, f["name"], F.element_at(lookup(table), f["name"])),
        ),
    )


def unsafe_imports(table=None):
    """Imported names on the list; of ``from m import x`` the name ``x`` is tested, not ``m``."""
    table = table or params.UNSAFE_MODULES

    def per_import(f):
        return F.transform(
            F.filter(f["names"], lambda n: n.isin(*table)),
            lambda n: issue(
                f["ord"], "security_issues", "import", params.UNSAFE_IMPORT_ISSUE, f["line"], f["col"],
                F.format_string(params.UNSAFE_IMPORT_TEXT, n, F.element_at(lookup(table), n)),
            ),
        )

    return F.flatten(F.transform(of_kind("import"), per_import))


def large_strings(limit=params.LARGE_STRING_LENGTH):
    hits = F.filter(of_kind("string"), lambda f: f["size"] > limit)
    return F.transform(
        hits,
        lambda f: issue(
            f["ord"], "security_issues", "string", params.LARGE_STRING_ISSUE, f["line"], f["col"],
            params.LARGE_STRING_TEXT,
        ),
    )


def bound(value, body):
    """``body`` of a column that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blanked(text):
    """The code with every character of comments and strings, and every mark, as a space."""
    parts = F.split(text, BLANKED, -1)
    gaps = F.transform(F.regexp_extract_all(text, F.lit(BLANKED), 0), lambda t: F.regexp_replace(t, r"[^\n]", " "))
    code = bound(F.struct(parts.alias("p"), gaps.alias("g")), lambda x: F.array_join(
        F.zip_with(x["p"], x["g"], lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), ""
    ))
    return F.translate(code, MARK, " ")


def marked_blocks(code, word):
    """The code with a mark before every ``word`` block that no catch or finally follows.

    Braces are matched by one walk over them that keeps the open blocks on a stack.
    """
    token = rf"\b{word}\s*\{{|\{{|\}}(?:\s*(?:catch|finally)\b)?"

    def walk(state, t):
        top = F.element_at(state["open"], -1)
        closing = F.startswith(t["text"], F.lit("}"))
        hit = closing & (F.size(state["open"]) > 0) & (top >= 0) & (t["text"] == "}")
        opened = F.when(F.startswith(t["text"], F.lit(word)), t["at"]).otherwise(F.lit(-1))
        rest = F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        return F.struct(
            F.when(closing, rest).otherwise(F.concat(state["open"], F.array(opened))).alias("open"),
            F.when(hit, F.concat(state["found"], F.array(top))).otherwise(state["found"]).alias("found"),
        )

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("open"), none.alias("found"))

    def marked(x):
        numbered = F.transform(x["t"], lambda t, i: F.struct(t.alias("text"), i.alias("at")))
        found = F.aggregate(numbered, start, walk, lambda s: s["found"])

        def joined(f):
            signed = F.transform(x["t"], lambda t, i: F.concat(F.when(F.array_contains(f, i), MARK).otherwise(""), t))
            return F.array_join(F.zip_with(x["p"], signed, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")

        return bound(found, joined)

    pieces = F.struct(F.split(code, token, -1).alias("p"), F.regexp_extract_all(code, F.lit(token), 0).alias("t"))
    return bound(pieces, marked)


def text_rule_issues(text, language, rules=None):
    """Issues of the line rules that belong to the language of the row.

    Each hit is preceded by a mark; the text before the k-th mark gives line and column.
    """
    none = F.array().cast(f"array<{ISSUE}>")
    rules = rules or TEXT_RULES

    def issues(code):
        found = []
        for source, lang, before, reported, message in rules:
            if before is None:
                marked = marked_blocks(code, reported)
            else:
                marked = F.regexp_replace(code, before + reported, f"$1{MARK}$2")

            hits = bound(F.split(marked, MARK, -1), marked_issues(source, message))
            found.append(F.when(language == lang, hits).otherwise(none))
        return F.concat(*found)

    known = language.isin(sorted({rule[1] for rule in rules}))
    return F.when(known, bound(blanked(text), issues)).otherwise(none)


def marked_issues(source, message):
    """The issues at all marks, from the parts between them."""

    def hits(parts):
        later = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return F.transform(later, marked_issue(parts, source, message))

    return hits


def marked_issue(parts, source, message):
    """Issue at the mark after the part with the given index."""

    def hit(_, index):
        head = lines(F.array_join(F.slice(parts, F.lit(1), index + 1), ""))
        text = F.lit(message)
        if "%s" in message:
            following = F.element_at(parts, index + 2)
            text = F.format_string(message, F.regexp_extract(following, r"^([\w$]+)", 1))
        col = F.length(F.element_at(head, -1))
        return issue(index, "errors", source, None, F.size(head), col, text)

    return hit


def analyse(df, code="text", keep=("doc_id",), unsafe_functions=None, unsafe_modules=None,
            text_rules=None, languages=None):
    """Whole-file analysis: language, then the issues of every rule that applies, in rule order.

    Python files get syntax and exception-clause errors, JavaScript and Java files the line
    rules; the security rules see every file that parses. The result keeps the features. The
    rule tables and the language patterns can be replaced by the caller's own.
    """
    known = with_language(df, code, table=languages)
    features = python_features(known, code, [*keep, "language", code])
    none = F.array().cast(f"array<{ISSUE}>")
    python_only = F.when(
        F.col("language") == "python", F.concat(syntax_issues(), except_issues())
    ).otherwise(none)
    return features.withColumn(
        "issues",
        F.concat(
            python_only,
            text_rule_issues(F.col(code), F.col("language"), text_rules),
            static_security_issues(unsafe_functions, unsafe_modules),
        ),
    )


def static_security_issues(functions=None, modules=None):
    """All security issues of a file in the order of the syntax walk."""
    found = F.concat(unsafe_calls(functions), unsafe_imports(modules), large_strings())
    return F.array_sort(found, lambda a, b: a["ord"] - b["ord"])


def issue_table(analysed, keep=("doc_id",)):
    """Long form: one row per issue with its position in the file's list."""
    return analysed.select(*keep, F.posexplode("issues").alias("place", "issue")).select(
        *keep, "place", "issue.*"
    )


def issue_dictionary(issues):
    """The four category lists of one file as a struct of arrays."""
    def members(category):
        return F.transform(
            F.filter(issues, lambda i: i["category"] == category),
            lambda i: F.struct(i["line"], i["col"].alias("column"), i["message"]),
        )

    return F.struct(*[members(c).alias(c) for c in params.ISSUE_CATEGORIES])


def count_of(category, issues="issues"):
    """Number of issues of one category."""
    return F.size(F.filter(issues, lambda i: i["category"] == category)).cast("long")


def issue_label(n):
    """Prefix shown in front of a suggestion when its file has issues."""
    return F.when(n > 0, F.format_string("(%d issues) ", n)).otherwise(F.lit(""))


def diagnostic(line, col, message):
    """0-based range and severity of an issue."""
    severity = F.when(F.startswith(message, F.lit("Error")), "Error").otherwise("Warning")
    return F.struct(
        (line - 1).alias("start_line"),
        (col - 1).alias("start_character"),
        (line - 1).alias("end_line"),
        col.alias("end_character"),
        severity.alias("severity"),
        message.alias("message"),
    )


def suggested_fix(message, line, rules=None):
    """Text of the first rule whose fragments all occur in the message; null without one."""
    chain = None
    for fragments, template in rules or params.FIX_RULES:
        fits = F.lit(True)
        for fragment in fragments:
            fits = fits & F.contains(message, F.lit(fragment))
        chain = (F if chain is None else chain).when(
            fits, F.replace(F.lit(template), F.lit("{line}"), line.cast("string"))
        )
    return chain


def fixes(issues_long, rules=None):
    """(…, error, fix) for every issue some rule fits."""
    fixed = issues_long.withColumn("fix", suggested_fix(F.col("message"), F.col("line"), rules))
    return fixed.where(F.col("fix").isNotNull())


def report(issues):
    """Security report text over an array of issues; a fixed text when it is empty."""
    entries = F.transform(
        issues,
        lambda i, n: F.format_string(
            params.REPORT_ENTRY, n + 1, i["issue_type"], i["line"], i["col"], i["message"]
        ),
    )
    total = F.format_string(params.REPORT_TOTAL, F.size(issues))
    full = F.concat(F.lit(params.REPORT_HEADER), F.array_join(entries, ""), total)
    return F.when(F.size(issues) == 0, params.REPORT_EMPTY).otherwise(full)


def security_issues(issues="issues"):
    return F.filter(issues, lambda i: i["category"] == "security_issues")
