"""Programming-language detection as column expressions."""

from functools import reduce

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import strip_comments, strip_strings

ANCHORS = {
    "literal": {"{BOL}": r"\A", "{EOL}": r"\n?\z"},
    "multiline": {"{BOL}": r"(?md:^)", "{EOL}": r"(?md:$)"},
}


def patterns(mode="literal", table=None):
    """Compiled-ready pattern per language; ``literal`` anchors match only at the text ends."""
    fill = {**ANCHORS[mode], "{W}": params.WORD_CLASS, "{S}": params.SPACE_CLASS}
    table = table or params.LANGUAGE_PATTERNS
    return {
        lang: reduce(lambda p, item: p.replace(*item), fill.items(), pattern)
        for lang, pattern in table.items()
    }


def preprocess(code):
    return strip_strings(strip_comments(code))


def match_counts(clean, mode="literal", table=None):
    """Matches per language.

    With literal anchors an opening construct can only match at the start of the text. Joined
    behind one anchor those alternatives are tried once, not at every position; only what may
    stand elsewhere is searched for. The two never overlap in the standard patterns.
    """
    table = table or params.LANGUAGE_PATTERNS
    if mode != "literal":
        return {
            lang: F.regexp_count(clean, F.lit(pattern))
            for lang, pattern in patterns(mode, table).items()
        }
    counts = {}
    for lang, pattern in table.items():
        elsewhere, *openings = ("|" + pattern).split("|{BOL}")
        parts = {"all": "|".join(openings), "rest": elsewhere.strip("|")}
        filled = patterns(mode, parts)
        n = F.lit(0)
        if openings:
            n = n + F.rlike(clean, F.lit(rf"\A(?:{filled['all']})")).cast("int")
        if filled["rest"]:
            n = n + F.regexp_count(clean, F.lit(filled["rest"]))
        counts[lang] = n
    return counts


def language_scores(code, mode="literal", table=None):
    """Struct with one match count per language, on code without comments and strings."""
    counts = match_counts(preprocess(code), mode, table)
    return F.struct(*[n.alias(lang) for lang, n in counts.items()])


def detect_language(code, mode="literal", table=None):
    """Language with most matches; the first listed wins ties, ``unknown`` without any match.

    The cleaned text is bound once as a lambda variable, so a filter on the result, into which
    the optimizer copies the whole expression, still cleans and scans each text only once.
    """

    def best(clean):
        ranked = [F.struct(F.lit(0), F.lit(0), F.lit(params.UNKNOWN_LANGUAGE))]
        for place, (lang, n) in enumerate(match_counts(clean, mode, table).items(), 1):
            ranked.append(F.struct(n, F.lit(-place), F.lit(lang)))
        named = [r.cast("struct<n:int,place:int,language:string>") for r in ranked]
        return F.array_max(F.array(*named))["language"]

    return F.get(F.transform(F.array(preprocess(code)), best), F.lit(0))


def extension_language(path):
    """Language named by the file extension, or null."""
    extension = F.regexp_extract(path, r"[^./][^/]*(\.[^./]+)$", 1)
    chain = None
    for lang, ext in params.LANGUAGE_EXTENSIONS.items():
        chain = (F if chain is None else chain).when(extension == ext, lang)
    return chain


def with_language(df, code="text", path=None, out="language", mode="literal", table=None):
    """Add the detected language; the extension of ``path``, when known, takes precedence."""
    language = detect_language(F.col(code), mode, table)
    if path is not None:
        language = F.coalesce(extension_language(F.col(path)), language)
    return df.withColumn(out, language)
