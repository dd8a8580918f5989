"""Text as lines, positions and words: plain column expressions."""

from pyspark.sql import functions as F

from codeloom import params


def lines(text):
    return F.split(text, "\n", -1)


def prefix_context(text, line, character):
    """Text from the start up to a 0-based (line, character); past the end the last line is cut."""
    all_lines = lines(text)
    at = F.least(line, F.size(all_lines) - 1)
    head = F.slice(all_lines, F.lit(1), at)
    cut = F.substring(F.element_at(all_lines, at + 1), F.lit(1), character)
    return F.array_join(F.concat(head, F.array(cut)), "\n")


def line_prefix(text, line, character):
    """The part of one line before the cursor; empty past the end of the text."""
    return F.substring(F.coalesce(F.get(lines(text), line), F.lit("")), F.lit(1), character)


def surrounding_lines(text, line, context_lines=params.CONTEXT_LINES):
    """Lines ``line - context_lines`` to ``line + context_lines``, clipped at both ends."""
    all_lines = lines(text)
    first = F.greatest(line - context_lines, F.lit(0))
    stop = F.least(line + context_lines + 1, F.size(all_lines))
    return F.array_join(F.slice(all_lines, first + 1, F.greatest(stop - first, F.lit(0))), "\n")


def trigger_character(prefix, characters=(".",)):
    return F.right(prefix, F.lit(1)).isin(*characters)


def words(text):
    """Lower-cased words in order (Unicode letters, digits, underscore)."""
    return F.array_remove(F.split(F.lower(text), params.NON_WORD_PATTERN, -1), "")


def keywords(text):
    return F.array_distinct(words(text))


def is_relevant(prompt, completion):
    """True when prompt and completion share a word."""
    return F.coalesce(F.arrays_overlap(keywords(prompt), keywords(completion)), F.lit(False))


def strip_comments(text):
    return F.regexp_replace(text, params.COMMENT_PATTERN, "")


def strip_strings(text):
    return F.regexp_replace(text, params.STRING_PATTERN, "")


def fingerprint(snippet):
    """Stable pattern key of a snippet."""
    return F.md5(snippet)


def micros(ts):
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
