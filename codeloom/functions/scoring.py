"""Scores of one suggestion candidate: plain column expressions."""

from functools import reduce

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import lines


def indented(code):
    """True when every non-blank line starts with four spaces or a tab."""
    blank = rf"^{params.SPACE_CLASS}*$"
    written = F.filter(lines(code), lambda x: ~F.rlike(x, F.lit(blank)))
    return F.forall(written, lambda x: F.startswith(x, F.lit("    ")) | F.startswith(x, F.lit("\t")))


def has_snake_case(code):
    """True when a lower-case ASCII identifier stands alone between non-word characters."""
    edge = params.WORD_CLASS
    return F.rlike(code, F.lit(rf"(?<!{edge})[a-z_][a-z0-9_]*(?!{edge})"))


def points(flag, value):
    return F.when(flag, F.lit(value)).otherwise(F.lit(0.0))


def style_score(code):
    return points(indented(code), 0.5) + points(has_snake_case(code), 0.5)


def complexity_score(code, depth):
    return points(F.length(code) < 100, 0.5) + points(depth <= 2, 0.5)


def has_dangerous_text(code, fragments=None):
    """True when the text contains a call that runs or imports code dynamically."""
    found = [F.contains(code, F.lit(f)) for f in fragments or params.DANGEROUS_TEXT]
    return reduce(lambda a, b: a | b, found)


def completion_score(relevant, completion, valid, depth):
    """0 for code that does not parse, else 1.0 to 5.0.

    ``relevant`` says whether prompt and completion share a word (``is_relevant``); computed
    before the Python stage, it spares sending the prompt through it.
    """
    score = (
        F.lit(1.0)
        + points(relevant, 1.0)
        + style_score(completion)
        + complexity_score(completion, depth)
        + points(~has_dangerous_text(completion), 1.0)
    )
    return F.when(~valid, F.lit(0.0)).otherwise(score)
