"""Options that are written inside a question's text, in the styles of question collections.

Each parser gives an array of (label, text) in order, or null if the text is not of its style. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDE"
MARK = r"\s*[.．、]\s*"


def _option(label: Column, text: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"))


def _in_order(options: Column, least: int = 2) -> Column:
    """The options if their labels run from A without a gap and every text says something."""
    want = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.char(F.lit(65) + i))
    ok = (F.size(options) >= least) & (F.transform(options, lambda o: o["label"]) == want) & ~F.exists(options, lambda o: o["text"] == "")
    return F.when(ok, options)


def trailing_lines(text: Column) -> Column:
    """The lines ``A. text`` behind the last line that is no option; letters may stand in any order."""
    lines = F.split(text, "\n")
    line = rf"^\s*([A-Z]){MARK}(\S.*)$"
    last = F.coalesce(F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(line), F.lit(-1)).otherwise(i)), lambda i: i >= 0)), F.lit(-1))
    tail = F.slice(lines, last + 2, F.size(lines))
    options = F.transform(tail, lambda x: _option(F.regexp_extract(x, line, 1), F.trim(F.regexp_extract(x, line, 2))))
    return _in_order(F.array_sort(options))


def listed(text: Column) -> Column:
    """``Options: A: text, B: text, ...`` behind the last ``Options:``; each label at its first place behind the one before."""
    tail = F.trim(F.regexp_extract(text, r"(?s)^.*Options:(.*)$", 1))
    pattern = r"(?s)^A: (.*?)(?:, B: (.*?)(?:, C: (.*?)(?:, D: (.*))?)?)?$"
    found = F.array(*(_option(F.lit(x), F.trim(F.regexp_extract(tail, pattern, k + 1))) for k, x in enumerate("ABCD")))
    shown = F.filter(found, lambda o: o["text"] != "")
    return F.when(F.contains(text, F.lit("Options:")) & tail.rlike(pattern), _in_order(shown))


def inline(text: Column) -> Column:
    """``A. text B. text ...`` in running text: the last markers that follow each other, five or else four of them."""

    def of(letters: str) -> Column:
        pattern = "(?s)^(.*)" + "".join(rf"{x}{MARK}(.*)" for x in letters) + "$"
        found = F.array(*(_option(F.lit(x), F.trim(F.regexp_extract(text, pattern, k + 2))) for k, x in enumerate(letters)))
        return F.when(text.rlike(pattern), _in_order(found, len(letters)))

    return F.coalesce(of(LETTERS), of(LETTERS[:4]))


def option_tail(text: Column) -> Column:
    """``Option: A:text; B:text;`` at the end of a question; options without a text are left out before the order is judged."""
    tail = F.regexp_extract(text, r"(?s)Options?:\s*((?:[A-Z]\s*:.*)?)$", 1)
    parts = F.filter(F.transform(F.split(tail, ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Z]\s*:\s*\S"))
    options = F.transform(parts, lambda x: _option(F.substring(x, 1, 1), F.trim(F.regexp_replace(x, r"^[A-Z]\s*:", ""))))
    return _in_order(options)


def bracketed(text: Column) -> Column:
    """The lines ``(A) text`` of a question; blank ones and those that say nan are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\([A-D]\) ?"))
    options = F.transform(lines, lambda x: _option(F.substring(x, 2, 1), F.trim(F.regexp_replace(x, r"^\([A-D]\) ?", ""))))
    kept = F.filter(options, lambda o: ~F.lower(o["text"]).isin("", "-", "nan", "none"))
    return F.when(F.size(lines) >= 2, kept)


def chosen(options: Column, answer: Column) -> tuple[Column, Column]:
    """Place of the answered option from 0, and why there is none: not parsed, several letters, or none of the options."""
    a = F.upper(F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\(?([A-Za-z])[).．]?\s*$", "$1")))
    labels = F.transform(options, lambda o: o["label"])
    at = F.array_position(labels, a) - 1
    several = F.length(F.regexp_replace(a, "[^A-Z]", "")) > 1
    reason = F.when(options.isNull(), "options_not_parsed").when(several, "multi_answer").when(at < 0, "answer_not_in_options")
    return F.when(reason.isNull(), at), reason
