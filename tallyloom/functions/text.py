"""Text functions: white space, numbers, answers, options, image numbers, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the Unicode standard as a class that Java and RE2 both read.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# How numbers are written.
NUMBER = r"^(-?)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(\.[0-9]+)?([eE][+-][0-9]+)?(%?)$"
# Colour words.
COLOURS = (
    "white", "black", "red", "blue", "green", "yellow", "brown", "gray", "grey", "orange", "pink", "purple", "silver", "tan", "beige", "gold", "maroon", "navy",
    "teal", "cream",
)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS + "+", " "))


def words(c: Column, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.filter(F.split(collapse(c), " "), lambda x: x != ""), 1, n), " ")


def plain_prompt(c: Column) -> Column:
    """Lower-case letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def question_line(c: Column) -> Column:
    """The first line."""
    return collapse(F.substring_index(F.ltrim(c), "\n", 1))


def clean_answer(c: Column) -> Column:
    """An answer without one period at its end."""
    return F.trim(F.regexp_replace(F.trim(c), r"\.$", ""))


def yes_no(c: Column) -> Column:
    """1 for yes, 0 for no, else null."""
    a = F.lower(clean_answer(c))
    return F.when(a == "yes", 1.0).when(a == "no", 0.0)


def is_number(c: Column) -> Column:
    """Whether a text is one number; a sign or a percent alone is none."""
    t = F.trim(c)
    return t.rlike(NUMBER) & t.rlike("[0-9]")


def number(c: Column) -> Column:
    """The number in a text, null if it is none."""
    return F.when(is_number(c), F.regexp_replace(F.trim(c), "[,%]", "").try_cast("double"))


def notation(c: Column) -> Column:
    """Which of sign, fraction, exponent and percent a number is written with."""
    part = lambda k: (F.regexp_extract(F.trim(c), NUMBER, k) != "").cast("int").cast("string")
    return F.when(is_number(c), F.concat(part(1), part(3), part(4), part(5)))


def number_parts(like: Column) -> tuple[Column, Column, Column, Column]:
    """Whole digits, fraction, exponent and percent of a number as it is written."""
    return tuple(F.regexp_extract(F.trim(like), NUMBER, k) for k in (2, 3, 4, 5))


def format_like(v: Column, like: tuple[Column, Column, Column, Column]) -> Column:
    """A number written like another, given by its parts: decimals, exponent, thousands, leading zeros, percent."""
    whole, frac, exp, pct = like
    rounded = F.bround(v, 0).cast("long")
    places = F.greatest(F.length(frac) - 1, F.lit(0)).cast("string")  # a format may be a column
    written = lambda kind: F.call_function("format_string", F.concat(F.lit("%."), places, F.lit(kind)), v)
    text = (
        F.when(exp != "", written("e"))
        .when(frac != "", written("f"))
        .when(F.contains(whole, F.lit(",")), F.format_number(rounded, 0))
        .when((F.length(whole) > 1) & F.startswith(whole, F.lit("0")) & (v >= 0), F.lpad(rounded.cast("string"), F.greatest(F.length(whole), F.length(rounded.cast("string"))), F.lit("0")))
        .otherwise(rounded.cast("string"))
    )
    return F.concat(text, pct)


def answer_kind(question: Column, answer: Column) -> Column:
    """number, color or text."""
    asks = F.lower(question).rlike("^what (is the )?colou?r")
    return F.when(is_number(answer), "number").when(asks | F.lower(answer).isin(*COLOURS), "color").otherwise("text")


def pool_keys(question: Column, answer: Column) -> Column:
    """From the most specific pool of answers to the widest: three words, two words, the kind."""
    w = F.regexp_extract_all(F.lower(question), F.lit("[a-z']+"), 0)
    kind = answer_kind(question, answer)
    return F.when(kind != "text", F.array(kind)).otherwise(F.array(F.array_join(F.slice(w, 1, 3), " "), F.array_join(F.slice(w, 1, 2), " "), kind))


def fix_exponent(c: Column) -> Column:
    """A number that lost the zero of its exponent, as in 1e+1 for 1e+10."""
    return F.regexp_replace(c, r"(e\+?)1$", "$110")


def inserted(options: Column, answer: Column, place: Column) -> Column:
    """The answer put among its distractors at a place from 0."""
    return F.concat(F.slice(options, F.lit(1), place), F.array(answer), F.slice(options, place + 1, F.size(options)))


def image_numbers(path: Column) -> Column:
    """Image numbers in a path: in the file name, or by the folder of the split."""
    named = F.regexp_extract(path, r"COCO_[A-Za-z]+[0-9]{4}_0*([0-9]+)[^/]*$", 1)
    placed = F.regexp_extract(path, r"(?:^|/)(?:train|val)[0-9]{4}/0*([0-9]+)[^/]*$", 1)
    return F.when(named != "", named).when(placed != "", placed).try_cast("long")


# How image numbers stand in the paths of held-out records, and in those of any record.
HELD_IMAGE = r"COCO_val20(?:14|17)_0*([0-9]+)"
ANY_IMAGE = (r"COCO_(?:train|val|test)20[0-9][0-9]_0*([0-9]+)", r"(?:train|val)20(?:14|17)[/\\]0*([0-9]+)\.")


def held_image_number(path: Column) -> Column:
    """The number of a held-out validation image in a path."""
    return F.nullif(F.regexp_extract(path, HELD_IMAGE, 1), F.lit("")).try_cast("long")


def any_image_number(path: Column) -> Column:
    """The number of an image in a path, by its file name or else by its folder."""
    return F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in ANY_IMAGE)).try_cast("long")


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct n-character pieces; a shorter text is its own piece."""
    def pieces(ch):  # the characters are split once, so a long text costs its length and not its square
        places = F.sequence(F.lit(1), F.greatest(F.size(ch) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.array_join(F.slice(ch, i, F.lit(n)), ""))

    chars = F.array(F.split(c, ""))
    return F.array_distinct(F.element_at(F.transform(chars, pieces), 1))


def minhash(pieces: Column, k: int = 16) -> Column:
    """k minima of seeded hashes of the pieces."""
    return F.array(*(F.array_min(F.transform(pieces, lambda p, s=s: F.xxhash64(F.lit(s), p))) for s in range(k)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of pieces in both out of pieces in either."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def data_url(c: Column) -> tuple[Column, Column]:
    """Media type and payload length of a data URL; null for other texts and for types that are no image."""
    mime = F.regexp_extract(c, r"^data:(image/(?:png|jpeg|webp|gif));base64,", 1)
    body = F.regexp_extract(c, r"(?s)^data:[^,]*,(.*)$", 1)
    ok = mime != ""
    return F.when(ok, mime), F.when(ok, F.length(F.unbase64(body)))


def report_number(c: Column, digits: int = 4) -> Column:
    """A figure with fixed digits, a dash for none."""
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", c))


def safe_name(c: Column) -> Column:
    """A file name of letters, digits and ``-_.``, at most 120 characters."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "_"), 1, 120)


def lettered(block: Column) -> Column:
    """Options of the lines ``A. text`` or ``(A) text``; null unless letters run from A without a gap."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*\(?[A-Z][.)]\s*\S"))
    letters = F.transform(lines, lambda x: F.regexp_extract(x, "([A-Z])", 1))
    want = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.char(F.lit(65) + i))
    texts = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\(?[A-Z][.)]\s*", "")))
    return F.when((F.size(lines) >= 2) & (letters == want) & (F.size(F.array_distinct(texts)) == F.size(texts)), texts)
