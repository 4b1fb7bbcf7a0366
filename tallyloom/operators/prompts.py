"""Requests and answers: states as text, prompts, answer parsing and shaping."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V

STEP = "  "


class _Members(list):
    """Members of a JSON object as written."""


_decode = json.JSONDecoder(object_pairs_hook=_Members).decode


def _scalar_text(x) -> str:
    """A scalar, or an empty container, as it stands in a prompt."""
    if isinstance(x, str):
        return x
    if isinstance(x, _Members):
        return "{}"
    return json.dumps(x, ensure_ascii=False)


def state_text(state_json: str | None, pictured_by: tuple[str, ...] = ("url",)) -> str | None:
    """A JSON state as indented lines: ``key: value``, ``1. value``, a slot ``[image]`` for each image.

    An image is an object under ``image`` with one of the members ``pictured_by`` as a string. Null stays null and an
    unreadable state stands as it is. No line ends stand behind the last line.
    """
    if state_json is None:
        return None
    try:
        state = _decode(state_json)
    except (ValueError, RecursionError):
        return state_json
    if isinstance(state, str):
        return state.rstrip("\n")
    lines: list[str] = []
    work: list[tuple] = [("", state, 0, True)]
    while work:
        lead, x, depth, alone = work.pop()
        pad = STEP * depth
        if isinstance(x, (_Members, list)) and len(x):
            if not alone:
                lines.append(pad + lead)
            inner = depth if alone else depth + 1
            named = [(f"{k}:", v, k) for k, v in x] if isinstance(x, _Members) else [(f"{i}.", v, None) for i, v in enumerate(x, 1)]
            for head, v, key in reversed(named):
                picture = key == "image" and isinstance(v, _Members) and any(k in pictured_by and isinstance(u, str) for k, u in v)
                work.append(("[image]", "", inner, False) if picture else (head, v, inner, False))
            continue
        text = _scalar_text(x)
        if "\n" in text:
            lines.append(pad + lead)
            lines.extend(STEP * (depth + 1) + t for t in text.split("\n"))
        elif lead == "[image]":
            lines.append(pad + lead)
        else:
            lines.append(pad + (f"{lead} {text}" if lead else text))
    return "\n".join(lines).rstrip("\n")


def with_state_text(records: DataFrame, column: str = "state_json", name: str = "state_text") -> DataFrame:
    """One more column: the state as a request shows it; the pictures of a path are sent as URLs."""

    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        return s.map(lambda x: state_text(x, ("url", "path")), na_action="ignore")

    return records.withColumn(name, render(F.col(column)))


def letter(i: Column) -> Column:
    """A..Z, then AA, AB, ..."""
    one = lambda k: F.char(F.lit(65) + k)
    return F.when(i < 26, one(i)).otherwise(F.concat(one(F.floor((i - 26) / 26)), one((i - 26) % 26)))


def question_prompt(q: Column) -> Column:
    """The question with its options and the wanted form of the answer."""
    options = F.transform(F.coalesce(q["criteria"], F.array()), lambda c, i: F.concat(letter(i), F.lit(". "), c["label"], F.when(F.coalesce(c["desc"], F.lit("")) != "", F.concat(F.lit(" - "), c["desc"])).otherwise("")))
    levels = F.transform(F.coalesce(q["criteria"], F.array()), lambda c, i: F.rtrim(F.concat(i.cast("string"), F.lit(". "), F.coalesce(c["desc"], F.lit("")))))
    meaning = lambda label: F.try_element_at(F.filter(F.coalesce(q["criteria"], F.array()), lambda c: c["label"] == label), F.lit(1))["desc"]
    choice = F.concat(F.lit("Options:\n"), F.array_join(options, "\n"), F.lit("\n\nAnswer with the letter of the single best option."))
    score = F.concat(F.lit("Scale, from lowest (0) to highest ("), (F.size(q["criteria"]) - 1).cast("string"), F.lit("):\n"), F.array_join(levels, "\n"), F.lit("\n\nAnswer with the level number only."))
    yes = F.array_join(F.array(F.lit("Answer Yes or No."), F.concat(F.lit("Yes means: "), meaning("true")), F.concat(F.lit("No means: "), meaning("false"))), "\n")
    form = F.when(q["type"] == "choice", choice).when(q["type"] == "score", score).otherwise(yes)
    asked = F.trim(F.coalesce(q["instructions"], F.lit("")))
    return F.concat(F.when(asked != "", F.concat(F.lit("Question: "), asked, F.lit("\n\n"))).otherwise(""), form)


def safe(text: Column) -> Column:
    """Text in which the marks of special tokens are broken."""
    return F.regexp_replace(text, r"<\|([^|<>]*)\|>", "<¦$1¦>")


# The instruction of the system, and what stands before a state.
SYSTEM = "You are a careful judge. Read the state, then answer the question about it. Reply with only the answer token, nothing else."
STATE, AGAIN = "State:\n", "\n\nState (repeated):\n"


def layout(pictured: Column, questions: Column, state_tokens: Column, longest: Column, image_read: str = "twice", read_twice: str = "state", most_twice: int = 3000, most: int = 32_768) -> Column:
    """How a state is read: a request with pictures and one question by ``image_read`` (twice, qfirst), a short text state
    by ``read_twice`` (state, full), any other once. A request that only the layout makes too long is read once.

    ``longest`` is the number of tokens of the longest question.
    """
    by_image = F.when(pictured & (questions == 1) & F.lit(bool(image_read)), F.lit(f"image_{image_read}"))
    by_text = F.when(~pictured & (state_tokens <= most_twice) & F.lit(bool(read_twice)), F.lit({"state": "state_twice", "full": "full"}.get(read_twice, "once")))
    chosen = F.coalesce(by_image, by_text, F.lit("once"))
    repeats = chosen.isin("image_twice", "state_twice", "full")
    written = F.when(repeats, state_tokens * 2).otherwise(state_tokens) + F.when(chosen.isin("image_twice", "full"), longest * 2).otherwise(longest)
    return F.when((chosen != "once") & (written > most), "once").otherwise(chosen)


def messages(state: Column, q: Column, how: Column) -> Column:
    """The two messages of a request: the system's, and the state and question in one of the layouts."""
    asked = F.trim(F.coalesce(q["instructions"], F.lit("")))
    first = F.when(asked != "", F.concat(F.lit("Question: "), asked)).otherwise("")
    between = F.when(asked != "", F.concat(F.lit("\n\n"), first)).otherwise("")
    lead = F.when((how == "image_qfirst") & (asked != ""), F.concat(first, F.lit("\n\n"))).otherwise("")
    middle = F.when(how.isin("image_twice", "full"), between).otherwise("")
    again = F.when(how.isin("image_twice", "full", "state_twice"), F.concat(F.lit(AGAIN), state)).otherwise("")
    user = F.concat(lead, F.lit(STATE), state, middle, again, F.lit("\n\n"), question_prompt(q))
    return F.struct(F.lit(SYSTEM).alias("system"), user.alias("user"))


def shaped(rows: DataFrame) -> DataFrame:
    """Answers in their public form: the value, its confidence and the probabilities as JSON in option order."""
    best = V.argmax(F.col("pred"))
    pairs = F.transform(F.arrays_zip("labels", "pred"), lambda z: F.concat(F.lit('"'), z["labels"], F.lit('":'), F.format_string("%.6f", z["pred"])))
    value = F.when(F.col("qtype") == "noul", F.format_string("%.6f", F.element_at("pred", 1))).when(F.col("qtype") == "choice", F.element_at("labels", best + 1)).otherwise(F.format_string("%.6f", V.expectation(F.col("pred"))))
    return rows.select("answer_id", "qtype", value.alias("value"), F.round(V.confidence(F.col("pred"), F.col("qtype")), 9).alias("confidence"), F.when(F.col("qtype") != "noul", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).alias("probabilities"))


def answer_faults(rows: DataFrame) -> DataFrame:
    """Why an answer cannot be read, null if it can: missing, wrong length, outside 0 to 1, options that differ."""
    size, options = F.size("pred"), F.size("labels")
    fault = (
        F.when(F.col("pred").isNull(), "missing")
        .when(size != options, "length")
        .when(F.exists("pred", lambda p: p.isNull() | (p < 0) | (p > 1)), "range")
        .when((F.col("qtype") == "noul") & (F.col("labels") != F.array(F.lit("true"), F.lit("false"))), "options")
        .when((F.col("qtype") == "score") & (F.col("labels") != F.transform(F.sequence(F.lit(0), options - 1), lambda i: i.cast("string"))), "options")
    )
    return rows.withColumn("fault", fault)


def jobs(records: DataFrame, one_per_request: bool = False) -> DataFrame:
    """Requests of an evaluation run: the record, whole or by question, and the perturbed forms that apply to it.

    One request a record asks all questions in the reversed order of options if any has an order, one asks the negated
    questions, one repeats it and one shakes its pictures; each question is asked alone where there are others.
    """
    q = F.col("questions")
    n = F.coalesce(F.size(q), F.lit(0))
    has = lambda cond: F.exists(F.coalesce(q, F.array()), cond)
    parts = n > 1 if one_per_request else F.lit(False)
    whole = F.array(
        F.when(~parts, F.lit("main")), F.lit("repeat"), F.when(has(lambda x: x["type"].isin("choice", "score")), F.lit("order")),
        F.when(has(lambda x: x["negated"].isNotNull()), F.lit("negation")), F.when(F.coalesce(F.size("images"), F.lit(0)) > 0, F.lit("jitter")),
    )
    each = F.array(F.when(parts, F.lit("main_part")), F.when(n > 1, F.lit("separate")))
    by_record = records.select("rec_key", F.explode(F.array_compact(whole)).alias("kind"), F.lit(None).cast("string").alias("qname"))
    alone = records.select("rec_key", F.array_compact(each).alias("kinds"), F.explode("questions").alias("q"))
    alone = alone.select("rec_key", F.explode("kinds").alias("kind"), F.col("q.name").alias("qname"))
    return by_record.unionByName(alone)


def bare(q: DataFrame) -> DataFrame:
    """Questions without help: choices keep labels only, yes/no loses its meanings, scores are left out; even targets."""
    kept = q.where("type <> 'score'")
    labels = F.when(F.col("type") == "choice", F.transform("criteria", lambda c: c["label"]))
    k = F.when(F.col("type") == "choice", F.size("criteria")).otherwise(2)
    return kept.select("rec_key", "name", "type", F.array_join(labels, "|").alias("labels"), F.round(1.0 / k, 6).alias("even"))


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_OPENS = re.compile(r"[ \t\r\n]*:[ \t\r\n]*(?=\{)")


def without_images(state_json: str) -> str:
    """A state as written, with ``"[image omitted]"`` for each object under ``image`` that has a path or a URL."""
    out, at, kept = [], 0, 0
    while m := _STRING.search(state_json, at):
        at = m.end()
        opens = _OPENS.match(state_json, at) if m[0] == '"image"' else None
        if not opens:
            continue
        try:
            value, end = json.JSONDecoder().raw_decode(state_json, opens.end())
        except (ValueError, RecursionError):
            continue
        if "path" in value or "url" in value:
            out += [state_json[kept : opens.end()], '"[image omitted]"']
            at = kept = end
    return "".join(out) + state_json[kept:]


def strip_images(state_json: Column) -> Column:
    """A state without its pictures, for a blind baseline; null stays null, and what is no JSON keeps what is unreadable."""

    @F.pandas_udf("string")
    def run(states: pd.Series) -> pd.Series:
        return states.map(without_images, na_action="ignore")

    return run(state_json)
