"""JSON objects out of free text: fenced, loose, whole or broken ones, by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfield.functions.clean import once

#: Fields that may hold picks, in order of precedence.
PICK_FIELDS = ["selected_horses", "predicted", "prediction"]
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FENCED_JSON = r"(?s)```json\s*(\{.*?\})\s*```"
OUTERMOST = r"(?s)(\{.*\})"
LOOSE = r'(?s)(\{[^{}]*"(?:selected_horses|predicted|prediction)"[^{}]*\})'
#: A string, or a comma with nothing but a closing bracket behind it.
STRING_OR_LAST_COMMA = r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])'
STATE = "struct<depth:int,text:boolean,escaped:boolean,start:int,end:int,at:int>"


def stripped(text: Column) -> Column:
    """The text without white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def valid_object(text: Column) -> Column:
    """The text if it is one JSON object and nothing else, else null.

    The parser alone would stop at the end of a first value. Within brackets as well as within
    braces, nothing can follow the object that both of them allow.
    """

    def whole(text: Column) -> Column:
        parsed = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
        alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
        return F.when(parsed & alone, text)

    return once(text, whole)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def balanced(text: Column) -> Column:
    """From the first opening brace to the one that closes it, braces in strings not counted; null if none does.

    One pass over the characters with a state of six numbers.
    """

    def step(s: Column, c: Column) -> Column:
        inside, done = s["depth"] > 0, s["end"] > 0
        plain = ~s["text"]
        quote = inside & (c == '"') & ~s["escaped"]
        opened, closed = plain & (c == "{"), plain & inside & (c == "}")
        depth = s["depth"] + F.when(opened, 1).when(closed, -1).otherwise(0)
        return F.when(done, s).otherwise(
            F.struct(
                depth.alias("depth"),
                F.when(quote, plain).otherwise(s["text"]).alias("text"),
                (s["text"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
                F.when(opened & ~inside, s["at"]).otherwise(s["start"]).alias("start"),
                F.when(closed & (depth == 0), s["at"]).otherwise(0).alias("end"),
                (s["at"] + 1).alias("at"),
            )
        )

    begin = F.struct(F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.lit(1)).cast(STATE)
    last = F.aggregate(F.split(text, ""), begin, step, lambda s: F.struct(s["start"], s["end"]))
    return once(last, lambda at: F.when(at["end"] > 0, F.substring(text, at["start"], at["end"] - at["start"] + 1)))


def repaired(text: Column) -> Column:
    """Text without commas before a closing bracket; strings stay as they are."""
    return F.regexp_replace(text, STRING_OR_LAST_COMMA, "$1")


def answer_object(text: Column) -> Column:
    """The object of a reply: the first one fenced as json, else from the first brace to the last; null where these are no objects."""
    return F.coalesce(valid_object(_found(text, FENCED_JSON)), valid_object(_found(text, OUTERMOST)))


def prediction_object(text: Column) -> Column:
    """The object of a prediction: the whole text, the first fenced object, or the first flat one that names picks."""
    return F.coalesce(valid_object(stripped(text)), valid_object(_found(text, FENCED)), valid_object(_found(text, LOOSE)))


def any_object(text: Column) -> Column:
    """The object of a prediction or of a reply, else the first whole one in the text, as it stands or repaired."""
    return F.coalesce(prediction_object(text), answer_object(text), mended_object(text))


def mended_object(text: Column) -> Column:
    """The first whole object in the text, as it stands or repaired, else in the repaired text."""
    inner = once(balanced(text), lambda whole: F.coalesce(valid_object(whole), valid_object(repaired(whole))))
    return F.coalesce(inner, valid_object(balanced(repaired(text))))


def picks(document: Column) -> Column:
    """The picks of an object as texts: numbers of selected entries, else the list of predicted, else of prediction; null if none is given."""
    listed = [F.from_json(F.get_json_object(document, f"$.{field}"), "array<string>") for field in PICK_FIELDS]
    numbers = F.transform(listed[0], lambda x: F.coalesce(F.get_json_object(x, "$.chulNo"), x))
    return F.coalesce(numbers, *listed[1:])
