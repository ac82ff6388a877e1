"""Response envelopes to rows: items, keys of the event, typed details, field lineage and results.

An envelope is a text column (JSON, or XML if it begins with <). Everything is expressions on
columns, so an envelope is parsed where it is scanned and rows leave by ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfield.functions import clean
from rankfield.sources.documents import items

# Names of places, and names of fields that the general rule would not give.
MEETS = {"서울": 1, "제주": 2, "부산": 3, "부경": 3, "부산경남": 3}
INNER_NAMES = {"rcDate": "race_date", "rcNo": "race_no", "rcName": "race_name", "rcDist": "race_distance", "rcTime": "race_time", "wgBudam": "weight"}
OUTER_NAMES = {inner: outer for outer, inner in INNER_NAMES.items()}
DETAILS = ["hrDetail", "jkDetail", "trDetail", "jkStats", "owDetail", "training"]

ITEM = (
    "struct<chulNo:string,hrNo:string,hrName:string,jkNo:string,jkName:string,trNo:string,trName:string,owNo:string,rcDate:string,rcNo:string,"
    "meet:string,wgBudam:string,winOdds:string,plcOdds:string,rating:string,ord:string,rank:string,"
    "win_rate_t:string,place_rate_t:string,rc_cnt_t:string,win_cnt_t:string,place_cnt_t:string,recent_form:string>"
)


def all_items(payload: Column) -> Column:
    """Every item of the envelope as ITEM; an empty array where a level is missing."""
    return items(payload, ITEM)


def first_item(payload: Column) -> Column:
    """The first item, null if there is none."""
    return F.get(all_items(payload), F.lit(0))


def error_message(payload: Column) -> Column:
    """The header's message, or what stands for a missing one."""
    header = F.get_json_object(payload, "$.response.header")
    message = F.coalesce(F.get_json_object(payload, "$.response.header.resultMessage"), F.lit("Unknown error"))
    return F.when(F.coalesce(clean.text(payload), F.lit("{}")) == "{}", "Empty API response").when(header.isNotNull(), message).otherwise("Failed to parse error message")


def meet_code(c: Column) -> Column:
    """A place by name or positive number."""
    return F.coalesce(clean.coded(clean.text(c), MEETS).cast("int"), clean.positive(clean.whole(c)))


def event_keys(item: Column) -> Column:
    """Struct (race_date, race_no, meet) of an item; what cannot be read is null."""
    return F.struct(
        _date(item["rcDate"]).alias("race_date"),
        clean.whole(item["rcNo"]).alias("race_no"),
        meet_code(item["meet"]).alias("meet"),
    )


def _date(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(F.length(digits) == 8, digits)


def merged_keys(parsed: Column, race_date: Column, race_no: Column, meet: Column) -> Column:
    """Keys as parsed, and as asked for where parsing gave none."""
    return F.struct(
        F.coalesce(parsed["race_date"], _date(race_date)).alias("race_date"),
        F.coalesce(parsed["race_no"], clean.whole(race_no)).alias("race_no"),
        F.coalesce(parsed["meet"], meet_code(meet)).alias("meet"),
    )


def matching_items(found: Column, race_no: Column, race_date: Column, meet: Column) -> Column:
    """Items whose keys equal those asked for; a null key asks for nothing."""

    def fits(item: Column) -> Column:
        keys = event_keys(item)
        wanted = {"race_no": clean.whole(race_no), "race_date": _date(race_date), "meet": meet_code(meet)}
        asked = {"race_no": race_no, "race_date": race_date, "meet": meet}
        tests = [asked[k].isNull() | wanted[k].isNull() & F.lit(k == "race_no") | keys[k].eqNullSafe(wanted[k]) for k in wanted]
        return tests[0] & tests[1] & tests[2]

    return F.filter(found, fits)


def target_item(found: Column, race_no: Column, race_date: Column, meet: Column) -> Column:
    """The first matching item where an event number is asked for, else (or without a match) the first of all."""
    return F.coalesce(F.when(race_no.isNotNull(), F.get(matching_items(found, race_no, race_date, meet), F.lit(0))), F.get(found, F.lit(0)))


def cancelled_items(found: Column, race_no: Column, race_date: Column, meet: Column) -> Column:
    """Matching items, all items where no event number is asked for."""
    return F.when(race_no.isNull(), found).otherwise(matching_items(found, race_no, race_date, meet))


def ordered_entries(found: Column) -> Column:
    """Items by entry number, those without one last, otherwise in their order."""
    numbered = F.transform(found, lambda item, i: F.struct(item["chulNo"].isNull().alias("last"), F.coalesce(clean.whole(item["chulNo"]), F.lit(0)).alias("no"), i.alias("i"), item.alias("item")))
    return F.transform(F.array_sort(numbered), lambda x: x["item"])


def entry_rows(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, <ITEM under inner names>) of every item, as one lateral unnest."""
    return rows.select(key, F.posexplode(ordered_entries(all_items(F.col(payload)))).alias("pos", "item")).select(key, "pos", F.col("item").cast(renamed(_parsed(ITEM), inner_name)).alias("item")).select(key, "pos", "item.*")


def _parsed(schema: str) -> T.DataType:
    return T._parse_datatype_string(schema)


def _camel_to_snake(name: str) -> str:
    out = []
    for i, c in enumerate(name):
        after = name[i + 1] if i + 1 < len(name) else ""
        if c.isupper() and i and (not name[i - 1].isupper() or after.islower()):
            out.append("_")
        out.append(c.lower())
    return "".join(out)


def inner_name(name: str) -> str:
    """The snake_case name of an outer field."""
    return INNER_NAMES.get(name, _camel_to_snake(name))


def outer_name(name: str) -> str:
    """The camelCase name of an inner field."""
    head, *tail = name.split("_")
    return OUTER_NAMES.get(name, head + "".join(part.title() for part in tail))


def renamed(kind: T.DataType, rule) -> T.DataType:
    """``kind`` with every field of every struct, at any depth, under its new name; a cast to it renames."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rule(f.name), renamed(f.dataType, rule), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(renamed(kind.elementType, rule), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, renamed(kind.valueType, rule), True)
    return kind


def renamed_columns(rows: DataFrame, rule) -> DataFrame:
    """``rows`` with all columns and all fields inside them under new names."""
    return rows.select(*[F.col(f"`{f.name}`").cast(renamed(f.dataType, rule)).alias(rule(f.name)) for f in rows.schema.fields])


def flattened(rows: DataFrame, separator: str = ".") -> DataFrame:
    """``rows`` with the fields of structs, at any depth, as columns of joined names."""

    def leaves(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in leaves(column[f.name], f.dataType, f"{name}{separator}{f.name}")]
        return [column.alias(name)]

    return rows.select(*[leaf for f in rows.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def nested(rows: DataFrame, separator: str = ".") -> DataFrame:
    """The inverse of ``flattened``: columns of joined names as fields of structs, in the order of their first column."""
    tree: dict = {}
    for name in rows.columns:
        *path, leaf = name.split(separator)
        node = tree
        for part in path:
            node = node.setdefault(part, {})
        node[leaf] = F.col(f"`{name}`")
    built = lambda node: F.struct(*[built(x).alias(n) for n, x in node.items()]) if isinstance(node, dict) else node
    return rows.select(*[built(x).alias(n) for n, x in tree.items()])


def _or_zero(c: Column, kind: str) -> Column:
    return F.coalesce(clean.number(c).cast(kind), F.lit(0).cast(kind))


def first_items(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, item): the first item of each envelope that has one; an envelope is parsed once, whatever is read from its item."""
    return rows.select(key, F.explode(F.slice(all_items(F.col(payload)), 1, 1)).alias("item")).filter("item IS NOT NULL")


def horse_info(payload: Column) -> Column:
    """``horse_detail`` of the first item; null without items."""
    return clean.once(first_item(payload), horse_detail)


def person_info(payload: Column, kind: str) -> Column:
    """``person_detail`` of the first item; null without items."""
    return clean.once(first_item(payload), lambda item: person_detail(item, kind))


def horse_detail(item: Column) -> Column:
    """Typed detail of a horse, with the item kept. Numbers that cannot be read are 0."""
    return F.when(
        item.isNotNull(),
        F.struct(item["hrNo"].alias("hr_no"), item["hrName"].alias("hr_name"), _or_zero(item["win_rate_t"], "double").alias("win_rate"), _or_zero(item["place_rate_t"], "double").alias("place_rate"), item["recent_form"].alias("recent_form"), item.alias("raw_data")),
    )


def person_detail(item: Column, kind: str) -> Column:
    """Typed detail of a jockey (``jk``) or trainer (``tr``), likewise."""
    counts = {"race_count": "rc_cnt_t", "win_count": "win_cnt_t", "place_count": "place_cnt_t"}
    return F.when(
        item.isNotNull(),
        F.struct(
            item[f"{kind}No"].alias(f"{kind}_no"),
            item[f"{kind}Name"].alias(f"{kind}_name"),
            _or_zero(item["win_rate_t"], "double").alias("win_rate"),
            *[_or_zero(item[c], "int").alias(n) for n, c in counts.items()],
            item.alias("raw_data"),
        ),
    )


def join_value(item: Column, join_key: str) -> Column:
    """The value of a join key: a name as trimmed text, a number as an integer's text, others as identifiers."""
    if join_key == "hrName":
        return clean.text(item["hrName"])
    if join_key in ("chulNo", "rcNo"):
        return clean.whole(item[join_key]).cast("string")
    return clean.identifier(item[join_key])


def detail_rows(rows: DataFrame, key: str, payload: str, *join_keys: str) -> DataFrame:
    """(key, join_key, join_value, value) of every item of a detail response, for each join key; responses are read and parsed once for all."""
    item = F.col("item")
    joins = F.array(*[F.struct(F.lit(k).alias("join_key"), join_value(item, k).alias("join_value")) for k in join_keys])
    found = rows.select(key, F.explode(all_items(F.col(payload))).alias("item")).select(key, F.inline(joins), "item")
    return found.select(key, "join_key", "join_value", item.cast(renamed(_parsed(ITEM), inner_name)).alias("value"))


def field_records(rows: DataFrame, key: str, payload: str, fields: list[str], required: list[str]) -> DataFrame:
    """Field-level lineage of a card: (key, source_field, schema_path, join_value, value) by an unpivot of the items.

    A missing value is a record only where the field is required.
    """
    item = F.col("item")
    records = F.array(
        *[F.struct(F.lit(f).alias("source_field"), F.lit(f"horses[].{inner_name(f)}").alias("schema_path"), clean.whole(item["chulNo"]).alias("join_value"), item[f].alias("value"), F.lit(f in required).alias("required")) for f in fields]
    )
    return rows.select(key, F.explode(all_items(F.col(payload))).alias("item")).select(key, F.inline(records)).filter("value IS NOT NULL OR required").drop("required")


def with_details(entries: DataFrame, details: DataFrame, key: str, blocks: list[str]) -> DataFrame:
    """Items with the detail blocks of their entry number; items without a number, or without details, keep nulls."""
    return entries.join(details.select(key, "chul_no", *blocks), [key, "chul_no"], "left")


HORSE = "struct<ord:string,position:string,chulNo:string,hr_no:string,hrNo:string,hrName:string,hr_name:string,win_odds:string,winOdds:string,odds:string,rating:string,weight:string>"


def _truthy(c: Column) -> Column:
    """Null for blank text and zero, so that the next alias is asked."""
    return F.when(~F.coalesce(clean.number(c) == 0, F.lit(False)), clean.text(c))


def placed(horse: Column, place: Column) -> Column:
    """One placed entry of a result: ord, chulNo, hr_no, hr_name, win_odds, rating, weight."""
    number = F.coalesce(_truthy(horse["hr_no"]), _truthy(horse["hrNo"]), _truthy(horse["chulNo"]))
    return F.struct(
        _or_zero(F.coalesce(_truthy(horse["ord"]), _truthy(horse["position"]), place.cast("string")), "int").alias("ord"),
        _or_zero(number, "int").alias("chulNo"),
        number.alias("hr_no"),
        F.coalesce(clean.text(horse["hrName"]), clean.text(horse["hr_name"])).alias("hr_name"),
        _or_zero(F.coalesce(_truthy(horse["win_odds"]), _truthy(horse["winOdds"]), _truthy(horse["odds"])), "double").alias("win_odds"),
        _or_zero(horse["rating"], "int").alias("rating"),
        _or_zero(horse["weight"], "double").alias("weight"),
    )


def result_horses(document: Column) -> Column:
    """The horses of a result in any of its shapes (list of numbers, {top3, horses}, {result}) as one contract; empty if there are none."""

    def shape(doc: Column, deeper: bool) -> Column:
        numbers = F.when(F.ltrim(doc).startswith("["), F.from_json(doc, "array<string>"))
        of_list = F.transform(F.filter(numbers, lambda x: clean.text(x).isNotNull()), lambda x, i: placed(F.named_struct(*_lone(x)), i + 1))
        listed = F.from_json(F.get_json_object(doc, "$.horses"), f"array<{HORSE}>")
        has = F.get_json_object(doc, "$.horses").isNotNull() | F.get_json_object(doc, "$.top3").isNotNull()
        of_horses = F.when(has, F.coalesce(F.transform(listed, lambda h, i: placed(h, i + 1)), F.array().cast(PLACED)))
        inner = F.get_json_object(doc, "$.result")
        return F.coalesce(of_list, of_horses, *([shape(inner, False)] if deeper else []))

    return F.coalesce(shape(document, True), F.array().cast(PLACED))


PLACED = "array<struct<ord:int,chulNo:int,hr_no:string,hr_name:string,win_odds:double,rating:int,weight:double>>"


def _lone(number: Column) -> list[Column]:
    names = [f.name for f in _parsed(HORSE).fields]
    return [part for n in names for part in (F.lit(n), number if n == "chulNo" else F.lit(None).cast("string"))]


def collected_top3(found: Column) -> Column:
    """Entry numbers of the first three places by finishing order; null with fewer than three finishers."""
    finished = F.filter(found, lambda x: F.coalesce(clean.whole(x["ord"]) > 0, F.lit(False)))
    keyed = F.array_sort(F.transform(finished, lambda x, i: F.struct(clean.whole(x["ord"]).alias("ord"), i.alias("i"), clean.whole(x["chulNo"]).alias("no"))))
    return clean.once(keyed, lambda k: F.when(F.size(k) >= 3, F.transform(F.slice(k, 1, 3), lambda x: x["no"])))


def projected_result(top3: Column, found: Column) -> Column:
    """The places of a result with odds and rating of the first item of that number; zeros without one."""

    def of(number: Column, place: Column) -> Column:
        item = F.get(F.filter(found, lambda x: clean.whole(x["chulNo"]) == number), F.lit(0))
        return clean.once(
            item,
            lambda item: F.struct(
                (place + 1).alias("ord"),
                number.alias("chulNo"),
                item["hrName"].alias("hr_name"),
                _or_zero(item["winOdds"], "double").alias("win_odds"),
                _or_zero(item["rating"], "int").alias("rating"),
            ),
        )

    return F.transform(top3, of)
