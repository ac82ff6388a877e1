"""Evaluation over windows, published packs, answers out of free text, leaked result fields."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions import freetext as X
from rankfield.operators import leakage as K
from rankfield.operators import windows as S
from rankfield.plans.analogue import ENTRIES_SQL, entries, events
from rankfield.plans.models import FEATURES, training_rows
from rankfield.plans.prediction import FINISHED_SQL, finished
from rankfield.plans.registry import query
from rankfield.sources import packs as B
from rankfield.sources.staging import shared_folder, staged

#: The primary split and the windows that roll behind it.
SPANS = [
    S.Span("dev", "1996-06-30", None, "1997-06-30"),
    S.Span("test", "1996-06-30", "1997-07-01"),
    S.Span("roll-1", "1996-12-31", "1997-01-01", "1997-06-30"),
    S.Span("roll-2", "1997-06-30", "1997-07-01", "1997-12-31"),
    S.Span("roll-3", "1997-12-31", "1998-01-01"),
]


@query()
def window_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for every window on one staged feature table: rates of each, and the robust, blended, rolling and overfit-safe ones. Runs when planned."""
    rows = staged(training_rows(spark, sf_dir), "training-rows")
    rates = staged(S.span_rates(S.predicted_spans(rows, FEATURES, SPANS)), "span-rates")
    names = ["robust", "blended", "rolling_min", "rolling_mean", "overfit_safe"]
    sums = S.overfit_safe(rates, "dev", "test").select(F.inline(F.array(*[F.struct(F.lit(n).alias("span"), F.col(n).alias("exact_rate")) for n in names])))
    return rates.select("span", "races", "incomplete", F.round("exact_rate", 6).alias("exact_rate"), F.round("set_match", 6).alias("set_match")).unionByName(sums, allowMissingColumns=True)


REFERENCE = "1997-01-01"


@query(
    "WITH "
    + FINISHED_SQL
    + f""", e AS (SELECT race_id, race_date, meet, status FROM events_v WHERE race_date <= DATE '{REFERENCE}'),
        h AS (SELECT horse_id, arg_max([race_id::BIGINT, entry_no::BIGINT], [(race_date - DATE '1970-01-01')::BIGINT, race_id::BIGINT, entry_no::BIGINT]) AS last, max(race_date) AS race_date FROM finished_v WHERE race_date <= DATE '{REFERENCE}' GROUP BY 1),
        a AS (SELECT f.race_id, f.entry_no, f.place FROM finished_v f JOIN e USING (race_id) WHERE place <= 3),
        d AS (
            SELECT 'answers' AS name, concat_ws('|', race_id, entry_no, place) AS said FROM a
            UNION ALL SELECT 'events', concat_ws('|', race_id, race_date, meet, status) FROM e
            UNION ALL SELECT 'horses', concat_ws('|', horse_id, race_date, last[1], last[2]) FROM h)
        SELECT name, count(*) AS rows, sum(('0x' || substr(md5(said), 1, 12))::BIGINT)::VARCHAR AS digest, true AS same FROM d GROUP BY 1"""
)
def snapshot_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known on a day, as a pack: written, published, read back and held against its manifest. Runs when planned."""
    day = F.to_date(F.lit(REFERENCE))
    rows = staged(finished(spark, sf_dir).select("race_id", "race_date", "horse_id", "entry_no", "place"), "finished")
    known = events(spark, sf_dir).filter(F.col("race_date") <= day).select("race_id", "race_date", "meet", "status")
    horses = B.as_of(rows.select("horse_id", "race_date", "race_id", "entry_no"), ["horse_id"], "race_date", day)
    answers = rows.filter((F.col("race_date") <= day) & (F.col("place") <= 3)).select("race_id", "entry_no", "place")
    target = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    B.write_pack({"events": known, "horses": horses, "answers": answers}, target, {"reference": REFERENCE}, "first")
    pack = B.read_pack(spark, target, check=False)
    return B.verified(pack.manifest, pack.tables)


_TEXT = """CASE race_id % 10
    WHEN 0 THEN concat('{"predicted":[', a, ',', b, ',', c, '],"confidence":70}')
    WHEN 1 THEN concat('My picks, with reasons {see below}: ```json {"selected_horses":[{"chulNo":', a, '},{"chulNo":', b, '},{"chulNo":', c, '}]} ``` Good luck.')
    WHEN 2 THEN concat('Sure. {"note":"a } in \\\\" text {","selected_horses":[{"chulNo":', c, ',"hrName":"x"},{"chulNo":', a, '}]} and no more')
    WHEN 3 THEN concat('{"prediction":["', b, '","', c, '",],"note":"keep ,] this",}')
    WHEN 4 THEN concat('{"predicted":[', a, ',', b)
    WHEN 5 THEN concat('First {"predicted":[', a, ',', b, '],} then {"predicted":[', c, ']}')
    WHEN 6 THEN concat('I like ', a, ', then ', b)
    WHEN 7 THEN concat('Result {"confidence":1} or ``` {"prediction":[', c, ',', b, ']} ```')
    WHEN 8 THEN concat('x {"predicted":[', b, ',', a, ']} y {"other":{"z":1}} {')
    END"""


@query(
    "WITH "
    + ENTRIES_SQL
    + """, m AS (SELECT race_id, arg_min(entry_no, horse_id * 10 + entry_no)::VARCHAR AS a, arg_max(entry_no, horse_id * 10 + entry_no)::VARCHAR AS b, count(*)::VARCHAR AS c FROM entries_v GROUP BY 1)
        SELECT race_id, CASE race_id % 10 WHEN 0 THEN a || ',' || b || ',' || c WHEN 1 THEN a || ',' || b || ',' || c WHEN 2 THEN c || ',' || a WHEN 3 THEN b || ',' || c WHEN 5 THEN a || ',' || b WHEN 7 THEN c || ',' || b WHEN 8 THEN b || ',' || a END AS picks,
            CASE WHEN race_id % 10 IN (0, 1, 7, 8) THEN 'prediction' WHEN race_id % 10 = 2 THEN 'reply' WHEN race_id % 10 IN (3, 5) THEN 'repaired' ELSE 'none' END AS kind FROM m"""
)
def free_text_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks in answers of ten shapes: whole, fenced, nested, loose, broken, cut off and absent objects."""
    order = F.col("horse_id") * 10 + F.col("entry_no")
    cards = entries(spark, sf_dir).groupBy("race_id").agg(F.min_by("entry_no", order).alias("a"), F.max_by("entry_no", order).alias("b"), F.count(F.lit(1)).alias("c"))
    rows = cards.select("race_id", F.expr(_TEXT).alias("text"))
    found = rows.select("race_id", X.prediction_object("text").alias("prediction"), X.answer_object("text").alias("reply"), "text")
    found = found.select("race_id", "prediction", "reply", F.coalesce("prediction", "reply", X.mended_object(F.col("text"))).alias("any"))
    kind = F.when(F.col("prediction").isNotNull(), "prediction").when(F.col("reply").isNotNull(), "reply").when(F.col("any").isNotNull(), "repaired").otherwise("none")
    return found.select("race_id", F.array_join(X.picks(F.col("any")), ",").alias("picks"), kind.alias("kind"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY entry_no) - 1 AS i FROM entries_v),
        l AS (
            SELECT race_id, 'horses[' || i || '].rank' AS path FROM n WHERE horse_id % 11 = 0
            UNION ALL SELECT race_id, 'horses[' || i || '].detail.sjG' || (horse_id % 8 + 1) || 'fOrd' FROM n WHERE horse_id % 13 = 0
            UNION ALL SELECT race_id, 'horses[' || i || '].detail.buS2fGTime' FROM n WHERE horse_id % 17 = 0
            UNION ALL SELECT DISTINCT race_id, 'result' FROM n WHERE race_id % 5 = 0
            UNION ALL SELECT DISTINCT race_id, 'result.top3' FROM n WHERE race_id % 5 = 0)
        SELECT path, count(*) AS documents FROM l GROUP BY 1"""
)
def leaked_result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result and section fields that say something, wherever they stand in documents of events; blank ones leak nothing."""
    h = F.col("horse_id")
    section = F.concat(F.lit('"sjG'), (h % 8 + 1).cast("string"), F.lit('fOrd":'), F.when(h % 13 == 0, "3").otherwise('" "'))
    other = F.concat(F.lit(',"buS2fGTime":'), F.when(h % 17 == 0, "[1]").otherwise("[]"), F.lit(',"sjG9fOrd":1'))
    horse = F.concat(F.lit('{"no":'), F.col("entry_no").cast("string"), F.lit(',"rank":'), F.when(h % 11 == 0, '"1"').otherwise("null"), F.lit(',"detail":{'), section, other, F.lit("}}"))
    rows = entries(spark, sf_dir).groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", horse.alias("h")))).alias("hs"))
    horses = F.array_join(F.transform("hs", lambda x: x["h"]), ",")
    documents = rows.select("race_id", F.concat(F.lit('{"horses":['), horses, F.lit('],"result":'), F.when(F.col("race_id") % 5 == 0, '{"top3":[1,2,3]}').otherwise("{}"), F.lit("}")).alias("document"))
    return K.leaked_fields(documents, "race_id", "document", depth=5).groupBy("path").agg(F.count(F.lit(1)).alias("documents"))
