"""Walk-forward choice among rank patterns.

A policy is a feature, a direction and a pattern of three ranks: it names the three entries that
stand at these ranks. How often a policy was right is known as of a date from the events of earlier
dates only. As a pattern's hits are the sums of its ranks' hits, the state is small: for each date
and ranked list the hits of each rank, and the events whose whole answer stood at one pattern. Both
are running sums over dates that stop at the day before, so every date is predicted at once and no
loop goes over dates. The best policies of a date vote for combinations of each of its events;
weights are whole millionths, so sums do not depend on the order in which they are made.

A state has dates x policies rows, whatever the number of events; an event has at most as many
candidates as there are sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MILLION = 1_000_000
#: Pairs of places in a combination.
PAIRS = [(0, 1), (0, 2), (1, 2)]
#: Order ranks of a candidate that the bucket model tells apart, and its prior: one in PRIOR candidates is right.
ORDERS, PRIOR = 8, 20
#: Events that are probed at a time, and bits of an entry's code.
BLOCK, CODE = 8_192, 20


def patterns(depth: int) -> list[tuple[int, int, int]]:
    """All patterns of three ranks from 1 to ``depth``."""
    return list(combinations(range(1, depth + 1), 3))


def ranked_lists(rows: DataFrame, features: list[str], depth: int, place: str | None = "place") -> DataFrame:
    """(race_id, race_date, size, lists, answer) of the events with three entries or more.

    ``lists`` has for each feature its first ``depth`` entries, high values first, then low values
    first; nulls come last, ties go to the smaller number. ``answer`` is the sorted triple of the
    entries with places 1 to 3, null where ``place`` is None or fewer than three are known. One
    shuffle by event; the entries of a batch of gathered events are sorted together.
    """
    known = F.col(place) if place else F.lit(None).cast("int")
    member = F.struct(F.col("entry_no").cast("int").alias("no"), known.cast("int").alias("place"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    events = rows.groupBy("race_id", "race_date").agg(F.collect_list(member).alias("members")).filter(F.size("members") >= 3)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields[:2]]
    return events.mapInArrow(_lister(len(features), depth), ", ".join([*kinds, "size int", "lists array<array<int>>", "answer array<int>"]))


def _lister(features: int, depth: int):
    """For ``mapInArrow``: (race_id, race_date, members) to the columns of ``ranked_lists``; the members of a batch of events are sorted together."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members, size = batch.column("members"), batch.column("members").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            no, place, *values = members.flatten().flatten()
            no, event, within = no.to_numpy(zero_copy_only=False), np.repeat(np.arange(size.size), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            taken, placed = within < depth, place.fill_null(4).to_numpy(zero_copy_only=False) <= 3
            named = np.empty((2 * features, int(taken.sum())), np.int32)
            for i, column in enumerate(values):
                unknown, value = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0.0).to_numpy(zero_copy_only=False)
                for j, key in enumerate((-value, value)):
                    named[2 * i + j] = no[np.lexsort((no, key, unknown, event))][taken]
            short = np.minimum(size, depth)
            order = np.argsort(np.tile(event[taken], 2 * features), kind="stable")  # an event's lists, one after the other
            lists = _nested(_nested(pa.array(named.ravel()[order]), np.repeat(short, 2 * features)), np.full(size.size, 2 * features))
            right = np.bincount(event[placed], minlength=size.size)
            found = placed & (right == 3)[event]
            answer = _nested(pa.array(no[np.lexsort((no, ~found, event))][within < np.where(right == 3, 3, 0)[event]]), np.where(right == 3, 3, 0), right != 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), lists, answer], ["race_id", "race_date", "size", "lists", "answer"])

    return listed


def _nested(values: pa.Array, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Lists of these lengths; null where ``missing``."""
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=None if missing is None else pa.array(missing))


def _as_dates(events: DataFrame, as_of: DataFrame | None) -> DataFrame:
    """The dates to be predicted: those of the events, or of ``as_of`` (race_date)."""
    return (events if as_of is None else as_of).select("race_date").distinct()


def policy_state(events: DataFrame, lists: int, depth: int, as_of: DataFrame | None = None) -> DataFrame:
    """(race_date, list, pattern, events, exact, places): each policy's record over the events before each date.

    ``exact`` counts events whose answer is the pattern's combination, ``places`` the entries of
    answers that stood at its ranks, ``events`` those with enough entries for it. Events without an
    answer count nowhere. Dates without earlier events have zeros.
    """
    known = events.filter(F.col("answer").isNotNull()).select("race_date", "answer", F.posexplode("lists").alias("list", "items"))
    here = F.array_sort(F.transform("answer", lambda a: F.array_position("items", a).cast("int")))
    ranks = [F.get("items", F.lit(r)) for r in range(depth)]
    daily = known.groupBy("race_date", "list").agg(
        *[F.count(rank).alias(f"n{r}") for r, rank in enumerate(ranks)], *[F.count(F.when(F.array_contains("answer", rank), 1)).alias(f"h{r}") for r, rank in enumerate(ranks)]
    )
    dates = _as_dates(events, as_of).select("race_date", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"))
    names = [f"{kind}{r}" for kind in "nh" for r in range(depth)]
    before = Window.partitionBy("list").orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    ran = dates.join(daily, ["race_date", "list"], "full").select("race_date", "list", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])

    exact = known.filter(F.get(here, F.lit(0)) > 0).groupBy("race_date", "list", here.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    choices = F.array(*[F.array(*map(F.lit, p)) for p in patterns(depth)])
    deepest = F.array(*[F.col(f"n{r}") for r in range(depth)])
    hits = F.array(*[F.col(f"h{r}") for r in range(depth)])
    grid = ran.select("race_date", "list", deepest.alias("ns"), hits.alias("hs"), F.explode(choices).alias("pattern"))
    upto = Window.partitionBy("list", "pattern").orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    whole = grid.join(exact, ["race_date", "list", "pattern"], "left").select(
        "race_date",
        "list",
        "pattern",
        F.get("ns", F.col("pattern")[2] - 1).alias("events"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("exact"),
        F.aggregate("pattern", F.lit(0).cast("long"), lambda s, r: s + F.get("hs", r - 1)).alias("places"),
    )
    return whole if as_of is None else whole.join(_as_dates(events, as_of), "race_date", "left_semi")


def chosen_sources(state: DataFrame, count: int, metric: str, rank_weight: float = 0.0) -> DataFrame:
    """(race_date, sources): the ``count`` best policies of each date by ``metric`` (exact or match), best first.

    A source's ``rate`` is its share of exact events, or of places, in millionths; its ``weight`` is
    that plus ``rank_weight`` for the first source, falling evenly to the last. Equal rates go by the
    other rate, then by list and pattern. Policies without an earlier event are none.
    """
    exact = F.expr(f"({MILLION} * exact) div events")
    match = F.expr(f"({MILLION} * places) div (3 * events)")
    main, other = (exact, match) if metric == "exact" else (match, exact)
    rated = state.filter("events > 0").select("race_date", "list", "pattern", main.alias("rate"), other.alias("other"))
    order = Window.partitionBy("race_date").orderBy(F.desc("rate"), F.desc("other"), "list", "pattern")
    best = rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    size = F.count(F.lit(1)).over(Window.partitionBy("race_date"))
    falling = F.floor(F.lit(round(MILLION * rank_weight)) * (size - F.col("rank") + 1) / size).cast("long") if rank_weight else F.lit(0).cast("long")
    weighted = best.select("race_date", "rank", "list", "pattern", "rate", (F.col("rate") + falling).alias("weight"))
    return weighted.groupBy("race_date").agg(F.array_sort(F.collect_list(F.struct("rank", "list", "pattern", "rate", "weight"))).alias("sources"))


def voted_combinations(events: DataFrame, sources: DataFrame, fallbacks: DataFrame, as_of: str = "race_date") -> DataFrame:
    """A row for each combination that an event's sources name, and for its fallback, with its sums of votes in millionths.

    ``sources`` holds for events whose ``as_of`` is their race_date; ``fallbacks`` is (race_id,
    fallback), a sorted triple or null. Events meet their fallbacks first, the one shuffle by event;
    sources are a row a date and are broadcast, so they are in no shuffle and votes stay in the
    event's partition.
    """
    voting = events.withColumn("voted_on", F.col(as_of)).join(fallbacks.hint("merge"), "race_id", "left")
    voting = voting.join(F.broadcast(sources.withColumnRenamed("race_date", "voted_on")), "voted_on", "left").withColumn("n", F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)))

    def vote(s: Column) -> Column:
        items = F.get("lists", s["list"])
        named = F.array_sort(F.transform(s["pattern"], lambda r: F.get(items, r - 1)))
        return F.struct(F.when(F.size(items) >= s["pattern"][2], named).alias("combo"), s["weight"].alias("weight"), F.lit(1).alias("vote"), s["rank"].alias("rank"), s["rate"].alias("rate"))

    none = F.lit(0).cast("long")
    last = F.struct(F.col("fallback").alias("combo"), none.alias("weight"), F.lit(0).alias("vote"), (F.col("n") + 1).alias("rank"), none.alias("rate"))
    about = ["race_date", "answer", "fallback", "n"]
    votes = voting.select("race_id", *about, F.explode(F.concat(F.coalesce(F.transform("sources", vote), F.array()), F.array(last))).alias("v"))
    return votes.filter(F.col("v.combo").isNotNull()).groupBy("race_id", F.col("v.combo").alias("combo"), *about).agg(
        F.sum("v.weight").alias("score"),
        F.sum("v.vote").alias("support"),
        F.max("v.weight").alias("most"),
        F.min("v.rank").alias("first_rank"),
        F.sum("v.rate").alias("rates"),
    )


def _shared() -> Column:
    return F.coalesce(F.size(F.array_intersect("combo", "fallback")), F.lit(0))


def judged_rows(combos: DataFrame) -> DataFrame:
    """The columns of ``candidate_rows`` that the bucket model and the overlap rule look at: (race_id, race_date, combo, fallback, score, support_share, support, overlap, is_fallback, place, points, exact, answered)."""
    n = F.greatest("n", F.lit(1))
    return combos.select(
        "race_id",
        "race_date",
        "combo",
        "fallback",
        (F.col("score") / MILLION / n).alias("score"),
        (F.col("support") / n).alias("support_share"),
        F.col("support").cast("long").alias("support"),
        _shared().alias("overlap"),
        F.coalesce(F.col("combo") == F.col("fallback"), F.lit(False)).alias("is_fallback"),
        (F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("score"), "combo")) - 1).cast("int").alias("place"),
        F.col("score").alias("points"),
        F.coalesce(F.col("combo") == F.col("answer"), F.lit(False)).alias("exact"),
        F.col("answer").isNotNull().alias("answered"),
    )


def candidate_rows(events: DataFrame, sources: DataFrame, fallbacks: DataFrame, as_of: str = "race_date") -> DataFrame:
    """``voted_combinations`` with all that a ranker may look at.

    Score, support and their sums over pairs and entries are shares of the number of sources; orders
    go from 0, best, to 1; ``exact`` says whether the combination is the answer. Votes, pairs,
    entries and orders of an event stay in its partition.
    """
    combos = voted_combinations(events, sources, fallbacks, as_of)
    parts = F.array(
        *[F.struct(F.col("combo")[i].alias("a"), F.lit(0).alias("b")) for i in range(3)], *[F.struct(F.col("combo")[i].alias("a"), F.col("combo")[j].alias("b")) for i, j in PAIRS]
    )
    of_part = Window.partitionBy("race_id", "part")
    spread = combos.select("*", F.explode(parts).alias("part")).select("*", F.sum("score").over(of_part).alias("part_score"), F.sum("support").over(of_part).alias("part_count"))
    single = F.col("part.b") == 0
    standing = Window.partitionBy("race_id", single).orderBy(F.desc("part_score"), F.desc("part_count"), "part.a")
    spread = spread.withColumn("top", single & (F.col("part_count") > 0) & (F.dense_rank().over(standing) <= 5))
    columns = ["race_date", "answer", "fallback", "n", "score", "support", "most", "first_rank", "rates"]
    sums = [
        how(F.when(which, F.col(c))).alias(f"{name}_{kind}_{label}")
        for name, which in (("pair", ~single), ("item", single))
        for c, kind in (("part_score", "score"), ("part_count", "count"))
        for how, label in ((F.sum, "sum"), (F.min, "least"), (F.max, "most"))
    ]
    rows = spread.groupBy("race_id", "combo").agg(*[F.first(c).alias(c) for c in columns], *sums, F.count(F.when(F.col("top"), 1)).alias("top_items"))

    event = Window.partitionBy("race_id")
    is_fallback = F.coalesce(F.col("combo") == F.col("fallback"), F.lit(False))
    order = lambda c: F.row_number().over(event.orderBy(F.desc(c), "combo")) - 1
    rows = rows.select(
        "*",
        is_fallback.alias("is_fallback"),
        order("score").alias("score_place"),
        order("support").alias("support_place"),
        F.greatest(F.count(F.lit(1)).over(event) - 1, F.lit(1)).alias("others"),
        F.coalesce(F.max(F.when(is_fallback, F.col("score"))).over(event), F.lit(0)).alias("own_score"),
        F.coalesce(F.max(F.when(is_fallback, F.col("support"))).over(event), F.lit(0)).alias("own_support"),
    )
    n, votes_of = F.greatest("n", F.lit(1)), F.greatest("support", F.lit(1))
    shared = _shared()
    units = lambda c: F.col(c) / MILLION
    shares = [
        (F.col(f"{name}_{kind}_{label}") / (MILLION if kind == "score" else 1) / n).alias(f"{name}_{kind}_{label}")
        for name in ("pair", "item")
        for kind in ("score", "count")
        for label in ("sum", "least", "most")
    ]
    return rows.select(
        "race_id",
        "race_date",
        "combo",
        "fallback",
        (units("score") / n).alias("score"),
        (units("score") / votes_of).alias("mean_score"),
        units("most").alias("most_score"),
        (F.col("support") / n).alias("support_share"),
        (F.col("first_rank") / n).alias("first_rank"),
        (units("rates") / votes_of).alias("mean_rate"),
        (shared / 3).alias("overlap_share"),
        F.col("is_fallback").cast("int").alias("same"),
        (F.col("score_place") / F.col("others")).alias("score_order"),
        (F.col("support_place") / F.col("others")).alias("support_order"),
        ((units("score") - F.col("own_score") / MILLION) / n).alias("score_lead"),
        ((F.col("support") - F.col("own_support")) / n).alias("support_lead"),
        *shares,
        (F.col("top_items") / 3).alias("top_share"),
        F.col("support").cast("long").alias("support"),
        shared.alias("overlap"),
        "is_fallback",
        F.col("score_place").cast("int").alias("place"),
        (F.col("score")).alias("points"),
        F.coalesce(F.col("combo") == F.col("answer"), F.lit(False)).alias("exact"),
        F.col("answer").isNotNull().alias("answered"),
    )


def bucket() -> Column:
    """What the bucket model knows of a candidate: its place by score and what it shares with the fallback."""
    return (F.least("place", F.lit(ORDERS)) * 4 + F.col("overlap")).cast("int")


def bucket_state(candidates: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """(race_date, bucket, rows, chance): how often candidates of a bucket were right before each date, in millionths.

    The chance is smoothed towards one in PRIOR. Buckets x dates rows, from one pass over the candidates.
    """
    daily = candidates.filter("answered").groupBy("race_date", bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("exact"), 1)).alias("hits"))
    dates = _as_dates(candidates, as_of).select("race_date", F.explode(F.sequence(F.lit(0), F.lit(ORDERS * 4 + 3))).alias("bucket"))
    before = Window.partitionBy("bucket").orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    ran = dates.join(daily, ["race_date", "bucket"], "full").select("race_date", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "hits")])
    out = ran.select("race_date", "bucket", F.col("n").alias("rows"), F.expr(f"({MILLION} * (hits + 1)) div (n + {PRIOR})").alias("chance"))
    return out if as_of is None else out.join(_as_dates(candidates, as_of), "race_date", "left_semi")


def select_by_chance(candidates: DataFrame, chances: DataFrame, bias: int, as_of: Column | None = None) -> DataFrame:
    """(race_id, race_date, fallback, chosen, switched, fit, exact, fallback_exact, in_pool, train_rows) of each event.

    The candidate of the highest chance (then score, support, smallest combination) replaces the
    fallback if its chance is at least ``bias`` millionths above the fallback's. Before any
    candidate has been judged (``fit`` false) the fallback stays. Labels serve the report only.
    """
    judged = candidates.select("*", bucket().alias("bucket"), (F.col("race_date") if as_of is None else as_of).alias("judged_on"))
    seen = chances.groupBy("race_date").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "chance"))).alias("chances"), F.sum("rows").alias("train_rows"))
    rows = judged.join(seen.withColumnRenamed("race_date", "judged_on"), "judged_on", "left").withColumn("chance", F.element_at("chances", F.col("bucket")))
    rank = F.struct(F.col("chance"), F.col("points"), F.col("support"), F.transform("combo", lambda x: -x).alias("least"), "combo", "exact")
    event = rows.groupBy("race_id", "race_date").agg(
        F.max(rank).alias("best"),
        F.first("fallback").alias("fallback"),
        F.max(F.when(F.col("is_fallback"), F.col("chance"))).alias("own"),
        F.max(F.when(F.col("is_fallback"), F.col("exact").cast("int"))).alias("own_exact"),
        F.max(F.col("exact").cast("int")).alias("in_pool"),
        F.max(F.coalesce("train_rows", F.lit(0))).alias("train_rows"),
    )
    fit = F.col("train_rows") > 0
    switched = F.coalesce(fit & (F.col("best.combo") != F.col("fallback")) & (F.col("best.chance") >= F.col("own") + bias), F.lit(False))
    return event.select(
        "race_id",
        "race_date",
        "fallback",
        F.when(switched, F.col("best.combo")).otherwise(F.col("fallback")).alias("chosen"),
        switched.alias("switched"),
        fit.alias("fit"),
        F.when(switched, F.col("best.exact").cast("int")).otherwise(F.coalesce("own_exact", F.lit(0))).alias("exact"),
        F.coalesce("own_exact", F.lit(0)).alias("fallback_exact"),
        "in_pool",
        "train_rows",
    )


def overlap_parts(candidates: DataFrame) -> DataFrame:
    """(race_id, race_date, combo, base, added, dropped, kept, support, own, exact, fallback_exact) of candidates that share two entries with the fallback.

    The parts of their score, in millionths: their own, what the added entry, the dropped one and the
    kept pair weigh, each the sum over the event's candidates that hold it of score and support
    share. ``own`` is the fallback's own. Any weights of the parts can be tried on these rows.
    """
    base = F.round(F.col("score") * MILLION).cast("long")
    weight = base + F.round(F.col("support_share") * MILLION).cast("long")
    rows = candidates.filter(F.col("fallback").isNotNull())
    held = F.struct("combo", base.alias("base"), weight.alias("w"), "support", (F.col("overlap") == 2).alias("near"), "is_fallback", F.col("exact").cast("int").alias("exact"))
    events = rows.groupBy("race_id", "race_date", "fallback").agg(F.collect_list(held).alias("all"))
    own = F.get(F.filter("all", lambda c: c["is_fallback"]), F.lit(0))
    events = events.select("race_id", "race_date", "fallback", "all", F.coalesce(own["base"], F.lit(0)).alias("own"), F.coalesce(own["exact"], F.lit(0)).alias("fallback_exact"))
    near = events.select("*", F.explode(F.filter("all", lambda c: c["near"] & ~c["is_fallback"])).alias("c"))
    near = near.withColumn("kept", F.array_intersect("c.combo", "fallback"))
    holding = lambda items: F.aggregate("all", F.lit(0).cast("long"), lambda s, c: s + F.when(F.size(F.array_except(items, c["combo"])) == 0, c["w"]).otherwise(0))
    return near.select(
        "race_id",
        "race_date",
        "c.combo",
        "c.base",
        holding(F.array_except("c.combo", "fallback")).alias("added"),
        holding(F.array_except("fallback", "c.combo")).alias("dropped"),
        holding(F.col("kept")).alias("kept"),
        "c.support",
        "own",
        "c.exact",
        "fallback_exact",
    )


def probe_weights(parts: DataFrame, adds: list[int], drops: list[int], pairs: list[int], biases: list[int], group: str) -> DataFrame:
    """(group, add, drop, pair, bias, switched, gained) for every setting, weights and biases in hundredths.

    ``switched`` counts the events whose fallback is replaced, ``gained`` how many more answers are
    met by that. The best candidate of an event depends on the first three weights alone, so it is
    found once for these, in the event's own row, and compared with each bias after.
    """
    settings = F.array(*[F.struct(F.lit(a).alias("add"), F.lit(d).alias("drop"), F.lit(p).alias("pair")) for a in adds for d in drops for p in pairs])
    held = F.struct("base", "added", "dropped", "kept", "support", F.transform("combo", lambda x: -x).alias("least"), "exact")
    events = parts.groupBy(group, "race_id", "own", "fallback_exact").agg(F.collect_list(held).alias("all"))

    def best_of(s: Column) -> Column:
        total = lambda c: 100 * c["base"] + s["add"] * c["added"] - s["drop"] * c["dropped"] + s["pair"] * c["kept"]
        return F.struct(s.alias("s"), F.array_max(F.transform("all", lambda c: F.struct(total(c).alias("total"), c["support"].alias("support"), c["least"].alias("least"), c["exact"].alias("exact")))).alias("best"))

    best = events.select(group, "own", "fallback_exact", F.inline(F.transform(settings, best_of)))
    each = best.select(group, "s", "best", "own", "fallback_exact", F.explode(F.array(*map(F.lit, biases))).alias("bias"))
    switched = F.col("best.total") >= 100 * F.col("own") + F.col("bias") * MILLION
    return each.groupBy(group, F.col("s.add").alias("add"), F.col("s.drop").alias("drop"), F.col("s.pair").alias("pair"), "bias").agg(
        F.count(F.when(switched, 1)).alias("switched"), F.coalesce(F.sum(F.when(switched, F.col("best.exact") - F.col("fallback_exact"))), F.lit(0)).alias("gained")
    )


def _sums(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each id the sum of the weights of all equal ids; whole numbers below 2**53."""
    if ids.max(initial=0) > 16 * ids.size:
        ids = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
    return np.bincount(ids.ravel(), weights.ravel()).astype(np.int64)[ids]


def _millionths(shares: np.ndarray) -> np.ndarray:
    """Round to whole millionths, halves up; shares are not negative."""
    scaled = shares * MILLION
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)).astype(np.int64)


def _coded(block: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Lists (events x lists x depth, -1 where they end), fallbacks (3 x events), keys of the answers (-1 if none) and the number of codes: entries as codes from 0 in their order."""
    lists, fallback, answer = (block.column(c) for c in ("lists", "fallback", "answer"))
    inner = lists.flatten()
    lengths, answered = inner.value_lengths().to_numpy(zero_copy_only=False), answer.is_valid().to_numpy(zero_copy_only=False)
    parts = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (inner, fallback, answer)]
    items = np.concatenate(parts)
    items = items - items.min() if np.ptp(items) < 1 << CODE else np.unique(items, return_inverse=True)[1]
    named, last, right = np.split(items, np.cumsum([p.size for p in parts])[:2])
    depth = max(depth, lengths.max())
    placed = np.full((lengths.size, depth), -1)
    placed[np.arange(depth) < lengths[:, None]] = named
    keys = np.full(block.num_rows, -1)
    keys[answered] = _key(*right.reshape(-1, 3).T)
    return placed.reshape(block.num_rows, -1, depth), last.reshape(-1, 3).T, keys, int(items.max()) + 1


def _key(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One number for a sorted triple of codes; numbers are in the order of triples."""
    return low << 2 * CODE | middle << CODE | high


def _probe(lists: np.ndarray, fallback: np.ndarray, answer: np.ndarray, codes: int, sources: list, weights: np.ndarray, biases: np.ndarray) -> np.ndarray | None:
    """(settings x biases x 2) switched and gained over the events of one date by its sources; None if no event has a candidate near its fallback."""
    # Votes: a combination for each source and the fallback, equal ones of an event brought together by sorting its keys.
    ranks = np.array([s["pattern"] for s in sources]) - 1
    x, y, z = (lists[:, [s["list"] for s in sources], ranks[:, i]] for i in range(3))
    low, high = np.minimum(np.minimum(x, y), z), np.maximum(np.maximum(x, y), z)
    none = 1 << 3 * CODE
    own_key = _key(*fallback)
    keys = np.column_stack([np.where(low < 0, none, _key(low, x + y + z - low - high, high)), own_key])
    order = np.argsort(keys, axis=1)
    keys = np.take_along_axis(keys, order, 1)
    starts = np.flatnonzero(np.diff(keys, axis=1, prepend=-1).ravel())
    votes = [np.add.reduceat(np.array([*column, 0])[order].ravel(), starts) for column in ([s["weight"] for s in sources], [1] * len(sources))]
    key, event = keys.ravel()[starts], starts // keys.shape[1]
    named = key < none
    key, event, points, support = (c[named] for c in (key, event, *votes))

    # Parts of the scores, as in overlap_parts.
    base = _millionths(points / MILLION / len(sources))
    weight = np.broadcast_to(base + _millionths(support / len(sources)), (3, key.size))
    items = np.stack([key >> 2 * CODE, key >> CODE & (1 << CODE) - 1, key & (1 << CODE) - 1])
    of_item = _sums(event * codes + items, weight)
    of_pair = _sums((event * codes + items[[0, 0, 1]]) * codes + items[[1, 2, 2]], weight)
    same = items[:, None] == fallback[None, :, event]
    shared, held = same.any(1), same.any(0)
    own = np.flatnonzero(key == own_key[event])  # one an event, in the order of events
    exact = (key == answer[event]).astype(np.int64)
    near = np.flatnonzero(shared.sum(0) == 2)
    if not near.size:
        return None
    near = near[np.lexsort((-support[near], event[near]))]  # of equal support the smaller combination is first
    event = event[near]
    added, dropped = np.argmin(shared[:, near], 0), np.argmin(held[:, near], 0)
    parts = 100 * base[near], of_item[added, near], of_item[dropped, own[event]], of_pair[2 - added, near]

    # The best candidate of each event for each setting: its total and its place among equal ones in one number.
    starts = np.flatnonzero(np.diff(event, prepend=-1))
    place = np.arange(near.size) - np.repeat(starts, np.diff(starts, append=near.size))
    bits = int(place.max()).bit_length()
    total = parts[0] + weights[:, :1] * parts[1] - weights[:, 1:2] * parts[2] + weights[:, 2:] * parts[3]
    best = np.maximum.reduceat((total << bits) + ((1 << bits) - 1 - place), starts, axis=1)
    own = own[event[starts]]
    gain = exact[near][starts + (1 << bits) - 1 - (best & (1 << bits) - 1)] - exact[own]
    lead = (best >> bits) - 100 * base[own]
    switched = [lead >= b * MILLION for b in biases]
    return np.stack([np.stack([s.sum(1), (gain * s).sum(1)], 1) for s in switched], 1)


def probe_events(events: DataFrame, sources: DataFrame, adds: list[int], drops: list[int], pairs: list[int], biases: list[int]) -> DataFrame:
    """(group, as_of, add, drop, pair, bias, switched, gained): ``probe_weights`` of ``overlap_parts`` of the combinations that sources vote for, in one pass over events.

    ``events`` has as_of, lists, answer and fallback (a sorted triple), ``sources`` is
    ``chosen_sources`` with a group: a row for each group and date, which goes to every task. Votes,
    parts and settings of a block of events are arrays; a task returns the sums of its events, a row a
    setting.
    """
    tried = {}
    for row in sources.select("group", "race_date", "sources").collect():
        tried.setdefault(row["race_date"], []).append((row["group"], [s.asDict() for s in row["sources"]]))
    depth = max((s["pattern"][2] for groups in tried.values() for _, chosen in groups for s in chosen), default=1)
    settings = list(product(adds, drops, pairs))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for block in (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK)):
            lists, fallback, answer, codes = _coded(block, depth)
            days = block.column("as_of").to_numpy(zero_copy_only=False)
            for date, groups in tried.items():
                on = days == np.datetime64(date)
                if not on.any():
                    continue
                for group, chosen in groups:
                    found = _probe(lists[on], fallback[:, on], answer[on], codes, chosen, np.array(settings), np.array(biases))
                    if found is not None:
                        sums[group, date] = sums.get((group, date), 0) + found
        rows = [(*at, *s, b, *map(int, found[i, j])) for at, found in sums.items() for i, s in enumerate(settings) for j, b in enumerate(biases)]
        names = ["group", "as_of", "add", "drop", "pair", "bias", "switched", "gained"]
        kinds = [pa.string(), pa.date32(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = events.select("as_of", "lists", "answer", "fallback").mapInArrow(probed, "group string, as_of date, add int, drop int, pair int, bias int, switched long, gained long")
    return found.groupBy("group", "as_of", "add", "drop", "pair", "bias").agg(F.sum("switched").alias("switched"), F.sum("gained").alias("gained"))
