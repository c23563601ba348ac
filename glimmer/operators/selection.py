"""Choosing a small diverse subset of each group's candidates.

Greedy choice depends on what was chosen before, so a group's candidates are gathered into one ordered array and folded
with higher-order functions. Each step keeps, per remaining candidate, its largest similarity to what is chosen, so a pick
costs one pass over the pool. A pool may be of any size: a choice can lower a candidate's score by a bounded amount only, so
``reachable`` leaves out, before anything is gathered, what cannot be chosen whatever is chosen before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms


def mmr_expression(k: str, relevance: str, sigma: str, drop_neighbors: bool = True) -> str:
    """SQL over column ``pool``, array<struct<t, id, modality, z, anchor_t, toks>> in (t, id) order. k, relevance and
    sigma are SQL expressions. Result: array<struct<id, rank, mmr, t, modality>> in order of choice."""
    kernel = f"exp(-((r.x.t - b.x.t) * (r.x.t - b.x.t)) / ({sigma} * {sigma}))"
    pair = "coalesce((r.x.modality = 'visual' and r.x.anchor_t = b.x.t) or (b.x.modality = 'visual' and b.x.anchor_t = r.x.t), false)"
    similarity = f"if(r.x.modality = b.x.modality, {kernel}, if({pair}, 0D, {terms.CROSS_MODAL_WEIGHT}D * {kernel}))"
    redundant = "false"
    if drop_neighbors:
        redundant = (
            f"(r.x.modality = 'audio' and b.x.modality = 'audio' and abs(r.x.t - b.x.t) <= {terms.NEIGHBOR_GAP_SIGMAS}D * {sigma}"
            f" and least(size(r.x.toks), size(b.x.toks)) >= {terms.NEIGHBOR_MIN_TOKENS}"
            f" and size(array_intersect(r.x.toks, b.x.toks)) / size(array_union(r.x.toks, b.x.toks)) >= {terms.NEIGHBOR_SIMILARITY}D)"
        )
    best = f"array_max(transform(acc.rem, r -> named_struct('score', if(r.sim is null, r.x.z, {relevance} * r.x.z - (1D - {relevance}) * r.sim), 'no', -r.o, 'x', r.x)))"
    step = f"""transform(array({best}), b -> named_struct(
        'sel', array_append(acc.sel, named_struct('id', b.x.id, 'rank', size(acc.sel) + 1, 'mmr', b.score, 't', b.x.t, 'modality', b.x.modality)),
        'rem', transform(filter(acc.rem, r -> r.o <> -b.no and not {redundant}),
                         r -> named_struct('o', r.o, 'x', r.x, 'sim', greatest(r.sim, {similarity})))))[0]"""
    empty = "cast(array() as array<struct<id: string, rank: int, mmr: double, t: double, modality: string>>)"
    return f"""aggregate(sequence(1, {k}),
        named_struct('sel', {empty}, 'rem', transform(pool, (x, i) -> named_struct('o', i, 'x', x, 'sim', cast(null as double)))),
        (acc, i) -> if(size(acc.rem) = 0, acc, {step}), acc -> acc.sel)"""


def pools(df: DataFrame, group: list[str]) -> DataFrame:
    """One row a group with its candidates, ordered by (t, id). Missing anchor_t and toks are filled."""
    if "anchor_t" not in df.columns:
        df = df.withColumn("anchor_t", F.lit(None).cast("double"))
    if "toks" not in df.columns:
        df = df.withColumn("toks", F.array().cast("array<string>"))
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("t", "id", "modality", "z", "anchor_t", "toks"))).alias("pool"))


def unfolded(df: DataFrame, fold: str, *keep) -> DataFrame:
    """The rows of a fold that yields an array of structs with an id. The outer generator has no filter on its array, which
    the optimizer would push down as a second and third copy of the whole fold."""
    return df.select(*keep, F.expr(f"inline_outer({fold})")).filter("id is not null")


def reachable(df: DataFrame, group: list[str], k: int, relevance: float) -> DataFrame:
    """The candidates that a choice of k can reach. Similarity lies in [0, 1], so a score is between lam * z - (1 - lam) and
    lam * z; of the k best by z one is left at every step, so nothing that is more than (1 - lam) / lam below the k-th of
    them is ever the best. Holds where choices remove nothing but themselves."""
    last = F.nth_value("z", k).over(W.partitionBy(*group).orderBy(F.desc("z")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col("z") >= F.col("__last") - (1 - relevance) / relevance - 1e-9)).drop("__last")


def mmr_select(df: DataFrame, group: list[str], preset: str = "balanced", scale: float = 1.0, drop_neighbors: bool = True, name: str = "sel") -> DataFrame:
    """(group, t, id, modality, z) -> (group, id, rank, mmr, t, modality) of the chosen."""
    k, lam, sigma = terms.PRESETS[preset]
    if not drop_neighbors:
        df = reachable(df, group, k, lam)
    expr = mmr_expression(str(k), f"{lam}D", f"{sigma * scale}D", drop_neighbors)
    return unfolded(pools(df, group), expr, *group)


def top_k(df: DataFrame, group: list[str], k: int, order: list, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def split_budget(budget: int, intent, modality):
    """How much of a budget a modality gets: the visual share is a third for questions about what is heard, two thirds
    for what is seen, else half, at least one item each if there are two."""
    if budget <= 1:
        visual = F.when(intent.isin(terms.AUDIO_INTENTS), 0).otherwise(budget)
    else:
        share = F.when(intent.isin(terms.AUDIO_INTENTS), round(budget / 3)).when(intent.isin(terms.VISUAL_INTENTS), round(2 * budget / 3)).otherwise(budget // 2)
        visual = F.greatest(F.lit(1), F.least(share, F.lit(budget - 1)))
    return F.when(modality == "visual", visual).otherwise(budget - visual)


def uniform(df: DataFrame, group: list[str], k: int, order: list) -> DataFrame:
    """k rows of each group evenly spaced in the order (positions rounded half to even); all of a small group."""
    w = W.partitionBy(*group)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = (F.col("__n") - 1) / F.lit(float(k - 1)) if k > 1 else F.lit(0.0)
    wanted = F.when(F.col("__n") <= k, F.sequence(F.lit(0), F.lit(k - 1))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * step).cast("int")))
    ranks = F.array_position(wanted, F.col("__i")).cast("int")
    return rows.withColumn("rank", ranks).filter("rank > 0").drop("__i", "__n")


def scene_budget(df: DataFrame, group: list[str], max_items: int) -> DataFrame:
    """Cut visuals that have a scene to a budget when a group has two scenes or more: the best of each of the best
    scenes, then the best of the rest. Audio and visuals without a scene stay. Ties end with id order."""
    w = W.partitionBy(*group)
    scene = (F.col("modality") == "visual") & F.col("segment_id").isNotNull()
    n_audio, n_scene = F.count_if(F.col("modality") == "audio").over(w), F.count_if(scene).over(w)
    scenes = F.size(F.collect_set(F.when(scene, F.col("segment_id"))).over(w))
    rows = df.withColumn("__scene", scene).withColumn("__scenes", scenes).withColumn("__budget", F.least(n_scene, F.greatest(F.lit(1), F.lit(max_items) - F.least(F.lit(2), n_audio))))
    by = [F.col("z").desc(), F.col("relevance").desc(), F.col("t"), F.col("id")]
    ws = W.partitionBy(*group, "segment_id", "__scene")
    rows = rows.withColumn("__first", F.row_number().over(ws.orderBy(*by))).withColumn("__z", F.max("z").over(ws)).withColumn("__r", F.max("relevance").over(ws))
    head = F.col("__scene") & (F.col("__first") == 1)
    rows = rows.withColumn("__head", head).withColumn("__place", F.row_number().over(W.partitionBy(*group, "__head").orderBy(F.when(head, F.col("__z")).desc(), F.when(head, F.col("__r")).desc(), F.when(head, F.col("segment_id")))))
    taken = F.least(F.col("__scenes"), F.col("__budget"))
    rest = F.col("__scene") & ~F.col("__head")
    rows = rows.withColumn("__rest", F.row_number().over(W.partitionBy(*group, rest).orderBy(*by)))
    keep = (F.col("__scenes") < 2) | ~F.col("__scene") | (F.col("__head") & (F.col("__place") <= F.col("__budget"))) | (rest & (F.col("__rest") <= F.col("__budget") - taken))
    return rows.filter(keep).select(*df.columns)


def escalation(selected: DataFrame, group: list[str]) -> DataFrame:
    """(group, modality, relevance, anchor_score, text, id, asset) -> (group, expand, reason): does a small budget's
    evidence look too weak?"""
    visual, audio = F.col("modality") == "visual", F.col("modality") == "audio"
    exact = visual & F.startswith(F.lower("text"), F.lit("on-screen text near")) & (F.col("relevance") >= 0.95)
    moment = audio & F.contains("id", F.lit(":audio:")) & F.contains("id", F.lit(":visual:")) & F.col("asset").isNotNull()
    a = selected.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.max("relevance").alias("best"), F.count_if(audio).alias("n_audio"), F.count_if(visual).alias("n_visual"),
        F.bool_or(visual & (F.col("anchor_score") >= terms.ANCHOR_MIN_SCORE)).alias("anchored"), F.bool_or(exact).alias("exact"), F.bool_and(moment).alias("moments"),
    )
    one = (F.col("n") > 1) & ((F.col("n_audio") == 0) | (F.col("n_visual") == 0)) & ~F.col("exact") & ~F.col("moments")
    reason = F.when(F.col("best") < 0.15, "low best relevance at aggressive budget").when(F.col("anchored") & (F.col("n_audio") < 2) & (F.col("n_visual") >= 2), "aggressive budget underrepresented source audio evidence").when(one, "aggressive budget selected only one modality")
    return a.select(*group, reason.isNotNull().alias("expand"), reason.alias("reason"))


def allocate_slots(df: DataFrame, group: list[str], budget: int) -> DataFrame:
    """(group, segment, start, capacity, peak, mean) -> slots: one each by priority, then by priority over slots taken.

    Giving every segment's j-th slot the priority divided by j and taking the largest is the same as the loop; the
    first slots come first whatever their size."""
    rows = df.withColumn("priority", F.col("peak") + 0.5 * F.col("mean")).withColumn("capacity", F.greatest("capacity", F.lit(1)))
    slots = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), F.least(F.col("capacity"), F.lit(budget)))))
    by = [F.col("priority").desc(), F.col("capacity").desc(), F.col("start"), F.col("segment")]
    w = W.partitionBy(*group).orderBy(F.when(F.col("slot") == 1, 0).otherwise(1), (F.col("priority") / F.col("slot")).desc(), *by, "slot")
    taken = slots.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= budget)
    return rows.join(taken.groupBy(*group, "segment").agg(F.count(F.lit(1)).alias("slots")), [*group, "segment"], "left").withColumn("slots", F.coalesce("slots", F.lit(0)))


def rank_cards(cards: DataFrame, group: list[str]) -> DataFrame:
    """(group, id, t, likelihood) -> the cards shown, with ``place`` in time order: those within the ratio of the best and
    the nearest one shortly before the earliest of them, by likelihood up to the most shown."""
    w = W.partitionBy(*group)
    rows = cards.withColumns({"__best": F.max("likelihood").over(w), "__n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("__direct", (F.col("__best") > 0) & (F.col("likelihood") >= F.col("__best") * terms.CARD_KEEP_RATIO))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__direct"), F.col("t"))).over(w))
    gap = F.col("__first") - F.col("t")
    rows = rows.withColumn("__pre", F.coalesce((gap > 0) & (gap <= terms.CARD_PRE_CONTEXT_SECONDS), F.lit(False)))
    rows = rows.withColumn("__near", F.row_number().over(W.partitionBy(*group, "__pre").orderBy(gap, F.desc("likelihood"), "id")))
    few = F.col("__n") <= terms.MAX_CARDS
    rows = rows.withColumn("__in", few | F.col("__direct") | (F.col("__pre") & (F.col("__near") == 1)))
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(*group, "__in").orderBy(F.desc("likelihood"), "t", "id"))).filter(F.col("__in") & (few | (F.col("__r") <= terms.MAX_CARDS)))
    return rows.withColumn("place", F.row_number().over(w.orderBy("t", "id"))).select(*cards.columns, "place")
