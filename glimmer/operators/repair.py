"""Coverage rules: a selection is repaired until it holds the kinds of evidence that its question needs.

A group is one row with ``pool``, all its candidates, and ``sel``, those chosen, in order of choice; both are arrays of
structs (id, modality, t, z, relevance, mmr, anchor_t, anchor_score, text), where mmr of the pool is what a row brings
when a rule puts it in. All rules are built from two steps over the array of chosen rows: insert, and evict the weakest
of a class that may go while a floor of it stays. A rule is a fold of these over its incoming rows, in order, until a
target is met or nothing may go, so it stays in the JVM and all groups are repaired in one job. Selections are as small
as the budget; a rule passes over its pool once to order what comes in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms

VISUAL, AUDIO = "y.modality = 'visual'", "y.modality = 'audio'"
ANCHORED = f"y.modality = 'visual' and coalesce(y.anchor_score, 0D) >= {terms.ANCHOR_MIN_SCORE}D"
SURE_TEXT = "y.modality = 'visual' and startswith(lower(y.text), 'on-screen text near') and y.relevance >= 0.95D"
FIELDS = ["id", "modality", "t", "z", "relevance", "mmr", "anchor_t", "anchor_score", "text"]

Evict = Callable[[str], str]


def evict(may_go: str, floor: int = 0) -> Evict:
    """The selection without the first of the weakest rows y that may go; null where no more than ``floor`` rows may."""

    def of(sel: str) -> str:
        weakest = f"array_min(transform({sel}, (y, i) -> if({may_go}, named_struct('mmr', y.mmr, 'i', i, 'id', y.id), null)))"
        return f"if(size(filter({sel}, y -> {may_go})) <= {floor}, null, transform(array({weakest}), v -> filter({sel}, y -> y.id <> v.id))[0])"

    return of


def evict_audio_first(sel: str) -> str:
    return f"coalesce({evict(AUDIO)(sel)}, {evict(VISUAL)(sel)})"


def ordered(candidates: str, keys: list[str]) -> str:
    """Candidates x by the keys, ascending, then time and id."""
    fields = ", ".join(f"'k{i}', {k}" for i, k in enumerate([*keys, "x.t", "x.id"]))
    return f"transform(array_sort(transform({candidates}, x -> named_struct({fields}, 'x', x))), o -> o.x)"


def unchosen(condition: str, sel: str = "sel") -> str:
    return f"filter(pool, x -> {condition.replace('y.', 'x.')} and not exists({sel}, y -> y.id = x.id))"


def count(condition: str, of: str = "sel") -> str:
    return f"size(filter({of}, y -> {condition}))"


def filled(incoming: str, have: str, target: str, k: str, evicted: Evict, sel: str = "sel") -> str:
    """The repair fold: incoming rows go in until ``target`` of what ``have`` counts are there; where the budget k is
    full one goes out for each, and the fold ends when none may."""
    step = f"""transform(array(if(size(acc.sel) >= {k}, {evicted('acc.sel')}, acc.sel)),
        s -> if(s is null, named_struct('sel', acc.sel, 'n', acc.n, 'done', true), named_struct('sel', array_append(s, x), 'n', acc.n + 1, 'done', false)))[0]"""
    return f"aggregate({incoming}, named_struct('sel', {sel}, 'n', {have}, 'done', false), (acc, x) -> if(acc.done or acc.n >= {target}, acc, {step}), acc -> acc.sel)"


def best_first(n: str, sel: str = "sel") -> str:
    """The n strongest chosen rows, in order of strength, earlier choices first."""
    return f"slice(transform(array_sort(transform({sel}, (y, i) -> named_struct('m', -y.mmr, 'i', i, 'y', y))), o -> o.y), 1, {n})"


def anchor_sources(k: str) -> str:
    """Chosen visuals that heard evidence supports bring that evidence: up to min(4, max(2, k // 3)) audio rows, the
    anchors' own, for the weakest anchored visuals."""
    own = unchosen(AUDIO).replace("not exists", f"exists(filter(sel, y -> {ANCHORED} and y.anchor_t is not null), y -> abs(x.t - y.anchor_t) < 1e-6D) and not exists")
    return filled(ordered(own, ["-x.relevance", "-x.z"]), count(AUDIO), f"least(4, greatest(2, cast({k} div 3 as int)))", k, evict(ANCHORED))


def opening_frame() -> str:
    """The earliest frame that bears text, else the earliest frame."""
    frames = [f"filter(pool, x -> x.modality = 'visual'{more})" for more in (" and startswith(lower(x.text), 'on-screen text')", "")]
    return f"coalesce({', '.join(f'get({ordered(f, [])}, 0)' for f in frames)})"


def opening(k: str) -> str:
    """For a question about the opening: its frame comes in, the strongest k - 1 others stay."""
    return f"""transform(array({opening_frame()}), x -> if(x is null or exists(sel, y -> y.id = x.id), sel,
        array_append({best_first(f'greatest({k} - 1, 0)')}, x)))[0]"""


def pair_coverage(k: str) -> str:
    """``anchor`` and ``target``, the best directed pair (null if there is none), come in with the strength of their
    roles; the strongest k - 2 others stay."""
    others = best_first(f"greatest({k} - 2, 0)", "filter(sel, y -> y.id not in (anchor.id, target.id))")
    return f"if(anchor is null or target is null, sel, concat({others}, array(anchor, target)))"


def counting_neighbors(k: str, reach: float = 12.0) -> str:
    """Each chosen visual in turn, the strongest first, claims its nearest unclaimed visual within reach; they come in
    for the weakest audio, then the weakest visuals."""
    near = f"filter(filter(pool, x -> x.modality = 'visual' and abs(x.t - v.t) <= {reach}D), x -> not exists(sel, y -> y.id = x.id) and not exists(acc, y -> y.id = x.id))"
    claim = f"transform(array(get({ordered(near, ['abs(x.t - v.t)', '-x.z'])}, 0)), x -> if(x is null, acc, array_append(acc, x)))[0]"
    claims = f"aggregate({ordered(f'filter(sel, y -> {VISUAL})', ['-x.z', '-x.relevance'])}, slice(pool, 1, 0), (acc, v) -> {claim})"
    return filled(claims, "0", "size(pool)", k, evict_audio_first)


def visual_coverage(k: str) -> str:
    """Half the budget, two at least, are visuals, unless a chosen one's text answers surely."""
    target = f"least({count(VISUAL, 'pool')}, greatest(2, cast({k} div 2 as int)))"
    return f"if(exists(sel, y -> {SURE_TEXT}), sel, {filled(ordered(unchosen(VISUAL), ['-x.z', '-x.relevance']), count(VISUAL), target, k, evict_audio_first)})"


def negative_coverage(k: str) -> str:
    """Half the budget, three at least, is audio: what is said must be compared with what is not."""
    return filled(ordered(unchosen(AUDIO), ["-x.z", "-x.relevance"]), count(AUDIO), f"least({k}, greatest(3, cast({k} div 2 as int)))", k, evict(VISUAL))


def required(kind: str, other: str, k: str) -> str:
    """One row of a kind at least: the best comes in for the weakest other, of which one stays."""
    return filled(f"slice({ordered(unchosen(kind), ['-x.relevance', '-x.z'])}, 1, 1)", count(kind), "1", k, evict(other, 1))


def nearby_audio(k: str) -> str:
    """A third of the budget, two at least, is audio next to a chosen visual, nearest first, for the weakest visuals, of
    which two stay."""
    gap = f"array_min(transform(filter(sel, y -> {VISUAL}), y -> abs(x.t - y.t)))"
    target = f"least({count(AUDIO, 'pool')}, greatest(2, cast({k} div 3 as int)))"
    return f"if({count(VISUAL)} = 0, sel, {filled(ordered(unchosen(AUDIO), [gap, '-x.z', '-x.relevance']), count(AUDIO), target, k, evict(VISUAL, 2))})"


def _third(row: str) -> str:
    return f"least(cast(({row}.t - heard.lo) / heard.span * 3 as int), 2)"


#: (start, length) of what is heard; a column that ``global_coverage`` reads.
HEARD = "transform(array(transform(filter(pool, y -> y.modality = 'audio'), y -> y.t)), ts -> named_struct('lo', array_min(ts), 'span', greatest(array_max(ts) - array_min(ts), 1D)))[0]"


def global_coverage(k: str) -> str:
    """Each third of what is heard has a chosen row: the best of a third without one comes in for the weakest audio of a
    third with several, else for the weakest visual while one stays, else the rule ends."""
    crowded = f"{AUDIO} and size(filter(acc.sel, w -> w.modality = 'audio' and {_third('w')} = {_third('y')})) > 1"
    best = ordered(f"filter(pool, x -> x.modality = 'audio' and {_third('x')} = third)", ["-x.z", "-x.relevance"])
    step = f"""transform(array(if(size(acc.sel) >= {k}, coalesce({evict(crowded)('acc.sel')}, {evict(VISUAL, 1)('acc.sel')}), acc.sel)),
        s -> if(s is null, named_struct('sel', acc.sel, 'done', true), named_struct('sel', array_append(s, get({best}, 0)), 'done', false)))[0]"""
    settled = f"acc.done or get({best}, 0) is null or exists(acc.sel, y -> {AUDIO} and {_third('y')} = third)"
    return f"if({count(AUDIO, 'pool')} = 0, sel, aggregate(array(0, 1, 2), named_struct('sel', sel, 'done', false), (acc, third) -> if({settled}, acc, {step}), acc -> acc.sel))"


def states(pool: DataFrame, chosen: DataFrame, group: list[str]) -> DataFrame:
    """Groups as one row: ``pool`` from all candidates, ``sel`` from (group, id, rank, mmr) of the chosen ones."""
    both = pool.join(chosen.select(*group, "id", "rank", F.col("mmr").alias("own")), [*group, "id"], "left")
    row = F.struct(*[F.col("z").alias("mmr") if f == "mmr" else F.col(f) for f in FIELDS])
    picked = F.struct(*[F.col("own").alias("mmr") if f == "mmr" else F.col(f) for f in FIELDS])
    sel = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", picked.alias("y")))))
    g = both.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("t", "id", row.alias("x")))).alias("pool"), sel.alias("sel"))
    return g.select(*group, F.transform("pool", lambda p: p["x"]).alias("pool"), F.transform("sel", lambda p: p["y"]).alias("sel"))


def repair(rows: DataFrame, k: int, opens: str = "false", pair: bool = False, near: float = 12.0) -> DataFrame:
    """(pool, sel, intent) and, with ``pair``, (anchor, target) -> sel after the rules of the group's intent, in order.
    ``opens`` is SQL: does the question ask about the opening? ``near``: seconds to a counted visual's neighbours."""
    budget = str(k)

    def when(intent: str, rule: str, more: str = "true"):
        return F.expr(f"if(intent = '{intent}' and {more}, {rule}, sel)")

    rows = rows.withColumn("sel", F.expr(anchor_sources(budget)))
    rows = rows.withColumn("sel", when("visual_object_action", opening(budget), opens))
    if pair:
        rows = rows.withColumn("sel", when("temporal_before_after", pair_coverage(budget)))
    rows = rows.withColumn("sel", when("counting_comparison", counting_neighbors(budget, near)))
    rows = rows.withColumn("sel", when("visual_object_action", visual_coverage(budget)))
    both = f"{k} >= 2 and {count(VISUAL, 'pool')} > 0 and {count(AUDIO, 'pool')} > 0"
    for rule in (required(AUDIO, VISUAL, budget), required(VISUAL, AUDIO, budget), nearby_audio(budget)):
        rows = rows.withColumn("sel", when("mixed_av", rule, both))
    rows = rows.withColumn("heard", F.expr(HEARD)).withColumn("sel", when("global_summary", global_coverage(budget)))
    return rows.withColumn("sel", when("negative_evidence", negative_coverage(budget))).drop("heard")


def rows_of(repaired: DataFrame, group: list[str]) -> DataFrame:
    """(group, rank, id, modality, t, mmr, ...): the repaired selections, ranks counted anew."""
    return repaired.select(*group, F.posexplode_outer("sel").alias("i", "x")).filter("i is not null").select(*group, (F.col("i") + 1).alias("rank"), "x.*")
