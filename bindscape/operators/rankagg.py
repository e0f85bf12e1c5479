"""Rank aggregation over ``(group..., expert, item, rank | score)`` tables.

Rank 1 is best.  Ties are broken by item everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindscape.functions.prefix import running_by_value, value_index
from bindscape.functions.session import broadcast_if_small, settle


def to_ranks(scores: DataFrame, *, group: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Scores (higher = better) to ranks 1..n within each expert."""
    return value_index(scores, [*group, "expert"], score, ["item"], name="rank", descending=True)


def item_universe(ranks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return ranks.select(*group, "item").distinct()


def _sizes(ranks: DataFrame, group: Sequence[str]) -> DataFrame:
    return ranks.groupBy(*group).agg(
        F.count_distinct("item").alias("n_items"), F.count_distinct("expert").alias("n_experts")
    )


def _attach(df: DataFrame, small: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add per-group constants: a join on the group, or one row's values."""
    if group:
        return df.join(broadcast_if_small(small.select(*group, *names)), list(group))
    row = small.select(*names).first()
    return df.withColumns({n: F.lit(row[n]) for n in names})


def _rank_items(scored: DataFrame, group: Sequence[str], *, descending: bool = True) -> DataFrame:
    return value_index(scored, group, "score", ["item"], name="rank", descending=descending).select(
        *group, "item", "score", "rank"
    )


def first_order_marginals(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Share of experts that put each item at each rank."""
    counted = ranks.groupBy(*group, "item", "rank").agg(F.count(F.lit(1)).alias("n"))
    sized = _attach(counted, _sizes(ranks, group), group, ["n_experts"])
    return sized.select(*group, "item", "rank", (F.col("n") / F.col("n_experts")).alias("share"))


def supplement(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Full lists: items an expert left out get that expert's largest rank + 1.

    The result is the whole expert-by-item table by definition.
    """
    group = list(group)
    last = ranks.groupBy(*group, "expert").agg((F.max("rank") + 1).alias("__sup"))
    experts = last.groupBy(*group).agg(F.collect_list(F.struct("expert", "__sup")).alias("__experts"))
    items = item_universe(ranks, group)
    if group:
        full = items.join(experts, group)
    else:
        full = items.withColumn("__experts", experts.scalar())
    full = full.select(*group, "item", F.explode("__experts").alias("e")).select(*group, "item", "e.*")
    return full.join(ranks.select(*group, "expert", "item", "rank"), [*group, "expert", "item"], "left").select(
        *group, "expert", "item", F.coalesce("rank", "__sup").alias("rank")
    )


def _geo(c: str) -> Column:
    return F.exp(F.avg(F.log(c)))


# statistic of the supplemented ranks, by name
STATISTICS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "median": F.median, "geo": _geo}


def partial_borda(ranks: DataFrame, *, stat: str = "mean", group: Sequence[str] = ()) -> DataFrame:
    """Mean / median / geometric mean of supplemented ranks, small = best.

    Mean and geo need no dense table: an item's missing part is the total over
    all experts minus the experts that did rank it.
    """
    group = list(group)
    if stat == "median":
        scored = supplement(ranks, group=group).groupBy(*group, "item").agg(
            STATISTICS[stat]("rank").cast("double").alias("score")
        )
        return _rank_items(scored, group, descending=False)
    shape = (lambda c: c) if stat == "mean" else F.log
    last = broadcast_if_small(ranks.groupBy(*group, "expert").agg((F.max("rank") + 1).alias("__sup")))
    totals = last.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_experts"), F.sum(shape(F.col("__sup")).cast("double")).alias("all_sup")
    )
    seen = ranks.join(last, [*group, "expert"]).groupBy(*group, "item").agg(
        F.sum((shape(F.col("rank")) - shape(F.col("__sup"))).cast("double")).alias("gain")
    )
    level = (F.col("all_sup") + F.col("gain")) / F.col("n_experts")
    scored = _attach(seen, totals, group, ["n_experts", "all_sup"]).select(
        *group, "item", F.round(level if stat == "mean" else F.exp(level), 10).alias("score")
    )
    return _rank_items(scored, group, descending=False)


def modified_borda(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Sum of (m + 1 - r) over the experts that ranked the item, m = list length."""
    lengths = ranks.groupBy(*group, "expert").agg(F.count(F.lit(1)).alias("m"))
    scored = ranks.join(broadcast_if_small(lengths), [*group, "expert"]).groupBy(*group, "item").agg(
        F.sum(F.col("m") + 1 - F.col("rank")).alias("score")
    )
    return _rank_items(scored, group)


def l1_ranks(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Sum over k of m_ik (n - k)."""
    sized = _attach(ranks, _sizes(ranks, group), group, ["n_items", "n_experts"])
    scored = sized.groupBy(*group, "item").agg(
        (F.sum(F.col("n_items") - F.col("rank")) / F.max("n_experts")).alias("score")
    )
    return _rank_items(scored, group)


def _by_item(ranks: DataFrame, group: Sequence[str], expr: Callable[[Column, Column], Column]) -> DataFrame:
    sized = _attach(ranks, _sizes(ranks, group), group, ["n_items", "n_experts"])
    scored = sized.groupBy(*group, "item").agg(expr(F.col("rank"), F.col("n_items")).alias("score"))
    return _rank_items(scored, group)


def borda(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    return _by_item(ranks, group, lambda r, n: F.sum(n - r))


def _stable(r: Column, n: Column, theta) -> Column:
    return F.sum((r <= (n / 2 if theta is None else F.lit(theta))).cast("bigint"))


def _expo(r: Column, n: Column, theta) -> Column:
    return F.sum(F.exp(-r / (n / 2 if theta is None else F.lit(theta))))


def stability(ranks: DataFrame, *, theta: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    return _by_item(ranks, group, lambda r, n: _stable(r, n, theta))


def exponential(ranks: DataFrame, *, theta: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    return _by_item(ranks, group, lambda r, n: F.round(_expo(r, n, theta), 10))


def stability_borda(ranks: DataFrame, *, theta: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    return _by_item(ranks, group, lambda r, n: F.sum(n - r) * _stable(r, n, theta))


def exponential_borda(ranks: DataFrame, *, theta: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    return _by_item(ranks, group, lambda r, n: F.round(F.sum(n - r) * _expo(r, n, theta), 8))


def highest_rank(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    scored = ranks.groupBy(*group, "item").agg(F.min("rank").alias("score"))
    return _rank_items(scored, group, descending=False)


def lowest_rank(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    scored = ranks.groupBy(*group, "item").agg(F.max("rank").alias("score"))
    return _rank_items(scored, group, descending=False)


def _numbered(ranks: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every item's ranks in ascending order with their position ``k`` (1-based).

    An item has one rank per expert, so the window is as long as the panel.
    """
    order = Window.partitionBy(*group, "item").orderBy("rank", "expert")
    sized = _attach(ranks, _sizes(ranks, group), group, ["n_items", "n_experts"])
    return sized.withColumn("k", F.row_number().over(order))


def median_rank(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Rank by which at least half of the lists have placed the item."""
    scored = (
        _numbered(ranks, group)
        .where(F.col("k") == F.ceil(F.col("n_experts") / 2))
        .select(*group, "item", F.col("rank").alias("score"))
    )
    return _rank_items(scored, group, descending=False)


def binomial_upper_tail(n: Column, k: Column, x: Column) -> Column:
    """P(Bin(n, x) >= k), summed in log form."""
    tail = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.struct(F.lit(0.0).alias("lc"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct(
            (a["lc"] + F.log((n - i + 1) / i)).alias("lc"),
            (
                a["s"]
                + F.when(
                    i >= k, F.exp(a["lc"] + F.log((n - i + 1) / i) + i * F.log(x) + (n - i) * F.log(1 - x))
                ).otherwise(F.lit(0.0))
            ).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when(x >= 1, F.lit(1.0)).otherwise(tail)


def robust(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Robust rank aggregation: 1 - min over k of P(Bin(n, r_(k)/N) >= k)."""
    x = F.col("rank") / F.col("n_items")
    beta = binomial_upper_tail(F.col("n_experts"), F.col("k"), x)
    scored = _numbered(ranks, group).groupBy(*group, "item").agg(
        F.round(1.0 - F.min(beta), 10).alias("score")
    )
    return _rank_items(scored, group)


def round_robin(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Experts take turns (in expert order) to place their best item left.

    Turn t of the list belongs to expert t mod E.  Solved by proposals: each
    turn proposes down its expert's list, each item keeps its earliest turn,
    and refused turns move on; the fixed point is the turn-by-turn result.  Every
    round moves some turn down its list, so the rounds end.
    """
    group = list(group)
    order = Window.partitionBy(*group).orderBy("expert")
    experts = ranks.select(*group, "expert").distinct().withColumn("e", F.row_number().over(order) - 1)
    sized = _attach(ranks.join(experts, [*group, "expert"]), _sizes(ranks, group), group, ["n_items", "n_experts"])
    lists = settle(sized.select(*group, "item", "e", "rank", "n_items", "n_experts"))
    # turn of (expert e, own turn m) = m * E + e; own turn m cannot do better than its rank m + 1
    turn = (F.col("rank") - 1) * F.col("n_experts") + F.col("e")
    state = lists.select(*group, "e", turn.alias("turn"), F.col("rank").alias("at"), "n_items").where("turn < n_items")
    while True:
        asked = state.join(
            lists.select(*group, "e", F.col("rank").alias("at"), "item"), [*group, "e", "at"]
        )
        kept = asked.groupBy(*group, "item").agg(F.min("turn").alias("best"))
        asked = settle(asked.join(kept, [*group, "item"]))
        refused = asked.where("turn <> best").count()
        if refused == 0:
            return asked.select(*group, "item", (F.col("turn") + 1).cast("bigint").alias("rank"))
        state = asked.select(
            *group, "e", "turn", (F.col("at") + (F.col("turn") != F.col("best")).cast("int")).alias("at"), "n_items"
        )


def footrule_costs(ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Cost of putting each item at each position: scaled sum of |rank - p|.

    The item-by-position table is the result by definition.
    """
    sized = _attach(
        ranks.groupBy(*group, "item").agg(F.collect_list("rank").alias("__r")),
        _sizes(ranks, group), group, ["n_items"],
    )
    n = F.col("n_items")
    total = F.aggregate("__r", F.lit(0).cast("bigint"), lambda a, r: a + F.abs(r - F.col("position")))
    return sized.withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), n))).select(
        *group, "item", "position", (total * 2.0 / (n * n - n % 2)).alias("cost")
    )


def kemeny_pass(start: DataFrame, ranks: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """One local pass: walk the items in rank order and swap the ranks of
    neighbours when that lowers the summed Kendall distance to the experts.

    A run of swaps carries one low rank forward; where no swap happens the
    walk starts afresh.  So the run that would begin at every item is followed
    for all items at once (one more item per round), and the runs the walk
    really takes are found by jumping from run end to run end.
    ``start`` ranks the items 1..n.
    """
    group = list(group)
    votes = settle(
        ranks.join(start.select(*group, "item", (F.col("rank") - 1).alias("at")), [*group, "item"])
        .select(*group, "at", "item", "expert", F.col("rank").alias("vote"))
    )
    nxt = votes.select(*group, (F.col("at") - 1).alias("end"), "expert", F.col("vote").alias("next"))
    # "carried" holds the low rank now; "passed" lie between it and the next item
    state = votes.select(
        *group, F.col("at").alias("first"), "expert", F.col("at").alias("end"), F.col("vote").alias("carried"),
        F.array().cast("array<bigint>").alias("passed"),
    )
    finished: DataFrame | None = None
    while True:
        step = state.join(nxt, [*group, "end", "expert"])
        gain = F.signum(F.col("next") - F.col("carried")) + F.aggregate(
            "passed", F.lit(0.0),
            lambda a, s: a + F.signum(s - F.col("carried")) + F.signum(F.col("next") - s),
        )
        swaps = step.groupBy(*group, "first").agg(F.sum(gain).alias("change")).where("change < 0")
        alive = settle(
            step.join(swaps.select(*group, "first"), [*group, "first"], "left_semi").select(
                *group, "first", "expert", (F.col("end") + 1).alias("end"), F.col("next").alias("carried"),
                F.concat("passed", F.array("carried")).alias("passed"),
            )
        )
        ended = settle(
            state.select(*group, "first", "end").distinct().join(
                alive.select(*group, "first").distinct(), [*group, "first"], "left_anti"
            )
        )
        finished = ended if finished is None else finished.unionByName(ended)
        if alive.limit(1).count() == 0:
            break
        state = alive
    runs = settle(finished)
    # runs reached from item 0: each round doubles the length of the jumps
    jump = runs.select(*group, "first", (F.col("end") + 1).alias("to"))
    reached = settle(runs.where("first = 0").select(*group, "first"))
    size = reached.count()
    while True:
        more = reached.join(jump, [*group, "first"]).select(*group, F.col("to").alias("first"))
        reached = settle(reached.unionByName(more).distinct())
        if reached.count() == size:
            break
        size = reached.count()
        onward = jump.select(*group, F.col("first").alias("to"), F.col("to").alias("__to"))
        jump = settle(jump.join(onward, [*group, "to"]).select(*group, "first", F.col("__to").alias("to")))
    taken = runs.join(reached, [*group, "first"], "left_semi")
    placed = taken.withColumn("at", F.explode(F.sequence("first", "end"))).select(
        *group, "at", F.when(F.col("at") == F.col("end"), F.col("first") + 1).otherwise(F.col("at") + 2).alias("rank")
    )
    items = start.select(*group, "item", (F.col("rank") - 1).alias("at"))
    return items.join(placed, [*group, "at"]).select(*group, "item", "rank")


def footrule_distance(ranks: DataFrame, target: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Spearman footrule of every expert to the ``target`` ranking."""
    other = target.select(*group, "item", F.col("rank").alias("__t"))
    return ranks.join(other, [*group, "item"]).groupBy(*group, "expert").agg(
        (2.0 * F.sum(F.abs(F.col("rank") - F.col("__t"))) / (F.count(F.lit(1)) * F.count(F.lit(1)))).alias("footrule")
    )


def kendall_distance(ranks: DataFrame, target: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Kendall tau distance of every expert to the ``target`` ranking.

    Counts discordant pairs without forming pairs: two target ranks first
    differ at one binary digit, so for each digit the items sharing the higher
    digits are ordered by the expert's rank and inversions between digit 0 and
    digit 1 are read off a running count.
    """
    keys = [*group, "expert"]
    other = target.select(*group, "item", (F.col("rank") - 1).alias("__t"))
    both = ranks.join(other, [*group, "item"])
    top = both.agg(F.max("__t")).first()[0]
    bits = range(max(1, int(top).bit_length()))
    rows = both.select(
        *keys, "rank", "__t", F.explode(F.array(*[F.lit(b) for b in bits])).alias("bit")
    ).withColumn("__digit", F.expr("shiftright(__t, bit) & 1")).withColumn("__high", F.expr("shiftright(__t, bit + 1)"))
    by = [*keys, "bit", "__high"]
    flat = settle(
        rows.groupBy(*by, "rank").agg(
            F.sum("__digit").cast("bigint").alias("ones"), F.sum(1 - F.col("__digit")).cast("bigint").alias("zeros")
        )
    )
    run = running_by_value(flat, by, "rank", sums={"__ones": "ones"})
    bad = run.groupBy(*keys).agg(F.sum(F.col("zeros") * (F.col("__ones") - F.col("ones"))).alias("discordant"))
    size = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return bad.join(size, keys).select(
        *keys, (2.0 * F.col("discordant") / (F.col("n") * (F.col("n") - 1))).alias("kendall")
    )


# method name -> function, for full and for partial lists
FULL_METHODS = {
    "borda": borda, "median": median_rank, "highest": highest_rank, "lowest": lowest_rank,
    "stability": stability, "exponential": exponential, "sborda": stability_borda,
    "eborda": exponential_borda, "robust": robust, "rrobin": round_robin,
}
PARTIAL_METHODS = {"borda": partial_borda, "modborda": modified_borda, "lone": l1_ranks}


def aggregate_ranks(
    long: DataFrame, *, method: str = "borda", scores: bool = True, partial: bool = False,
    stat: str = "mean", theta: float | None = None, group: Sequence[str] = (),
) -> DataFrame:
    """Combine expert lists with a named method."""
    methods = PARTIAL_METHODS if partial else FULL_METHODS
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; choose from {sorted(methods)}")
    ranks = to_ranks(long, group=group) if scores else long
    options = {"group": group}
    if partial and method == "borda":
        options["stat"] = stat
    if theta is not None and method in ("stability", "exponential", "sborda", "eborda"):
        options["theta"] = theta
    return methods[method](ranks, **options)
