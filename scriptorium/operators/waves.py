"""Search in waves: candidates are scored a few places at a time, and targets that are through leave.

The candidates of a block, in one order, are those of all its targets.  Each wave scores
the next places for the targets that are left, is written to the shared folder, and lets
those go that a search in order would have ended for: so what stands late is scored only
where it is looked at, or a little beyond.  What was seen is then what `early_exit` says of
all waves, as if every candidate had been scored.

Where scores have a bound that costs less than they do, a pair whose bound is no more than the
best score of its target so far is not scored: it cannot be the best, of equals the first wins,
and it cannot end the search.  Its score is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.folder import new_folder, written
from scriptorium.operators import matching

#: Places up to which each wave scores; the search may end after the first wave.
WAVES = (5, 15, 50)


Pairs = Callable[[DataFrame, DataFrame], DataFrame]


def search(targets: DataFrame, candidates: DataFrame, block: str, target: str, pos: str, score: Pairs, settings: matching.MatchSettings = matching.DEFAULTS, waves: tuple[int, ...] = WAVES, bound: Pairs | None = None) -> DataFrame:
    """The candidates seen, with `seen` from 0; score(targets, candidates) gives target, pos, score and more for the pairs of a block.

    With bound(targets, candidates), which gives all pairs with `bound` and what their score needs,
    score(pairs, None) scores those that are worth it; other pairs have null for what it gives.
    """
    ends = [w for w in waves if settings.skip_from < w < settings.give_up] + [settings.give_up]
    folder = new_folder(targets.sparkSession, "waves")
    numbered = written(matching.first_of_block(candidates, block, pos, settings.give_up, keep="number"), f"{folder}/candidates")
    left, scored, best, begin = targets, None, None, 0
    for k, end in enumerate(ends):
        part = numbered.where((F.col("number") > begin) & (F.col("number") <= end)).drop("number")
        if bound is None:
            wave = written(score(left, part), f"{folder}/{k}")
        else:
            pairs = bound(left, part)
            pairs = written(pairs.join(best, target, "left") if best is not None else pairs.withColumn("best", F.lit(None).cast("double")), f"{folder}/pairs {k}")
            worth = F.col("best").isNull() | (F.col("bound") > F.col("best"))
            found = score(pairs.where(worth).drop("bound", "best"), None)
            wave = written(found.unionByName(pairs.where(~worth).select(target, pos), allowMissingColumns=True), f"{folder}/{k}")
        scored = wave if scored is None else scored.unionByName(wave)
        if end < settings.give_up:
            sums = scored.groupBy(target).agg(F.max("score").alias("best"), F.count("*").alias("n"))
            best = sums.select(target, "best")
            through = sums.where((F.col("best") > settings.skip_score) & (F.col("n") > settings.skip_from))
            left = written(left.join(through.select(target), target, "left_anti"), f"{folder}/left {k}")
        begin = end
    return matching.early_exit(scored, target, pos, settings=settings)


def best(targets: DataFrame, candidates: DataFrame, block: str, target: str, pos: str, score: Pairs, settings: matching.MatchSettings = matching.DEFAULTS, bound: Pairs | None = None) -> DataFrame:
    """The best candidate seen; of equals the first."""
    return matching.best_match(search(targets, candidates, block, target, pos, score, settings, bound=bound), target, pos, settings=settings)
