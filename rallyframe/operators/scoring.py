"""Tennis scoring as an ordered fold of each match's points, and statistics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import ScoringConfig
from rallyframe.operators import folds

COUNTS = ("points_a", "points_b", "games_a", "games_b", "sets_a", "sets_b", "tie_a", "tie_b")
BOARD = "match_id long, point_number long, winner string, rejected boolean, in_tiebreak boolean, " + ", ".join(f"{c} int" for c in COUNTS) + ", match_winner string, events string"


class Score:
    """The state of one match. A point after its end is rejected and changes nothing."""

    def __init__(self, config: ScoringConfig):
        self.config, self.points, self.games, self.sets, self.tie = config, [0, 0], [0, 0], [0, 0], [0, 0]
        self.in_tiebreak, self.winner = False, None

    def award(self, w: int) -> list[str] | None:
        """The events of a point for player w (0 or 1) in order; None if it is rejected."""
        c, o = self.config, 1 - w
        if self.winner is not None:
            return None
        if self.in_tiebreak:
            self.tie[w] += 1
            if self.tie[w] < c.tiebreak_points_to_win or self.tie[w] - self.tie[o] < c.tiebreak_minimum_difference:
                return []
            self.games[w] += 1
            self.in_tiebreak = False
            return ["point", *self._set(w)]
        self.points[w] += 1
        if self.points[w] < 4 or self.points[w] - self.points[o] < 2:
            return ["point"]
        self.games[w] += 1
        self.points = [0, 0]
        events = ["game"]
        if c.enable_tiebreak and self.games[0] == self.games[1] == c.tiebreak_trigger_games:
            self.in_tiebreak = True
        elif self.games[w] >= c.games_to_win_set and self.games[w] - self.games[o] >= c.minimum_game_difference:
            events += self._set(w)
        return [*events, "point"]

    def _set(self, w: int) -> list[str]:
        self.sets[w] += 1
        if self.sets[w] >= self.config.sets_to_win_match:
            self.winner = w
            return ["set", "match"]
        self.games, self.points, self.tie, self.in_tiebreak = [0, 0], [0, 0], [0, 0], False
        return ["set"]


class Match:
    """Score as the state of a fold."""

    def __init__(self, config: ScoringConfig):
        self.score = Score(config)

    def step(self, number: int, winner: str):
        s = self.score
        events = s.award("AB".index(winner))
        return [(number, winner, events is None, s.in_tiebreak, *s.points, *s.games, *s.sets, *s.tie, None if s.winner is None else "AB"[s.winner], ",".join(events or []))]

    def end(self):
        return ()


def scoreboard(points: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """The score after each point. points: match_id, point_number (order), winner ('A' or 'B')."""
    return folds.folded(points, ["match_id"], ["point_number"], ["point_number", "winner"], lambda: Match(config), BOARD)


def _after(config: ScoringConfig, s: Column, w: Column) -> Column:
    """The state after a point for w (0 or 1), as Score.award gives it. won: -1 while the match goes on."""
    own, other = ({k: F.when(w == one, s[f"{k}a"]).otherwise(s[f"{k}b"]) for k in "pgst"} for one in (0, 1))
    over, tie = s["won"] >= 0, s["tie"]
    tie_won = (own["t"] + 1 >= config.tiebreak_points_to_win) & (own["t"] + 1 - other["t"] >= config.tiebreak_minimum_difference)
    game_won = ~tie & (own["p"] + 1 >= 4) & (own["p"] + 1 - other["p"] >= 2)
    g = own["g"] + 1
    starts_tie = game_won & F.lit(config.enable_tiebreak) & (g == config.tiebreak_trigger_games) & (other["g"] == config.tiebreak_trigger_games)
    set_won = (tie & tie_won) | (game_won & ~starts_tie & (g >= config.games_to_win_set) & (g - other["g"] >= config.minimum_game_difference))
    match_won = set_won & (own["s"] + 1 >= config.sets_to_win_match)
    fresh = set_won & ~match_won  # a match's last set stays on the board
    gained = (tie & tie_won) | game_won
    new = {
        "p": (F.when(fresh | game_won, 0).otherwise(F.when(tie, own["p"]).otherwise(own["p"] + 1)), F.when(fresh | game_won, 0).otherwise(other["p"])),
        "g": (F.when(fresh, 0).when(gained, g).otherwise(own["g"]), F.when(fresh, 0).otherwise(other["g"])),
        "s": (F.when(set_won, own["s"] + 1).otherwise(own["s"]), other["s"]),
        "t": (F.when(fresh, 0).when(tie, own["t"] + 1).otherwise(own["t"]), F.when(fresh, 0).otherwise(other["t"])),
    }
    name = lambda when, text: F.when(when, text)
    told = F.when(tie & ~tie_won, "").when(tie, F.concat_ws(",", F.lit("point"), F.lit("set"), name(match_won, "match"))).otherwise(F.concat_ws(",", name(game_won, "game"), name(set_won, "set"), name(match_won, "match"), F.lit("point")))
    side = lambda k, a: F.when(over, s[f"{k}{a}"]).when(w == int(a == "b"), new[k][0]).otherwise(new[k][1])
    return F.struct(
        *(side(k, a).cast("int").alias(f"{k}{a}") for k in "pgst" for a in "ab"), F.when(over, tie).otherwise(F.when(tie, ~tie_won).otherwise(starts_tie)).alias("tie"), F.when(over, s["won"]).when(match_won, w).otherwise(-1).cast("int").alias("won"),
        F.when(over, "").otherwise(told).alias("events"), over.alias("rejected"),
    )


def scoreboard_by_chunks(points: DataFrame, config: ScoringConfig = ScoringConfig(), chunk: int = 128) -> DataFrame:
    """scoreboard() without Python: the points of a match are cut into chunks, aggregate() folds a chunk from a state, and a second fold carries
    the state from chunk to chunk, so that no array of states is longer than a chunk's. Chunks of a match are one value while it is
    folded; scoreboard() takes matches of any length."""
    c = F.col
    order = Window.partitionBy("match_id").orderBy("point_number")
    rows = points.select("match_id", "point_number", (c("winner") == "B").cast("int").alias("w")).withColumn("n", F.row_number().over(order) - 1)
    chunks = rows.groupBy("match_id", F.floor(c("n") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("n", "point_number", "w"))).alias("points"))
    zero = F.struct(*(F.lit(0).alias(f"{k}{a}") for k in "pgst" for a in "ab"), F.lit(False).alias("tie"), F.lit(-1).alias("won"), F.lit("").alias("events"), F.lit(False).alias("rejected"))
    whole = chunks.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "points"))).alias("chunks"))
    # the state before each chunk, then the states inside of it
    step = lambda s, p: _after(config, s, p["w"])
    starts = F.aggregate("chunks", F.array(zero), lambda acc, k: F.concat(acc, F.array(F.aggregate(k["points"], F.element_at(acc, -1), step))))
    begun = whole.select("match_id", F.inline(F.zip_with("chunks", F.slice(starts, 1, F.size("chunks")), lambda k, s: F.struct(k["points"].alias("points"), s.alias("start")))))
    states = F.aggregate("points", F.array("start"), lambda acc, p: F.concat(acc, F.array(step(F.element_at(acc, -1), p))), lambda acc: F.slice(acc, 2, F.greatest(F.size(acc) - 1, F.lit(1))))
    out = begun.select("match_id", F.inline(F.zip_with("points", states, lambda p, s: F.struct(p["point_number"].alias("point_number"), p["w"].alias("w"), s.alias("s")))))
    who = lambda v: F.when(v == 0, "A").when(v == 1, "B")
    counts = (c(f"s.{k}{a}").alias(f"{long}_{a}") for k, long in zip("pgst", ("points", "games", "sets", "tie"), strict=True) for a in "ab")
    return out.select("match_id", "point_number", who(c("w")).alias("winner"), c("s.rejected").alias("rejected"), c("s.tie").alias("in_tiebreak"), *counts, who(c("s.won")).alias("match_winner"), c("s.events").alias("events"))


def point_display(own: Column, other: Column, in_tiebreak: Column, tie: Column) -> Column:
    """0, 15, 30, 40 or AD; the raw points in a tie-break."""
    plain = F.element_at(F.array(*map(F.lit, ("0", "15", "30", "40"))), F.least(own, F.lit(3)) + 1)
    return F.when(in_tiebreak, tie.cast("string")).when((own >= 3) & (other >= 3) & (own > other), "AD").otherwise(plain)


def displayed(board: DataFrame) -> DataFrame:
    """Adds show_a, show_b, status and leader."""
    c = F.col
    deuce = (c("points_a") >= 3) & (c("points_b") >= 3)
    status = F.when(c("in_tiebreak"), "TIEBREAK").when(deuce & (c("points_a") == c("points_b")), "DEUCE").when(deuce, "ADVANTAGE").otherwise("NORMAL")

    def ahead(kind: str, rest: Column) -> Column:
        a, b = c(f"{kind}_a"), c(f"{kind}_b")
        return F.when(a > b, "A").when(b > a, "B").otherwise(rest)

    leader = F.coalesce(c("match_winner"), ahead("sets", ahead("games", ahead("points", F.lit("TIED")))))
    return board.withColumns(
        {"show_a": point_display(c("points_a"), c("points_b"), c("in_tiebreak"), c("tie_a")), "show_b": point_display(c("points_b"), c("points_a"), c("in_tiebreak"), c("tie_b")), "status": status, "leader": leader}
    )


def final_states(board: DataFrame) -> DataFrame:
    """The last score of each match."""
    last = F.max_by(F.struct(*COUNTS, "in_tiebreak", "match_winner"), "point_number").alias("s")
    sums = board.groupBy("match_id").agg(F.count("*").alias("points_played"), F.count_if("rejected").alias("rejected"), last)
    return sums.select("match_id", "points_played", "rejected", "s.*")


def match_statistics(board: DataFrame, points_won_mode: str = "event_log") -> DataFrame:
    """Points won, share and leader by match. `event_log` counts only points that gave a `point` event (tie-break points that
    don't end the tie-break give none); `all_points` counts every point that wasn't rejected."""
    if points_won_mode not in ("event_log", "all_points"):
        raise ValueError(points_won_mode)
    counted = ~F.col("rejected") & (F.array_contains(F.split("events", ","), "point") if points_won_mode == "event_log" else F.lit(True))
    won = lambda p: F.count_if(counted & (F.col("winner") == p))
    sums = board.groupBy("match_id").agg(won("A").alias("won_a"), won("B").alias("won_b"), F.count_if(F.array_contains(F.split("events", ","), "game")).alias("games_events"))
    total = F.col("won_a") + F.col("won_b")
    rate = lambda p: F.coalesce(F.round(F.try_divide(100.0 * F.col(p), total), 2), F.lit(0.0))
    leader = F.when(F.col("won_a") > F.col("won_b"), "A").when(F.col("won_b") > F.col("won_a"), "B").otherwise("TIED")
    return sums.withColumns({"total_points": total, "win_rate_a": rate("won_a"), "win_rate_b": rate("won_b"), "points_leader": leader})
