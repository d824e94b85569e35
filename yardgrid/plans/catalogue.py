"""The query catalogue: one entry per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from yardgrid.functions.geometry import add_foci, ellipse_axes, radius, raw_velocity
from yardgrid.functions.nulls import zero_nulls
from yardgrid.functions.scoring import logistic, tackle_probability
from yardgrid.operators import clean as cleaning
from yardgrid.operators import contact as contacts
from yardgrid.operators import control as controls
from yardgrid.operators import grades as grading
from yardgrid.operators import influence as spreading
from yardgrid.operators import models, profile
from yardgrid.operators import play_view as views
from yardgrid.operators import quality as qualities
from yardgrid.operators import tackles as tackling
from yardgrid.plans.adapter import Season
from yardgrid.session import configure, fan_out, settle, shared_folder
from yardgrid.sources import signal, stages, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

KEYS = ["gameId", "playId", "frameId", "nflId"]
FRAME = ["game", "play", "frame"]
# Contacts are rare in the given tables, so contact queries reach further than a tackle would.
CONTACT_REACH = 8


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Whole numbers as longs and doubles rounded, so that engines can be compared."""

    def column(name: str, kind: object) -> Column:
        if isinstance(kind, (IntegerType, ShortType, ByteType)):
            return F.col(name).cast("bigint").alias(name)
        if isinstance(kind, (DoubleType, FloatType)):
            return (F.round(name, digits) + F.lit(0.0)).alias(name)
        return F.col(name)

    return df.select(*[column(f.name, f.dataType) for f in df.schema.fields])


def query(name: str, digits: int = 4) -> Callable[[Callable[[Season], DataFrame]], Query]:
    """Register a query on the derived tables under a name."""

    def register(build: Callable[[Season], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(build(Season(configure(spark), folder)), digits)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        return run

    return register


def by_frame(surface: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Number of cells and summary of a surface per frame."""
    return surface.groupBy(*(keys or FRAME)).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(value).alias("total"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


# -- shared tables -------------------------------------------------------------------------


def _clean(s: Season) -> DataFrame:
    return cleaning.clean_tracking(s.tracking, s.plays, s.pbp)


def _stored(s: Season) -> DataFrame:
    """The cleaned frames as a stored stage, for queries that read them more than once."""
    return settle(_clean(s))


def _frames(s: Season, clean: DataFrame | None = None) -> DataFrame:
    """Player-frames with their sides, stored."""
    return settle(controls.framed_sides(_clean(s) if clean is None else clean, s.plays))


def _near(clean: DataFrame) -> DataFrame:
    return cleaning.near_ball(clean).select(
        F.col("gameId").alias("game"),
        F.col("playId").alias("play"),
        F.col("frameId").alias("frame"),
        F.col("nflId").alias("player"),
    )


def _control(s: Season) -> DataFrame:
    return controls.control_surface(controls.without_carrier(_frames(s)))


def _quality(s: Season, only_tacklers: bool = True) -> DataFrame:
    clean = _stored(s)
    followed = tackling.tackle_frames(clean, s.plays, s.tackles, only_tacklers)
    return qualities.quality_summary(
        controls.control_value(_frames(s, clean)),
        qualities.tackler_ellipses(followed),
    )


def _contact(s: Season) -> DataFrame:
    # One narrow row per frame and tackler, read twice: by the rows and by their successors.
    return contacts.contact_set(settle(_quality(s)), s.tackles, s.pbp, CONTACT_REACH)


def _grades(s: Season) -> DataFrame:
    return grading.player_grades(_contact(s), s.players, s.rosters)


# -- cleaning ------------------------------------------------------------------------------


@query("clean_tracking")
def clean_tracking(s: Season) -> DataFrame:
    """Cleaned frames."""
    return _clean(s).select(
        *KEYS, "club", "initial", "play_type", "x", "y", "rad_dir", "vector_x", "vector_y", "x_car",
        "y_car", "distance_to_ball", "radio", "speed_ratio", "scal_x", "scal_y", "mu_x", "mu_y",
    )


@query("carrier_track")
def carrier_track(s: Season) -> DataFrame:
    """Standardised position of the carrier."""
    return cleaning.carrier_location(s.tracking, s.plays)


@query("carrier_profile")
def carrier_profile(s: Season) -> DataFrame:
    """Carrier with situation and build."""
    return cleaning.carrier_profile(s.tracking, s.plays, views.parse_height(s.players)).select(
        "gameId", "playId", "frameId", "x_car", "s_car", "dir_car", "height_car", "weight_car",
        "position_car", "name_car", "quarter", "down", "gameClock",
    )


@query("ball_track")
def ball_track(s: Season) -> DataFrame:
    """Distance of every player to the recorded ball."""
    players = cleaning.players_only(cleaning.standardize(s.tracking))
    location = cleaning.ball_location(s.tracking)
    return cleaning.add_distance(players, location, "x_ball", "y_ball").select(
        *KEYS, "distance_to_ball"
    )


@query("distance_radius")
def distance_radius(s: Season) -> DataFrame:
    """Distance to the carrier and the radius that follows from it, for all frames."""
    players = cleaning.players_only(cleaning.standardize(s.tracking))
    location = cleaning.carrier_location(s.tracking, s.plays)
    return (
        cleaning.add_distance(players, location)
        .withColumn("radio", radius(F.col("distance_to_ball")))
        .select(*KEYS, "distance_to_ball", "radio")
    )


@query("influence_scales_foci")
def influence_scales_foci(s: Season) -> DataFrame:
    """Scales, centre and foci."""
    return add_foci(_clean(s)).select(
        *KEYS, "scal_x", "scal_y", "mu_x", "mu_y", "f1_1", "f1_2", "f2_1", "f2_2"
    )


@query("ellipse_axes")
def ellipse_axes_query(s: Season) -> DataFrame:
    """Axes of the influence ellipse."""
    return ellipse_axes(_clean(s)).select(
        *KEYS, "eigen_v1_1", "eigen_v1_2", "eigen_v2_1", "eigen_v2_2"
    )


@query("raw_velocity")
def raw_velocity_query(s: Season) -> DataFrame:
    """Velocity on the recorded field."""
    return raw_velocity(cleaning.players_only(s.tracking)).select(*KEYS, "v_x", "v_y", "v_theta")


@query("first_initial_trim")
def first_initial_trim(s: Season) -> DataFrame:
    """Frames left from possession on, per player."""
    return (
        cleaning.trim_from_initial(s.tracking)
        .groupBy("gameId", "playId", "nflId")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.min("frameId").alias("first_frame"),
            F.max("frameId").alias("last_frame"),
        )
    )


@query("until_tackle_trim")
def until_tackle_trim(s: Season) -> DataFrame:
    """The first form of the cleaner."""
    return cleaning.clean_tracking_by_ball(s.tracking, s.pbp).select(
        *KEYS, "distance_to_ball", "scal_x", "scal_y", "mu_x", "mu_y"
    )


@query("designed_plays")
def designed_plays(s: Season) -> DataFrame:
    """Passes and planned runs."""
    return cleaning.designed_plays(s.pbp).select(
        "game_id", "play_id", "pass", "rush", "sack", "qb_scramble", "play_type"
    )


@query("broken_plays_anti")
def broken_plays_anti(s: Season) -> DataFrame:
    """Plays that are neither scramble nor fumble."""
    plays = s.plays.select(F.col("gameId").alias("game_id"), F.col("playId").alias("play_id"))
    broken = cleaning.broken_plays(s.pbp).select("game_id", "play_id")
    return plays.join(broken, ["game_id", "play_id"], "left_anti")


@query("near_defenders")
def near_defenders(s: Season) -> DataFrame:
    """Defenders near the carrier."""
    return cleaning.near_defenders(_clean(s), s.pbp)


@query("find_frames")
def find_frames(s: Season) -> DataFrame:
    """Frames of a fast carrier running in one direction."""
    fast = (
        (F.col("distance_to_ball") == 0)
        & (F.col("s") >= 5)
        & F.col("rad_dir").between(2.3, 3.5)
    )
    return cleaning.find_frames(_clean(s), fast).select(*KEYS, "s", "rad_dir")


# -- surfaces ------------------------------------------------------------------------------


@query("influence_by_frame")
def influence_by_frame(s: Season) -> DataFrame:
    """Influence cells summarised per frame."""
    return by_frame(spreading.influence(_clean(s)), "influ")


@query("influence_by_player")
def influence_by_player(s: Season) -> DataFrame:
    """Influence cells summarised per player and play."""
    return by_frame(spreading.influence(_clean(s)), "influ", ["game", "play", "player"])


@query("pitch_control_frame")
def pitch_control_frame(s: Season) -> DataFrame:
    """Pitch control from player-frames, grid completed, per frame."""
    return by_frame(_control(s), "PC")


@query("pitch_control_stored")
def pitch_control_stored(s: Season) -> DataFrame:
    """Pitch control from an influence table, grid completed, per frame."""
    clubs = controls.single_clubs(cleaning.players_only(s.tracking))
    return by_frame(controls.pitch_control(spreading.influence_by_play(_stored(s)), clubs, s.plays), "PC")


@query("pitch_control_home_away")
def pitch_control_home_away(s: Season) -> DataFrame:
    """Control of the home side, carrier left out, grid completed per frame."""
    frames = settle(controls.framed_home_away(_clean(s), s.plays, s.games))
    surface = controls.control_surface(controls.without_carrier(frames), "home", "away")
    return by_frame(surface, "PC")


@query("home_away_ungrouped")
def home_away_ungrouped(s: Season) -> DataFrame:
    """First form of control: carrier included, grid completed once."""
    sides = s.games.select("gameId", "homeTeamAbbr", "visitorTeamAbbr")
    # The sides of the given tables change from game to game, so they come with the frames.
    frames = settle(controls.framed_home_away(_clean(s), s.plays, sides))
    sums = controls.cell_totals(frames, {"net": controls.signed_weight("home", "away")})
    surface = sums.select("game", "play", "x", "y", logistic(F.col("net")).alias("PC"))
    return by_frame(spreading.complete_grid(surface, [], "PC", 0.5), "PC", ["game", "play"])


@query("complete_grid_counts")
def complete_grid_counts(s: Season) -> DataFrame:
    """Cells of each completed frame, on the grid and at a half."""
    return _control(s).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(F.when(F.col("x") <= 100, 1)).alias("on_grid"),
        F.count(F.when(F.col("PC") == 0.5, 1)).alias("even"),
    )


@query("level_bins")
def level_bins(s: Season) -> DataFrame:
    """Cells per contour level of control."""
    return profile.level_bins(_control(s), "PC", [0.2, 0.4, 0.6, 0.8, 1.0])


@query("contour_lines")
def contour_lines(s: Season) -> DataFrame:
    """Iso-lines of control per frame and level: segments, their length and their middle."""
    segments = profile.contour_segments(_control(s), "PC", [0.2, 0.4, 0.6, 0.8])
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return segments.groupBy(*FRAME, "level").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(length).alias("length"), F.avg(F.col("x1") + F.col("x2")).alias("x")
    )


@query("capped_control")
def capped_control(s: Season) -> DataFrame:
    """Added influence near the carrier, per frame."""
    clean = _stored(s)
    return by_frame(controls.capped_control(_frames(s, clean), _near(clean)), "PC")


@query("individual_control")
def individual_control(s: Season) -> DataFrame:
    """Each near defender with the opponents, per frame."""
    clean = _stored(s)
    defenders = cleaning.near_defenders(clean, s.pbp)
    surface = controls.individual_control(_frames(s, clean), _near(clean), defenders)
    return by_frame(surface, "PC", [*FRAME, "defender"])


@query("value_map_frame")
def value_map_frame(s: Season) -> DataFrame:
    """Value cells from player-frames, per frame."""
    return by_frame(controls.value_surface(_frames(s)), "value")


@query("value_map_stored")
def value_map_stored(s: Season) -> DataFrame:
    """Value cells from an influence table, per frame."""
    return by_frame(controls.value_map(spreading.influence_by_play(_stored(s)), s.plays), "value")


@query("pc_training_set")
def pc_training_set(s: Season) -> DataFrame:
    """Strong cells with the carrier's recorded position, per frame."""
    rows = models.pc_training_set(_control(s), s.tracking, s.plays)
    return rows.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("PC").alias("total"),
        F.avg("x_car").alias("x_car"),
        F.avg("y_car").alias("y_car"),
    )


# -- tackles -------------------------------------------------------------------------------


@query("tackle_frames")
def tackle_frames(s: Season) -> DataFrame:
    """Frames of the tacklers."""
    return tackling.tackle_frames(_stored(s), s.plays, s.tackles).select(
        *KEYS, "bc_id", "s_car", "a_car", "o_car", "dir_car", "gameClock", "tackle", "assist",
        "pff_missedTackle", "play_frame_id", "min_dist", "action",
    )


@query("tackle_frames_all")
def tackle_frames_all(s: Season) -> DataFrame:
    """Frames of everybody."""
    return tackling.tackle_frames(_stored(s), s.plays, s.tackles, only_tacklers=False).select(
        *KEYS, "tackle", "min_dist", "action"
    )


@query("tackle_frames_by_event")
def tackle_frames_by_event(s: Season) -> DataFrame:
    """The earlier form, on recorded positions."""
    players = cleaning.players_only(s.tracking)
    return tackling.tackle_frames_by_event(players, s.plays, s.tackles, s.pbp).select(
        *KEYS, "distance_to_carrier", "min_dist", "action"
    )


@query("min_dist_flag")
def min_dist_flag(s: Season) -> DataFrame:
    """Closest approach of every player."""
    return tackling.flag_closest(_stored(s)).select(*KEYS, "min_dist")


@query("cumulative_distance_play")
def cumulative_distance_play(s: Season) -> DataFrame:
    """Distance covered in the play so far."""
    players = cleaning.players_only(s.tracking)
    return tackling.covered_distance_play(players).select(*KEYS, "traveled_play")


@query("cumulative_distance_game")
def cumulative_distance_game(s: Season) -> DataFrame:
    """Distance covered in the game so far."""
    players = cleaning.players_only(s.tracking)
    return tackling.covered_distance_game(players).select(*KEYS, "traveled_game")


# -- quality and contacts ------------------------------------------------------------------


@query("quality_summary")
def quality_summary(s: Season) -> DataFrame:
    """Quality per frame and tackler."""
    return _quality(s)


@query("quality_all_players")
def quality_all_players(s: Season) -> DataFrame:
    """Quality per frame and player."""
    return _quality(s, only_tacklers=False)


@query("quality_stored")
def quality_stored(s: Season) -> DataFrame:
    """Quality from control and value tables."""
    clean = _stored(s)
    frames = _frames(s, clean)
    carried = frames.filter("carries").repartition(fan_out(s.spark), *FRAME)
    cells = qualities.stored_control_value(
        controls.control_surface(controls.without_carrier(frames)), controls.value_surface(carried)
    )
    followed = tackling.tackle_frames(clean, s.plays, s.tackles)
    return qualities.quality_summary(cells, qualities.tackler_ellipses(followed))


@query("quality_by_frame")
def quality_by_frame(s: Season) -> DataFrame:
    """Quality from control and value tables that are stored by frame."""
    root = f"{shared_folder(s.spark)}/cells-{uuid.uuid4().hex}"
    clean = _stored(s)
    frames = _frames(s, clean)
    # A row per field column: every cell is stored, but a frame is sorted and read as some hundred rows.
    stages.write_by_frame(controls.control_columns(controls.without_carrier(frames)), root, "pitch_control")
    carried = frames.repartition(fan_out(s.spark), *FRAME)
    stages.write_by_frame(controls.value_columns(carried), root, "value_map")
    cells = qualities.control_value_by_column(
        stages.read_by_frame(s.spark, root, "pitch_control"), stages.read_by_frame(s.spark, root, "value_map"),
        stages.part_index(s.spark, root, "pitch_control"),
    )
    followed = tackling.tackle_frames(clean, s.plays, s.tackles)
    return qualities.quality_summary(cells, qualities.tackler_ellipses(followed))


@query("quality_strips")
def quality_strips(s: Season) -> DataFrame:
    """Quality with ellipses joined by field columns."""
    clean = _stored(s)
    followed = tackling.tackle_frames(clean, s.plays, s.tackles)
    return qualities.quality_by_strips(
        controls.control_value(_frames(s, clean)), qualities.tackler_ellipses(followed)
    )


@query("frame_tackle_prob")
def frame_tackle_prob(s: Season) -> DataFrame:
    """Control times value in the smaller ellipse."""
    clean = _stored(s)
    followed = tackling.tackle_frames(clean, s.plays, s.tackles)
    return qualities.frame_tackle_prob(
        controls.control_value(_frames(s, clean)), qualities.tackler_ellipses(followed)
    )


@query("frame_before_lead")
def frame_before_lead(s: Season) -> DataFrame:
    """Contact flag of the following frame."""
    return contacts.with_frame_before(_quality(s)).select(
        *FRAME, "tackler", "min_dist", "frame_before"
    )


@query("contact_set")
def contact_set(s: Season) -> DataFrame:
    """Labelled contacts."""
    return _contact(s).select(
        *FRAME, "tackler", "sum_quality", "distance", "min_dist", "frame_before", "tackling"
    )


@query("tackle_probability")
def tackle_probabilities(s: Season) -> DataFrame:
    """Probabilities by the three stored curves."""
    return _quality(s).select(
        *FRAME,
        "tackler",
        *[tackle_probability("sum_quality", name).alias(name) for name in ("base", "cloglog", "new")],
    )


@query("play_probability")
def play_probability(s: Season) -> DataFrame:
    """Best tackler of each frame."""
    return contacts.play_probability(_quality(s)).select(*FRAME, "max_sum", "probability", "label")


# -- grades --------------------------------------------------------------------------------


@query("player_grades")
def player_grades(s: Season) -> DataFrame:
    """Grades of all tacklers."""
    return _grades(s)


BOARD = ["displayName", "position_tackle", "position", "tackle_pct", "technique", "tackles"]


@query("leaderboard_positioning")
def leaderboard_positioning(s: Season) -> DataFrame:
    """Best linebackers by mean probability."""
    return grading.leaderboard(
        _grades(s), "LB", "position_tackle", k=5, min_tackles=3
    ).select(*BOARD)


@query("leaderboard_top")
def leaderboard_top(s: Season) -> DataFrame:
    """Best defensive backs by technique."""
    return grading.leaderboard(_grades(s), "DB", "technique", k=10, min_tackles=3).select(*BOARD)


@query("leaderboard_bottom")
def leaderboard_bottom(s: Season) -> DataFrame:
    """Weakest linemen by technique."""
    return grading.leaderboard(
        _grades(s), "DL", "technique", k=10, ascending=True, min_tackles=3
    ).select(*BOARD)


@query("leaderboard_each_position")
def leaderboard_each_position(s: Season) -> DataFrame:
    """Best two of every position."""
    return grading.leaderboard(_grades(s), by="technique", k=2, min_tackles=3).select(
        "displayName", "position", "place", "tackles"
    )


# -- summaries -----------------------------------------------------------------------------


@query("first_events")
def first_events(s: Season) -> DataFrame:
    """Events that open the cleaned plays."""
    return profile.first_events(_clean(s))


@query("play_length")
def play_length(s: Season) -> DataFrame:
    """Frames per play."""
    return profile.play_length(s.tracking)


@query("mean_by")
def mean_by(s: Season) -> DataFrame:
    """Mean quality of successes and misses."""
    return profile.mean_by(_contact(s), "sum_quality", ["tackling"])


@query("histogram_quality")
def histogram_quality(s: Season) -> DataFrame:
    """Density of quality for successes and misses."""
    return profile.histogram(_contact(s), "sum_quality", 0.7, ["tackling"])


@query("histogram_default_bins")
def histogram_default_bins(s: Season) -> DataFrame:
    """Distance to the carrier in thirty bins."""
    return profile.histogram(_stored(s), "distance_to_ball")


@query("box_stats")
def box_stats(s: Season) -> DataFrame:
    """Box summary of the distance to the carrier by type of play."""
    return profile.box_stats(_stored(s), "distance_to_ball", ["play_type"])


@query("qq_uniform", digits=6)
def qq_uniform(s: Season) -> DataFrame:
    """Speeds against uniform quantiles by type of play."""
    points = profile.qq_uniform(_stored(s), "s", ["play_type"])
    return points.withColumn("speed", F.round("s", 2)).drop("s")


@query("qq_uniform_grid")
def qq_uniform_grid(s: Season) -> DataFrame:
    """Fifty quantiles of speed from stored sketches, after one week was written again.

    An approximate value has no SQL form; the result shows the points, their positions and the rows
    that the merged sketches stand for. Tests compare the values with exact ranks.
    """
    root = f"{shared_folder(s.spark)}/stages-{uuid.uuid4().hex}"
    rows = stages.partition_by_game(cleaning.players_only(s.tracking), "gameId")
    stages.write_stage(profile.quantile_sketches(rows, "s"), root, "speed", rebalance=True)
    slow = rows.filter("week = 1 and s < 5")
    stages.write_stage(profile.quantile_sketches(slow, "s"), root, "speed", rebalance=True, weeks=[1])
    grid = profile.qq_uniform_grid(stages.read_stage(s.spark, root, "speed"), 50)
    return grid.select("i", "uniform", "n")


@query("confusion_matrix")
def confusion_matrix(s: Season) -> DataFrame:
    """The stored curve as a classifier."""
    scored = _contact(s).withColumn("p", tackle_probability("sum_quality"))
    return profile.confusion_matrix(scored.filter(F.col("p").isNotNull()), "p", "tackling")


@query("log_loss")
def log_loss(s: Season) -> DataFrame:
    """Log loss of the stored curve."""
    scored = _contact(s).withColumn("p", tackle_probability("sum_quality"))
    return profile.log_loss(scored, "p", "tackling")


@query("calibration_bins")
def calibration_bins(s: Season) -> DataFrame:
    """Observed and expected rates by quality."""
    return profile.calibration_bins(_contact(s))


# -- plays, teams, measurements ------------------------------------------------------------


@query("field_lines")
def field_lines(s: Season) -> DataFrame:
    """Line of scrimmage and first-down line."""
    return views.field_lines(s.plays, views.play_direction(s.tracking))


@query("team_colors")
def team_colors(s: Season) -> DataFrame:
    """Colours with the visitors' swapped."""
    return views.team_colors(s.games, s.colors, diverge=True)


@query("parse_height")
def parse_height(s: Season) -> DataFrame:
    """Height in yards."""
    return views.parse_height(s.players)


@query("team_sides")
def team_sides(s: Season) -> DataFrame:
    """Offence and defence of every play."""
    return controls.play_sides(s.plays)


@query("week_sides")
def week_sides(s: Season) -> DataFrame:
    """Home and away players of every game."""
    clubs = (
        cleaning.players_only(s.tracking)
        .select("gameId", "nflId", "club")
        .distinct()
    )
    return controls.game_sides(clubs, s.games.drop("week"))


@query("signal_export")
def signal_export(s: Season) -> DataFrame:
    """Measurements of one operator inside the band."""
    return signal.selected_signal(s.signal, "view").drop("result_date")


@query("signal_by_operator")
def signal_by_operator(s: Season) -> DataFrame:
    """Measurements of all operators inside the band, summarised."""
    return (
        signal.selected_signal(s.signal)
        .groupBy("network_operator_name")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("rsrp").alias("mean_rsrp"))
    )


@query("game_buckets")
def game_buckets(s: Season) -> DataFrame:
    """Ranges of games per week."""
    return stages.game_buckets(s.games.select("week", F.col("gameId").alias("game")))


# -- files ---------------------------------------------------------------------------------


def _by_week(df: DataFrame) -> DataFrame:
    return df.groupBy("week").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("gameId").alias("games"), F.sum("x").alias("x")
    )


@query("tracking_files")
def tracking_files(s: Season) -> DataFrame:
    """Tracking rows written as weekly CSV files, with the columns of odd weeks in another order,
    and read back by their headers."""
    folder = f"{shared_folder(s.spark)}/tracking-{uuid.uuid4().hex}"
    names = s.tracking.drop("week").columns
    for odd, ordered in ((0, names), (1, names[::-1])):
        tables.write_tracking(s.tracking.filter(F.col("week") % 2 == odd).select(*ordered, "week"), folder)
    return _by_week(tables.read_tracking(s.spark, folder))


def _written(df: DataFrame, name: str, sep: str = ",") -> str:
    """The path of a table written as CSV."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.csv"
    df.write.csv(path, header=True, nullValue="NA", sep=sep)
    return path


@query("season_files")
def season_files(s: Season) -> DataFrame:
    """Plays, tackles, players and games written as CSV and read back: rows and a total of each."""
    read = {
        "plays": (tables.read_plays(s.spark, _written(s.plays, "plays")), F.col("yardsToGo")),
        "tackles": (tables.read_tackles(s.spark, _written(s.tackles, "tackles")), F.col("tackle") + F.col("assist")),
        "players": (tables.read_players(s.spark, _written(s.players, "players")), F.col("weight")),
        "games": (tables.read_games(s.spark, _written(s.games, "games")), F.col("week")),
    }
    rows = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        for name, (df, value) in read.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("pbp_file")
def pbp_file(s: Season) -> DataFrame:
    """Play-by-play records written and read back, per type of play."""
    return tables.read_pbp(s.spark, _written(s.pbp, "pbp")).groupBy("play_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sack").alias("sacks"), F.count_distinct("old_game_id").alias("games")
    )


@query("roster_file")
def roster_file(s: Season) -> DataFrame:
    """Rosters written and read back."""
    return tables.read_rosters(s.spark, _written(s.rosters, "rosters"))


@query("color_file")
def color_file(s: Season) -> DataFrame:
    """Team colours written and read back, separated by tabs."""
    return tables.read_team_colors(s.spark, _written(s.colors, "colors", "\t"))


@query("play_columns")
def play_columns(s: Season) -> DataFrame:
    """A contiguous range of the columns of the plays, without one of them."""
    return cleaning.select_range(s.plays, "gameId", "yardsToGo").drop("down")


@query("zeroed_players")
def zeroed_players(s: Season) -> DataFrame:
    """Missing numbers as zero: the ball's player and week sums."""
    numbers = zero_nulls(s.tracking.select("week", "nflId", "x"))
    return numbers.groupBy("week").agg(F.sum("nflId").alias("ids"), F.count_if(F.col("nflId") == 0).alias("balls"))


@query("stage_files")
def stage_files(s: Season) -> DataFrame:
    """Tracking rows as a stage by week and range of games, written twice and read back."""
    folder = f"{shared_folder(s.spark)}/stages-{uuid.uuid4().hex}"
    rows = stages.partition_by_game(s.tracking, "gameId")
    for _ in range(2):
        stages.write_stage(rows, folder, "tracking", rebalance=True, weeks=None)
    return stages.read_stage(s.spark, folder, "tracking").groupBy("week", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("gameId").alias("games"), F.sum("x").alias("x")
    )


@query("play_lookup")
def play_lookup(s: Season) -> DataFrame:
    """Cleaned frames of the plays that end in a touchdown, looked up in a stored stage."""
    root = f"{shared_folder(s.spark)}/stages-{uuid.uuid4().hex}"
    rows = stages.partition_by_game(_clean(s), "gameId")
    stages.write_stage(rows, root, "clean", rebalance=True)
    wanted = s.tracking.filter("event = 'touchdown'").select("gameId", "playId").distinct()
    return stages.stage_lookup(s.spark, root, "clean", wanted).groupBy("gameId", "playId").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("frameId").alias("frames"), F.sum("x").alias("x")
    )


@query("replaced_week")
def replaced_week(s: Season) -> DataFrame:
    """A stage whose first week is written again without its fast rows, read from both snapshots."""
    root = f"{shared_folder(s.spark)}/stages-{uuid.uuid4().hex}"
    rows = stages.partition_by_game(s.tracking, "gameId")
    stages.write_stage(rows, root, "tracking", rebalance=True)
    stages.write_stage(rows.filter("week = 1 and s < 5"), root, "tracking", rebalance=True, weeks=[1])
    both = [
        stages.read_stage(s.spark, root, "tracking", snapshot=k).groupBy("week").agg(
            F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")
        ).withColumn("snapshot", F.lit(k))
        for k in (1, 2)
    ]
    return both[0].unionByName(both[1])


@query("signal_files")
def signal_files(s: Season) -> DataFrame:
    """The export of one operator's measurements, read back."""
    folder = f"{shared_folder(s.spark)}/signal-{uuid.uuid4().hex}"
    signal.export_signal(s.signal, "view", folder)
    return signal.read_signal(s.spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rsrp").alias("rsrp"), F.sum("client_latitude").alias("latitude")
    )


# -- models --------------------------------------------------------------------------------


@query("stratified_split")
def stratified_split(s: Season) -> DataFrame:
    """Sizes of the exact split per label."""
    split = models.stratified_split(_contact(s), "tackling", 0.75, [*FRAME, "tackler"])
    return split.groupBy("tackling").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("n_train")
    )


@query("pc_split_groups")
def pc_split_groups(s: Season) -> DataFrame:
    """The split of the control training set over five exact quantile bounds."""
    rows = models.settled_for_split(models.pc_training_set(_control(s), s.tracking, s.plays))
    split = models.pc_split(rows, groups=5)
    return split.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum("PC").alias("total"), F.sum(F.col("x") * F.col("y")).alias("places")
    )


@query("glm_logit", digits=3)
def glm_logit(s: Season) -> DataFrame:
    """Logit fit on all contacts."""
    return models.coefficients(_contact(s), "logit")


@query("glm_saved", digits=3)
def glm_saved(s: Season) -> DataFrame:
    """The logit fit, saved and loaded."""
    folder = f"{shared_folder(s.spark)}/model-{uuid.uuid4().hex}"
    models.save_model(models.fit_tackle_model(_contact(s), "logit"), folder)
    return models.curve_of(s.spark, models.load_model(folder), "logit")


@query("glm_probit", digits=3)
def glm_probit(s: Season) -> DataFrame:
    """Probit fit on all contacts."""
    return models.coefficients(_contact(s), "probit")


@query("glm_cloglog", digits=3)
def glm_cloglog(s: Season) -> DataFrame:
    """Complementary log-log fit on all contacts."""
    return models.coefficients(_contact(s), "cloglog")


@query("model_evaluation", digits=3)
def model_evaluation(s: Season) -> DataFrame:
    """Every link fitted on the training part and judged on the rest: by its own curve, and with
    the link value through the logistic."""
    split = settle(
        models.stratified_split(_contact(s), "tackling", 0.75, [*FRAME, "tackler"])
    )
    train, held = split.filter("is_train"), split.filter("not is_train")
    rows = []
    for link in models.LINKS:
        model = models.fit_tackle_model(train, link)
        for logistic_link in (False, True):
            scored = models.score(model, held, logistic_link=logistic_link)
            matrix = profile.confusion_matrix(scored, "prediction", "tackling")
            loss = profile.log_loss(scored, "prediction", "tackling")
            rows.append(
                matrix.select(
                    F.lit(link).alias("link"), F.lit(logistic_link).alias("logistic_link"),
                    "tp", "fp", "fn", "tn", "accuracy", loss.scalar().alias("log_loss"),
                )
            )
    return reduce(DataFrame.unionByName, rows)


@query("pc_regressor")
def pc_regressor(s: Season) -> DataFrame:
    """Boosted trees of control on positions, fitted, saved, loaded and judged on the held-out part.

    The trees have no SQL form, so the result says what SQL can check: the rows of both parts, the
    rows that the loaded model scores, the squared error of always answering the training mean, and
    whether the model's predictions do better. (In absolute error they do not beat the median: most
    cells of the given tables have 0.5.)
    """
    rows = models.settled_for_split(models.pc_training_set(_control(s), s.tracking, s.plays))
    split = settle(models.pc_split(rows, groups=None).select(*models.INPUTS, "PC", "is_train"))
    folder = f"{shared_folder(s.spark)}/model-{uuid.uuid4().hex}"
    models.fit_pc_regressor(split).write().overwrite().save(folder)
    held = split.filter("not is_train")
    scored = models.score_regressor(GBTRegressionModel.load(folder), held)
    mean = split.filter("is_train").agg(F.avg("PC"))
    plain = held.agg(F.avg((F.col("PC") - mean.scalar()) ** 2).alias("plain"))
    judged = scored.agg(
        F.struct(F.count("prediction").alias("n"), F.avg((F.col("PC") - F.col("prediction")) ** 2).alias("mse"))
    ).scalar()
    parts = split.agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_held_out")
    )
    return parts.select(
        "n_train", "n_held_out", judged["n"].alias("n_scored"), plain.scalar().alias("mean_mse"),
        (judged["mse"] < plain.scalar()).alias("better"),
    )
