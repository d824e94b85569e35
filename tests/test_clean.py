import pytest
from pyspark.sql import functions as F

from tests import field
from yardgrid.operators import clean as c
from yardgrid.operators import contact, grades, play_view, profile, tackles

TRACK = (
    "gameId bigint, playId bigint, nflId bigint, frameId int, club string, playDirection string, "
    "x double, y double, s double, a double, dis double, o double, dir double, event string"
)
PBP = (
    "old_game_id string, play_id bigint, pass int, rush int, sack int, qb_scramble int, "
    "play_type string, fumble int, defteam string"
)
PLAYS = (
    "gameId bigint, playId bigint, ballCarrierId bigint, possessionTeam string, defensiveTeam string, "
    "gameClock string, yardlineNumber int, yardsToGo int"
)


def track(spark, events, players=(1, 2, None), play=1, direction="right"):
    """Frames 1.. with the given events; player ``None`` is the ball."""
    rows = []
    for player in players:
        for frame, event in enumerate(events, start=1):
            club = "football" if player is None else ("AAA" if player == 1 else "BBB")
            base = 0 if player is None else player
            rows.append(
                (1, play, player, frame, club, direction, 20.0 + base + frame, 10.0 + base, 3.0, 0.0,
                 0.3, 0.0, 90.0, event)
            )
    return spark.createDataFrame(rows, TRACK)


def frames_of(df, player=1):
    return sorted(r.frameId for r in df.filter(F.col("nflId") == player).collect())


@pytest.mark.parametrize(
    "events, kept",
    [
        ([None, "handoff", None, "tackle"], [2, 3, 4]),
        ([None, None, "tackle", None], []),
        (["run", None, "lateral", None], [1, 2, 3, 4]),
        ([None, "ball_snap", None, "pass_outcome_caught"], [4]),
    ],
)
def test_trim_from_initial(spark, events, kept):
    assert frames_of(c.trim_from_initial(track(spark, events))) == kept


@pytest.mark.parametrize(
    "events, kept",
    [
        (["handoff", None, "tackle", None, None], [1, 2, 3, 4]),
        (["handoff", None, None, None, "tackle"], [1, 2, 3, 4, 5]),
        (["handoff", None, None], [1, 2, 3]),
    ],
)
def test_trim_until_tackle(spark, events, kept):
    df = track(spark, events)
    assert frames_of(c.trim_until_tackle(df)) == kept
    ball = c.trim_until_tackle(df).filter(F.col("nflId").isNull())
    assert ball.count() == len(kept)


def test_both_bounds_count_on_the_untrimmed_group(spark):
    df = track(spark, ["tackle", None, "handoff", None])
    trimmed = c.trim_until_tackle(c.trim_from_initial(df), df)
    assert frames_of(trimmed) == []


def test_designed_and_broken_plays(spark):
    rows = [
        ("1", 1, 1, 0, 0, 0, "pass", 0, "B"), ("1", 2, 0, 1, 0, 0, "run", 1, "B"),
        ("1", 3, 0, 1, 0, 1, "run", 0, "B"), ("1", 4, 1, 0, 1, 0, "pass", 0, "B"),
        ("1", 5, None, 1, 0, 0, "run", 0, "B"),
    ]
    df = spark.createDataFrame(rows, PBP)
    assert {r.play_id for r in c.designed_plays(df).collect()} == {1, 2, 5}
    assert {r.play_id for r in c.broken_plays(df).collect()} == {2, 3}


def test_clean_tracking(spark):
    df = track(spark, [None, "handoff", None], direction="left")
    plays = spark.createDataFrame([(1, 1, 1, "AAA", "BBB", "10:00", 30, 10)], PLAYS)
    pbp = spark.createDataFrame([("1", 1, 0, 1, 0, 0, "run", 0, "BBB")], PBP)
    rows = c.clean_tracking(df, plays, pbp).orderBy("nflId", "frameId").collect()
    assert [(r.nflId, r.frameId, r.initial) for r in rows] == [
        (1, 2, True), (1, 3, None), (2, 2, True), (2, 3, None)
    ]
    assert rows[0].x == pytest.approx(120 - 23 - 10) and rows[0].y == pytest.approx(160 / 3 - 11)
    assert rows[0].distance_to_ball == 0 and rows[0].radio == 4
    assert rows[2].distance_to_ball == pytest.approx(2**0.5)
    wanted = field.shape(rows[2].x, rows[2].y, 3.0, 90.0, 2**0.5)
    for name, value in wanted.items():
        assert rows[2][name] == pytest.approx(value)
    without = c.clean_tracking(df.filter("nflId = 2"), plays, pbp).first()
    assert without.distance_to_ball is None and without.radio is None


def test_closest_approach_ties_and_gaps(spark):
    rows = [(1, 1, 1, f, d) for f, d in [(1, 3.0), (2, 2.0), (3, 2.0)]]
    rows += [(1, 1, 2, 1, 1.0), (1, 1, 2, 2, None)]
    df = spark.createDataFrame(rows, "gameId bigint, playId bigint, nflId bigint, frameId int, distance_to_ball double")
    got = {(r.nflId, r.frameId): r.min_dist for r in tackles.flag_closest(df).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 1): None, (2, 2): None}


def worked_play(spark, final="tackle"):
    """Carrier 1, a tackler who first misses (2), an assistant (3), and a bystander (4)."""
    rows = []
    for frame in range(1, 6):
        event = {1: "handoff", 4: final}.get(frame)
        for player, d in ((1, 0.0), (2, abs(4 - frame)), (3, abs(3 - frame) + 1.0), (4, 20.0)):
            rows.append(field.clean_row(player, "AAA" if player == 1 else "BBB", 50 + d, 20, 3, 90, d, frame, event=event))
    return field.clean_frame(spark, rows)


def test_tackle_frames(spark):
    plays = spark.createDataFrame([(1, 1, 1, "AAA", "BBB", "10:00", 30, 10)], PLAYS)
    records = spark.createDataFrame(
        [(1, 1, 2, 1, 0, 0), (1, 1, 3, 0, 0, 1)],
        "gameId bigint, playId bigint, nflId bigint, tackle int, assist int, pff_missedTackle int",
    )
    out = tackles.tackle_frames(worked_play(spark), plays, records)
    acted = {(r.nflId, r.frameId): r.action for r in out.collect() if r.action is not None}
    assert acted == {(2, 4): 1, (3, 3): 0}
    assert {r.nflId for r in out.collect()} == {2, 3}
    everybody = tackles.tackle_frames(worked_play(spark), plays, records, only_tacklers=False)
    assert {r.nflId for r in everybody.collect()} == {1, 2, 3, 4}
    assert tackles.tackle_frames(worked_play(spark, "out_of_bounds"), plays, records).count() == 0
    assert out.filter("s_car = 3.0 and bc_id = 1 and gameClock = '10:00'").count() == out.count()


def test_contacts_and_labels(spark):
    quality = spark.createDataFrame(
        [(1, 1, 3, 2, 5.0, 0, 4.0), (1, 1, 4, 2, 6.0, 1, 1.5), (1, 1, 7, 2, 7.0, 1, 1.5), (1, 2, 4, 2, 6.0, 1, 1.0),
         (1, 1, 5, 3, 4.0, 1, 1.0)],
        "game bigint, play bigint, frame int, tackler bigint, sum_quality double, min_dist int, distance double",
    )
    records = spark.createDataFrame(
        [(1, 1, 2, 1, 0, 0), (1, 2, 2, 1, 0, 0), (1, 1, 3, 1, 1, 1)],
        "gameId bigint, playId bigint, nflId bigint, tackle int, assist int, pff_missedTackle int",
    )
    pbp = spark.createDataFrame([("1", 2, 0, 1, 0, 1, "run", 0, "BBB")], PBP)
    out = sorted((r.frame, r.tackling, r.frame_before) for r in contact.contact_set(quality, records, pbp).collect())
    assert out == [(4, 1, 1), (7, 1, None)]
    best = {r.frame: (r.max_sum, r.label) for r in contact.play_probability(quality.filter("play = 1")).collect()}
    p = round(field.logistic(-1.118 + 0.2277 * 6), 3)
    assert best[4] == (6.0, f"Tackle Probability: {round(p * 100, 1):g}%")


def test_grades_and_boards(spark):
    rows = [(t, 6.0 + t, t % 2) for t in range(1, 7) for _ in range(12 if t < 6 else 3)]
    contacts = spark.createDataFrame(rows, "tackler bigint, sum_quality double, tackling int")
    players = spark.createDataFrame([(t, f"P{7 - t}") for t in range(1, 7)], "nflId bigint, displayName string")
    rosters = spark.createDataFrame(
        [(str(t), "LB" if t < 4 else "DB", "AAA", None) for t in range(1, 7)],
        "gsis_it_id string, position string, team string, headshot_url string",
    )
    graded = grades.player_grades(contacts, players, rosters)
    one = graded.filter("tackler = 1").first()
    assert one.position_tackle == pytest.approx(field.logistic(-1.2134 + 0.2324 * 7)) and one.tackles == 12
    assert one.technique == pytest.approx(1 - one.position_tackle)
    board = grades.leaderboard(graded, "LB", "position_tackle", k=2).collect()
    assert [r.tackler for r in board] == [3, 2]
    assert board[0].tackle_pct == 100.0
    assert grades.leaderboard(graded, "DB").count() == 2
    every = grades.leaderboard(graded, k=1, min_tackles=1).collect()
    assert {r.position for r in every} == {"LB", "DB"} and len(every) == 2


def test_events_lengths_lines_colours(spark):
    df = track(spark, ["ball_snap", None, "handoff", "tackle"])
    assert [r["first"] for r in profile.first_events(c.players_only(df)).collect()] == ["handoff"]
    assert profile.play_length(df).first().frames == 4
    plays = spark.createDataFrame([(1, 1, 1, "AAA", "BBB", "10:00", 30, 10), (1, 2, 1, "AAA", "BBB", "9:00", 40, 5)], PLAYS)
    way = spark.createDataFrame([(1, 1, "left"), (1, 2, "right")], "gameId bigint, playId bigint, playDirection string")
    lines = {r.playId: (r.line_of_scrimmage, r.to_go_line) for r in play_view.field_lines(plays, way).collect()}
    assert lines == {1: (40, 30), 2: (70, 75)}
    games = spark.createDataFrame([(1, "A", "B")], "gameId bigint, homeTeamAbbr string, visitorTeamAbbr string")
    colors = spark.createDataFrame([("A", "1", "2", "red"), ("B", "3", "4", "red")],
                                   "teams string, color1 string, color2 string, color1_family string")
    plain, swapped = (play_view.team_colors(games, colors, d).first() for d in (False, True))
    assert (plain.away_1, plain.away_2) == ("3", "4") and (swapped.away_1, swapped.away_2) == ("4", "3")


def test_small_helpers(spark):
    df = track(spark, [None, "run"])
    assert c.frame_slice(df, "1", 1, 2, ("gameId", "playId", "frameId")).count() == 3
    assert c.select_range(df, "nflId", "club").columns == ["nflId", "frameId", "club"]
    assert c.at_least(df, "x", 24.0).filter("x < 24").count() == 0
