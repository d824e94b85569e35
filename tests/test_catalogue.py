import pytest

import __spark_entry__ as entry
from tests.comparison import connect, difference
from yardgrid.plans.catalogue import QUERIES
from yardgrid.plans.oracles import oracle_sql

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "clean_tracking", "carrier_profile", "ball_track", "distance_radius", "until_tackle_trim",
    "first_initial_trim", "pitch_control_frame", "pitch_control_home_away", "capped_control",
    "individual_control", "tackle_frames", "tackle_frames_by_event", "cumulative_distance_game",
    "quality_summary", "play_probability", "box_stats", "qq_uniform", "histogram_default_bins",
    "game_buckets", "signal_export", "team_colors", "contact_set", "stratified_split", "tracking_files",
    "stage_files", "signal_files", "season_files", "pbp_file", "roster_file", "color_file", "play_columns", "zeroed_players",
    "quality_by_frame", "quality_strips", "replaced_week", "contour_lines", "qq_uniform_grid", "pc_split_groups",
]


@pytest.fixture(scope="module")
def sql():
    return connect(SMALL)


def test_every_statement_has_a_query(spark):
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    ours = entry.queries()[name](spark, SMALL).toPandas()
    assert difference(ours, sql.sql(entry.oracle_sql()[name]).df()) is None
    assert len(ours) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
