"""Registered queries against their SQL in an in-process DuckDB."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.check import rows_of

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")

# one or more per family; tools/check.py compares them all
NAMES = """pressure_score team_shape marking_label holes_in_block free_opponents raster_blur zone_index asof_possession asof_nearest_tol trailing_mean flicker_fixpoint
merged_runs lerp_fill_strict live_mask ppda_by_state segment_labels settle_duration phase_label turnovers presses chances_traced line_breaks lane_shares zone_entries
rolling_median_grid youden_threshold auc lead_lag quantile_report game_state_bins fe_wls_effect rank_chips publish_merge dedup_first text_clock view_sentences event_snap
chapters debounced_possession scan_tracking_json scan_events_json xml_events io_raster io_only_missing stream_trailing_mean stream_late
attach_challenge files_presses files_turnovers files_board embedded_game_events registry_matches registry_teams press_spells_moving state_study line_break_report""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_stream_queries_do_not_depend_on_segmentation(spark, con, monkeypatch):
    """Force tiny tasks, so every ordered operator runs segmented, and compare with the same SQL."""
    from touchline.operators import timeline
    from touchline.sources import driver_tables as dt

    monkeypatch.setattr(timeline, "MAX_ROWS_PER_TASK", 20)
    monkeypatch.setattr(dt, "_plans", {})
    monkeypatch.setattr(dt, "fitted_axis", lambda s, d: timeline.fit_timeline(dt.stream(s, d), ["match_id"], "clock_us", ["event_id"], max_rows=20))
    assert len(dt.stream_axis(spark, DIR).cuts) > 5
    for name in ("asof_possession", "possession_spells", "live_mask", "presses", "trailing_mean", "chapters"):
        df = entry.queries()[name](spark, DIR)
        rel = con.sql(entry.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall()), name
