"""What moves between machines: plans of queries whose rows once were multiplied first."""

import re

import pytest

from partweave.plans.catalogue import QUERIES


def shuffles(df) -> list[str]:
    """The keys of each shuffle of the plan."""
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())]


@pytest.fixture
def no_small_images(spark):
    """As with large tables: images are not broadcast, the library is."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


INFERENCE = "subpart_matches best_subparts strong_links part_responses infer_layer second_layer_summary sliding_subparts centred_subparts hypothetical_nodes"


@pytest.mark.parametrize("name", INFERENCE.split())
def test_inference_moves_nodes_once_by_image(spark, data, no_small_images, name):
    # The library's own rows may meet elsewhere.
    moved = {k for k in shuffles(QUERIES[name](spark, data)) if set(k.split(", ")) != {"part", "idx", "sub_m", "dx", "dy"}}
    assert moved == {"image_id"}


@pytest.mark.parametrize("name", ["part_sequences", "strongest_subparts"])
def test_peaks_go_to_the_nodes(spark, data, no_small_images, name):
    """No node moves by its type, of which there are seven."""
    assert not {k for k in shuffles(QUERIES[name](spark, data)) if k in ("m", "mc")}


KEYED = "spanning_trees tree_regions mean_shift_clusters suppressed_points hull_areas longest_tree_paths neighbour_cliques filled_polygons"


@pytest.mark.parametrize("name", KEYED.split())
def test_many_keys_take_one_call(spark, data, name):
    """A key of a few dozen rows is no call of its own."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["disc_cells", "pasted_cells", "dense_contexts"])
def test_rows_that_grow_stay_in_their_image(spark, data, no_small_images, name):
    """Cells and contexts are not dealt by themselves."""
    assert {k.split(", ")[0] for k in shuffles(QUERIES[name](spark, data))} <= {"image_id"}


@pytest.mark.parametrize("name", ["cooccurrence", "part_sequences"])
def test_windows_make_no_rows_of_their_own(spark, data, no_small_images, name):
    """What nodes ask for is looked up in their image's task: no row is written for a cell or
    a place asked for, and none is sorted to meet nodes."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_many_small_keys_are_not_gathered(spark, data, no_small_images):
    """A polygon's corners are sorted in place and are no value of their own."""
    df = QUERIES["filled_polygons"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and set(shuffles(df)) == {"image_id"}


@pytest.mark.parametrize("name", ["part_responses", "second_layer_summary", "reestimated_library"])
def test_matches_write_no_row_for_a_tile(spark, data, no_small_images, name):
    """What candidates ask for becomes a row only where it is found."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().upper()
    assert "FLOOR(" not in plan and "MAPINARROW" in plan
