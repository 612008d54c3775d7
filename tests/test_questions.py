from __future__ import annotations

from test_task_sizes import plan_of, rows_of, some_log

from askahead.operators import context, zones
from askahead.plans.labels import label_sampled, label_table


def test_light_questions_are_ordered_and_heavy_ones_visit_zones(events):
    log = some_log(events, 600)
    grid = label_table(log, None, [5, 9], 1)
    asked = grid.select("subject_id", "prediction_time", "query", "duration_days")
    light = label_sampled(asked.join(context.record_end(log), "subject_id"), log, 5)
    assert rows_of(light) == rows_of(grid)
    hits = [rows_of(zones.label_questions(asked, log, 5, light_rows)) for light_rows in (0, 30, 10_000)]
    assert hits[0] == hits[1] == hits[2]
    # No row per zone: each question is shuffled once.
    stored = asked.limit(10_000).localCheckpoint()
    assert "Generate" not in plan_of(zones.label_questions(stored, log, 5))


def test_codes_and_times_that_are_null_answer_nothing(events):
    log = events([(1, 0, "a"), (1, 2, None), (1, None, "a"), (1, 9, "b"), (1, 20, "a")])
    asked = label_table(log, ["a", "b"], [5, 10], 1).select("subject_id", "prediction_time", "query", "duration_days")
    assert rows_of(zones.label_questions(asked, log, 5)) == rows_of(zones.label_questions(asked, log, 5, 0))
