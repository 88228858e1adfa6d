from trialspark.operators import edits


def test_every_frame_is_clicked(spark):
    from trialspark.plans.fixture import Trials
    from trialspark.plans.registry import SQL, nearest_click

    sf = "/root/testdata/sf0.001"
    rows = Trials(spark, sf).detections.select("trial_id", "frame_index", "found", "cx", "cy").collect()
    want = {}
    for c in rows:
        near = [(((p.cx - c.cx - 2) ** 2 + (p.cy - c.cy + 1) ** 2) ** 0.5, p.frame_index) for p in rows if p.found and p.trial_id == c.trial_id]
        near = [x for x in near if x[0] < 14]
        if near:
            want[c.trial_id, c.frame_index] = (min(near)[1], round(min(near)[0], 6))
    got = {(r.trial_id, r.click): (r.frame_index, r.d) for r in nearest_click(spark, sf).collect()}
    assert got == want and len(got) > 900 and "% 50" not in SQL["nearest_click"]


def test_places_count_once(spark):
    path = spark.range(600).selectExpr("1L AS trial_id", "599 - id AS frame_index", "100.0D AS cx", "CAST(50 + id % 2 * 28 AS DOUBLE) AS cy")
    clicks = spark.range(600).selectExpr("1L AS trial_id", "id AS click", "114.0D - id % 3 AS x", "50.0D AS y")
    got = {(r.click % 3, r.frame_index, r.d) for r in edits.nearest_point(path, clicks).collect()}
    assert got == {(1, 1, 13.0), (2, 1, 12.0)}
