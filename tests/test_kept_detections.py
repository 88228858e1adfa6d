def test_detections_are_made_once(spark):
    from trialspark.plans.fixture import Trials

    t = Trials(spark, "/root/testdata/sf0.001")
    plan = t.tracks._jdf.queryExecution().optimizedPlan().toString()
    assert t.detections.is_cached and "InMemoryRelation" in plan
    assert t.detections.count() == 1000
