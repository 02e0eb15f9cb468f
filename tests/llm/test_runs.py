"""Two runs of the pipeline in one driver."""

import corpus_pipeline


def test_a_later_run_leaves_the_first_result(spark, sf):
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() > 0
