"""Report lists of a scan."""

import pytest

from barlens.plans import scan


def test_lists_stop_at_their_lengths_and_reject_unknown_actions(spark):
    schema = "final_action string, bucket_position int"
    rows = [(a, n) for a in scan.BUCKET_LIMITS for n in range(1, 101)]
    got = scan.bucket_lists(spark.createDataFrame(rows, schema)).groupBy("final_action").count().collect()
    assert {r["final_action"]: r["count"] for r in got} == scan.BUCKET_LIMITS
    for odd in ("hold", None):
        with pytest.raises(Exception, match="unknown action"):
            scan.bucket_lists(spark.createDataFrame([(odd, 1)], schema)).collect()
