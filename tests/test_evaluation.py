import pytest
from conftest import not_broadcast_by_size


@pytest.mark.parametrize("name", ["a1_average_precision", "a2_precision_envelope", "a10_confusion_matrix", "a12_normalized_matrix", "a13_tp_fp", "a19_metrics_summary", "a21_pose_map", "a22_oriented_map"])
def test_no_truths_are_broadcast(spark, name):
    not_broadcast_by_size(spark, name)
