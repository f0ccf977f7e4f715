"""Schemas of the files that the pipeline reads and writes."""

from __future__ import annotations

PREDICTIONS_A = "sample_id long, volume_name string, GT_combined_report string, Pred_combined_report string"
PREDICTIONS_B = "AccessionNo string, GroundTruth string, Findings string"
PREDICTIONS_C = "AccNum string, Question string, GT_combined_report string, Pred_combined_report string"
REGION_REPORTS = "Volumename string, Anatomy string, Sentence string"
METRICS = "Condition string, Precision double, Recall double, F1 double"
MANUAL_METRICS = "Label string, Precision double, Recall double, `F1 Score` double, Support long"
SHARD_MEMBERS = "shard string, member string, idx long, content binary"

#: columns (id, reference, prediction) of the known layouts of prediction files
LAYOUTS = [
    ("volume_name", "GT_combined_report", "Pred_combined_report"),
    ("AccessionNo", "GroundTruth", "Findings"),
    ("AccNum", "GT_combined_report", "Pred_combined_report"),
]
