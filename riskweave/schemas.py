"""Table schemas shared by sources, sinks and streams."""

from pyspark.sql import types as T

TEXT = T.StringType()

REQUESTS = T.StructType([
    T.StructField("request_id", TEXT, False),
    T.StructField("platform", TEXT),
    T.StructField("account_id", TEXT),
    T.StructField("requested_at", T.TimestampType()),
])

ASSESSMENTS = T.StructType([
    T.StructField("assessment_id", TEXT, False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("model_id", TEXT, False),
    T.StructField("risk_band", TEXT, False),
    T.StructField("status", TEXT, False),
])

OVERRIDES = T.StructType([
    T.StructField("assessment_id", TEXT, False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("override_label", TEXT, False),
    T.StructField("reason_code", TEXT, False),
])

_METRICS = T.StructType([
    T.StructField("threshold", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])

REGISTRY = T.StructType([
    T.StructField("model_id", TEXT),
    T.StructField("created_at", TEXT),
    T.StructField("random_state", T.LongType()),
    T.StructField("source_files", T.ArrayType(TEXT)),
    T.StructField("feature_names", T.ArrayType(TEXT)),
    T.StructField("transformed_feature_names", T.ArrayType(TEXT)),
    T.StructField("thresholds", T.StructType([
        T.StructField("medium", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("validation_mean_cost", T.DoubleType()),
    ])),
    T.StructField("confidence_margin", T.DoubleType()),
    T.StructField("cleaning", T.StructType([
        T.StructField("invalid_rows_removed", T.LongType()),
        T.StructField("conflicting_account_ids_removed", T.LongType()),
        T.StructField("duplicate_rows_removed", T.LongType()),
        T.StructField("clean_account_count", T.LongType()),
    ])),
    T.StructField("split_counts", T.MapType(TEXT, T.LongType())),
    T.StructField("below_completeness_threshold_removed", T.MapType(TEXT, T.LongType())),
    T.StructField("metrics", T.StructType([
        T.StructField("baseline_test", _METRICS),
        T.StructField("boosted_test", _METRICS),
    ])),
    T.StructField("library_versions", T.MapType(TEXT, TEXT)),
])
