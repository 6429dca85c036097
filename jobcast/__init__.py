"""Resource prediction for batch-job traces, written as Spark DataFrame jobs."""

from jobcast.functions.filters import (
    between_right_inclusive, drop_incomplete, feature_profile, filter_failure, filter_overpred, filter_success,
    filter_underpred, filter_user_over, min_group_size)
from jobcast.functions.labels import format_bounds_label, format_error_label, model_bias_label
from jobcast.functions.scalar import (
    cast_int_columns, ceil_prediction, epoch_relative_submit, exp_prediction, fill_missing, hours_minutes_units,
    inf_to_null, log_target, overestimation_factor, parse_timestamps, run_time, safe_ratio, select_columns,
    signed_abs_error, status_code_map, strip_timezone, time_limit_seconds, to_numeric_coerce, wait_time)
from jobcast.operators.cluster import (
    kmeans_group_jobs, kmeans_wcss, optimal_k, silhouette_curve, silhouette_exact, wcss_curve)
from jobcast.operators.dictionary import encode_with, grow_dictionary
from jobcast.operators.encode import (
    elbow_k, first_seen_id, label_encode, random_sample_n, sequential_job_number, silhouette_k, sort_trace,
    wcss_second_diff)
from jobcast.operators.metrics import (
    apply_bias, average_metrics, bin_counts, boxplot_stats, count_jobs, distinct_values, error_histogram,
    group_mean_predictor, kde_density, mae, mean_impute, median_error_by_range, min_max, minmax_scale,
    overprediction_totals, pooled_success_rate, r2_score, rmse, underpred_amounts, underpred_bias, underpred_ratio,
    wait_by_request_bin, window_metrics)
from jobcast.operators.sampling import (
    balance_weights, balanced_resample, concat_frames, equal_width_bins, split_by_cluster, split_exact, split_hash,
    split_success_failure)
from jobcast.operators.windows import (
    assign_windows_sliding, assign_windows_tumbling, lookup_join, nearest_center, window_table)
from jobcast.plans.evaluate import add_to_report, evaluate_results, kept_report
from jobcast.plans.experiment import experiment_baseline, experiment_grouped
from jobcast.plans.models import StoredModels
from jobcast.plans.preprocess import preprocess_eagle, preprocess_fugaku, preprocess_m100
from jobcast.plans.swf import to_swf
from jobcast.plans.train import (
    predict_global, predict_per_cluster, train_cluster_gbt, train_cluster_rf, train_global_gbt, train_resampled,
    train_variants)
from jobcast.session import drop_stored, local_session
from jobcast.sources.predictions import clean_predictions, scan_predictions, sink_predictions
from jobcast.sources.traces import scan_csv_bz2_trace, scan_parquet_trace
from jobcast.sources.versions import Versions
from jobcast.spec import EAGLE, FUGAKU, M100, TraceSpec
from jobcast.streaming.jobs import run_available, stream_suggest, stream_window_stats

__all__ = [name for name, value in list(globals().items()) if callable(value) or isinstance(value, TraceSpec)]
