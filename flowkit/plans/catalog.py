"""Every query of the library, without the llm subpackage."""

from flowkit.plans import audit_queries, drawn_queries, evaluation_queries, file_queries, flow_queries, series_queries  # noqa: F401
from flowkit.plans.registry import ORACLE, QUERIES, rounded

for name, columns in {
    "c11_log1p_features": ("x",), "e14_sum_per_sample": ("total", "mean"), "e24_classification_report": ("precision", "recall", "f1"), "e26_forecast_errors": ("mae", "mse", "rmse", "mape", "mspe"), "e27_rse_corr": ("rse", "corr"),
    "e28_masked_errors": ("mae", "mse", "rmse", "mape", "mspe"), "e29_m4_scores": ("smape", "mape", "mase"), "e30_m4_owa_summary": ("smape", "mase", "owa"), "e31_masked_losses": ("mape", "smape", "mase"), "e35_seed_statistics": ("mean", "std"),
    "e32_latency_summary": ("mean_ms", "std_ms", "p50_ms", "p95_ms", "p99_ms", "per_item_ms", "items_per_s"), "g6_anomaly_threshold": ("threshold",), "h3_concat_energy": ("threshold",), "j19_anomaly_report": ("threshold", "accuracy", "precision", "recall", "f1"),
}.items():
    rounded(name, *columns)

__all__ = ["ORACLE", "QUERIES"]
