"""Thresholds of the analysis, in one frozen record."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # The default thresholds of the analysis.
    sample_rows: int = 50_000
    sample_seed: int = 42

    duplicate_pct: float = 0.10
    columns_per_row: float = 0.5
    dataset_mb: float = 500.0
    missing_pct: float = 0.20
    high_cardinality_pct: float = 0.90
    skewness: float = 1.0
    column_size_share: float = 0.20
    categorical_limit: int = 20
    id_uniqueness: float = 0.99

    target_class_limit: int = 50

    outlier_method: str = "mz-score"
    outlier_score: float = 3.0
    outlier_pct: float = 0.05
    vif: float = 10.0
    spearman_strong: float = 0.85
    cramers_v_strong: float = 0.5
    correlation_ratio_strong: float = 0.6
    spearman_leak: float = 0.98
    cramers_v_leak: float = 0.95
    correlation_ratio_leak: float = 0.98
    class_ratio: float = 6.0
    p_value: float = 0.05

    impute_with: str = "median"
    pca_components: int = 10
    tsne_perplexity: float = 30.0
    tsne_iterations: int = 1000
    umap_neighbours: int = 15
    umap_min_dist: float = 0.1

    clusters: int = 4
    cluster_restarts: int = 10
    cluster_rounds: int = 300
    bars: int = 10
    bivariate_top: int = -1


DEFAULTS = Settings()
