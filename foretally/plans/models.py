"""The model catalogue: what each key is, and which pipeline axes apply to it."""

# fixed values: key, family, axes a study may vary
CATALOGUE = (
    ("persistence", "statistical", "horizon"),
    ("train_mean", "statistical", "split,washout"),
    ("moving_average", "statistical", "horizon"),
    ("drift", "ml", "split"),
    ("ar", "statistical", "lookback,washout"),
    ("smoothing", "statistical", "split"),
    ("theta", "statistical", "split"),
    ("linear", "ml", "scaler,scope,split,washout,lookback,horizon,alpha,postprocess"),
    ("knn", "ml", "scaler,lookback"),
    ("random_forest", "ml", "lookback"),
    ("boosted_trees", "ml", "lookback"),
    ("elastic_net", "ml", "lookback"),
    ("poly_delay", "reservoir", "scaler,lookback,stride,alpha"),
    ("normed_poly_delay", "reservoir", "scaler,lookback,stride,alpha"),
    ("random_layer", "reservoir", "scaler,lookback,alpha"),
    ("recurrent", "reservoir", "scaler,alpha,washout,windowing"),
    ("angle_delay", "reservoir", "horizon,alpha,encoding"),
    ("chebyshev", "reservoir", "scaler,lookback,alpha"),
)
FAMILY = {key: family for key, family, _ in CATALOGUE}

# fixed values: the preset levels of each study axis
AXIS_LEVELS = {
    "scaler": ("minmax", "standard", "robust", "identity"),
    "scope": ("train", "global"),
    "split": ((0.6, 0.2, 0.2), (0.8, 0.1, 0.1), (0.5, 0.25, 0.25)),
    "washout": (0, 50, 100, 300),
    "lookback": (1, 2, 3, 5, 8, 12),
    "windowing": ("internal", "shared"),
    "horizon": (1, 2, 3, 5, 10),
    "alpha": (1e-8, 1e-6, 1e-4, 1e-2, 1.0),
    "postprocess": ("none", "leaky0.1", "leaky0.3", "poly2", "zscore"),
    "encoding": (0.5, 1.0, 1.5, 2.0, 3.0),
}
