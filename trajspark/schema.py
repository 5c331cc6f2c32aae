"""Column names, struct types and fixed constants shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _numbered(prefix: str, n: int) -> list[str]:
    return [f"{prefix}_{i}" for i in range(n)]


# Fixed column order of one solved-trajectory CSV.
TRAJECTORY_COLUMNS: list[str] = (
    ["time"]
    + _numbered("sol_x", 9)
    + _numbered("sol_u", 3)
    + _numbered("sol_quad_x", 9)
    + _numbered("sol_quad_quat", 4)
    + _numbered("sol_payload_rpy", 3)
    + _numbered("rot_mat", 6)
)

# Vector block -> source columns.
BLOCKS: dict[str, list[str]] = {
    "p": _numbered("sol_x", 9)[0:3],
    "v": _numbered("sol_x", 9)[3:6],
    "a": _numbered("sol_x", 9)[6:9],
    "j": _numbered("sol_u", 3),
    "quad_p": _numbered("sol_quad_x", 9)[0:3],
    "quad_v": _numbered("sol_quad_x", 9)[3:6],
    "quad_a": _numbered("sol_quad_x", 9)[6:9],
    "quad_quat": _numbered("sol_quad_quat", 4),
    "payload_rpy": _numbered("sol_payload_rpy", 3),
    "rot_cols": _numbered("rot_mat", 6),
}

VEC = T.ArrayType(T.DoubleType())

MANIFEST = T.StructType(
    [
        T.StructField("stem", T.StringType()),
        T.StructField("yaml_path", T.StringType()),
        T.StructField("csv_path", T.StringType()),
        T.StructField("subdir", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("env_id", T.StringType()),
        T.StructField("solver_status", T.StringType()),
        T.StructField("status_source", T.StringType()),
        T.StructField("iterations", T.LongType()),
        T.StructField("solve_time_s", T.DoubleType()),
        T.StructField("path_length_m", T.DoubleType()),
        T.StructField("total_time_s", T.DoubleType()),
        T.StructField("n_timesteps", T.LongType()),
        T.StructField("dt_s", T.DoubleType()),
        T.StructField("sample_rate_hz", T.DoubleType()),
        T.StructField("split", T.StringType()),
        T.StructField("forest_type", T.LongType()),
        T.StructField("env_seed", T.LongType()),
        T.StructField("manifest_version", T.IntegerType()),
    ]
)

SOLVE_INFO = T.StructType(
    [
        T.StructField("stem", T.StringType()),
        T.StructField("solver_status", T.StringType()),
        T.StructField("iterations", T.LongType()),
        T.StructField("solve_time_s", T.DoubleType()),
        T.StructField("total_time_s", T.DoubleType()),
        T.StructField("succeeded", T.BooleanType()),
        T.StructField("status_source", T.StringType()),
    ]
)

_ARM = T.StructType(
    [
        T.StructField("r2", T.DoubleType()),
        T.StructField("r2_per_channel", VEC),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("val_r2", T.DoubleType()),
        T.StructField("n_constant_channels", T.IntegerType()),
    ]
)
_DIMS = T.StructType(
    [
        T.StructField("participation_ratio", T.DoubleType()),
        T.StructField("effective_rank", T.DoubleType()),
        T.StructField("n_components_90pct", T.IntegerType()),
        T.StructField("n_components_99pct", T.IntegerType()),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("lambda_sig", T.DoubleType()),
        T.StructField("latent_dim", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("recovery", T.MapType(T.StringType(), T.MapType(T.StringType(), _ARM))),
        T.StructField("dimensionality", T.MapType(T.StringType(), _DIMS)),
        T.StructField("final_val_pred", T.DoubleType()),
        T.StructField("collapsed", T.BooleanType()),
    ]
)

EPOCH_LOG = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField(
            "val",
            T.StructType(
                [
                    T.StructField("loss", T.DoubleType()),
                    T.StructField("loss_pred", T.DoubleType()),
                    T.StructField("loss_sigreg", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("diagnostics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "collapse_alarm",
            T.StructType(
                [
                    T.StructField("triggered", T.BooleanType()),
                    T.StructField("reasons", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("prober_loss", T.DoubleType()),
        T.StructField("residual_abs_mean", T.DoubleType()),
    ]
)

# Physical defaults, guard floors, quality sentinels, sweep thresholds, split names.
GOOD_STATUSES = ["Solve_Succeeded", "Solved_To_Acceptable_Level"]
TIME_SENTINEL = 1000.0
LENGTH_SENTINEL = 999.0
ITERATION_SENTINEL = 99999
MIN_PATH_LENGTH = 1e-2
SPLIT_NAMES = ["train", "val", "test"]
SPLIT_FRACTIONS = [0.8, 0.1, 0.1]
HELDOUT = "heldout"
SLACK_THRESHOLDS = [0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01]
MARGIN_PERCENTILES = [0.0, 0.01, 0.1, 1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 95.0, 100.0]
RIDGE_ALPHAS = [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]


@dataclass(frozen=True)
class SystemParams:
    """Vehicle mass, load mass, cable length and gravity."""

    mass_quad: float = 0.715
    mass_load: float = 0.163
    cable_length: float = 0.567
    gravity: float = 9.81

    def __post_init__(self):
        for name in ("mass_quad", "mass_load", "cable_length", "gravity"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Guards:
    """Norm floors below which the closed-form map is undefined."""

    acceleration: float = 1e-3
    force: float = 1e-9
    cross: float = 1e-9


# Packed probe target -> (width, kind, description), in storage order.
TARGETS: list[tuple[str, int, str, str]] = [
    ("v", 3, "linear_trivial", "payload velocity"),
    ("a", 3, "linear_trivial", "payload acceleration"),
    ("j", 3, "linear_trivial", "payload jerk"),
    ("cable_dir", 3, "nonlinear", "unit cable direction"),
    ("R_quad_cols", 6, "nonlinear", "first two attitude columns"),
    ("p_quad", 3, "nonlinear", "vehicle position relative to the anchor"),
    ("tension_margin", 1, "nonlinear", "normalised cable tension"),
]
