"""Closed-form map from payload motion to vehicle state, as staged JVM columns.

Each stage names its intermediates, so nothing is recomputed and every stage compiles into codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.vectors import norm
from trajspark.schema import Guards, SystemParams

def tension_margin(a: list[Column], gravity: float = SystemParams.gravity) -> Column:
    return norm([a[0], a[1], a[2] + gravity]) / gravity


def acceleration_cable_dir(a: list[Column], gravity: float = SystemParams.gravity) -> list[Column]:
    """Cable direction from acceleration alone (not the force direction ``flat_map`` reports).

    The length is floored, so free fall gives a zero vector.
    """
    pull = [a[0], a[1], a[2] + gravity]
    size = F.greatest(norm(pull), F.lit(1e-12))
    return [c / size for c in pull]


def acceleration_quad_position(
    p: list[Column], a: list[Column], params: SystemParams = SystemParams()
) -> list[Column]:
    return [
        x + params.cable_length * d
        for x, d in zip(p, acceleration_cable_dir(a, params.gravity))
    ]


def _stages(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    """One projection per stage, so every intermediate is evaluated once."""
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS {name}" for name, e in stage.items()])
    return df


def _axes(name: str, pattern: str) -> dict[str, str]:
    """One expression per axis; ``#`` stands for the axis letter."""
    return {f"_{name}{c}": pattern.replace("#", c) for c in "xyz"}


def _norm(name: str) -> str:
    return f"sqrt(_{name}x * _{name}x + _{name}y * _{name}y + _{name}z * _{name}z)"


def _cross(name: str, a: str, b: str) -> dict[str, str]:
    return {
        f"_{name}{i}": f"_{a}{j} * _{b}{k} - _{a}{k} * _{b}{j}"
        for i, j, k in ("xyz", "yzx", "zxy")
    }


def _blank(exprs: list[str]) -> str:
    nans = ", ".join(["double('NaN')"] * len(exprs))
    return f"IF(valid, array({', '.join(exprs)}), array({nans}))"


def _over(top: str, flag: str, bottom: str) -> str:
    """top / bottom with bottom replaced by one where ``flag`` says it is too small; never NULL."""
    return f"coalesce({top} / IF({flag}, 1D, {bottom}), 0D)"


def _vec(pattern: str) -> str:
    return _blank([pattern.replace("#", c) for c in "xyz"])


OUTPUTS = [
    "z_flat", "p_quad", "v_quad", "a_quad", "R_quad", "cable_dir", "payload_rpy_flat", "p_hat",
    "p_hat_dot", "p_hat_ddot", "tension", "tension_margin", "valid", "guard_free_fall",
    "guard_force", "guard_degenerate_cross", "guard_nonfinite_input",
]


def flat_map(
    df: DataFrame,
    params: SystemParams = SystemParams(),
    guards: Guards = Guards(),
    yaw: str | float = 0.0,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Adds vehicle state, attitude, cable, tension and guard columns to rows with p, v, a, j arrays.

    ``yaw`` is a number or a column name. Rows with a tripped guard get NaN in every derived array but
    keep their tension. ``operators.kinematics.continuous_quaternion`` adds the attitude quaternion.
    """
    src = {"p": "p", "v": "v", "a": "a", "j": "j"} | (names or {})
    g, length = params.gravity, params.cable_length
    mass, lever = params.mass_quad + params.mass_load, params.mass_quad * length
    num = lambda x: f"{float(x)!r}D"
    # Columns that cannot be NULL keep the generated code free of null checks, and small enough to compile.
    raw = {
        f"_{k}{c}": f"coalesce({src[k]}[{i}], double('NaN'))"
        for k in "pvaj"
        for i, c in enumerate("xyz")
    }
    finite = " AND ".join(f"abs({c}) < double('Infinity')" for c in raw)  # NaN sorts above infinity
    angle = num(yaw) if isinstance(yaw, float) else yaw
    rotation = [f"_b{k}{c}" for c in "xyz" for k in (1, 2, 3)]
    staged = _stages(
        df,
        [
            raw | {"_yaws": f"-sin({angle})", "_yawc": f"cos({angle})"},
            {"_bad": f"NOT ({finite})"},
            {"_cx": "IF(_bad, 0D, _ax)", "_cy": "IF(_bad, 0D, _ay)"}
            | {"_cz": f"IF(_bad, {num(g)}, _az + {num(g)})"}
            | _axes("k", "IF(_bad, 0D, _j#)"),
            {
                "_n": _norm("c"),
                "_s": "_cx * _kx + _cy * _ky + _cz * _kz",
                "_q": "_kx * _kx + _ky * _ky + _kz * _kz",
            },
            {"_ff": f"_n < {num(guards.acceleration)}"},
            {"_i": _over("1D", "_ff", "_n")},
            {"_nd": "_s * _i", "_ndd": "_q * _i - _s * _s * (_i * _i * _i)"},
            {"_w1": "_nd * _i * _i", "_w2": "_ndd * _i * _i", "_w3": "_nd * _nd * _i * _i * _i"},
            _axes("h", "-_c# * _i")
            | _axes("hd", "_w1 * _c# - _k# * _i")
            | _axes("hdd", "2D * _w1 * _k# + _w2 * _c# - 2D * _w3 * _c#"),
            _axes("f", f"{num(mass)} * _c# - {num(lever)} * _hdd#"),
            {"_fn": _norm("f")},
            {"_fbad": f"_fn < {num(guards.force)}"},
            _axes("b3", _over("_f#", "_fbad", "_fn")) | {"_ux": "_yaws", "_uy": "_yawc", "_uz": "0D"},
            _cross("x", "u", "b3"),
            {"_xn": _norm("x")},
            {"_xbad": f"_xn < {num(guards.cross)}"},
            _axes("b1", _over("_x#", "_xbad", "_xn")),
            _cross("b2", "b3", "b1")
            | {
                # The last term always holds but cannot be folded: a later filter on the outputs stays
                # above this stage instead of being substituted through every intermediate.
                "valid": "NOT (_bad OR _ff OR _fbad OR _xbad) AND monotonically_increasing_id() >= 0",
                "guard_nonfinite_input": "_bad",
                "guard_free_fall": "_ff AND NOT _bad",
                "guard_force": "_fbad AND NOT _bad AND NOT _ff",
                "guard_degenerate_cross": "_xbad AND NOT _bad AND NOT _ff AND NOT _fbad",
                "tension": f"{num(params.mass_load)} * sqrt(_ax * _ax + _ay * _ay + (_az + {num(g)}) * (_az + {num(g)}))",
            },
            {
                "p_quad": _vec(f"_p# + {num(length)} * _b3#"),
                "v_quad": _vec(f"_v# - {num(length)} * _hd#"),
                "a_quad": _vec(f"_a# - {num(length)} * _hdd#"),
                "R_quad": _blank(rotation),
                "cable_dir": _vec("_b3#"),
                "payload_rpy_flat": _blank(["0D"] * 3),
                "p_hat": _vec("_h#"),
                "p_hat_dot": _vec("_hd#"),
                "p_hat_ddot": _vec("_hdd#"),
                "z_flat": "concat({p}, {v}, {a}, {j})".format(**src),
                "tension_margin": f"tension / {num(params.mass_load * g)}",
            },
        ],
    )
    return staged.select(*df.columns, *OUTPUTS)


def with_quaternion(df: DataFrame, rotation: str, out: str) -> DataFrame:
    """(x, y, z, w) of a row-major rotation from its largest component; NaN where it is not finite.

    The sign is per row.
    """
    m = [f"{rotation}[{i}]" for i in range(9)]
    cells = {f"_m{i}": e for i, e in enumerate(m)}
    finite = " AND ".join(f"abs(_m{i}) < double('Infinity')" for i in range(9))
    staged = _stages(
        df,
        [
            cells,
            {"_tr": "_m0 + _m4 + _m8"},
            {"_top": "greatest(_m0, _m4, _m8, _tr)"},
            {
                "_raw": """CASE WHEN _m0 = _top THEN array(1D - _tr + 2D * _m0, _m3 + _m1, _m6 + _m2, _m7 - _m5)
                    WHEN _m4 = _top THEN array(_m3 + _m1, 1D - _tr + 2D * _m4, _m7 + _m5, _m2 - _m6)
                    WHEN _m8 = _top THEN array(_m6 + _m2, _m7 + _m5, 1D - _tr + 2D * _m8, _m3 - _m1)
                    ELSE array(_m7 - _m5, _m2 - _m6, _m3 - _m1, 1D + _tr) END"""
            },
            {"_rl": "sqrt(_raw[0] * _raw[0] + _raw[1] * _raw[1] + _raw[2] * _raw[2] + _raw[3] * _raw[3])"},
            {
                out: f"IF({finite}, array(_raw[0] / _rl, _raw[1] / _rl, _raw[2] / _rl, _raw[3] / _rl), "
                "array_repeat(double('NaN'), 4))"
            },
        ],
    )
    return staged.select(*df.columns, out)


def rotation_of(q: Column) -> Column:
    """Row-major rotation of an (x, y, z, w) unit quaternion."""
    x, y, z, w = (q[i] for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )
